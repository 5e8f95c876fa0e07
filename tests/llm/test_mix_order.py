"""The order of the mix: in the token files of the pipeline, and in op 4's own rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import DOCS
from tidewater import shared
from tidewater.llm import curriculum


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 40))), "en", f"s{i % 4}", 1) for i in range(60)]
    return spark.createDataFrame(rows, DOCS)


def test_token_files_keep_the_order_of_the_mix(spark, mix):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    want = [r.doc_id for r in curriculum.schedule(mix).collect()]
    assert want != sorted(want)
    docs, _ = shared.written(stages["mixing"](spark, mix, ""), "mixing")
    found = sorted(stages["token_files"](spark, docs, "").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == want


def test_token_files_of_several_parts_keep_the_order_of_rows(spark, mix):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    # Parts of unlike sizes: a scan takes the largest first.
    docs, _ = shared.written(mix.selectExpr("doc_id", "repeat(text, int(doc_id) + 1) AS text", "lang", "source", "n_chars").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id"), "parts")
    found = sorted(corpus_pipeline.token_files(spark, docs, "").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == list(range(60))


def _order(rows, targets, schedules):
    """(position, doc_id, copy) of every occurrence, the integrals by a fine grid."""
    grid = np.linspace(0, 1, 100_001)
    names = sorted({r.source for r in rows})
    for k, name in enumerate(names):
        mine = [r for r in rows if r.source == name]
        size = {r.doc_id: len(r.text.split()) for r in mine}
        whole = sum(size.values())
        passes = int(targets[name] // whole)
        knots = schedules[k % 3]
        weight = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
        demand = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        offset = 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{r.doc_id}:{r.text}".encode()).hexdigest()):
            more = passes < 3 and offset + size[r.doc_id] / 2 <= targets[name] - passes * whole
            for i in range(passes + more):
                yield float(np.interp((i * whole + offset) / targets[name], demand / demand[-1], grid)), r.doc_id, i
            offset += size[r.doc_id]


@pytest.mark.parametrize("schedules", [curriculum.SCHEDULES, curriculum.SCHEDULES[::-1]])
def test_positions_and_ranks(spark, mix, schedules):
    rows = mix.collect()
    source = {r.doc_id: r.source for r in rows}
    targets = {source[r.doc_id]: r.target for r in curriculum.digest(mix).collect()}
    want = {(d, i): p for p, d, i in _order(rows, targets, schedules)}
    found = sorted(curriculum.order(mix, schedules=schedules).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(len(want)))
    assert {(r.doc_id, r["copy"]): r.position for r in found} == pytest.approx(want, abs=1e-4)
    assert [(r.position, r.doc_id) for r in found] == sorted((r.position, r.doc_id) for r in found)


def test_each_document_has_its_first_occurrence(spark, mix, docs, empty):
    """Also those that are never taken, and repeated rows."""
    first = {r.doc_id: (r.position, r["rank"]) for r in curriculum.order(mix).collect() if r["copy"] == 0}
    taken = Counter(r.doc_id for r in curriculum.schedule(mix).collect())
    found = curriculum.digest(mix).collect()
    assert {r.doc_id: (r.first_position, r.first_rank) for r in found if r.taken} == first
    assert all(r.taken == r.size * taken[r.doc_id] for r in found) and len(found) == mix.count()
    assert Counter(r.doc_id for r in curriculum.digest(docs).collect()) == Counter(r.doc_id for r in docs.collect())
    assert curriculum.order(empty).count() == curriculum.digest(empty).count() == 0


def test_the_query_s_plan_inverts_the_schedule(spark, mix, monkeypatch):
    """The positions are made, not pruned."""
    plans = []
    written = shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    curriculum.digest(mix)
    assert any("SQRT" in p.upper() and "transform(" in p and "RepartitionByExpression" in p for p in plans)
