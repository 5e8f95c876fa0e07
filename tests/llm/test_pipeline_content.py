"""The whole pipeline against plain Python: rules, classes, windows, occurrences and ids, stage by stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import DOCS, corpus
from tests.llm.test_mix_order import _order
from tests.llm.test_operators import WORD, _classes, _judged, _measured
from tidewater.llm import curriculum, tokens


def _good(text):
    n, chars, symbols, twice, repeated = _measured(text)
    lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 2 * twice > lines)


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, open_, target = float(sum(sizes.values())), {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(20, 60)) for _ in range(30)]
    item = prose(30)
    texts += [f"{prose(20)} {item} {prose(10)}", f"{prose(900)} {item[:90]}", texts[3] + " end", " ".join(["edit", *texts[5].split()[1:]])]
    rows = [(100 + i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(i if i is not None else 999, t, lang, s or "d", n) for i, t, lang, s, n in corpus()]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, item), (2, "something else"), (3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def test_the_pipeline_does_what_its_operators_say(spark, fixture):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    folder, rows, bench = fixture
    good = [r for r in rows if _good(r[1])]
    assert 0 < len(good) < len(rows)
    classes = _classes([(r[0], r[1]) for r in good])
    heads = {}
    for r, (_, name) in zip(good, classes):
        if r[0] == name:
            heads.setdefault(name, r)
    one = [heads[name] for name in dict.fromkeys(name for _, name in classes)]
    assert len(one) < len(good) - 2
    judged = {(d, n): bad for (d, *_), n, bad in (((d, 0), i, j[-1]) for i, (d, j) in enumerate(zip([r[0] for r in one], _judged([(r[0], r[1]) for r in one], bench))))}
    clean = [r for i, r in enumerate(one) if not judged[r[0], i]]
    assert len(clean) == len(one) - 1
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += len(WORD.findall(r[1]))

    class Row:
        def __init__(self, r):
            self.doc_id, self.text, _, self.source, _ = r

    due = {(d, i): p for p, d, i in _order([Row(r) for r in clean], _targets(sizes), curriculum.SCHEDULES)}
    found = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in due)
    seen, places = Counter(), []
    for r in found:
        places.append(due[r.doc_id, seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert all(a <= b + 2e-4 for a, b in zip(places, places[1:]))
    tokenizer, text, start = Tokenizer.from_file(tokens.default_tokenizer()), {r[0]: r[1] for r in clean}, 0
    for r in found:
        ids = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
