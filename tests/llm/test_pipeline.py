"""The pipeline, and the catalogue's queries against their SQL."""

import duckdb
import pytest

from tests.conftest import SF


def test_stages_keep_columns_and_feed_each_other(spark, clashing):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tidewater import shared

    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = shared.written(stage(spark, docs, SF), name)
        assert docs.columns == clashing.columns and docs.count() > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count()


def test_stages_of_an_empty_table(spark, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tidewater import shared

    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = shared.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op3_quality_ablations", "op4_source_mix", "op5_substring_dedup", "op7_decontaminate", "op10_warc"])
def test_queries_equal_their_sql(spark, name):
    from tidewater.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(norm(v) for v in row) for row in want.select(*columns).fetchall()), key=repr)
    assert mine == theirs
