"""Documents over 64 KiB are indexed whole: the queries equal their SQL on words that only their ends have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_search import DOCS
from tidewater import registry, shared
from tidewater.functions import text as X
from tidewater.operators import search
from tidewater.plans import tables
from tidewater.sources.versions import Root, fingerprint
from tidewater.streaming import projector


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The rows of a query, of Spark and of its SQL, over short texts and two long ones."""
    folder = tmp_path_factory.mktemp("long")
    filler = "\n" + "plain words and more\n" * 4000
    # 200 expansions of a prefix, and further ones that come before or after them.
    known = [f"{p}b{i:03d}" for p in ("th", "tio") for i in range(200)]
    texts = ["short\n" + " of ".join(known), f"name{filler}of tha tioa lastword", f"näme{filler}of thz tioz lastword", "of thb199\nof thb199 tiob199", "x\nof thb198 lastword", "x\nof tha"]
    assert sum(len(t) > X.INDEX_BYTES for t in texts) == 2
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")

    def rows_of(name):
        got = registry.queries()[name](spark, str(folder))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect())), sorted(want)

    return rows_of


def test_index_term_statistics(run):
    got, want = run("index_term_statistics")
    assert got == want and ("files", "lastword", 3) in got and ("files", "thz", 1) in got


def test_search_phrase_prefix(run):
    """Words at the ends count among the 200 expansions and match."""
    got, want = run("search_phrase_prefix")
    assert got == want and (1,) in got and (2,) not in got


def test_search_prefix(run):
    got, want = run("search_prefix")
    assert got == want == [(0,), (1,)]

def test_limit_of_items(spark):
    """Items are cut where the limit says, as they were."""
    docs = spark.createDataFrame([(1, "name", "a" * 60 + " b" * X.INDEX_BYTES + " last", 1, 1, 0, 1)], DOCS)
    terms = lambda **limit: {r.term for r in search.build(docs, **limit).terms.collect()}
    assert "last" not in terms() and "last" in terms(limit=None)


def test_index_of_other_rules(spark, tmp_path):
    """An index that earlier code left in the shared folder, which cut texts, is not opened."""
    rows = [(0, "x\nof other" + " plain words" * 6000 + " of tha", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    root = Root(spark, f"{shared.shared_dir(spark)}/tidewater/index-{fingerprint(spark, f'{tmp_path}/documents.parquet')}")
    docs = tables.documents(spark, str(tmp_path))
    root.promote(projector.create(root, docs, 0, search.postings_of(docs)), None)
    assert [r.id for r in registry.queries()["search_phrase_prefix"](spark, str(tmp_path)).collect()] == [0]


def test_latin_letters(spark):
    """Each character is taken by the JVM or left to Python as its letter says, and both make the same tokens."""
    assert len(X._ranges("".join(X.LATIN))) < 30
    texts = {i: f"a{chr(i)}b Straße\n{chr(i)}" for i in range(0x250)}
    rows = spark.createDataFrame(list(texts.items()), "i int, text string").select("i", X.is_latin(F.col("text")).alias("latin"), X.latin_tokens(F.col("text")).alias("ts")).collect()
    for r in rows:
        assert r.latin == (r.i < 0x80 or chr(r.i) in X.LATIN)
        if r.latin:
            assert [tuple(t) for t in r.ts] == [t[:2] for t in X.tokenize(texts[r.i])]
