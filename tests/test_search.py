"""Small corpora and the exact ids that queries find."""

import pytest

from tidewater.operators import search

DOCS = "id long, name string, files string, size long, created long, seen long, file_count long"


def index(spark, rows):
    full = [(i, name, files, *(extra or (1, 1, 0)), 1) for i, name, files, extra in rows]
    built = search.build(spark.createDataFrame(full, DOCS))
    return search.Index(built.docs.cache(), built.postings.cache(), built.terms.cache(), built.fields.cache())


def ids(ix, query, sort="relevance"):
    return [r.id for r in search.page(search.ranked(ix, query, sort)).orderBy("rank").collect()]


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(1, "linux iso", "", None), (2, "linux source", "", None), (3, "linux", "docs/iso/readme.txt", None)], {"linux ": {1, 2, 3}, "linux -iso": {2}, 'linux -"linux iso"': {2, 3}}),
        ([(1, "big red dog", "", None), (2, "red big dog", "", None), (3, "a b a b c", "", None)], {'"big red"': {1}, "big red ": {1, 2}, "big-red ": {1}, '"a b c"': {3}, '"a b a b"': {3}, '"b b"': set()}),
        ([(1, "Ubuntu 22.04 desktop", "", None), (2, "Debian", "", None)], {"ubunt": {1}, "ubunt ": set(), "22.0": {1}, "u": set()}),
        ([(1, "東京大学", "", None), (2, "京都大学", "", None)], {"京大": {1}, "大学": {1, 2}, "東大": set(), "学": {1, 2}}),
    ],
)
def test_matches(spark, rows, wanted):
    ix = index(spark, rows)
    for query, want in wanted.items():
        assert set(ids(ix, query)) == want, query


def test_order(spark):
    assert ids(index(spark, [(1, "Collection", "x/moonlight.flac", None), (2, "Moonlight sonata", "", None)]), "moonlight ") == [2, 1]
    same = [(i, "same name", "", (1, 1, s)) for i, s in ((1, 5), (2, 500), (3, 0))]
    assert ids(index(spark, same), "same ") == [2, 1, 3]
    ix = index(spark, [(1, "t", "", (300, -5, 10)), (2, "t", "", (100, 50, 30)), (3, "t", "", (200, 10, 20)), (4, "t", "", (200, 10, 20))])
    assert ids(ix, "t ", "size") == [1, 4, 3, 2] and ids(ix, "t ", "newest") == [2, 4, 3, 1] and ids(ix, "t ", "seen") == [2, 4, 3, 1]


def test_pages_and_expansions(spark):
    ix = index(spark, [(i, f"page pre{i:04d}", "", (i, 1, 0)) for i in range(1, 251)])
    hits = search.ranked(ix, "page ", "size")
    assert [r.id for r in search.page(hits, 13, 20).orderBy("rank").collect()] == list(range(10, 0, -1))
    assert search.total(hits).first().total == 250 and search.total(search.ranked(ix, "pre")).first().total == 200
    assert search.expansions(ix, "") == []


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(1, 10, 1.0, None), (2, 11, 1.0, 0), (3, 12, 0.9, 1000), (4, 13, 0.1, None)], "rank long, id long, score double, estimate int")
    assert [r.id for r in search.rerank(rows, "relevance").collect()] == [12, 10, 11, 13]
    assert [r.id for r in search.rerank(rows, "seeders").collect()] == [12, 11, 10, 13]
