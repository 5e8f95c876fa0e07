"""The search queries over texts of several scripts, against a brute-force version."""

import math
import random
from collections import Counter

import pytest

from tidewater import registry
from tidewater.functions import text as X

BM25 = ("the", "and")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["the", "and", "with", "of the", "tion", "tio", "tiö", "er", "erün", "ère", "größe", "niño", "东京大学", "x1", "café", "plain"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))) for _ in range(90)]
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    tokens = {}
    for i, t, *_ in rows:
        name, _, files = t.partition("\n")
        tokens[i] = {"name": [(w, p) for w, p, _, _ in X.tokenize(name)], "files": [(w, p) for w, p, _, _ in X.tokenize(files)]}
    return str(folder), {r[0]: r[1] for r in rows}, tokens


def _scores(tokens):
    found = {i: Counter() for i in tokens}
    for field, boost in (("name", 3.0), ("files", 1.0)):
        mean = sum(len(t[field]) for t in tokens.values()) / len(tokens)
        for term in BM25:
            tf = {i: n for i, t in tokens.items() if (n := sum(w == term for w, _ in t[field]))}
            idf = math.log(1 + (len(tokens) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, n in tf.items():
                found[i][term] += boost * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i][field]) / mean))
    return {i: sum(c.values()) * (1 + 0.15 * math.log10(1 + i % 100)) for i, c in found.items() if len(c) == 2}


def test_all_rows_are_searched(spark, corpus):
    folder, texts, tokens = corpus
    run = lambda name: registry.queries()[name](spark, folder).collect()
    has = lambda term: {i for i, t in tokens.items() if any(w == term for f in t.values() for w, _ in f)}
    ids = lambda name: sorted(r.id for r in run(name))
    the = has("the")
    assert any(not texts[i].isascii() for i in the)
    assert ids("search_terms_and") == sorted(the & has("and"))
    assert ids("search_exclusion") == sorted(the - has("with"))
    pairs = {i for i, t in tokens.items() for f in t.values() if any(("of", p) in f and ("the", p + 1) in f for _, p in f)}
    assert ids("search_phrase") == sorted(pairs)
    terms = {w for t in tokens.values() for f in t.values() for w, _ in f}
    assert ids("search_prefix") == sorted(i for i, t in tokens.items() if any(w.startswith("tio") for f in t.values() for w, _ in f))
    assert sorted(r.term for r in run("search_prefix_terms")) == sorted(w for w in terms if w.startswith("er")) and "erun" in terms
    by_size = sorted(the, key=lambda i: (-len(texts[i]), -i))
    assert sorted((r["rank"], r.id, r.value) for r in run("search_top_size")) == [(k + 1, i, len(texts[i])) for k, i in enumerate(by_size)][20:40]
    assert run("search_page_total")[0].total == len(the)
    scores = _scores(tokens)
    assert {r.id: r.score for r in run("search_bm25_relevance")} == pytest.approx(scores, abs=1e-5)
    top = sorted(scores, key=lambda i: (-scores[i], -i))[:20]
    boosted = {i: scores[i] * (1 + 0.15 * math.log10(1 + i % 40) if i % 2 == 0 else 1) for i in top}
    assert {r.id: r.boosted for r in run("search_rerank_boost")} == pytest.approx(boosted, abs=1e-5)
    df = Counter((f, w) for t in tokens.values() for f, found in t.items() for w in {w for w, _ in found})
    assert {(r.field, r.term): r.df for r in run("index_term_statistics")} == df
