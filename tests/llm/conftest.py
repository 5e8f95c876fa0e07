import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, junk, nulls, empty and long ones, and a repeated row."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(70)
    texts = [prose(120), prose(200), None, "", " \t\n ", "one two three", prose(49), passage]
    near = texts[1].split(" ")
    near[50] = "changed"
    texts += [texts[0], " ".join(near), prose(30) + " " + passage + " " + prose(40), passage + "\n" + prose(60)]
    texts += ["spam " * 300, "\n".join(["same line here again"] * 12), prose(3000), "a### b*** c%%% d e f g h i j k", "Ünïcode ß 東京 wörter " + prose(20)]
    texts += ["x = 1\r\n\r\npassword = hunter2222 \x00 \x1c end", "trailing space ", "  two  leading", prose(60) + " " + passage[:200]]
    rows = [(i * 3 % 47, t, "en", "s%d" % (i % 4) if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, texts[0], None, "s0", 1), (None, prose(80), None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns, of names that operators use."""
    from pyspark.sql import functions as F

    more = {c: F.lit(1) for c in ("node", "key", "n_words", "fail_bits", "size", "target", "position", "hits", "kept", "dk", "th", "class_id")}
    return docs.withColumns(more)
