"""Op 9: the exact join of what the leaders leave, and weights by counts, against all pairs."""

import random
import re
from collections import Counter

import pytest

from tidewater.llm import neardup


def _sets(rng, n):
    """Families of edited sets, sets that contain others, and unrelated ones."""
    found = []
    for family in range(n):
        base = [rng.getrandbits(62) for _ in range(rng.choice([3, 9, 40, 41, 120]))]
        for _ in range(rng.randint(1, 9)):
            one = set(base)
            for x in rng.sample(base, rng.randint(0, max(1, len(base) // 5))):
                one.discard(x)
                if rng.random() < 0.7:
                    one.add(rng.choice([rng.getrandbits(62), 7, 8, 9 + family]))
            one |= {rng.getrandbits(62) for _ in range(rng.choice([0, 0, 1, len(base) // 6]))}
            found.append(one or {1})
    return found


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_prefix_pairs_miss_no_link(spark, similarity):
    rng = random.Random(3)
    sets = _sets(rng, 30)
    names = [bytes([i // 256, i % 256]) for i in range(len(sets))]
    roots = [names[i - i % rng.choice([1, 1, 2])] for i in range(len(sets))]
    table = spark.createDataFrame([(bytearray(a), sorted(s)) for a, s in zip(names, sets)], "node binary, shingles array<long>")
    pool = spark.createDataFrame([(bytearray(a), bytearray(r)) for a, r in zip(names, roots)], "node binary, root binary")
    pairs = neardup.prefix_pairs(pool, table, similarity)
    found = {(bytes(r.u), bytes(r.v)) for r in pairs.collect()}
    want = {(names[i], names[j]) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    assert want and want <= found
    assert len(found) < len(sets) ** 2 / 8
    checked = {(bytes(r.u), bytes(r.v)) for r in neardup._checked(pairs, table, similarity).collect()}
    assert checked == want


def test_edited_copies_that_are_unlike_each_other_make_few_pairs(spark):
    """A family with a text's edits at random places: pairs of the heavily edited ones are never made."""
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(150)]
    sets = []
    for i in range(120):
        cut = rng.sample(range(150), 21 if i % 2 else 30)
        sets.append({rng.getrandbits(62) if k in cut else x for k, x in enumerate(base)})
    table = spark.createDataFrame([(bytearray([i]), sorted(s)) for i, s in enumerate(sets)], "node binary, shingles array<long>")
    assert neardup.prefix_pairs(table.selectExpr("node", "node AS root"), table).count() < 120


@pytest.mark.parametrize("weighting", ["set", "tf"])
def test_classes_by_weighted_sets(spark, weighting):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    texts = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(60)]
        refrain = [f"r{i}", "a", "b", "c", "d", "e"] * rng.choice([0, 3, 12])
        texts += [" ".join(base + refrain), " ".join(base[:1] + ["edit"] + base[2:] + refrain), " ".join(base + refrain * 2), " ".join(base + refrain + [f"x{i}"] * 40)]
    rows = list(enumerate(texts))

    def bag(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))
        return c if weighting == "tf" else Counter(dict.fromkeys(c, 1))

    bags = [bag(t) for t in texts]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == list(enumerate(root))
    assert len(set(root)) < len(root)
