"""Batches of fetched items against a plain store that takes them one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_maintain import DAY, ITEMS, NOW, QUEUE, REMOVED
from tidewater.operators import maintain

BATCH = "pos long, key binary, v1 binary, v2 binary, name string, total_size long, file_count long, files array<struct<path:string,size:bigint>>, files_truncated boolean, piece_length long"


class Store:
    """Rows as dicts, searched one after the other."""

    def __init__(self, items, queue, removed, last_id, last_seq):
        self.items, self.queue, self.removed = {r["id"]: r for r in items}, {r["key"]: r for r in queue}, set(removed)
        self.last_id, self.last_seq = last_id, last_seq

    def complete(self, new, now):
        waiting = self.queue.pop(new["key"], None)
        same = lambda r, c: r[c] is not None and r[c] == new[c]
        met = [r for _, r in sorted(self.items.items()) if same(r, "key") or same(r, "v1") or same(r, "v2")]
        for r in [new, *met]:
            self.removed -= {r["key"], r["v1"], r["v2"] and r["v2"][:20]}
        row = next((r for r in met if r["key"] == new["key"]), met[0] if met else None)
        content = {c: new[c] for c in maintain.CONTENT}
        if row is None:
            self.last_id, self.last_seq = self.last_id + 1, self.last_seq + 1
            row = {"id": self.last_id, "key": new["key"], **content, "seen_count": max(waiting["seen_count"], 1) if waiting else 1}
            row |= {"first_seen_at": waiting["discovered_at"] if waiting else now, "last_seen_at": now, "change_seq": self.last_seq, "deleted_at": None}
            self.items[row["id"]] = row
            return row["id"], True
        for h in ("v1", "v2"):
            if new[h] is not None and any(r is not row and r[h] == new[h] for r in met):
                content[h] = row[h]
        if any(row[c] != content[c] for c in content):
            self.last_seq += 1
            row["change_seq"] = self.last_seq
        row |= content
        row |= {"seen_count": row["seen_count"] + (waiting["seen_count"] if waiting else 0), "last_seen_at": now, "deleted_at": None}
        return row["id"], waiting is not None


def short(n):
    return None if n is None else bytes([n]) * 20


def wide(n):
    return None if n is None else bytes([n]) * 32


def _row(pos, key, v1, v2, name):
    return (pos, short(key), short(v1), wide(v2), name, 5, 1, [("a", 5)], False, None)


def _check(spark, stored, batch, queued=(), removed=()):
    """``stored``: (id, key, v1, v2, name, deleted)."""
    items = [(i, short(k), short(a), wide(b), n, 5, 1, [("a", 5)], False, None, 3, DAY, DAY, i, DAY if gone else None, None, None, 0) for i, k, a, b, n, gone in stored]
    queue = [(short(k), DAY + dt.timedelta(k), k, 0, DAY, None, None, False, None) for k in queued]
    names = [c.split(" ")[0] for c in ITEMS.replace("\n", " ").replace("struct<path:string,size:bigint>", "s").split(", ")]
    plain = [dict(zip(names, r)) for r in items]
    model = Store(plain, [{"key": q[0], "seen_count": q[2], "discovered_at": q[1]} for q in queue], [short(n) for n in removed], 1000, 5000)
    fields = [c.split(" ")[0] for c in BATCH.replace("struct<path:string,size:bigint>", "s").split(", ")]
    want = [(r[0], *model.complete(dict(zip(fields, r)), NOW)) for r in sorted(batch)]
    frames = [spark.createDataFrame(items, ITEMS), spark.createDataFrame(queue, QUEUE), spark.createDataFrame([(short(n), DAY, 1, 0) for n in removed], REMOVED)]
    new, waiting, memory, told = maintain.complete_batch(*frames, spark.createDataFrame(batch, BATCH), F.lit(NOW), 1000, 5000)
    assert sorted(map(tuple, told.collect())) == want
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    got = {r.id: r for r in new.collect()}
    assert set(got) == set(model.items) and new.count() == len(got)
    for i, row in model.items.items():
        for c in ("key", "v1", "v2", "name", "seen_count", "first_seen_at", "last_seen_at", "change_seq", "deleted_at"):
            assert plain(got[i][c]) == row[c], (i, c)
    assert {bytes(r.key) for r in waiting.collect()} == set(model.queue) and {bytes(r.key) for r in memory.collect()} == model.removed


def test_two_keys_of_one_item(spark):
    _check(spark, [(1, 1, 1, 9, "one", False), (2, 2, 2, None, "two", True)], [_row(1, 1, 1, 9, "new"), _row(2, 7, 1, 9, "again"), _row(3, 2, 2, None, "two")], queued=(1, 7), removed=(1, 7, 2, 30))


def test_a_chain_and_new_keys_with_a_common_hash(spark):
    _check(spark, [], [_row(1, 1, 11, None, "a"), _row(2, 2, 11, 21, "b"), _row(3, 3, None, 21, "c"), _row(4, 4, None, None, "d"), _row(5, 4, 12, None, "d")], queued=(2, 4))


def test_hashes_of_other_items_are_not_taken(spark):
    _check(spark, [(1, 1, 11, 21, "one", False), (2, 2, 12, 22, "two", False)], [_row(1, 1, 12, 22, "x"), _row(2, 2, None, None, "y"), _row(3, 1, 12, 22, "z")])


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    pick = lambda low, n: rng.choice([None, *range(low, low + n)])
    firsts, seconds, stored = list(range(100, 110)), list(range(200, 210)), []
    for i in range(1, 6):
        stored.append((i, i, firsts.pop() if rng.random() < 0.7 else None, seconds.pop() if rng.random() < 0.5 else None, f"i{i}", rng.random() < 0.3))
    batch = [_row(p, rng.randint(1, 12), pick(100, 10), pick(200, 10), f"n{rng.randint(0, 3)}") for p in range(25)]
    _check(spark, stored, batch, queued=range(1, 13, 2), removed=(1, 3, 100, 105, 205, 77))


def test_batches_that_cannot_be(spark):
    items, queue, removed = spark.createDataFrame([], ITEMS), spark.createDataFrame([], QUEUE), spark.createDataFrame([], REMOVED)
    good, bad = _row(1, 1, 1, None, "a"), (2, short(2), None, None, "", 1, 1, [("x", 1)], False, 1)
    with pytest.raises(ValueError, match="invalid items at"):
        maintain.complete_batch(items, queue, removed, spark.createDataFrame([good, bad], BATCH), F.lit(NOW), 0, 0)
    with pytest.raises(ValueError, match="at most 1 items"):
        maintain.complete_batch(items, queue, removed, spark.createDataFrame([good, _row(2, 2, 2, None, "b")], BATCH), F.lit(NOW), 0, 0, most=1)
    new, _, _, told, wrong = maintain.complete_each(items, queue, removed, spark.createDataFrame([good, bad], BATCH), F.lit(NOW), 0, 0)
    assert new.count() == told.count() == 1 and [r.errors for r in wrong.collect()] == [["name"]]
    assert maintain.complete_batch(items, queue, removed, spark.createDataFrame([], BATCH), F.lit(NOW), 0, 0)[0].count() == 0
