"""The catalogue's changes: observations, completion, tombstones, purges, the index that follows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.functions import scalars as S
from tidewater.operators import catalogue, maintain, search
from tidewater.sources.versions import Root, generation_name, generation_number
from tidewater.streaming import projector

ITEMS = """id long, key binary, v1 binary, v2 binary, name string, total_size long, file_count long, files array<struct<path:string,size:bigint>>, files_truncated boolean,
piece_length long, seen_count long, first_seen_at timestamp, last_seen_at timestamp, change_seq long, deleted_at timestamp, last_scraped_at timestamp, seeders_est int, scrape_failures int"""
QUEUE = "key binary, discovered_at timestamp, seen_count long, attempts int, next_attempt_at timestamp, lease_until timestamp, last_attempt_at timestamp, gave_up boolean, seeders_est int"
REMOVED = "key binary, removed_at timestamp, removals int, sightings long"
PURGED = "item_id long, purged_seq long, purged_at timestamp"
DAY = dt.datetime(2024, 1, 15, 12, 30)
NOW = dt.datetime(2024, 1, 20)


def key(n):
    return bytes([n]) + bytes(18) + b"\xa5"


def wide(n):
    return bytes([n]) + b"\x77" * 31


def item(n, seen=1, deleted=None, v2=None, name=None, seq=None, size=3000):
    return (n, key(n), key(n), v2, name or f"item {n}", size, 1, [(f"a/{n}.txt", size)], False, 16384, seen, DAY, DAY, seq or n, deleted, None, None, 0)


@pytest.fixture
def tables(spark):
    items = spark.createDataFrame([item(1, 7), item(2, 3, v2=wide(9)), item(3, 1, deleted=DAY)], ITEMS)
    queue = spark.createDataFrame([(key(20), DAY, 4, 0, DAY, None, None, False, None)], QUEUE)
    return items, queue, spark.createDataFrame([(key(30), DAY, 1, 0)], REMOVED)


def batch(spark, rows):
    return spark.createDataFrame(rows, "key binary, sightings int, priority boolean")


def test_observe(spark, tables):
    items, queue, _ = tables
    given = [(key(1), 1, False), (key(1), 1, False), (wide(9)[:20], 5, False), (key(3), 2, True), (key(20), 3, False), (key(21), 1, False), (key(22), 0, True)]
    now = F.lit(NOW)
    new, waiting, out = maintain.observe(items, queue, batch(spark, given), now, 100, 0, 10)
    assert out.first().asDict() == {"known": 2, "queued": 2, "dropped": 0}
    seen = {r.id: (r.seen_count, r.change_seq) for r in new.collect()}
    assert seen == {1: (9, 101), 2: (8, 102), 3: (1, 3)}
    assert {bytes(r.key): r.seen_count for r in waiting.collect()} == {key(20): 7, key(21): 1, key(3): 2}
    _, waiting, out = maintain.observe(items, queue, batch(spark, given), now, 100, 15, 10)
    assert out.first().asDict() == {"known": 2, "queued": 1, "dropped": 1}
    _, _, out = maintain.observe(items, queue, batch(spark, given), now, 100, 20, 10)
    assert out.first().asDict() == {"known": 2, "queued": 0, "dropped": 2}


def test_sightings_move_the_sequence_by_powers_of_two(spark):
    steps = [(1, 1, True), (2, 1, False), (3, 1, True), (4, 3, False), (7, 1, True), (8, 100, True), (108, 10, False)]
    rows = spark.createDataFrame(steps, "seen long, added long, moved boolean")
    assert all(r.moved == r.got for r in rows.withColumn("got", S.bucket_changed(F.col("seen"), F.col("seen") + F.col("added"))).collect())


def test_complete(spark, tables):
    items, queue, removed = tables
    content = "key binary, v1 binary, v2 binary, name string, total_size long, file_count long, files array<struct<path:string,size:bigint>>, files_truncated boolean, piece_length long"
    rows = [
        (key(1), key(1), None, "item 1", 3000, 1, [("a/1.txt", 3000)], False, 16384),
        (key(2), key(1), wide(9), "renamed", 5, 0, [], False, None),
        (key(20), key(20), None, "fresh", 1, 1, [("x", 1)], False, 1),
        (key(3), key(3), None, "back", 1, 1, [("x", 1)], False, 1),
    ]
    new, waiting, memory = maintain.complete(items, queue, removed.unionByName(spark.createDataFrame([(key(3), DAY, 2, 5)], REMOVED)), spark.createDataFrame(rows, content), F.lit(NOW), 3, 100)
    got = {r.id: r for r in new.collect()}
    assert got[1].change_seq == 1 and got[1].seen_count == 7 and got[1].last_seen_at == NOW
    assert got[2].name == "renamed" and bytes(got[2].v1) == key(2) and bytes(got[2].key) == key(2) and got[2].change_seq > 100
    assert got[3].deleted_at is None and got[3].name == "back" and got[3].first_seen_at == DAY
    assert got[4].seen_count == 4 and got[4].first_seen_at == DAY and bytes(got[4].key) == key(20)
    assert len({r.change_seq for r in got.values()}) == 4 and waiting.count() == 0 and [bytes(r.key) for r in memory.collect()] == [key(30)]


def test_lease_queue(spark):
    rows = [(key(i), DAY, 1, i % 2, DAY, DAY if i == 3 else NOW + dt.timedelta(1) if i == 4 else None, None, i == 5, i if i % 3 else None) for i in range(1, 8)]
    queue, now = spark.createDataFrame(rows, QUEUE), F.lit(NOW)
    assert [r.key[0] for r in maintain.claim(queue, 10, now).collect()] == [2, 6, 7, 1, 3]
    assert [r.key[0] for r in maintain.claim_live_first(queue, 4, now).collect()] == [2, 7, 1, 6]
    failed = {r.key[0]: r for r in maintain.fail(queue, queue.where("attempts = 1").select("key"), now).collect()}
    assert failed[1].gave_up and failed[1].attempts == 2 and failed[1].next_attempt_at == NOW + dt.timedelta(seconds=600) and failed[5].attempts == 1 and failed[2].attempts == 0
    until = F.lit(NOW + dt.timedelta(hours=1))
    renewed = {r.key[0]: r.lease_until for r in maintain.renew(queue, queue.select("key"), until, now).collect()}
    assert renewed[4] == NOW + dt.timedelta(1) and renewed[3] == DAY and renewed[1] is None


def test_tombstones_are_compare_and_set(spark, tables):
    items, _, removed = tables
    wanted = spark.createDataFrame([(1, DAY, 1), (2, DAY, 99)], "id long, last_seen_at timestamp, change_seq long")
    new, memory = maintain.tombstone(items, removed, wanted, F.lit(NOW), 100)
    got = {r.id: r for r in new.collect()}
    assert got[1].deleted_at == NOW and got[1].name == "" and got[1].files == [] and got[1].change_seq == 101 and got[2].deleted_at is None
    assert {bytes(r.key): r.removals for r in memory.collect()} == {key(30): 1, key(1): 1}


def test_scrapes_leave_the_sequence(spark, tables):
    items, _, _ = tables
    rows = [(1, 0, "dead", 0), (1, 1, "live", 9), (2, 0, "dead", 0), (3, 0, "live", 4)]
    got = {r.id: r for r in maintain.record_scrapes(items, spark.createDataFrame(rows, "id long, pos int, verdict string, est int"), F.lit(NOW)).collect()}
    assert (got[1].seeders_est, got[1].scrape_failures) == (9, 0) and (got[2].seeders_est, got[2].scrape_failures) == (0, 1) and got[3].seeders_est is None
    assert [got[i].change_seq for i in (1, 2, 3)] == [1, 2, 3]


def test_cooldowns(spark):
    rows = spark.createDataFrame([(n,) for n in range(5)], "n int")
    assert [r.s // 86400 for r in rows.select(S.cooldown_seconds(F.col("n"), 7).alias("s")).collect()] == [0, 7, 28, 90, 90]
    assert {r.s for r in rows.select(S.cooldown_seconds(F.col("n"), 0).alias("s")).collect()} == {0}


def test_feed_and_index_follow(spark, tables):
    items, _, _ = tables
    purged = spark.createDataFrame([], PURGED)
    root = Root(spark, shared.new_path(spark, "index"))
    assert projector.follow(root, items, purged) == 3
    found = lambda q: sorted(r.id for r in search.ranked(projector.open_index(root), q).collect())
    assert found("item ") == [1, 2] and projector.follow(root, items, purged) == 3
    more = items.where("id <> 1").unionByName(spark.createDataFrame([item(4, seq=5, name="new item"), item(3, seq=6, name="item back")], ITEMS)).where("NOT (id = 3 AND deleted_at IS NOT NULL)")
    gone = spark.createDataFrame([(1, 7, NOW)], PURGED)
    assert projector.follow(root, more, gone) == 7 and found("item ") == [2, 3, 4]
    step = {t: sorted(map(repr, df.collect())) for t, df in root.read().items()}
    assert projector.rebuild(root, more, gone) == root.current()
    assert {t: sorted(map(repr, df.select(*root.read()[t].columns).collect())) for t, df in root.read().items()}.keys() == step.keys() and found("item ") == [2, 3, 4]
    assert sorted(map(repr, root.read()["docs"].select("id", "name").collect())) == sorted(map(repr, root.read(root.current() - 1)["docs"].select("id", "name").collect()))
    with pytest.raises(projector.FeedError):
        projector.follow(root, items, purged, 1)


def test_feed_pages(spark, tables):
    items, _, _ = tables
    purged = spark.createDataFrame([(77, 4, NOW)], PURGED)
    rows = catalogue.change_feed(items, purged, 0, 10).collect()
    assert [(r.seq, r.id, r.visible) for r in rows] == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 77, False)] and rows[3].name == ""
    assert catalogue.change_feed(items, purged, 0, 10, budget=1).count() == 1 and catalogue.high_water_mark(items, purged) == 4
    assert [p[1] for p in projector.pages(items, purged, 0, 10, limit=3)] == [3, 4]


def test_lookup(spark, tables):
    items, _, _ = tables
    assert catalogue.lookup(items, wide(9)).first().id == 2 and catalogue.lookup(items, key(1)).first().id == 1 and catalogue.lookup(items, key(3)).count() == 0
    ids = spark.createDataFrame([(0, 2), (1, 3), (2, 1), (3, 2), (4, 50)], "pos long, id long")
    assert [r.id for r in catalogue.hydrate(ids, items).collect()] == [2, 1, 2]


def test_generations(spark):
    root = Root(spark, shared.new_path(spark, "gen"))
    assert root.current() is None and generation_number("gen-1") is None and generation_number(generation_name(12)) == 12
    a = root.create_next()
    with pytest.raises(FileNotFoundError):
        root.promote(a, None)
    root.write(a, {"t": spark.range(3)}, 5)
    assert root.promote(a, None) and root.current() == a and not root.promote(a, None)
    b = root.create_next()
    root.write(b, {"t": spark.range(4)}, 6)
    assert root.promote(b, a) and root.read()["t"].count() == 4 and root.cleanup(0, 1 << 60) == [a] and root.generations() == [b]


def test_settings(spark):
    settings = spark.createDataFrame([("a", "1")], "key string, value string")
    audit = spark.createDataFrame([], "at timestamp, actor string, action string, subject string, detail string")
    new, log = maintain.set_setting(settings, audit, "a", "2", "me", F.lit(NOW))
    assert new.first().value == "2" and log.first().detail == '{"old":"1","new":"2"}'
    assert maintain.set_setting(settings, audit, "a", "1", "me", F.lit(NOW))[1].count() == 0
