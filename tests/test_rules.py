"""Scalar rules, sketches, parsers and stream rules."""

import datetime as dt
import hashlib
import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.functions import scalars as S
from tidewater.functions import sketches
from tidewater.operators import network
from tidewater.sources import bencode as B
from tidewater.sources import metadata as M
from tidewater.streaming import stateful


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_formats(spark):
    sizes = [0, 1023, 1024, 1536, 1048575, 1048524, 1 << 40, (1 << 63) - 1]
    assert column(spark, sizes, "long", S.human_size) == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "1023.9 KiB", "1.0 TiB", "8.0 EiB"]
    assert column(spark, ["a b*~+é"], "string", S.encode_query) == ["a%20b%2A~%2B%C3%A9"]
    assert column(spark, ["<a href='x'>& "], "string", S.safe_json) == ["\\u003ca href=\\u0027x\\u0027\\u003e\\u0026\\u2028"]


def test_keys(spark):
    import base64

    raw = bytes(range(20))
    given = [raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode().lower(), (raw + raw[:12]).hex(), "xyz", None]
    got = column(spark, given, "string", S.parse_key)
    assert [bytes(k.key) if k else None for k in got] == [raw, raw, raw, raw + raw[:12], None, None] and got[3].kind == "v2"
    link = spark.range(1).select(S.magnet(F.lit(bytearray(raw)), F.lit(bytearray(raw + raw[:12])), F.lit("a b")).alias("m")).first().m
    assert link == f"magnet:?xt=urn:btih:{raw.hex()}&xt=urn:btmh:1220{(raw + raw[:12]).hex()}&dn=a%20b"


def test_schedules(spark):
    assert column(spark, [0, 1, 10, 11, 90], "int", S.backoff_seconds) == [300, 600, 307200, 604800, 604800]
    assert column(spark, [0, 1, 2, 3, 50], "int", lambda c: S.ladder_seconds(c, 300, 1000)) == [0, 300, 600, 1000, 1000]
    assert column(spark, [S.MAX_LONG, 1, None], "long", lambda c: S.saturating_add(c, F.lit(5))) == [S.MAX_LONG, 6, None]
    assert [tuple(e) for e in column(spark, [None, 0, 1, 5], "int", S.effort)] == [(3, 1), (3, 1), (8, 1), (8, 2)]


def test_addresses(spark):
    texts = ["8.8.8.8", "10.1.1.1", "172.32.0.1", "172.16.0.1", "1.2.3", "256.1.1.1", "100.64.0.1", "198.19.0.1", None]
    got = column(spark, texts, "string", lambda c: S.ipv4_global(S.ipv4_number(c)))
    assert got == [True, False, True, False, None, None, False, False, None]
    for text, want in {"8.8.8.8": True, "2001:4860::1": True, "2001:db8::1": False, "fe80::1": False, "::ffff:10.0.0.1": False, "2002:0a00:0001::": False, "64:ff9b::808:808": True, "::1": False}.items():
        assert M.is_global(ipaddress.ip_address(text).packed) == want, text


def test_ids_prove_addresses():
    """Published examples."""
    for ip, rand, prefix in (("124.31.75.21", 1, "5fbfb8"), ("21.75.31.124", 86, "5a3ce8"), ("65.23.51.170", 22, "a5d430"), ("84.124.73.14", 65, "1b0320"), ("43.213.53.83", 90, "e56f68")):
        packed = ipaddress.ip_address(ip).packed
        assert M.id_prefix(packed, rand) << 3 == int(prefix, 16) & 0xFFFFF8
        id_ = (M.id_prefix(packed, rand) << 3).to_bytes(3, "big") + bytes(16) + bytes([rand])
        assert M.id_valid(id_, packed) and not M.id_valid(b"\x00" * 20, packed)


def test_distances(spark):
    ids = [hashlib.sha1(bytes([i])).digest() for i in range(60)]
    target = hashlib.sha1(b"t").digest()
    near = sorted(ids, key=lambda i: int.from_bytes(i, "big") ^ int.from_bytes(target, "big"))[:8]
    nodes = spark.createDataFrame([(i,) for i in ids], "id binary")
    assert [bytes(r.id) for r in network.closest(nodes, target).collect()] == near
    bits = {bytes(r.id): r.n for r in nodes.select("id", S.common_prefix(F.col("id"), F.lit(bytearray(target))).alias("n")).collect()}
    assert all(bits[i] == 160 - (int.from_bytes(i, "big") ^ int.from_bytes(target, "big")).bit_length() for i in ids)


def test_sketch_vector(spark):
    """The published vector: 1256 addresses give 1224.9308."""
    v4 = [ipaddress.ip_address(f"192.0.2.{i}").packed for i in range(256)]
    v6 = [ipaddress.ip_address(f"2001:db8::{i:x}").packed for i in range(1000)]
    one, two = (sketches.build(spark.createDataFrame([("k", a) for a in v], "key string, address binary"), ["key"], "address") for v in (v4, v6))
    both = sketches.union(one.unionByName(two).unionByName(one), ["key"])
    assert abs(sketches.estimate(both, ["key"]).first().estimate - 1224.9308) < 1e-3
    packed = sketches.to_bytes(both, ["key"])
    assert bytes(packed.first().filter).hex().upper().startswith("F6C3F5EAA07FFD91BDE89F777F26FB2B")
    assert sorted(map(repr, sketches.from_bytes(packed, ["key"]).collect())) == sorted(map(repr, both.select("key", "word", "bits").collect()))


def test_bencode():
    value = {b"a": [1, -5, b"x", {}], b"b": {b"c": b""}}
    spans = {}
    assert B.decode(B.encode(value), spans=spans) == value and spans[(b"b",)] == (21, 28)
    for bad in (b"", b"i01e", b"i-0e", b"i9223372036854775808e", b"d1:a1:b1:a1:ce", b"di1e1:ae", b"l", b"3:ab", b"i1ei2e", b"d1:ae", b"x", b"e"):
        with pytest.raises(B.BencodeError):
            B.decode(bad)
    with pytest.raises(B.BencodeError):
        B.decode(b"l" * 70 + b"e" * 70)
    assert B.decode_prefix(b"i1exyz") == (1, 3)


def test_metadata(spark):
    one = B.encode({b"name": b"n", b"piece length": 16384, b"pieces": b"x" * 20, b"files": [{b"length": 5, b"path": [b"b", b".."]}, {b"length": 3, b"path": [b"a", b"c"]}, {b"length": 9, b"path": [b".pad", b"9"]}]})
    two = B.encode({b"name": b"w", b"piece length": 1, b"meta version": 2, b"file tree": {b"d": {b"f": {b"": {b"length": 7}}}}})
    rows = M.parse_items(spark.createDataFrame([(1, one), (2, two), (3, b"junk"), (4, None)], "id int, data binary")).collect()
    got = {r.id: r for r in rows}
    assert [tuple(f) for f in got[1].files] == [("a/c", 3), ("b", 5)] and got[1].total_size == 8 and bytes(got[1].v1) == hashlib.sha1(one).digest() and got[1].v2 is None
    assert [tuple(f) for f in got[2].files] == [("d/f", 7)] and bytes(got[2].v2) == hashlib.sha256(two).digest() and got[3].error and got[4].error


def test_pieces(spark):
    data = bytes(range(256)) * 100
    rows = [("k", len(data), 1, data[16384:], 2), ("k", len(data), 0, data[:16384], 1), ("k", len(data), 0, b"late", 9), ("m", 20000, 0, data[:16384], 1)]
    got = M.assemble(spark.createDataFrame(rows, "key string, total int, piece int, data binary, seq int")).collect()
    assert [(r.key, bytes(r.data)) for r in got] == [("k", data)]


def test_messages(spark):
    id_ = b"i" * 20
    given = [
        B.encode({b"t": b"aa", b"y": b"q", b"q": b"get_peers", b"a": {b"id": id_, b"info_hash": b"h" * 20}}),
        B.encode({b"t": b"aa", b"y": b"r", b"r": {b"id": id_, b"nodes": b"n" * 26, b"samples": b"bad"}}),
        B.encode({b"t": b"aa", b"y": b"q", b"q": b"odd", b"a": {b"id": id_, b"target": b"h" * 20}}),
        B.encode({b"t": b"aa", b"y": b"q", b"q": b"ping", b"a": {}}),
        b"nonsense",
    ]
    rows = M.parse_messages(spark.createDataFrame([(i, d) for i, d in enumerate(given)], "i int, data binary")).orderBy("i").collect()
    assert [(r.kind, r.method) for r in rows] == [("query", "get_peers"), ("response", None), ("query", "find_node"), ("bad_query", None), ("unusable", None)] and rows[1].samples is None
    peers = spark.createDataFrame([(b"\x01\x02\x03\x04\x1a\xe1" * 2,), (b"",), (b"12345",)], "d binary").select(M.compact_peers(F.col("d")).alias("p")).collect()
    assert [[(bytes(x.ip), x.port) for x in r.p] if r.p is not None else None for r in peers] == [[(b"\x01\x02\x03\x04", 6881)] * 2, [], None]


# --- stream rules

EVENTS = "event_id long, key long, source string, network long, peer string, ts timestamp"


def events(spark, n=120):
    t0 = dt.datetime(2024, 1, 1)
    sources = ("announce", "sample", "get_peers", "get_peers")
    return [(i, i * 7 % 5, sources[i % 4], i * 3 % 4, f"p{i % 6}", t0 + dt.timedelta(seconds=i * 37 % 900)) for i in range(n)]


RULES = [stateful.FixedWindowQuota(3, 100), stateful.TokenBucket(0.05, 2), stateful.SlidingLimit(2, 60), stateful.Corroboration(), stateful.Horizon(200), stateful.RecentPeers(3, 120)]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
def test_replay_is_the_rule(spark, rule):
    given = events(spark)
    names = stateful._names(rule)
    got = {r.event_id: tuple(r[n] for n in names) for r in stateful.replay(spark.createDataFrame(given, EVENTS), ["key"], "ts", ["event_id"], rule).collect()}
    from types import SimpleNamespace

    for k in range(5):
        state = rule.start()
        for row in sorted((e for e in given if e[1] == k), key=lambda e: (e[5], e[0])):
            at = row[5].replace(tzinfo=dt.timezone.utc).timestamp()
            out, state = rule.event(state, at, SimpleNamespace(**dict(zip(("event_id", "key", "source", "network", "peer", "ts"), row))))
            assert got[row[0]] == out


def test_stream_equals_replay(spark, tmp_path):
    rule = stateful.FixedWindowQuota(3, 100)
    df = spark.createDataFrame(events(spark), EVENTS).orderBy("ts", "event_id")
    folder = str(tmp_path / "in")
    rows = df.collect()
    for i in range(3):  # files in order of time
        spark.createDataFrame(rows[40 * i : 40 * i + 40], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = stateful.stream(source, ["key"], "ts", ["event_id"], rule)
    query = out.writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.event_id, r.allowed) for r in spark.table("quota").collect()}
    assert got == {(r.event_id, r.allowed) for r in stateful.replay(df, ["key"], "ts", ["event_id"], rule).collect()}


def test_admission_batches_are_applied_once(spark):
    from tests.test_maintain import ITEMS, PURGED, QUEUE, REMOVED, key
    from tidewater.sources.versions import Root
    from tidewater.streaming import admission

    root = Root(spark, shared.new_path(spark, "admission"))
    n = root.create_next()
    now = dt.datetime(2024, 1, 1)
    removed = spark.createDataFrame([(key(2), now, 1, 0)], REMOVED)
    root.write(n, {"items": spark.createDataFrame([], ITEMS), "queue": spark.createDataFrame([], QUEUE), "removed": removed, "purged": spark.createDataFrame([], PURGED)}, 0)
    root.promote(n, None)
    given = [(1, key(1), "announce", 1, "p", now), (2, key(2), "sample", 1, "p", now), (3, key(3), "get_peers", 1, "p", now), (4, key(1), "sample", 2, "p", now)]
    batch = spark.createDataFrame(given, admission.SCHEMA)
    for _ in range(2):
        admission.apply(root, batch, 1)
    tables = root.read()
    assert {r.key[0]: r.seen_count for r in tables["queue"].collect()} == {1: 2, 3: 1} and tables["removed"].first().sightings == 1 and root.manifest(root.current())["checkpoint"] == 1


def test_lookup_finds_the_nearest(spark):
    ids = [hashlib.sha1(bytes([i])).digest() for i in range(64)]
    number = lambda i: int.from_bytes(i, "big")
    target = hashlib.sha1(b"goal").digest()
    edges = [(a, b) for a in ids for b in sorted(ids, key=lambda x: number(x) ^ number(a))[1:13]] + [(a, ids[(i * 5 + 1) % 64]) for i, a in enumerate(ids)]
    found = network.iterative_lookup(spark.createDataFrame(edges, "id binary, neighbour binary"), spark.createDataFrame([(ids[0],)], "id binary"), target).collect()
    assert {bytes(r.id) for r in found} >= set(sorted(ids, key=lambda i: number(i) ^ number(target))[:3])


def test_votes(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [(v, "a" if v < 7 else "b", now) for v in range(9)] + [(0, "b", now - dt.timedelta(1))]
    votes = spark.createDataFrame(rows, "voter long, value string, at timestamp")
    assert network.majority(votes, 3, 100, F.lit(now)).collect()[0].asDict() == {"value": "a", "votes": 7, "total": 9}
    assert network.majority(votes.where("voter > 3"), 3, 100, F.lit(now)).count() == 0 and math.isclose(S.POPULARITY, 0.15)
