"""Generations of seen keys, pacing, secrets, the gate, promotion, metrics, audit rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.operators import maintain, metrics, nodes, serving
from tidewater.sources.versions import Root
from tidewater.streaming import generations, limits


def test_generations_turn_by_time_and_by_capacity(spark):
    rng = random.Random(1)
    empty = spark.createDataFrame([], "key long")
    seen, current, previous, began = generations.Seen(empty, empty, 0.0), [], [], 0.0
    for step in range(7):
        now = step * 40.0
        keys = [rng.randrange(40) for _ in range(rng.choice([2, 5, 14]))]
        batch = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, n long")
        if now - began >= 100:
            current, previous, began = [], current, now
        turned = generations.turned(seen, now, 100)
        assert {r.key for r in generations.fresh(turned, batch).collect()} == set(keys) - set(current) - set(previous)
        for k in [k for k in dict.fromkeys(keys) if k not in current and k not in previous]:
            if len(current) == 6:
                current, previous, began = [], current, now
            current.append(k)
        seen = generations.entered(seen, batch, now, capacity=6, seconds=100)
        assert sorted(r.key for r in seen.current.collect()) == sorted(current) and sorted(r.key for r in seen.previous.collect()) == sorted(previous)
        assert (seen.size, seen.began) == (len(current), began)


class Event:
    def __init__(self, **columns):
        self.__dict__.update(columns)


def test_pacing():
    rule = limits.Pacing(spacing=1, rate=10, burst=2, most=1.5)
    state, out = rule.start(), []
    for at, address, ok in [(0, "a", True), (0, "a", True), (0, "a", True), (0, "b", True), (0, "c", False), (0, "c", True), (5, "a", True)]:
        result, state = rule.event(state, at, Event(address=address, ok=ok))
        out.append(result)
    # The third to a would wait two seconds; the one that could not be sent takes neither token nor place.
    assert out == [(True, 0.0), (True, 1.0), (False, 2.0), (True, pytest.approx(0.1)), (False, pytest.approx(0.2)), (True, pytest.approx(0.2)), (True, 0.0)]


def test_secrets():
    rule, state, out = limits.Secrets(10), None, []
    for at in (0, 5, 10, 19, 21, 50, 59):
        result, state = rule.event(state, at, None)
        out.append(result)
    assert out == [(1, 0, False), (1, 0, False), (2, 1, True), (2, 1, False), (3, 2, True), (5, 4, True), (5, 4, False)]


def test_gate(spark):
    gate = serving.Gate(spark, most=2, seconds=60)
    assert gate.run(lambda: spark.range(10).count()) == 10
    with pytest.raises(ZeroDivisionError):
        gate.run(lambda: 1 // 0)
    slow = F.udf(lambda i: time.sleep(60) or i, "long")
    short = serving.Gate(spark, most=1, seconds=3)
    began = time.monotonic()
    with pytest.raises(serving.TimedOut):
        short.run(lambda: spark.range(1).select(slow("id")).collect())
    short.seconds = 20  # the place is free again once the cancelled job has ended
    assert short.run(lambda: spark.range(3).count()) == 3 and time.monotonic() - began < 40
    shut = serving.Gate(spark, most=1, seconds=0.1)
    shut.places.acquire()
    with pytest.raises(serving.Busy):
        shut.run(lambda: None)


def test_one_of_two_writers_is_promoted(spark):
    root = Root(spark, shared.new_path(spark, "root"))
    one, two = root.create_next(), root.create_next()
    for n in (one, two):
        root.write(n, {"t": spark.range(n)}, n)
    assert root._successor(two, None) == two  # the second has claimed, and stops there
    assert not root.promote(one, None) and root.current() == two
    assert not root.promote(one, None) and root.read()["t"].count() == two
    three = root.create_next()
    root.write(three, {"t": spark.range(7)}, 3)
    assert root.promote(three, two) and root.current() == three


def test_metrics(spark):
    rows = spark.createDataFrame([('a"b\\c\nd', 3), (None, 1)], "label string, v long")
    lines = [r.line for r in metrics.exposition(rows, "m", "gauge", ["label"], "v").collect()]
    assert lines == ["# TYPE m gauge", 'm{label=""} 1', 'm{label="a\\"b\\\\c\\nd"} 3']
    seen, watch = metrics.observed(spark.range(10), "r", n=F.count("*"), top=F.max("id"))
    assert seen.where("id > 4").count() == 5 and watch.get == {"n": 10, "top": 9}
    from tidewater.operators import catalogue

    values = spark.createDataFrame([(0.5,), (3.0,), (9.0,)], "x double")
    told = [r.line for r in metrics.exposed_histogram(values, "h", catalogue.histogram(values, "x", (1.0, 5.0)), 12.5).collect()]
    assert told == ["# TYPE h histogram", 'h_bucket{le="1.0"} 1', 'h_bucket{le="5.0"} 2', 'h_bucket{le="+Inf"} 3', "h_sum 12.5", "h_count 3"]


def test_audit_rows_have_bounds(spark):
    schema = "at timestamp, actor string, action string, subject string, detail string"
    audit = spark.createDataFrame([], schema)
    assert maintain.append_audit(audit, spark.createDataFrame([(None, "a", "b", "", "{}")], schema)).count() == 1
    for row in [("", "b", ""), ("a", "b" * 65, ""), ("a", None, ""), ("a", "b", "c" * 257)]:
        with pytest.raises(ValueError):
            maintain.append_audit(audit, spark.createDataFrame([(None, *row, "{}")], schema))


def test_ids_with_a_prefix(spark):
    own, noise = bytes(range(100, 120)), bytes(range(200, 220))
    rows = spark.createDataFrame([(b, f) for b in range(0, 162, 3) for f in (True, False)], "bits int, flip boolean")
    made = rows.withColumn("id", nodes.id_with_prefix(F.lit(bytearray(own)), F.col("bits"), F.lit(bytearray(noise)), F.col("flip")))
    bits = lambda b: "".join(f"{x:08b}" for x in b)
    for r in made.collect():
        n, got = min(r.bits, 160), bits(r.id)
        assert len(r.id) == 20 and got[:n] == bits(own)[:n] and got[n + 1 :] == bits(noise)[n + 1 :]
        assert n == 160 or got[n] == (str(1 - int(bits(own)[n])) if r.flip else bits(noise)[n])


def test_addresses_of_both_families(spark):
    from tidewater.functions import scalars as S
    from tidewater.sources import metadata

    rng = random.Random(6)
    heads = [bytes(12), bytes(10) + b"\xff\xff", bytes.fromhex("20010000") + bytes(8), bytes.fromhex("2002"), bytes.fromhex("0064ff9b") + bytes(8), bytes.fromhex("20010db8"), bytes.fromhex("2001001f"), bytes.fromhex("3fff0fff"), bytes.fromhex("3fff10"), b"\xfe\x80", b"\x2a"]
    inner = [bytes.fromhex(x) for x in ("0a000001", "08080808", "c0a80101", "e0000001", "00000001", "0000ffff", "00010000", "f7ffffff", "3f5757f5")]
    rows = [None, b"", b"abc", bytes(16), bytes(15) + b"\x01"]
    for head in heads:
        rows += [(head + i).ljust(16, b"\x07")[:16] for i in inner] + [(head + rng.randbytes(16))[:16] for _ in range(20)]
    rows += inner + [rng.randbytes(4) for _ in range(100)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ip binary")
    for r in df.select("i", S.address_global(F.col("ip")).alias("ok"), S.address_network(F.col("ip")).alias("net")).collect():
        assert r.ok == metadata.is_global(rows[r.i]) and r.net == metadata.network_number(rows[r.i]), rows[r.i]


def test_replies_are_cut_to_a_datagram():
    from tidewater.sources import bencode, metadata

    def sent(**fields):
        data = metadata.encode_reply(b"tt", {"id": b"i" * 20, **fields})
        assert data is None or len(data) <= 1024
        return data and bencode.decode(data, bencode.KRPC)[b"r"]

    assert sent(nodes=b"n" * 26 * 8)[b"nodes"] == b"n" * 26 * 8
    cut = sent(values=[bytes([i % 250]) * 6 for i in range(200)], nodes=b"n" * 26 * 8)
    assert cut[b"nodes"] == b"n" * 26 * 8 and cut[b"values"] == [bytes([i % 250]) * 6 for i in range(len(cut[b"values"]))]
    assert len(sent(values=[b"v" * 6] * 200)[b"values"]) > len(cut[b"values"]) > 50
    both = sent(samples=b"s" * 20 * 60, nodes=b"n" * 26 * 8, nodes6=b"m" * 38 * 8)
    assert 0 < len(both[b"samples"]) < 1200 and len(both[b"samples"]) % 20 == 0 and both[b"nodes6"] == b"m" * 38 * 8
    many = sent(samples=b"s" * 20, nodes=b"n" * 26 * 20, nodes6=b"m" * 38 * 20)
    assert many[b"samples"] == b"" and len(many[b"nodes6"]) % 38 == 0 and many[b"nodes"] == b"n" * 26 * 20
    assert sent(BFsd=b"b" * 1000) is None


def test_connections_to_one_address():
    rule, out = limits.Destination(active=2, begun=4, seconds=60), []
    state = rule.start()
    steps = [(0, "start", None), (1, "start", None), (2, "start", None), (3, "end", "connected"), (4, "start", None), (5, "end", "connected"), (6, "start", None), (7, "end", "connected"), (8, "start", None)]
    steps += [(61, "start", None), (62, "end", "refused"), (100, "start", None), (242, "start", None), (243, "end", "error"), (842, "start", None), (843, "start", None)]
    for at, kind, outcome in steps:
        result, state = rule.event(state, at, Event(kind=kind, outcome=outcome))
        out.append(result)
    # Two at once; four begun in a minute; three minutes after a refusal and ten after another error.
    assert [a for a, _ in out] == [True, True, False, False, True, False, True, False, False, True, False, False, True, False, False, True]
    assert [n for _, n in out][:7] == [1, 2, 2, 1, 2, 1, 2]
