"""Limits, announces, schedules, node tables, display, settings."""

import datetime as dt
import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewater.operators import display
from tidewater.sources import settings
from tidewater.streaming import limits


def run(rule, rows):
    state, out = rule.start(), []
    for at, row in rows:
        got, state = rule.event(state, at, SimpleNamespace(**row))
        out.append(got)
    return out


def test_prefixes():
    assert limits.prefixes("::ffff:1.2.3.4") == [("1.2.3.4/32", 1)]
    assert [f for _, f in limits.prefixes("2001:db8::1")] == [1, 4, 16, 64] and limits.widest("2001:db8::1") == "2001:db8::/32"


def test_prefix_limit():
    rule = limits.PrefixLimit(1, 2)
    assert [r[0] for r in run(rule, [(0, {"ip": "1.2.3.4"})] * 3 + [(1.0, {"ip": "1.2.3.4"})])] == [True, True, False, True]
    hosts = [(0, {"ip": f"2001:db8:0:{i:x}::1"}) for i in range(9)]
    assert [r[0] for r in run(rule, hosts)].count(True) == 8  # of one /56
    assert [r[0] for r in run(rule, [(0, {"ip": "1.2.3.4"})] * 2 + [(700, {"ip": "1.2.3.4"})] * 2)] == [True] * 4


def test_announces():
    row = lambda p, h="h", s="s", seed=False: {"peer": p, "host": h, "subnet": s, "seed": seed}
    got = run(limits.Announces(100, 2, 3), [(0, row("a")), (1, row("b")), (2, row("a", seed=True)), (3, row("c")), (4, row("d", "i", "t")), (5, row("e", "j", "u")), (200, row("f"))])
    assert got == [("added", 1, 0), ("added", 2, 0), ("refreshed", 2, 1), ("replaced", 2, 1), ("added", 3, 1), ("replaced", 3, 0), ("added", 1, 0)]


def test_next_sample():
    row = lambda o, i=None: {"outcome": o, "interval": i}
    got = run(limits.NextSample(), [(0, row("answer", 10)), (100, row("answer", 10)), (300, row("timeout")), (600, row("timeout")), (1200, row("unsupported"))])
    assert got == [(True, 300), (False, 300), (True, 600), (True, 1200), (True, 22800)]


def test_node_table():
    own = b"\x00" * 20
    ids = [hashlib.sha1(bytes([i])).digest() for i in range(120)]
    rule = limits.NodeTable(own)
    state, at = rule.start(), 0.0
    for i, id_ in enumerate(ids):
        (placed, n), state = rule.event(state, at, SimpleNamespace(id=id_, subnet=f"n{i}", answered=True, valid=True))
        members = [x for x, v in state["nodes"].items() if v[5]]
        assert n == len(members)
        depth = state["depth"]
        sizes = {}
        for m in members:
            sizes[rule._bucket(m, depth)] = sizes.get(rule._bucket(m, depth), 0) + 1
        assert max(sizes.values()) <= rule.K
    assert depth > 1
    first = next(x for x, v in state["nodes"].items() if v[5])
    clash = SimpleNamespace(id=bytes.fromhex(first)[:19] + b"\xee", subnet=state["nodes"][first][0], answered=True, valid=True)
    assert rule.event(state, 1.0, clash)[0][0] == "refused"
    for _ in range(2):
        _, state = rule.event(state, 2.0, SimpleNamespace(id=bytes.fromhex(first), subnet=state["nodes"][first][0], answered=False, valid=True))
    assert rule.event(state, 3.0, clash)[0][0] == "replaced"


def test_api_rows(spark):
    now = dt.datetime(2024, 1, 2)
    schema = "id long, key binary, v1 binary, v2 binary, name string, total_size long, file_count long, files array<struct<path:string,size:bigint>>, files_truncated boolean, seen_count long, first_seen_at timestamp, last_seen_at timestamp, last_scraped_at timestamp, seeders_est int"
    rows = [(1, b"\x01", b"\x02", None, "<b>", 5, 2, [("a", 1), ("bcd", 2)], False, 1, now, now, now, 3), (2, b"\xab", None, None, " \x07 ", 5, 1, [("a", 1)], False, 1, now, now, now - dt.timedelta(9), 3)]
    items = spark.createDataFrame(rows, schema)
    got = {r.id: r.json for r in display.api_rows(items, F.lit(now), 3600).collect()}
    assert '"name":"\\u003cb\\u003e"' in got[1] and '"seeders_est":3' in got[1] and '"last_scraped_at":"2024-01-02T00:00:00Z"' in got[1]
    assert '"name":"ab"' in got[2] and "seeders_est" not in got[2] and "magnet" not in got[2]
    full = display.shown(items, True, 3).withColumn("t", display.files_truncated())
    assert {r.id: (len(r.shown_files), r.shown_cut, r.t) for r in full.collect()} == {1: (1, True, True), 2: (1, False, False)}
    assert display.visible_total(10, 5, 3) == 8


def test_client_address():
    of = lambda peer, *lines: display.client_address(peer, list(lines), ["10.0.0.0/8"])
    assert of("8.8.8.8", "1.1.1.1") == "8.8.8.8" and of("10.0.0.1", "6.6.6.6, 1.1.1.1, 10.0.0.2") == "1.1.1.1"
    assert of("10.0.0.1", "10.0.0.3") == "10.0.0.1" and of("10.0.0.1", "1.1.1.1, x, 10.0.0.2") == "10.0.0.2" and of("::ffff:10.0.0.1", "1.1.1.1") == "1.1.1.1"


def test_page_cache():
    now = [0.0]
    cache, made = display.PageCache(2, 10, lambda: now[0]), []
    make = lambda k: lambda: made.append(k) or [k]
    for k in ("a", "a", "b", "a", "c", "b"):
        assert cache.get(k, 1, make(k)) == [k]
    assert made == ["a", "b", "c", "b"]
    now[0] = 11
    cache.get("b", 1, make("b"))
    cache.get("b", 2, make("b"))
    assert made[4:] == ["b", "b"] and cache.get("e", 2, list) == [] and cache.get("e", 2, make("e")) == ["e"]


def test_settings(tmp_path):
    made = settings.parse("[queue]\nclaim = 9\n", {"TIDEWATER_QUEUE__CLAIM": "10", "TIDEWATER_INDEX__POLL_SECONDS": "2", "OTHER": "x"})
    assert made.queue.claim == 10 and made.index.poll_seconds == 2.0 and made.search.per_page == 20
    for bad in ("[queue]\nclaim = 0", "[queue]\nnone = 1", "[none]\na = 1", "[queue]\nclaim = 'x'", "queue = 1", "[["):
        with pytest.raises(settings.SettingsError):
            settings.parse(bad)
    path = str(tmp_path / "s.json")
    assert settings.load_state(path) is None
    settings.save_state(path, "me", [{"id": i} for i in range(400)])
    assert len(settings.load_state(path)["nodes"]) == 300
    (tmp_path / "s.json").write_text("[]")
    with pytest.raises(settings.SettingsError):
        settings.load_state(path)
