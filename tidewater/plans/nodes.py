"""Queries of node tables, tokens, metrics and arrays."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewater.operators import catalogue, metrics, network, nodes
from tidewater.plans import tables as T
from tidewater.registry import query, table
from tidewater.streaming import limits, stateful

NOW = f"TIMESTAMP '{T.AS_OF}'"
OWN = hashlib.sha1(b"own").hexdigest()


def _ago(seconds):
    return T.as_of() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


@query(
    "peers_reject_own",
    """WITH p AS (SELECT o_custkey % 500 AS ip, o_orderkey % 7 AS port FROM orders), o AS (SELECT c_custkey % 500 AS ip, c_custkey % 7 AS port FROM customer WHERE c_custkey % 11 = 0)
    SELECT 'ip' AS by, ip, port FROM p WHERE ip NOT IN (SELECT ip FROM o) UNION ALL SELECT 'endpoint', ip, port FROM p WHERE (ip, port) NOT IN (SELECT (ip, port) FROM o)""",
)
def _(spark, sf):
    peers = table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("ip"), (F.col("o_orderkey") % 7).alias("port"))
    own = table(spark, sf, "customer").where("c_custkey % 11 = 0").select((F.col("c_custkey") % 500).alias("ip"), (F.col("c_custkey") % 7).alias("port"))
    each = lambda name, by: nodes.reject_own(peers, own, by).select(F.lit(name).alias("by"), "ip", "port")
    return each("ip", False).unionByName(each("endpoint", True))


_BITS = "list_aggregate([lpad(bin(('0x' || substr({0}, 2 * i + 1, 2))::INT), 8, '0') FOR i IN range(20)], 'string_agg', '')"


@query(
    "nodes_refresh_targets",
    f"""WITH b AS (SELECT n_nationkey AS bucket, n_nationkey * 7 % 25 * 100 AS age, max(n_nationkey) OVER () AS last FROM nation), d AS (SELECT * FROM b WHERE age >= 900 ORDER BY age DESC, bucket LIMIT 10),
    t AS (SELECT bucket, last, {_BITS.format(f"'{OWN}'")} AS own, {_BITS.format("sha1('5:' || bucket)")} AS noise FROM d)
    SELECT bucket, left(own, bucket) || CASE WHEN bucket < last THEN CASE substr(own, bucket + 1, 1) WHEN '1' THEN '0' ELSE '1' END ELSE substr(noise, bucket + 1, 1) END || substr(noise, bucket + 2) AS target FROM t""",
)
def _(spark, sf):
    """Targets as bits."""
    buckets = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("bucket"), _ago(F.col("n_nationkey") * 7 % 25 * 100).alias("last_changed"))
    due = nodes.refresh_targets(buckets, F.lit(bytearray.fromhex(OWN)), T.as_of(), 900, 10, seed=5)
    bits = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.lpad(F.conv(F.hex(F.substring("target", i, F.lit(1))), 16, 2), 8, "0"))
    return due.select(F.col("bucket").cast("long").alias("bucket"), F.array_join(bits, "").alias("target"))


def _nodes(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("id"), (c % 20).alias("bucket"), c.alias("place"), F.when(c % 3 > 0, _ago(c % 40 * 60)).alias("last_ping"), F.when(c % 4 > 0, _ago(c * 13 % 3600)).alias("last_active"),
        F.when(c % 5 > 0, _ago(c * 17 % 7200)).alias("last_response"), F.element_at(F.array(F.lit("good"), F.lit("questionable"), F.lit("bad")), (c % 3 + 1).cast("int")).alias("status"), (c % 7 > 0).alias("confirmed"),
    )


_NODES = """n AS (SELECT c_custkey AS id, c_custkey % 20 AS bucket, c_custkey AS place, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 * 60 END AS pinged, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 13 % 3600 END AS active,
CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 17 % 7200 END AS answered, ['good', 'questionable', 'bad'][c_custkey % 3 + 1] AS status, c_custkey % 7 > 0 AS confirmed FROM customer)"""


@query("nodes_ping_candidates", f"WITH {_NODES} SELECT id FROM n WHERE (pinged IS NULL OR pinged >= 900) AND status <> 'good' ORDER BY active DESC NULLS FIRST, bucket, place LIMIT 40")
def _(spark, sf):
    return nodes.ping_candidates(_nodes(spark, sf), T.as_of(), 900, 40).select("id")


@query("nodes_export", f"WITH {_NODES} SELECT id FROM n WHERE confirmed AND status <> 'bad' ORDER BY status = 'good' DESC, answered NULLS LAST, bucket, place LIMIT 70")
def _(spark, sf):
    return nodes.export(_nodes(spark, sf), 70).select("id")


@query(
    "visited_make_room",
    """WITH v AS (SELECT o_orderkey AS key, o_orderkey * 31 % 997 AS next, o_orderkey % 10 = 0 AS fly FROM orders), h AS (SELECT * FROM v WHERE next > 200 OR fly),
    r AS (SELECT *, row_number() OVER (PARTITION BY NOT fly AND next > 200 ORDER BY next DESC, key) AS k FROM h) SELECT key FROM r WHERE NOT (NOT fly AND next > 200 AND k <= (SELECT count(*) FROM h) + 100 + 50 - 1000)""",
)
def _(spark, sf):
    o = F.col("o_orderkey")
    visited = table(spark, sf, "orders").select(o.alias("key"), (o * 31 % 997).alias("next"), (o % 10 == 0).alias("in_flight"))
    return nodes.make_room(visited, 100, 1000, 200, reserved=50).select("key")


@query(
    "announce_tokens",
    """WITH t AS (SELECT c_custkey AS id, unhex(sha1('s' || c_custkey % 5)) AS a, unhex(sha1('s' || (c_custkey % 5 + 1))) AS b, unhex(printf('%08x', c_custkey * 65537)) AS ip, unhex(sha1('s' || c_custkey % 7)) AS used FROM customer)
    SELECT id, substr(sha1(a || ip), 1, 16) AS token, substr(sha1(used || ip), 1, 16) IN (substr(sha1(a || ip), 1, 16), substr(sha1(b || ip), 1, 16)) AS ok FROM t""",
)
def _(spark, sf):
    """Tokens of a secret, and whether one of another secret is still good."""
    c = F.col("c_custkey")
    secret = lambda n: F.unhex(F.sha1(F.concat(F.lit("s"), n.cast("string"))))
    number = F.hex(c * 65537)
    ip = F.unhex(F.when(F.length(number) < 8, F.lpad(number, 8, "0")).otherwise(number))  # lpad also cuts
    token, used = nodes.announce_token(secret(c % 5), ip), nodes.announce_token(secret(c % 7), ip)
    return table(spark, sf, "customer").select(c.alias("id"), F.lower(F.hex(token)).alias("token"), nodes.token_valid(used, ip, secret(c % 5), secret(c % 5 + 1)).alias("ok"))


@query(
    "token_secrets",
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_id, key, n, 1 AS c, 0 AS p, false AS turned, t AS s FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.key, e.n, CASE WHEN t - s >= 100000 THEN c + 2 WHEN t - s >= 50000 THEN c + 1 ELSE c END, CASE WHEN t - s >= 100000 THEN c + 1 WHEN t - s >= 50000 THEN c ELSE p END,
    t - s >= 50000, CASE WHEN t - s >= 50000 THEN t ELSE s END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1) SELECT event_id, c AS current, p AS previous, turned FROM r""",
)
def _(spark, sf):
    """A turn is late if nothing happened for long; then both secrets are new."""
    events = T.discoveries(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.replay(events, ["key"], "ts", ["event_id"], limits.Secrets(50_000)).select("event_id", "current", "previous", "turned")


# --- hints

_HINTS = """l AS (SELECT user_id AS key, event_type AS peer, max(ts) AS "at" FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2), v AS (SELECT * FROM l WHERE "at" > TIMESTAMP '2024-01-30' - INTERVAL 10 DAY),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY "at" DESC, peer DESC) <= 3), u AS (SELECT key FROM k GROUP BY key ORDER BY max("at") DESC, key DESC LIMIT 12), h AS (SELECT * FROM k WHERE key IN (SELECT key FROM u))"""


def _hints(spark, sf):
    e = table(spark, sf, "events").where("ts < TIMESTAMP_NTZ '2024-01-30'").select(F.col("user_id").alias("key"), F.col("event_type").alias("peer"), F.col("ts").alias("at"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    old, new = e.where("day(at) < 15"), e.where("day(at) >= 15")
    return network.remember(old, new, now, 864_000, 3, 12), now


@query("hints_remembered", f"WITH {_HINTS} SELECT key, peer, \"at\" FROM h")
def _(spark, sf):
    return _hints(spark, sf)[0]


@query("hints_taken", f"WITH {_HINTS} SELECT key, string_agg(peer, ',' ORDER BY \"at\" DESC, peer DESC) AS peers FROM h WHERE key % 2 = 0 GROUP BY key UNION ALL SELECT key, 'left' FROM h WHERE key % 2 = 1 GROUP BY key")
def _(spark, sf):
    hints, now = _hints(spark, sf)
    taken, left = network.take(hints, hints.where("key % 2 = 0"), now, 864_000)
    return taken.select("key", F.array_join("peers", ",").alias("peers")).unionByName(left.select("key", F.lit("left").alias("peers")).distinct())


# --- metrics

@query("counters_total", "SELECT count(*)::BIGINT AS received, (sum(user_id % 3))::BIGINT AS errors, (sum(CASE WHEN user_id % 2 = 0 THEN 1 END))::BIGINT AS sent FROM events")
def _(spark, sf):
    """Snapshots of families as counters, summed."""
    e = table(spark, sf, "events")
    families = e.groupBy("event_type").agg(F.count("*").alias("received"), F.sum(F.col("user_id") % 3).alias("errors"), F.sum(F.when(F.col("user_id") % 2 == 0, 1)).alias("sent"))
    return metrics.totals(families, ["received", "errors", "sent"])


@query(
    "metrics_lines",
    """SELECT 0 AS n, '# TYPE events_total counter' AS line UNION ALL SELECT 1, 'events_total{type="' || event_type || '",even="' || (user_id % 2 = 0)::VARCHAR || '"} ' || count(*) FROM events GROUP BY event_type, user_id % 2 = 0""",
)
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("type"), (F.col("user_id") % 2 == 0).alias("even")).agg(F.count("*").alias("v"))
    return metrics.exposition(counts, "events_total", "counter", ["type", "even"], "v")


# --- arrays

@query("unnest_arrays", f"WITH {T.FILES} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n, path, size) - 1)::INT AS at, path, size FROM f")
def _(spark, sf):
    lists = T.item_files(spark, sf).select("id", F.col("files.path").alias("path"), F.col("files.size").alias("size"))
    return catalogue.unnest(lists, "path", "size")


@query(
    "audit_settings",
    "SELECT 'admin' AS actor, 'set_setting' AS action, 'k' || n_nationkey AS subject FROM nation UNION ALL SELECT 'system', 'purge', r_name FROM region",
)
def _(spark, sf):
    from tidewater.operators import maintain

    row = lambda df, actor, action, subject: df.select(T.as_of().alias("at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), subject.alias("subject"), F.lit("{}").alias("detail"))
    audit = row(table(spark, sf, "nation"), "admin", "set_setting", F.concat(F.lit("k"), F.col("n_nationkey").cast("string")))
    return maintain.append_audit(audit, row(table(spark, sf, "region"), "system", "purge", F.col("r_name"))).select("actor", "action", "subject")
