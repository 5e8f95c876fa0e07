"""Queries of what leaves the engine, of settings, and of choices among nodes."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import display, maintain, network
from tidewater.plans import tables as T
from tidewater.registry import query, table

#: Links of items by their hashes, in hexadecimal.
_MAGNET = """CASE WHEN v1 IS NOT NULL OR v2 IS NOT NULL THEN 'magnet:?' || coalesce('xt=urn:btih:' || v1 || '&', '') || coalesce('xt=urn:btmh:1220' || v2 || '&', '') || 'dn=' || url_encode(name) END"""


@query(
    "shown_rows",
    f"""WITH {T.ITEMS}, f AS (SELECT id, unnest(string_split(text, chr(10))) AS path, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM it),
    s AS (SELECT id, count(*) FILTER (WHERE chars <= 15)::INT AS kept, count(*) AS n FROM (SELECT id, sum(length(path)) OVER (PARTITION BY id ORDER BY n) AS chars FROM f) GROUP BY id)
    SELECT id, name AS shown_name, {_MAGNET} AS magnet, kept, kept < n AS shown_cut, kept < file_count AS truncated FROM it JOIN s USING (id)""",
)
def _(spark, sf):
    """Names, links, and as many files as fit into a page."""
    rows = display.shown(T.items(spark, sf), with_files=True, budget=15)
    return rows.select("id", "shown_name", "magnet", F.size("shown_files").alias("kept"), "shown_cut", display.files_truncated().alias("truncated"))


_TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_FRESH = f"seeders_est IS NOT NULL AND epoch(TIMESTAMP '{T.AS_OF}') - epoch(last_scraped_at) <= 850000000"


@query(
    "api_documents",
    f"""WITH {T.ITEMS}, m AS (SELECT *, {_MAGNET} AS magnet FROM it)
    SELECT id, replace('{{"key":"' || key || '"' || coalesce(',"v1":"' || v1 || '"', '') || coalesce(',"v2":"' || v2 || '"', '') || ',"name":"' || name || '","size":' || total_size || ',"file_count":' || file_count
    || ',"first_seen":"' || {_TIME.format("first_seen_at")} || '","last_seen":"' || {_TIME.format("last_seen_at")} || '","seen_count":' || seen_count
    || CASE WHEN {_FRESH} THEN ',"seeders_est":' || seeders_est || ',"last_scraped_at":"' || {_TIME.format("last_scraped_at")} || '"' ELSE '' END || coalesce(',"magnet":"' || magnet || '"', '') || '}}', '&', chr(92) || 'u0026') AS json FROM m""",
)
def _(spark, sf):
    """One JSON document an item, safe inside HTML; estimates only while fresh."""
    return display.api_rows(T.items(spark, sf), T.as_of(), 850_000_000)


@query(
    "settings_changed",
    """WITH s AS (SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation), c AS (SELECT 'settings' AS part, CASE WHEN key = 'k3' THEN key ELSE key END AS key, CASE WHEN key = 'k3' THEN 'changed' ELSE value END AS value FROM s)
    SELECT * FROM c UNION ALL SELECT 'settings', 'fresh', 'x' UNION ALL SELECT 'audit', 'k3', '{"old":"' || n_name || '","new":"changed"}' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'audit', 'fresh', '{"new":"x"}'""",
)
def _(spark, sf):
    """A changed setting, a new one, and one that is set to what it was, which leaves no audit row."""
    nation = table(spark, sf, "nation")
    settings = nation.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    audit = spark.createDataFrame([], "at timestamp_ntz, actor string, action string, subject string, detail string")
    same = nation.where("n_nationkey = 5").select("n_name").first()[0]
    for key, value in (("k3", "changed"), ("k5", same), ("fresh", "x")):
        settings, audit = maintain.set_setting(settings, audit, key, value, "admin", T.as_of())
    return settings.select(F.lit("settings").alias("part"), "key", "value").unionByName(audit.select(F.lit("audit").alias("part"), F.col("subject").alias("key"), F.col("detail").alias("value")))


@query(
    "lookup_candidates",
    """WITH u AS (SELECT o_orderkey % 40 AS subnet, sha1(o_orderkey::VARCHAR) AS h FROM orders), t AS (SELECT sha1('target') AS h),
    x AS (SELECT u.h AS id, subnet, [xor(('0x' || substr(u.h, 1 + 8 * i, 8))::BIGINT, ('0x' || substr(t.h, 1 + 8 * i, 8))::BIGINT) FOR i IN range(5)] AS d FROM u, t),
    r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY subnet ORDER BY d[1], d[2], d[3], d[4], d[5]) <= 2) SELECT upper(id) AS id, subnet FROM r ORDER BY d[1], d[2], d[3], d[4], d[5] LIMIT 50""",
)
def _(spark, sf):
    """The nearest nodes, no more than two of a subnet."""
    o = F.col("o_orderkey")
    known = table(spark, sf, "orders").select(F.unhex(F.sha1(o.cast("string"))).alias("id"), (o % 40).alias("subnet"))
    return network.candidates(known, hashlib.sha1(b"target").digest(), 2, 50).select(F.hex("id").alias("id"), "subnet")


@query("short_names", "SELECT p_partkey, substr(sha256(p_name), 1, 40) AS short, url_encode(p_name) AS encoded FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.lower(F.hex(S.alias_of(F.unhex(F.sha2(F.col("p_name"), 256))))).alias("short"), S.encode_query(F.col("p_name")).alias("encoded"))


@query(
    "announce_estimates",
    """WITH a AS (SELECT user_id % 5 AS key, event_type = 'signup' AS seed, sha1(user_id::VARCHAR) AS h FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY),
    b AS (SELECT DISTINCT key, seed, unnest([(('0x' || substr(h, 1, 2))::INT + 256 * ('0x' || substr(h, 3, 2))::INT) % 2048, (('0x' || substr(h, 5, 2))::INT + 256 * ('0x' || substr(h, 7, 2))::INT) % 2048]) AS bit FROM a),
    c AS (SELECT key, seed, floor(ln((2048 - count(*)) / 2048.0) / (2 * ln(1 - 1 / 2048.0)))::BIGINT AS n FROM b GROUP BY 1, 2)
    SELECT key, coalesce(max(n) FILTER (WHERE seed), 0)::BIGINT AS seeds, coalesce(max(n) FILTER (WHERE NOT seed), 0)::BIGINT AS peers FROM c GROUP BY key""",
)
def _(spark, sf):
    """Live announces of both classes by key, estimated from their filters."""
    e = table(spark, sf, "events")
    rows = e.select((F.col("user_id") % 5).alias("key"), (F.col("event_type") == "signup").alias("seed"), F.col("user_id").cast("string").cast("binary").alias("address"), F.col("ts").alias("at"))
    found = network.two_class_estimates(rows, T.as_of(), 20 * 86_400)
    return found.select("key", F.col("seeds").cast("long").alias("seeds"), F.col("peers").cast("long").alias("peers"))
