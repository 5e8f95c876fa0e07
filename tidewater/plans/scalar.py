"""Queries of the scalar rules: verdicts, efforts, formats, links, hashes, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.plans import tables as T
from tidewater.registry import query, table


@query("verdict_classify", f"WITH {T.QUEUE} SELECT key, CASE WHEN seeders_est IS NULL THEN 'unknown' WHEN seeders_est > 1 THEN 'live' WHEN key % 2 = 0 THEN 'dead' ELSE 'unknown' END AS verdict FROM q")
def _(spark, sf):
    return T.queue(spark, sf).select("key", S.verdict(F.col("seeders_est"), 1, F.col("key") % 2 == 0).alias("verdict"))


@query("effort_buckets", f"WITH {T.QUEUE} SELECT key, CASE WHEN coalesce(seeders_est, 0) <= 0 THEN 3 ELSE 8 END AS dials, CASE WHEN seeders_est >= 5 THEN 2 ELSE 1 END AS lookups FROM q")
def _(spark, sf):
    return T.queue(spark, sf).select("key", S.effort(F.col("seeders_est")).alias("e")).select("key", "e.dials", "e.lookups")


@query("fresh_estimate", f"WITH {T.QUEUE} SELECT key, CASE WHEN epoch(TIMESTAMP '{T.AS_OF}') - epoch(lease_until) <= 900000000 THEN seeders_est END AS estimate FROM q")
def _(spark, sf):
    return T.queue(spark, sf).select("key", S.fresh(F.col("seeders_est"), F.col("lease_until"), T.as_of(), 900_000_000).alias("estimate"))


@query("popularity_multiplier", "SELECT doc_id, round(1 + 0.15 * log10(1 + doc_id % 100), 6) AS factor FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(S.popularity(F.col("doc_id") % 100), 6).alias("factor"))


@query(
    "next_sample_delay",
    """SELECT event_id, CASE event_type WHEN 'click' THEN least(greatest(floor(value)::BIGINT * 60, 300), 21600) WHEN 'view' THEN CASE WHEN event_id % 9 <= 0 THEN 0 ELSE least(300 * pow(2, event_id % 9 - 1), 21600) END ELSE 21600 END::BIGINT AS seconds FROM events""",
)
def _(spark, sf):
    outcome = F.when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "view", "timeout").otherwise("unsupported")
    return table(spark, sf, "events").select("event_id", S.next_sample_seconds(outcome, F.floor("value").cast("long") * 60, F.col("event_id") % 9).alias("seconds"))


@query(
    "human_size",
    """WITH n AS (SELECT doc_id, n_chars * n_chars * (doc_id % 50 + 1) AS n FROM documents), u AS (SELECT doc_id, n,
    CASE WHEN n * 10 < 10240 THEN 0 WHEN (n * 10 + 512) // 1024 < 10240 THEN 1 WHEN (n * 10 + 524288) // 1048576 < 10240 THEN 2 WHEN (n * 10 + 536870912) // 1073741824 < 10240 THEN 3 ELSE 4 END AS k FROM n),
    t AS (SELECT doc_id, n, k, (n * 10 + (1::BIGINT << (10 * k)) // 2) // (1::BIGINT << (10 * k)) AS t FROM u)
    SELECT doc_id, CASE WHEN k = 0 THEN n || ' B' ELSE (t // 10) || '.' || (t % 10) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB'][k] END AS size FROM t""",
)
def _(spark, sf):
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 50 + 1)
    return table(spark, sf, "documents").select("doc_id", S.human_size(n).alias("size"))


@query("grouped_number", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) || CASE WHEN o_orderkey * 1000 = 1 THEN ' item' ELSE ' items' END AS text FROM orders")
def _(spark, sf):
    n = F.col("o_orderkey") * 1000
    return table(spark, sf, "orders").select("o_orderkey", S.plural(n, "item", "items").alias("text"))


@query("magnet_link", "SELECT p_partkey, 'magnet:?xt=urn:btih:' || sha1(p_name) || '&dn=' || url_encode(p_name) AS link FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.magnet(F.unhex(F.sha1("p_name")), F.lit(None).cast("binary"), F.col("p_name")).alias("link"))


@query(
    "json_html_safe",
    """SELECT page_id, replace(replace(replace(replace(url, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), '''', '\\u0027') AS json FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_json(F.col("url")).alias("json"))


@query("hash_verify", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v1' WHEN doc_id % 3 = 0 THEN 'v2' END AS version FROM documents")
def _(spark, sf):
    data = F.col("text").cast("binary")
    key = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.sha1(data))).when(F.col("doc_id") % 3 == 0, F.substring(F.unhex(F.sha2(data, 256)), 1, 20)).otherwise(F.unhex(F.sha1(F.lit(b"x"))))
    return table(spark, sf, "documents").select("doc_id", S.matches_hash(data, key).alias("version"))


@query("key_parse", "SELECT user_id, 'v1' AS kind, upper(sha1(user_id::VARCHAR)) AS key FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, sf):
    ids = table(spark, sf, "events").select("user_id").distinct()
    return ids.select("user_id", S.parse_key(F.sha1(F.col("user_id").cast("string"))).alias("k")).select("user_id", "k.kind", F.hex("k.key").alias("key"))


_IP = "(o_orderkey * 2654435761 % 256) || '.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.' || (o_orderkey % 7)"


def _ip():
    parts = (F.col("o_orderkey") * 2654435761 % 256, F.col("o_custkey") % 256, F.col("o_orderkey") % 256, F.col("o_orderkey") % 7)
    return F.concat_ws(".", *(p.cast("string") for p in parts))


@query(
    "ipv4_dialable",
    f"""WITH i AS (SELECT o_orderkey, {_IP} AS ip, (o_orderkey * 2654435761 % 256) AS a, o_custkey % 256 AS b, o_orderkey % 256 AS c FROM orders)
    SELECT o_orderkey, ip, o_orderkey % 11 > 0 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS ok FROM i""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _ip().alias("ip"), S.ipv4_dialable(S.ipv4_number(_ip()), F.col("o_orderkey") % 11).alias("ok"))


@query("source_network", "SELECT o_orderkey, 281474976710656 + (o_orderkey * 2654435761 % 256) * 65536 + (o_custkey % 256) * 256 + o_orderkey % 256 AS network FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.source_network(S.ipv4_number(_ip())).alias("network"))


#: Eight kinds of addresses around the same four bytes: plain, mapped, compatible, three tunnels, documentation and global.
_KINDS = ("", "00000000000000000000FFFF", "0" * 24, "20010000" + "1" * 16, "2002", "0064FF9B" + "0" * 16, "20010DB8" + "2" * 16, "2A00" + "3" * 20)
_V4 = "printf('%02X%02X%02X%02X', o_orderkey * 2654435761 % 256, o_custkey % 256, o_orderkey % 256, o_orderkey % 7)"
_RESERVED = """(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))"""


def _address():
    o = F.col("o_orderkey")
    inner = F.concat(*(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (o * 2654435761 % 256, F.col("o_custkey") % 256, o % 256, o % 7)))
    head = F.element_at(F.array(*map(F.lit, _KINDS)), (o % 8 + 1).cast("int"))
    return F.unhex(F.when(o % 8 == 4, F.concat(head, inner, F.lit("0" * 20))).otherwise(F.concat(head, inner)))


@query(
    "address_global",
    f"""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS kind, o_orderkey * 2654435761 % 256 AS a0, o_custkey % 256 AS b0, o_orderkey % 256 AS c0, o_orderkey % 7 AS d0 FROM orders),
    i AS (SELECT *, CASE WHEN kind = 3 THEN 255 - a0 ELSE a0 END AS a, CASE WHEN kind = 3 THEN 255 - b0 ELSE b0 END AS b, CASE WHEN kind = 3 THEN 255 - c0 ELSE c0 END AS c FROM o)
    SELECT o_orderkey, CASE WHEN kind = 7 THEN true WHEN kind = 6 THEN false WHEN kind = 2 AND a0 = 0 AND b0 = 0 THEN false ELSE NOT {_RESERVED} END AS ok FROM i""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.address_global(_address()).alias("ok"))


@query(
    "address_network",
    f"""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS kind, {_V4} AS h, [{", ".join(f"'{k}'" for k in _KINDS)}][o_orderkey % 8 + 1] AS head FROM orders)
    SELECT o_orderkey, CASE WHEN kind < 3 AND NOT (kind = 2 AND left(h, 4) = '0000') THEN 281474976710656 + ('0x' || left(h, 6))::BIGINT ELSE ('0x' || left(head || h, 12))::BIGINT END AS network FROM o""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.address_network(_address()).alias("network"))


@query("key_partition", "SELECT user_id, ('0x' || substr(sha1(user_id::VARCHAR), 1, 8))::BIGINT AS part FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", S.partition_word(F.unhex(F.sha1(F.col("user_id").cast("string")))).alias("part"))


@query("rfc3339_seconds", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.rfc3339(F.col("o_orderdate")).alias("at"))


@query("display_name", r"SELECT doc_id, rtrim(left(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 80)) AS name FROM documents")
def _(spark, sf):
    """SQL for the texts at hand; tests hold the character classes of other scripts against the plain function."""
    from tidewater.functions import text as X

    return table(spark, sf, "documents").select("doc_id", X.display(F.col("text"), 80).alias("name"))


@query("constraint_errors", "SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 1024 THEN '' ELSE 'name' END AS errors FROM documents")
def _(spark, sf):
    from tidewater.operators import maintain

    files = F.array(F.struct(F.lit("a/b").alias("path"), F.lit(1).cast("long").alias("size")))
    errors = maintain.item_errors(F.col("text"), files, F.col("n_chars"), F.lit(1), F.lit(None).cast("long"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"))
