"""The engine's relations, read off the driver's tables: same shapes, stand-in values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.registry import table

#: The instant that stands for now.
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Index documents: the first line is the name, the others are files."""
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        lines[0].alias("name"),
        F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n").alias("files"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 7 % 1000).alias("created"),
        (F.col("doc_id") % 100).alias("seen"),
        F.size(lines).cast("long").alias("file_count"),
    )


DOCUMENTS = """d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines, n_chars AS size, doc_id * 7 % 1000 AS created, doc_id % 100 AS seen FROM documents),
docs AS (SELECT id, lines[1] AS name, coalesce(list_aggregate(lines[2:], 'string_agg', chr(10)), '') AS files, size, created, seen FROM d)"""


def item_files(spark: SparkSession, sf: str) -> DataFrame:
    """(id, files): lines of an order as its file list, in order."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("dir/"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("path"), F.floor("l_extendedprice").cast("long").alias("size")).alias("f"),
    )
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(f["path"].alias("path"), f["size"].alias("size"))).alias("files"))


FILES = "f AS (SELECT l_orderkey AS id, l_linenumber AS n, 'dir/' || l_partkey || '-' || l_suppkey AS path, floor(l_extendedprice)::BIGINT AS size FROM lineitem)"


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the lease queue."""
    o = table(spark, sf, "orders")
    estimate = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 7).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderdate").alias("discovered_at"),
        (F.col("o_custkey") % 50 + 1).alias("seen_count"),
        (F.length("o_orderpriority") % 3).cast("long").alias("attempts"),
        F.col("o_orderdate").alias("next_attempt_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("lease_until"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"),
        (F.col("o_orderstatus") == "P").alias("gave_up"),
        estimate.alias("seeders_est"),
    )


QUEUE = """q AS (SELECT o_orderkey AS key, o_custkey % 50 + 1 AS seen_count, length(o_orderpriority) % 3 AS attempts, o_orderdate AS next_attempt_at,
CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS lease_until, o_orderstatus = 'P' AS gave_up,
CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 7)::INT END AS seeders_est FROM orders)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as observations of users."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") % 4).alias("sightings"), (F.col("event_type") == "signup").alias("priority"))


OBSERVATIONS = "b AS (SELECT user_id AS key, event_id % 4 AS sightings, event_type = 'signup' AS priority FROM events)"


def discoveries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as discoveries with a source and a network."""
    e = table(spark, sf, "events")
    source = F.when(F.col("event_type") == "signup", "announce").when(F.col("event_type") == "click", "sample").otherwise("get_peers")
    return e.select("event_id", F.col("user_id").alias("key"), source.alias("source"), F.get_json_object("props", "$.k").cast("long").alias("network"), "ts")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items, each with a key, two of three with a short hash, one of four with a long one; one status is removed."""
    o, i = table(spark, sf, "orders"), F.col("o_orderkey")
    named = lambda letter: F.concat(F.lit(letter), i.cast("string"))
    files = F.transform(F.sequence(F.lit(1).cast("long"), i % 3 + 1), lambda n: F.struct(F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit("/"), n.cast("string")).alias("path"), (i * n % 1000).alias("size")))
    none = lambda condition, value: F.when(condition, value)
    return o.select(
        i.alias("id"),
        F.unhex(F.sha1(named("k"))).alias("key"),
        none(i % 3 != 0, F.unhex(F.sha1(named("v")))).alias("v1"),
        none(i % 4 == 0, F.unhex(F.sha2(named("w"), 256))).alias("v2"),
        F.concat(F.lit("item "), F.col("o_orderpriority"), F.lit(" "), i.cast("string")).alias("name"),
        F.floor("o_totalprice").cast("long").alias("total_size"),
        (i % 3 + 1).alias("file_count"),
        files.alias("files"),
        F.lit(False).alias("files_truncated"),
        none(i % 5 != 0, F.lit(16384).cast("long")).alias("piece_length"),
        (F.col("o_custkey") % 50 + 1).alias("seen_count"),
        F.col("o_orderdate").alias("first_seen_at"),
        (F.col("o_orderdate") + F.make_dt_interval((i % 30).cast("int"))).alias("last_seen_at"),
        (i * 2).alias("change_seq"),
        none(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
        none(i % 4 > 0, F.col("o_orderdate")).alias("last_scraped_at"),
        none(i % 3 > 0, (i % 7).cast("int")).alias("seeders_est"),
        (i % 2).cast("int").alias("scrape_failures"),
    )


#: The same with names in hexadecimal; ``text`` is the paths, one a line.
ITEMS = """it AS (SELECT o_orderkey AS id, sha1('k' || o_orderkey) AS key, CASE WHEN o_orderkey % 3 <> 0 THEN sha1('v' || o_orderkey) END AS v1,
CASE WHEN o_orderkey % 4 = 0 THEN sha256('w' || o_orderkey) END AS v2, 'item ' || o_orderpriority || ' ' || o_orderkey AS name, floor(o_totalprice)::BIGINT AS total_size, o_orderkey % 3 + 1 AS file_count,
list_aggregate([('d' || o_custkey || '/' || n) FOR n IN range(1, o_orderkey % 3 + 2)], 'string_agg', chr(10)) AS text, o_custkey % 50 + 1 AS seen_count, o_orderdate AS first_seen_at,
o_orderdate + to_days((o_orderkey % 30)::INT) AS last_seen_at, o_orderkey * 2 AS change_seq, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS last_scraped_at, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7)::INT END AS seeders_est, (o_orderkey % 2)::INT AS scrape_failures FROM orders),
names AS (SELECT id, deleted_at, key AS alias FROM it UNION SELECT id, deleted_at, v1 FROM it WHERE v1 IS NOT NULL UNION SELECT id, deleted_at, left(v2, 40) FROM it WHERE v2 IS NOT NULL)"""


def purged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as items that are gone for good."""
    c = table(spark, sf, "customer")
    return c.select((F.col("c_custkey") + 10_000_000).alias("item_id"), (F.col("c_custkey") * 2 + 1).alias("purged_seq"), F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("purged_at"))


PURGED = "gone AS (SELECT c_custkey + 10000000 AS item_id, c_custkey * 2 + 1 AS purged_seq FROM customer)"


def named_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as observations: of a third of the users by key, of a third by short hash, of a third by a key that no item has."""
    e, u = table(spark, sf, "events"), F.col("user_id")
    letter = F.element_at(F.array(F.lit("k"), F.lit("v"), F.lit("x")), (u % 3 + 1).cast("int"))
    return e.select(F.unhex(F.sha1(F.concat(letter, u.cast("string")))).alias("key"), (F.col("event_id") % 4).alias("sightings"), (F.col("event_type") == "signup").alias("priority"))


SEEN = """b AS (SELECT sha1(substr('kvx', user_id % 3 + 1, 1) || user_id) AS key, event_id % 4 AS sightings, event_type = 'signup' AS priority FROM events),
m AS (SELECT key, sum(sightings)::BIGINT AS n, bool_or(priority) AS priority FROM b WHERE sightings > 0 GROUP BY key),
known AS (SELECT DISTINCT id, key FROM m JOIN names ON alias = key WHERE deleted_at IS NULL)"""


def named_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a queue of keys that no item has."""
    c, i = table(spark, sf, "customer"), F.col("c_custkey")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        F.unhex(F.sha1(F.concat(F.lit("x"), i.cast("string")))).alias("key"), at.alias("discovered_at"), (i % 9 + 1).alias("seen_count"), (i % 2).cast("int").alias("attempts"), at.alias("next_attempt_at"),
        F.lit(None).cast("timestamp_ntz").alias("lease_until"), F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"), (i % 7 == 0).alias("gave_up"), F.lit(None).cast("int").alias("seeders_est"),
    )


NAMED_QUEUE = "nq AS (SELECT sha1('x' || c_custkey) AS key, c_custkey % 9 + 1 AS seen_count FROM customer)"


def removal_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' short hashes as removed names."""
    c, i = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(F.unhex(F.sha1(F.concat(F.lit("v"), i.cast("string")))).alias("key"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("removed_at"), (i % 3 + 1).cast("int").alias("removals"), (i % 5).alias("sightings"))


MEMORY = "rm AS (SELECT sha1('v' || c_custkey) AS key, (c_custkey % 3 + 1)::INT AS removals, c_custkey % 5 AS sightings FROM customer)"


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a batch of fetched items: by turns an item's key, an item's short hash under a new key, a new item, and another key of that one."""
    n, i = table(spark, sf, "nation"), F.col("n_nationkey")
    turn, text = i % 4, i.cast("string")
    hashed = lambda letter, number=text: F.unhex(F.sha1(F.concat(F.lit(letter), number)))
    file = F.array(F.struct(F.lit("only").alias("path"), i.alias("size")))
    return n.select(
        i.alias("pos"),
        F.when(turn == 0, hashed("k")).when(turn == 1, hashed("y")).when(turn == 2, hashed("x")).otherwise(hashed("q")).alias("key"),
        F.when(turn == 0, F.when(i % 3 != 0, hashed("v"))).when(turn == 1, hashed("v")).when(turn == 2, hashed("n")).otherwise(hashed("n", (i - 1).cast("string"))).alias("v1"),
        F.lit(None).cast("binary").alias("v2"),
        F.concat(F.lit("fetched "), F.col("n_name")).alias("name"),
        i.alias("total_size"), F.lit(1).cast("long").alias("file_count"), file.alias("files"), F.lit(False).alias("files_truncated"), F.lit(None).cast("long").alias("piece_length"),
    )


#: Where each of them goes by construction: an item (turn 0, and 1 if the item has a short hash), else a new row; turn 3 to that of turn 2.
FETCHED = """f0 AS (SELECT n_nationkey AS n, 'fetched ' || n_name AS name, n_nationkey % 4 = 0 OR (n_nationkey % 4 = 1 AND n_nationkey % 3 <> 0) AS old, n_nationkey % 4 = 3 AS chained,
CASE n_nationkey % 4 WHEN 0 THEN sha1('k' || n_nationkey) WHEN 1 THEN sha1('y' || n_nationkey) WHEN 2 THEN sha1('x' || n_nationkey) ELSE sha1('q' || n_nationkey) END AS key,
CASE n_nationkey % 4 WHEN 0 THEN CASE WHEN n_nationkey % 3 <> 0 THEN sha1('v' || n_nationkey) END WHEN 1 THEN sha1('v' || n_nationkey) WHEN 2 THEN sha1('n' || n_nationkey) ELSE sha1('n' || (n_nationkey - 1)) END AS v1 FROM nation),
f1 AS (SELECT *, 20000000 + count(*) FILTER (WHERE NOT old AND NOT chained) OVER (ORDER BY n) AS made FROM f0), ft AS (SELECT *, CASE WHEN old THEN n ELSE made END AS id FROM f1)"""
