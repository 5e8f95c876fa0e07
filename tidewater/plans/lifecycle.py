"""Queries of an item's life through the operators themselves: lookup, feed, page, observation, completion, scrapes, removal, index."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewater import shared
from tidewater.operators import catalogue, maintain
from tidewater.plans import tables as T
from tidewater.registry import query
from tidewater.sources.versions import Root
from tidewater.streaming import projector

NOW = f"TIMESTAMP '{T.AS_OF}'"
SEQ, ID = 5_000_000_000, 20_000_000


@query("scan_visible", f"WITH {T.ITEMS} SELECT id, name FROM it WHERE deleted_at IS NULL")
def _(spark, sf):
    return catalogue.visible(T.items(spark, sf)).select("id", "name")


def _hex(*columns: str):
    return [F.lower(F.hex(c)).alias(c) for c in columns]


def _text(letter: str, number: int) -> str:
    return f"{letter}{number}"


#: Names to look up: stored keys, short hashes, long ones, and one that no item has.
_ASKED = [("k", 7), ("k", 8), ("k", 1100), ("v", 8), ("v", 13), ("v", 1400), ("w", 16), ("w", 20), ("w", 1200), ("x", 3)]


def _found(letter: str, number: int) -> str:
    name = f"{'sha256' if letter == 'w' else 'sha1'}('{letter}{number}')"
    match = f"v2 = {name}" if letter == "w" else f"(key = {name} OR v1 = {name})"
    return f"(SELECT '{letter}{number}' AS asked, id, name FROM it WHERE deleted_at IS NULL AND {match} ORDER BY key = {name} DESC, id LIMIT 1)"


@query("lookup_preferred_match", f"WITH {T.ITEMS} {' UNION ALL '.join(_found(*a) for a in _ASKED)}")
def _(spark, sf):
    items, out = T.items(spark, sf), None
    for letter, number in _ASKED:
        name = _text(letter, number).encode()
        one = catalogue.lookup(items, (hashlib.sha256 if letter == "w" else hashlib.sha1)(name).digest()).select(F.lit(_text(letter, number)).alias("asked"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


_FEED = f"""WITH {T.ITEMS}, {T.PURGED}, a AS (SELECT change_seq AS seq, id, (strlen(name) + strlen(text))::BIGINT AS bytes FROM it UNION ALL SELECT purged_seq, item_id, 0 FROM gone),
p AS (SELECT * FROM a WHERE seq > 101 AND seq <= 2500 ORDER BY seq LIMIT {{limit}}), w AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT w.seq, w.id, it.id IS NOT NULL AND deleted_at IS NULL AS visible, coalesce(it.name, '') AS name, coalesce(text, '') AS files, coalesce(total_size, 0)::BIGINT AS size,
coalesce(epoch(first_seen_at), 0)::BIGINT AS created, coalesce(seen_count, 0)::BIGINT AS seen, coalesce(file_count, 0)::BIGINT AS file_count FROM w LEFT JOIN it USING (id) WHERE before < {{budget}}"""


@query("feed_page_window", _FEED.format(limit=1000, budget=9000))
def _(spark, sf):
    """A page cut by its bytes."""
    return catalogue.change_feed(T.items(spark, sf), T.purged(spark, sf), 101, 2500, budget=9000)


@query("feed_union_purges", _FEED.format(limit=60, budget=10**9))
def _(spark, sf):
    """A page cut by its rows; entries of removed items have no content."""
    return catalogue.change_feed(T.items(spark, sf), T.purged(spark, sf), 101, 2500, limit=60)


@query("feed_high_water", f"WITH {T.ITEMS}, {T.PURGED} SELECT greatest((SELECT max(change_seq) FROM it), (SELECT max(purged_seq) FROM gone)) AS mark")
def _(spark, sf):
    return spark.createDataFrame([(catalogue.high_water_mark(T.items(spark, sf), T.purged(spark, sf)),)], "mark long")


@query(
    "hydrate_in_order",
    f"""WITH {T.ITEMS} SELECT conv_id * 8 + turn AS pos, id, name, row_number() OVER (ORDER BY conv_id * 8 + turn, id) - 1 AS place FROM conversations JOIN it ON id = conv_id * 13 % 1500 WHERE deleted_at IS NULL""",
)
def _(spark, sf):
    """Every turn as an id to hydrate; ``place`` is where the operator puts it."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 8 + F.col("turn")).alias("pos"), (F.col("conv_id") * 13 % 1500).alias("id"))
    rows = catalogue.hydrate(turns, T.items(spark, sf)).select("pos", "id", "name").coalesce(1)
    return rows.withColumn("place", F.monotonically_increasing_id())


# --- observations

@query("observe_known", f"WITH {T.ITEMS}, {T.SEEN} SELECT id, key FROM known")
def _(spark, sf):
    return maintain.observed_known(T.items(spark, sf), maintain.merge_observations(T.named_observations(spark, sf))).select("id", *_hex("key"))


def _observed(spark, sf, depth):
    return maintain.observe(T.items(spark, sf), T.named_queue(spark, sf), T.named_observations(spark, sf), T.as_of(), SEQ, depth, 100)


@query(
    "observe_items",
    f"""WITH {T.ITEMS}, {T.SEEN}, a AS (SELECT id, sum(n)::BIGINT AS n FROM known JOIN m USING (key) GROUP BY id),
    j AS (SELECT it.*, a.n, a.n IS NOT NULL AND xor(seen_count, seen_count + coalesce(a.n, 0)) > (seen_count & (seen_count + coalesce(a.n, 0))) AS moved FROM it LEFT JOIN a USING (id))
    SELECT id, (seen_count + coalesce(n, 0))::BIGINT AS seen_count, CASE WHEN n IS NULL THEN last_seen_at ELSE {NOW} END AS last_seen_at,
           CASE WHEN moved THEN {SEQ} + row_number() OVER (PARTITION BY moved ORDER BY id) ELSE change_seq END AS change_seq FROM j""",
)
def _(spark, sf):
    return _observed(spark, sf, 0)[0].select("id", "seen_count", "last_seen_at", "change_seq")


_UNKNOWN = "u AS (SELECT * FROM m WHERE key NOT IN (SELECT key FROM known))"


def _gated(name: str, depth: int, admitted: str):
    @query(
        f"observe_queue_{name}",
        f"""WITH {T.ITEMS}, {T.SEEN}, {T.NAMED_QUEUE}, {_UNKNOWN} SELECT coalesce(nq.key, u.key) AS key, (CASE WHEN nq.key IS NULL THEN n ELSE seen_count + coalesce(n, 0) END)::BIGINT AS seen_count
        FROM nq FULL JOIN u ON nq.key = u.key WHERE nq.key IS NOT NULL OR {admitted}""",
    )
    def _(spark, sf):
        return _observed(spark, sf, depth)[1].select(*_hex("key"), "seen_count")

    @query(
        f"observe_outcome_{name}",
        f"""WITH {T.ITEMS}, {T.SEEN}, {T.NAMED_QUEUE}, {_UNKNOWN}, c AS (SELECT count(*) FILTER (WHERE nq.key IS NULL AND ({admitted})) AS queued, count(*) FILTER (WHERE nq.key IS NULL AND NOT ({admitted})) AS dropped
        FROM u LEFT JOIN nq ON nq.key = u.key) SELECT (SELECT count(DISTINCT key) FROM known) AS known, queued, dropped FROM c""",
    )
    def _(spark, sf):
        return _observed(spark, sf, depth)[2]


_gated("open", 0, "true")
_gated("priority", 100, "priority")
_gated("closed", 200, "false")


# --- completion

def _completed(spark, sf):
    return maintain.complete_batch(T.items(spark, sf), T.named_queue(spark, sf), T.removal_memory(spark, sf), T.fetched(spark, sf), T.as_of(), ID, SEQ)


@query(
    "complete_batch_items",
    f"""WITH {T.ITEMS}, {T.FETCHED}, {T.NAMED_QUEUE}, s AS (SELECT ft.*, seen_count AS q FROM ft LEFT JOIN nq USING (key)),
    l AS (SELECT id, max(n) AS n, arg_max(name, n) AS name, arg_max(v1, n) AS v1, sum(CASE WHEN old OR chained THEN coalesce(q, 0) ELSE greatest(coalesce(q, 0), 1) END)::BIGINT AS more, arg_min(key, n) AS key FROM s GROUP BY id)
    SELECT coalesce(it.id, l.id) AS id, CASE WHEN it.id IS NULL THEN l.key ELSE it.key END AS key, CASE WHEN l.id IS NULL THEN it.v1 ELSE l.v1 END AS v1, coalesce(l.name, it.name) AS name,
           (coalesce(it.seen_count, 0) + coalesce(more, 0))::BIGINT AS seen_count, CASE WHEN l.id IS NULL THEN change_seq ELSE {SEQ} + l.n + 1 END AS change_seq, l.id IS NULL AND deleted_at IS NOT NULL AS removed
    FROM it FULL JOIN l ON it.id = l.id""",
)
def _(spark, sf):
    """Two keys of one item, items under other keys, and keys of items that are new in the batch."""
    return _completed(spark, sf)[0].select("id", *_hex("key", "v1"), "name", "seen_count", "change_seq", F.col("deleted_at").isNotNull().alias("removed"))


@query("complete_batch_stored", f"WITH {T.FETCHED}, {T.NAMED_QUEUE} SELECT n AS pos, id, (NOT old AND NOT chained) OR nq.key IS NOT NULL AS counted FROM ft LEFT JOIN nq ON nq.key = ft.key")
def _(spark, sf):
    return _completed(spark, sf)[3]


@query(
    "complete_batch_cleared",
    f"""WITH {T.ITEMS}, {T.FETCHED}, {T.NAMED_QUEUE}, {T.MEMORY}, c AS (SELECT key AS name FROM ft UNION SELECT v1 FROM ft UNION SELECT alias FROM names WHERE id IN (SELECT id FROM ft))
    SELECT 'queue' AS kind, key FROM nq WHERE key NOT IN (SELECT key FROM ft) UNION ALL SELECT 'removed', key FROM rm WHERE key NOT IN (SELECT name FROM c WHERE name IS NOT NULL)""",
)
def _(spark, sf):
    """What is left of the queue and of the removal memory."""
    _, queue, removed, _ = _completed(spark, sf)
    return queue.select(F.lit("queue").alias("kind"), *_hex("key")).unionByName(removed.select(F.lit("removed").alias("kind"), *_hex("key")))


# --- scrapes, removal

@query(
    "record_scrapes",
    f"""WITH {T.ITEMS}, s AS (SELECT l_orderkey AS id, arg_max(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1),
    j AS (SELECT it.*, part, CASE part % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' ELSE 'unknown' END AS verdict, part IS NOT NULL AND deleted_at IS NULL AS hit FROM it LEFT JOIN s USING (id))
    SELECT id, CASE WHEN hit THEN {NOW} ELSE last_scraped_at END AS last_scraped_at, CASE WHEN hit AND verdict = 'live' THEN (part % 50)::INT WHEN hit AND verdict = 'dead' THEN 0 ELSE seeders_est END AS seeders_est,
           CASE WHEN hit AND verdict = 'live' THEN 0 WHEN hit AND verdict = 'dead' THEN scrape_failures + 1 ELSE scrape_failures END AS scrape_failures, change_seq FROM j""",
)
def _(spark, sf):
    """Lines of orders as estimates; the last of an item counts."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    verdict = F.element_at(F.array(F.lit("live"), F.lit("dead"), F.lit("unknown")), (F.col("part") % 3 + 1).cast("int"))
    batch = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), verdict.alias("verdict"), (F.col("part") % 50).cast("int").alias("est"))
    return maintain.record_scrapes(T.items(spark, sf), batch, T.as_of()).select("id", "last_scraped_at", "seeders_est", "scrape_failures", "change_seq")


def _tombstoned(spark, sf):
    items = T.items(spark, sf)
    wanted = items.where("id % 10 = 0").select("id", "last_seen_at", F.when(F.col("id") % 20 == 0, F.col("change_seq") + 1).otherwise(F.col("change_seq")).alias("change_seq"))
    return maintain.tombstone(items, T.removal_memory(spark, sf), wanted, T.as_of(), SEQ)


_WON = "w AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM it WHERE id % 20 = 10 AND deleted_at IS NULL)"


@query(
    "tombstone",
    f"""WITH {T.ITEMS}, {_WON} SELECT id, CASE WHEN r IS NULL THEN name ELSE '' END AS name, CASE WHEN r IS NULL THEN file_count ELSE 0 END::BIGINT AS file_count, CASE WHEN r IS NULL THEN deleted_at ELSE {NOW} END AS deleted_at,
    CASE WHEN r IS NULL THEN change_seq ELSE {SEQ} + r END AS change_seq FROM it LEFT JOIN w USING (id)""",
)
def _(spark, sf):
    """Half of the wanted removals are of rows that have moved on, and of these none is made."""
    return _tombstoned(spark, sf)[0].select("id", "name", "file_count", "deleted_at", "change_seq")


@query(
    "tombstone_memory",
    f"""WITH {T.ITEMS}, {_WON}, {T.MEMORY}, k AS (SELECT DISTINCT alias FROM names WHERE id IN (SELECT id FROM w))
    SELECT coalesce(rm.key, alias) AS key, (coalesce(removals, 0) + CASE WHEN alias IS NULL THEN 0 ELSE 1 END)::INT AS removals, CASE WHEN alias IS NULL THEN sightings ELSE 0 END::BIGINT AS sightings FROM rm FULL JOIN k ON rm.key = alias""",
)
def _(spark, sf):
    return _tombstoned(spark, sf)[1].select(*_hex("key"), "removals", "sightings")


@query(
    "purge_biggest_first",
    f"""WITH {T.ITEMS}, g AS (SELECT id FROM it WHERE deleted_at < TIMESTAMP '1999-01-01' ORDER BY total_size DESC, id LIMIT 50)
    SELECT 'item' AS kind, id, 0::BIGINT AS seq FROM it WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'purged', id, {SEQ} + row_number() OVER (ORDER BY id) FROM g
    UNION ALL SELECT 'purged', c_custkey + 10000000, c_custkey * 2 + 1 FROM customer""",
)
def _(spark, sf):
    before = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    items, purged = maintain.purge(T.items(spark, sf), T.purged(spark, sf), before, 50, T.as_of(), SEQ)
    left = items.select(F.lit("item").alias("kind"), "id", F.lit(0).cast("long").alias("seq"))
    return left.unionByName(purged.select(F.lit("purged").alias("kind"), F.col("item_id").alias("id"), F.col("purged_seq").alias("seq")))


@query(
    "refresh_clock",
    f"""WITH {T.ITEMS}, {T.SEEN}, h AS (SELECT DISTINCT id FROM b JOIN names ON alias = key WHERE deleted_at IS NULL)
    SELECT it.id, CASE WHEN h.id IS NULL THEN last_scraped_at ELSE {NOW} END AS last_scraped_at, CASE WHEN h.id IS NULL THEN scrape_failures ELSE 0 END AS scrape_failures FROM it LEFT JOIN h ON it.id = h.id""",
)
def _(spark, sf):
    """Announces of seeds count as scrapes."""
    return maintain.refresh_clock(T.items(spark, sf), T.named_observations(spark, sf), T.as_of()).select("id", "last_scraped_at", "scrape_failures")


# --- index

_DOCS = "SELECT id, name, text AS files, total_size AS size, epoch(first_seen_at)::BIGINT AS created, seen_count AS seen, file_count FROM it WHERE deleted_at IS NULL"


@query("index_rebuild", f"WITH {T.ITEMS} {_DOCS}")
def _(spark, sf):
    root = Root(spark, shared.new_path(spark, "rebuilt"))
    projector.rebuild(root, T.items(spark, sf), T.purged(spark, sf))
    return projector.open_index(root).docs


@query(
    "index_follow",
    f"""WITH {T.ITEMS}, d AS ({_DOCS} AND id % 20 <> 10), tok AS (SELECT id, unnest(regexp_extract_all(lower(name), '[0-9a-z]+')) AS term FROM d) SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term""",
)
def _(spark, sf):
    """An index that has followed a removal: the terms of names that are left."""
    root = Root(spark, shared.new_path(spark, "followed"))
    projector.rebuild(root, T.items(spark, sf), T.purged(spark, sf))
    items, _ = shared.written(_tombstoned(spark, sf)[0], "items")
    projector.follow(root, items, T.purged(spark, sf))
    return projector.open_index(root).terms.where("field = 'name'").select("term", "df")
