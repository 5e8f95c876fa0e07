"""Discoveries into the queue, as one streaming query: corroborate, deduplicate, gate, upsert by micro-batch.

Source rows: ``event_id, key, source, network, peer, ts``. Each batch is a new version of the tables (see ``sources.versions``),
and its number stands in the manifest, so a batch that Spark repeats after a failure is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions import scalars as S
from tidewater.operators import catalogue, maintain
from tidewater.sources.versions import Root
from tidewater.streaming import stateful

SCHEMA = "event_id long, key binary, source string, network long, peer string, ts timestamp"


def discoveries(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Landed discovery files as a stream; the bound on files is the backpressure."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def observations(batch: DataFrame, cap: int = 200) -> DataFrame:
    """(key, sightings, priority) of admitted events of one batch."""
    admitted = stateful.replay(batch, ["key"], "ts", ["event_id"], stateful.Corroboration())
    return stateful.first_seen_cap(admitted, cap).where("admitted").groupBy("key").agg(F.count("*").alias("sightings"), F.bool_or("priority").alias("priority"))


def past_cooldown(batch: DataFrame, removed: DataFrame, as_of, base_days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, held): keys that are not, and that are, within their removal's cooldown."""
    known = removed.select("key", "removed_at", "removals", F.col("sightings").alias("held_sightings"))
    left = S.cooldown_left(F.col("removals"), F.col("held_sightings"), F.col("priority"), F.col("removed_at"), as_of, base_days)
    joined = batch.join(known, "key", "left").withColumn("left", F.when(F.col("removals").isNull(), 0).otherwise(left).cast("long"))
    return joined.where("left = 0").select(*batch.columns), joined.where("left > 0").select(*batch.columns)


def apply(root: Root, batch: DataFrame, batch_id: int, most: int = 5_000_000, base_days: int = 7) -> None:
    """One micro-batch into the tables ``items``, ``queue`` and ``removed`` of a versioned root."""
    live = root.current()
    if live and root.manifest(live)["checkpoint"] >= batch_id:
        return
    old = root.read(live)
    as_of = F.lit(batch.agg(F.max("ts")).first()[0])
    kept, held = past_cooldown(observations(batch), old["removed"], as_of, base_days)
    last_seq = catalogue.high_water_mark(old["items"], old["purged"])
    depth = old["queue"].where(~F.col("gave_up")).count()
    items, queue, _ = maintain.observe(old["items"], old["queue"], kept, as_of, last_seq, depth, most)
    n = root.create_next()
    root.write(n, {"items": items, "queue": queue, "removed": maintain.note_sightings(old["removed"], held), "purged": old["purged"]}, batch_id)
    root.promote(n, live)


def start(events: DataFrame, root: Root, checkpoint: str, **options) -> StreamingQuery:
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, i: apply(root, batch, i + 1, **options)).start()
