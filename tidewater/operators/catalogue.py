"""Reading the catalogue: visibility, key lookup, file lists, hydration, the change feed and statistics.

Item rows have ``id, key, v1, v2, name, total_size, file_count, files array<struct<path,size>>, files_truncated, seen_count,
first_seen_at, last_seen_at, change_seq, deleted_at, last_scraped_at, seeders_est, scrape_failures`` (see ``schemas``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEED_ROWS, FEED_BYTES = 1000, 64 << 20
PAGE_IDS = 10_000
LIST_FILES, DETAIL_FILES, DETAIL_BYTES = 10, 2000, 256 << 10


def visible(items: DataFrame) -> DataFrame:
    return items.where(F.col("deleted_at").isNull())


def aliases(items: DataFrame) -> DataFrame:
    """(alias, id): the up to three 20-byte names of every item. An equi-join on it stands for an OR over three columns."""
    names = F.array_distinct(F.array_compact(F.array("key", "v1", F.substring("v2", 1, 20))))
    return items.select(F.explode(names).alias("alias"), "id")


def lookup(items: DataFrame, key: bytes) -> DataFrame:
    """The visible item that a 20-byte key (stored key first, else v1) or a 32-byte hash names; at most one row."""
    k = F.lit(bytearray(key))
    match = F.col("v2") == k if len(key) == 32 else (F.col("key") == k) | (F.col("v1") == k)
    return visible(items).where(match).orderBy((F.col("key") == k).desc(), "id").limit(1)


# --- file lists: a row's array is never exploded, so nothing is shuffled

def first_files(files: Column, n: int = LIST_FILES) -> Column:
    """struct<files, cut>: the first n."""
    return F.struct(F.slice(F.coalesce(files, F.array().cast(_FILES)), 1, n).alias("files"), (F.coalesce(F.size(files), F.lit(0)) > n).alias("cut"))


_FILES = "array<struct<path:string,size:bigint>>"


def budget_files(files: Column, budget: int = DETAIL_BYTES, most: int = DETAIL_FILES) -> Column:
    """struct<files, cut>: the first ones whose paths hold at most ``budget`` bytes together."""
    files = F.coalesce(files, F.array().cast(_FILES))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(a: Column, f: Column) -> Column:
        total = a["bytes"] + F.octet_length(f["path"])
        on = a["on"] & (total <= budget) & (a["n"] < most)
        return F.struct(F.when(on, total).otherwise(a["bytes"]).cast("long").alias("bytes"), (a["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    n = F.aggregate(files, start, step)["n"]
    return F.struct(F.slice(files, 1, n).alias("files"), (F.size(files) > n).alias("cut"))


def files_text(files: Column) -> Column:
    """Paths in order, one a line."""
    return F.coalesce(F.array_join(F.transform(files, lambda f: f["path"]), "\n"), F.lit(""))


def smallest_files(files: Column, n: int = DETAIL_FILES) -> Column:
    """The n least by (path, size), sorted."""
    return F.slice(F.array_sort(files), 1, n)


# --- hydration

def hydrate(ids: DataFrame, items: DataFrame, pos: str = "pos", id_: str = "id") -> DataFrame:
    """Items in the order of ``ids`` (pos, id): missing and invisible ones drop out, repeated ones repeat.

    A page of up to ``PAGE_IDS`` ids is broadcast, any other list is joined by a shuffle.
    """
    wanted = ids.select(pos, id_)
    small = wanted.limit(PAGE_IDS + 1).count() <= PAGE_IDS
    return (F.broadcast(wanted) if small else wanted).join(visible(items), id_).orderBy(pos, id_)


# --- change feed

def change_feed(items: DataFrame, purged: DataFrame, after: int, upto: int, limit: int = FEED_ROWS, budget: int = FEED_BYTES) -> DataFrame:
    """Changes in (after, upto] in order: at most ``limit``, and those before which the rows hold under ``budget`` bytes.

    The range is pushed to the scans and the page is cut by ids before payloads are joined; the running sum is over a page.
    """
    inside = lambda c: (F.col(c) > after) & (F.col(c) <= upto)
    size = F.octet_length("name") + F.octet_length(files_text(F.col("files")))
    live = items.where(inside("change_seq")).select(F.col("change_seq").alias("seq"), "id", size.cast("long").alias("bytes"))
    gone = purged.where(inside("purged_seq")).select(F.col("purged_seq").alias("seq"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("bytes"))
    page = live.unionByName(gone).orderBy("seq").limit(min(limit, FEED_ROWS))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = page.withColumn("before", before).where(F.col("before") < budget).select("seq", "id")
    joined = F.broadcast(page).join(items, "id", "left")
    return joined.select("seq", "id", (F.col("change_seq").isNotNull() & F.col("deleted_at").isNull()).alias("visible"), *index_columns()).orderBy("seq")


def index_columns() -> list[Column]:
    """What the index holds of an item; dummies for a purged one."""
    return [
        F.coalesce("name", F.lit("")).alias("name"),
        files_text(F.col("files")).alias("files"),
        F.coalesce("total_size", F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.unix_seconds(F.col("first_seen_at").cast("timestamp")), F.lit(0)).alias("created"),
        F.coalesce("seen_count", F.lit(0)).cast("long").alias("seen"),
        F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"),
    ]


def high_water_mark(items: DataFrame, purged: DataFrame) -> int:
    """The last sequence number of a committed version; 0 for none."""
    each = items.agg(F.max("change_seq").alias("m")).unionByName(purged.agg(F.max("purged_seq").alias("m")))
    return each.agg(F.coalesce(F.max("m"), F.lit(0)).alias("m")).first()["m"]


def unnest(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of one length as rows, in order, beside the other columns; ``at`` counts from 0."""
    others = [c for c in df.columns if c not in arrays]
    return df.select(*others, F.posexplode(F.arrays_zip(*arrays)).alias("at", "__z")).select(*others, "at", *(F.col(f"__z.{a}").alias(a) for a in arrays))


# --- statistics

def daily(days: DataFrame, today: Column, n: int) -> DataFrame:
    """The last n (at most 366) UTC days that have counts, oldest first."""
    n = max(0, min(n, 366))
    return days.where((F.col("day") > F.date_sub(today, n)) & (F.col("day") <= today)).orderBy("day")


def today_and_yesterday(days: DataFrame, today: Column, counter: str) -> DataFrame:
    """One row: totals of both days, 0 where there is none."""
    on = lambda k: F.coalesce(F.sum(F.when(F.col("day") == F.date_sub(today, k), F.col(counter))), F.lit(0)).cast("long")
    return days.agg(on(0).alias("today"), on(1).alias("yesterday"))


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(~F.col("gave_up")).alias("pending"), F.count_if(F.col("gave_up")).alias("gave_up"))


def bounded_count(df: DataFrame, most: int) -> DataFrame:
    """How many rows, counting no further than ``most``."""
    return df.select(F.lit(1).alias("one")).limit(most).agg(F.count("one").alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts (le, n) for the bounds and infinity, in one pass."""
    counts = df.agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*rows, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))).alias("r")).select("r.le", "r.n")


def outcome_counts(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows by outcome and estimate bucket."""
    return df.groupBy("outcome", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def share(df: DataFrame, condition: Column) -> DataFrame:
    """Share of rows that meet a condition; null without rows."""
    return df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))
