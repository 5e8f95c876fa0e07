"""A set of seen keys in two generations: the older one is forgotten when the newer is full or has had its time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater import shared

CAPACITY, SECONDS = 2_000_000, 1800.0


@dataclass(frozen=True)
class Seen:
    """``current`` and ``previous`` (key); the time at which the current one began, and how many keys it has."""

    current: DataFrame
    previous: DataFrame
    began: float
    size: int = 0


def fresh(seen: Seen, batch: DataFrame) -> DataFrame:
    """The batch's rows with keys of neither generation."""
    return batch.join(seen.current, "key", "left_anti").join(seen.previous, "key", "left_anti")


def turned(seen: Seen, now: float, seconds: float = SECONDS) -> Seen:
    """The set after its time: the current generation is the previous one."""
    if now - seen.began < seconds:
        return seen
    return Seen(seen.current.limit(0), seen.current, now)


def entered(seen: Seen, batch: DataFrame, now: float, capacity: int = CAPACITY, seconds: float = SECONDS) -> Seen:
    """The set with the keys of a batch (key, n), in the order of n; called once the batch has been written, not before.

    A generation that is full gives way to the next key. A key that is in either generation is not entered again. Keys are
    numbered in one window over the batch.
    """
    seen = turned(seen, now, seconds)
    keys = fresh(seen, batch.groupBy("key").agg(F.min("n").alias("n")))
    placed = keys.withColumn("g", F.floor((F.lit(seen.size) + F.row_number().over(Window.orderBy("n", "key")) - 1) / capacity))
    placed, _ = shared.written(placed.select("key", "g"), "entered")
    told = placed.agg(F.max("g").alias("g"), F.count("*").alias("n")).first()
    if not told["n"]:
        return seen
    of = lambda g: placed.where(F.col("g") == g).select("key")
    if told["g"] == 0:
        current, previous, began, size = seen.current.unionByName(of(0)), seen.previous, seen.began, seen.size + told["n"]
    else:
        previous = seen.current.unionByName(of(0)) if told["g"] == 1 else of(told["g"] - 1)
        current, began, size = of(told["g"]), now, seen.size + told["n"] - told["g"] * capacity
    return Seen(shared.written(current, "current")[0], shared.written(previous, "previous")[0], began, size)
