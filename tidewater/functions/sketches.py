"""The mergeable 2048-bit cardinality filter: two bits per address, from its SHA-1, as 32 words of 64 bits.

Everything is built in: a partial aggregate per task, 32 words a key in the shuffle, ``bit_or`` to merge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES, WORD = 2048, 2, 64
_SCALE = HASHES * math.log(1 - 1 / BITS)


def bit_places(address: Column) -> Column:
    """The two bits of an address in bytes: little-endian 16-bit numbers from its SHA-1, modulo the size."""
    digest = F.sha1(address)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    return F.array(*((byte(i) + byte(i + 1) * 256) % BITS for i in (0, 2)))


def build(df: DataFrame, keys: list[str], address: str) -> DataFrame:
    """Filters as rows (keys, word, bits): the form that merges. Null addresses count for nothing."""
    each = df.where(F.col(address).isNotNull()).select(*keys, F.explode(bit_places(F.col(address))).alias("__bit"))
    return each.groupBy(*keys, F.shiftright("__bit", 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, __bit % {WORD})")).alias("bits"))


def union(filters: DataFrame, keys: list[str]) -> DataFrame:
    """Any number of filters of a key as one."""
    return filters.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def estimate_from_zeros(zeros: Column) -> Column:
    """0 for an empty filter, null for a full one."""
    return F.when(zeros >= BITS, F.lit(0.0)).when(zeros > 0, F.log(zeros / F.lit(float(BITS))) / F.lit(_SCALE))


def estimate(filters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_set, estimate, floor of it). A key that is in no row has no filter, hence no estimate."""
    counted = filters.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("n_set"))
    value = estimate_from_zeros(F.lit(BITS) - F.col("n_set"))
    return counted.select(*keys, F.col("n_set").cast("long").alias("n_set"), value.alias("estimate"), F.floor(value).cast("long").alias("estimate_floor"))


def to_bytes(filters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filter): the 256 bytes, bit i of byte j being place 8 j + i."""
    words = filters.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # at most 32 entries
    hexed = lambda w: F.lpad(F.hex(F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))), 16, "0")
    turned = lambda h: F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substr(h, 2 * i + 1, F.lit(2))), "")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BITS // WORD - 1)), lambda w: turned(hexed(w))), "")
    return words.select(*keys, F.unhex(text).alias("filter"))


def from_bytes(df: DataFrame, keys: list[str], column: str = "filter") -> DataFrame:
    """The inverse of ``to_bytes``; anything but 256 bytes is no filter."""
    good = df.where(F.length(column) == BITS // 8).select(*keys, F.hex(column).alias("h"))
    each = good.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BITS // WORD - 1)), lambda w: F.substr("h", w * 16 + 1, F.lit(16)))).alias("word", "t"))
    high_low = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substr("t", 2 * i + 1, F.lit(2))), "")
    half = lambda a: F.conv(F.substr(high_low, F.lit(a), F.lit(8)), 16, 10).cast("long")
    return each.select(*keys, "word", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("bits")).where("bits <> 0")
