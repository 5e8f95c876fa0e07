"""Tables of nodes: which to refresh, ping, export or forget, ids near an own one, announce tokens, own addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_BITS, TOKEN_BYTES = 160, 8


def reject_own(peers: DataFrame, own: DataFrame, by_endpoint: bool = False) -> DataFrame:
    """``peers`` (ip, port) without those at an own address, or at an own address and port."""
    columns = ["ip", "port"] if by_endpoint else ["ip"]
    return peers.join(own.select(*columns).distinct(), columns, "left_anti")


def _byte(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")


def id_with_prefix(own: Column, bits: Column, noise: Column, flip_next: Column) -> Column:
    """A 20-byte id that has the first ``bits`` bits of ``own`` and the others of ``noise``; with ``flip_next`` the next bit differs."""
    bits = F.greatest(F.least(bits, F.lit(ID_BITS)), F.lit(0)).cast("int")

    def made(i: Column) -> Column:
        mine = F.greatest(F.least(bits - i * 8, F.lit(8)), F.lit(0))
        low = F.pow(F.lit(2), 8 - mine).cast("int") - 1
        value = _byte(own, i).bitwiseAND(F.lit(255) - low).bitwiseOR(_byte(noise, i).bitwiseAND(low))
        one = F.pow(F.lit(2), 7 - bits % 8).cast("int")
        flipped = value.bitwiseAND(F.lit(255) - one).bitwiseOR((F.lit(255) - _byte(own, i)).bitwiseAND(one))
        return F.lpad(F.hex(F.when(flip_next & (bits < ID_BITS) & (F.floor(bits / 8) == i), flipped).otherwise(value)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ID_BITS // 8 - 1)), made), ""))


def announce_token(secret: Column, ip: Column) -> Column:
    """The first 8 bytes of the SHA-1 of a secret and an address (4 or 16 bytes)."""
    return F.substring(F.unhex(F.sha1(F.concat(secret, ip))), 1, TOKEN_BYTES)


def token_valid(token: Column, ip: Column, current: Column, previous: Column) -> Column:
    """Is it a token of the current secret or of the one before?"""
    return F.coalesce((token == announce_token(current, ip)) | (token == announce_token(previous, ip)), F.lit(False))


def refresh_targets(buckets: DataFrame, own: Column, as_of: Column, interval_seconds: int, n: int, seed: int = 0) -> DataFrame:
    """(bucket, target): up to n buckets (bucket, last_changed) that have not changed for the interval, longest ago first, with an id inside each."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_changed").cast("timestamp"))
    last = buckets.agg(F.max("bucket").alias("last"))
    due = buckets.where(age >= interval_seconds).orderBy("last_changed", "bucket").limit(n).crossJoin(F.broadcast(last))  # by one row
    noise = F.unhex(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("bucket").cast("string"))))
    return due.select("bucket", id_with_prefix(own, F.col("bucket"), noise, F.col("bucket") < F.col("last")).alias("target"))


def ping_candidates(nodes: DataFrame, as_of: Column, interval_seconds: int, n: int) -> DataFrame:
    """Up to n nodes that are not good and were not pinged in the interval, those least recently active first, never active ones before."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_ping").cast("timestamp"))
    due = nodes.where((F.col("last_ping").isNull() | (age >= interval_seconds)) & (F.col("status") != "good"))
    return due.orderBy(F.col("last_active").asc_nulls_first(), "bucket", "place").limit(n)


def export(nodes: DataFrame, n: int) -> DataFrame:
    """Up to n confirmed nodes that are not bad: good ones first, then by the last response."""
    kept = nodes.where(F.col("confirmed") & (F.col("status") != "bad"))
    return kept.orderBy((F.col("status") == "good").desc(), F.col("last_response").desc_nulls_last(), "bucket", "place").limit(n)


def make_room(visited: DataFrame, needed: int, cap: int, now: int, reserved: int = 0) -> DataFrame:
    """``visited`` (key, next, in_flight) with room for ``needed`` more, where that can be: expired ones go first, then those whose next time is farthest.

    Ones in flight stay. Nothing goes if there is room. The surplus is a top-k.
    """
    if visited.count() + needed + reserved <= cap:
        return visited
    held = visited.where((F.col("next") > now) | F.col("in_flight"))
    surplus = held.count() + needed + reserved - cap
    if surplus <= 0:
        return held
    out = held.where(~F.col("in_flight") & (F.col("next") > now)).orderBy(F.col("next").desc(), "key").limit(surplus).select("key")
    return held.join(out, "key", "left_anti")
