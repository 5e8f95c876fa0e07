"""What leaves the engine: rows fit to display, JSON documents, totals, the address a request is counted for, cached pages."""

from __future__ import annotations

import ipaddress
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions import text as X

PATH_BUDGET = 128_000
MOST_FORWARDED = 64


def shown(items: DataFrame, with_files: bool = False, budget: int = PATH_BUDGET) -> DataFrame:
    """``items`` with ``shown_name``, ``magnet``, ``shown_files`` and ``shown_cut``: cleaned again, since names come from strangers.

    A name that cleans to nothing is the key in hex. Paths are listed as long as their characters are within the budget.
    """
    clean = F.when(X.is_ascii(F.col("name")), X.display_ascii(F.col("name"))).otherwise(X.display(F.col("name")))
    named = items.withColumn("__clean", clean)
    name = F.when(F.col("__clean") == "", F.lower(F.hex("key"))).otherwise(F.col("__clean"))
    out = named.withColumn("shown_name", name).withColumn("magnet", S.magnet(F.col("v1"), F.col("v2"), F.col("shown_name"))).drop("__clean")
    if not with_files:
        return out.withColumns({"shown_files": F.array().cast("array<struct<path:string,size:bigint>>"), "shown_cut": F.lit(False)})
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(a: Column, f: Column) -> Column:
        chars = a["chars"] + F.char_length(f["path"])
        on = a["on"] & (chars <= budget)
        return F.struct(F.when(on, chars).otherwise(a["chars"]).cast("long").alias("chars"), (a["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    n = F.aggregate("files", start, step)["n"]
    return out.withColumns({"shown_files": F.slice("files", 1, n), "shown_cut": F.size("files") > n})


def files_truncated() -> Column:
    """By the stored flag, by the display, or because fewer files are there than were counted."""
    return F.col("files_truncated") | F.col("shown_cut") | (F.size("shown_files") < F.col("file_count"))


def api_rows(items: DataFrame, as_of: Column, fresh_seconds: int) -> DataFrame:
    """(id, json): one document an item; an estimate, and its time, only while fresh."""
    estimate = S.fresh(F.col("seeders_est"), F.col("last_scraped_at"), as_of, fresh_seconds)
    hexed = lambda c: F.lower(F.hex(c))
    document = F.struct(
        hexed("key").alias("key"),
        hexed("v1").alias("v1"),
        hexed("v2").alias("v2"),
        F.col("shown_name").alias("name"),
        F.col("total_size").alias("size"),
        "file_count",
        S.rfc3339(F.col("first_seen_at")).alias("first_seen"),
        S.rfc3339(F.col("last_seen_at")).alias("last_seen"),
        "seen_count",
        estimate.alias("seeders_est"),
        F.when(estimate.isNotNull(), S.rfc3339(F.col("last_scraped_at"))).alias("last_scraped_at"),
        "magnet",
    )
    return shown(items).select("id", S.safe_json(F.to_json(document)).alias("json"))


def visible_total(index_total: int, hits: int, found: int) -> int:
    """The index' total without the hits of this page that are gone."""
    return max(index_total - (hits - found), 0)


def client_address(peer: str, forwarded: list[str], trusted: list[str]) -> str:
    """The peer, or, if that is a trusted proxy, the first untrusted address of the forwarded ones from the right.

    An entry that is no address ends the walk at the last trusted hop; if all are trusted it is the peer.
    """
    nets = [ipaddress.ip_network(t, strict=False) for t in trusted]

    def canonical(text: str):
        ip = ipaddress.ip_address(text.strip())
        return ip.ipv4_mapped or ip if ip.version == 6 else ip

    def is_trusted(ip) -> bool:
        mapped = ipaddress.IPv6Address(f"::ffff:{ip}") if ip.version == 4 else None
        return any(ip in n or (mapped is not None and mapped in n) for n in nets)

    first = last = canonical(peer)
    if not is_trusted(first):
        return str(first)
    entries = [e for line in reversed(forwarded) for e in reversed(line.split(","))]
    for entry in entries[:MOST_FORWARDED]:
        try:
            ip = canonical(entry)
        except ValueError:
            return str(last)
        if not is_trusted(ip):
            return str(ip)
        last = ip
    return str(last if len(entries) > MOST_FORWARDED else first)


class PageCache:
    """Pages by (query, sort, page, size, index version): the least recently used go, as do old ones and those of another version."""

    def __init__(self, size: int = 100, ttl: float = 900, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.version: Hashable = None
        self.pages: OrderedDict = OrderedDict()

    def get(self, key: Hashable, version: Hashable, make: Callable[[], list]) -> list:
        """The page, made if it isn't there. Only non-empty pages are kept; an error is not."""
        if version != self.version:
            self.pages.clear()
            self.version = version
        now = self.clock()
        if key in self.pages and now - self.pages[key][0] < self.ttl:
            self.pages.move_to_end(key)
            return self.pages[key][1]
        rows = make()
        self.pages.pop(key, None)
        if rows:
            self.pages[key] = (now, rows)
            while len(self.pages) > self.size:
                self.pages.popitem(last=False)
        return rows
