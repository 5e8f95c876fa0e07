"""Evidence and distance over tables of nodes, votes and announces: votes, corroboration, subnets, XOR neighbours, iterative lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater import shared
from tidewater.functions import scalars as S
from tidewater.functions import sketches

K, ALPHA, ROUNDS, CANDIDATES, PER_SUBNET = 8, 3, 8, 128, 8
HINTS, HINT_KEYS, HINT_SECONDS = 8, 100_000, 300


def corroborated(df: DataFrame, key: str, network: str, most: int = 4) -> DataFrame:
    """(key, networks): distinct source networks, ``most`` at most."""
    return df.select(key, network).distinct().groupBy(key).agg(F.least(F.count(network), F.lit(most)).cast("long").alias("networks"))


def majority(votes: DataFrame, min_votes: int, ttl_seconds: int, as_of: Column) -> DataFrame:
    """The value that has at least ``min_votes`` and over two thirds of the current votes; a voter's last vote counts. At most one row."""
    live = votes.where(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) < ttl_seconds)
    last = live.groupBy("voter").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    counts = last.groupBy("value").agg(F.count("*").alias("votes"))
    total = counts.agg(F.sum("votes").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("votes") >= min_votes) & (3 * F.col("votes") > 2 * F.col("total"))).select("value", "votes", "total")  # by one row


def busiest(df: DataFrame, key: str, subnet: str, expires: str) -> DataFrame:
    """(key, subnet, n): each key's subnet with most entries, ties to the one with the oldest entry, then the least."""
    counts = df.groupBy(key, subnet).agg(F.count("*").alias("n"), F.min(expires).alias("oldest"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "oldest", F.col(subnet).alias("s"))).alias("b"))
    return best.select(key, F.col("b.s").alias(subnet), (-F.col("b.neg")).alias("n"))


def two_class_estimates(announces: DataFrame, as_of: Column, ttl_seconds: int = 2700) -> DataFrame:
    """(key, seeds, peers): estimates of live announces of both classes; a key without live ones is absent."""
    live = announces.where(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) < ttl_seconds)
    each = sketches.estimate(sketches.build(live, ["key", "seed"], "address"), ["key", "seed"])
    pick = lambda seed: F.coalesce(F.max(F.when(F.col("seed") == seed, F.col("estimate_floor"))), F.lit(0))
    return each.groupBy("key").agg(pick(True).alias("seeds"), pick(False).alias("peers"))


def closest(nodes: DataFrame, target: bytes, n: int = K) -> DataFrame:
    """(id, distance): the n nearest ids by XOR."""
    return nodes.select("id", S.xor_distance(F.col("id"), F.lit(bytearray(target))).alias("distance")).orderBy("distance").limit(n)


def candidates(nodes: DataFrame, target: bytes, per_subnet: int = PER_SUBNET, most: int = CANDIDATES) -> DataFrame:
    """The nearest ids, no more than ``per_subnet`` of one subnet."""
    placed = nodes.select("id", "subnet", S.xor_distance(F.col("id"), F.lit(bytearray(target))).alias("distance"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("subnet").orderBy("distance")))
    return ranked.where(F.col("rank") <= per_subnet).orderBy("distance").limit(most).select("id", "subnet", "distance")


def iterative_lookup(edges: DataFrame, seeds: DataFrame, target: bytes, alpha: int = ALPHA, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(id, distance, asked): the k nearest ids found by asking the ``alpha`` nearest unasked ones a round; ``edges``: id, neighbour.

    A round that finds nothing nearer asks all of the k nearest that are left, and ends the search if they know nothing nearer
    either. The state of a round, at most CANDIDATES rows, is a small table.
    """
    goal = F.lit(bytearray(target))
    known = seeds.select("id").distinct().withColumn("distance", S.xor_distance(F.col("id"), goal)).withColumn("asked", F.lit(False))
    sweep = False
    for _ in range(rounds):
        known, _path = shared.written(known.orderBy("distance").limit(CANDIDATES), "lookup")
        front = known.orderBy("distance").limit(k).where(~F.col("asked")) if sweep else known.where(~F.col("asked")).orderBy("distance").limit(alpha)
        front, _path = shared.written(front.select("id"), "front")
        if front.isEmpty():
            break
        before = known.agg(F.min("distance")).first()[0]
        heard = edges.join(F.broadcast(front), "id").select(F.col("neighbour").alias("id")).distinct()
        fresh = heard.join(known.select("id"), "id", "left_anti").withColumn("distance", S.xor_distance(F.col("id"), goal)).withColumn("asked", F.lit(False))
        marked = known.join(F.broadcast(front.withColumn("__a", F.lit(True))), "id", "left").select("id", "distance", (F.col("asked") | F.coalesce("__a", F.lit(False))).alias("asked"))
        known = marked.unionByName(fresh)
        known, _path = shared.written(known, "lookup")
        nearer = known.agg(F.min("distance")).first()[0] < before
        if sweep and not nearer:
            break
        sweep = not nearer
    return known.orderBy("distance").limit(k)


def union_peers(df: DataFrame, key: str, peer: str, order: str) -> DataFrame:
    """(key, peers): distinct peers in the order of first sight."""
    first = df.groupBy(key, peer).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", peer))), lambda x: x[peer]).alias("peers"))


def remember(hints: DataFrame, batch: DataFrame, as_of: Column, ttl_seconds: int = HINT_SECONDS, per_key: int = HINTS, most_keys: int = HINT_KEYS) -> DataFrame:
    """Hints (key, peer, at) with a batch added: a peer once, each for its time, the newest ``per_key`` of a key, and the ``most_keys`` keys last added to."""
    age = lambda at: F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    last = hints.select("key", "peer", "at").unionByName(batch.select("key", "peer", "at")).groupBy("key", "peer").agg(F.max("at").alias("at"))
    live = last.where(age(F.col("at")) < ttl_seconds * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("peer")))
    kept = live.withColumn("__r", rank).where(F.col("__r") <= per_key).drop("__r")
    used = kept.groupBy("key").agg(F.max("at").alias("used"))
    surplus = max(used.count() - most_keys, 0)
    if not surplus:
        return kept
    return kept.join(used.orderBy("used", "key").limit(surplus).select("key"), "key", "left_anti")


def take(hints: DataFrame, keys: DataFrame, as_of: Column, ttl_seconds: int = HINT_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(taken, hints): the live peers of the keys, newest first, and the hints without those keys."""
    names = keys.select("key").distinct()
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    live = hints.join(names, "key", "left_semi").where(age < ttl_seconds * 1_000_000)
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("at", "peer"))))  # at most ``per_key``
    return live.groupBy("key").agg(F.transform(newest, lambda x: x["peer"]).alias("peers")), hints.join(names, "key", "left_anti")


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, the same for the same seed: the least by a hash. A top-k; no row order matters."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def within_last(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``df`` with ``recent``: rows of its key in the ``seconds`` before and at it."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("recent", F.count("*").over(window))
