"""Changing the catalogue: observations, the lease queue, completed items, scrapes, tombstones, purges, removal memory.

Each operator is (tables, batch, as_of) -> new tables. Tables are Parquet versions (see ``sources.versions``), so an upsert is a
full outer join on the key and a rewrite. ``as_of`` is a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.operators import catalogue

MOST_CLAIMED = 10_000
MOST_COMPLETED = 1024
#: Characters of an audit row's texts, least and most.
AUDIT = {"actor": (1, 128), "action": (1, 64), "subject": (0, 256)}


def _numbered(df: DataFrame, order: list[Column | str], base: Column, name: str) -> DataFrame:
    """Sequence numbers after ``base``. The batch, not the table, is in one window."""
    return df.withColumn(name, base + F.row_number().over(Window.orderBy(*order)))


# --- observations

def merge_observations(batch: DataFrame) -> DataFrame:
    """(key, sightings, priority): one row a key; sightings under 1 are ignored; sums saturate."""
    total = F.sum(F.col("sightings").cast("decimal(38,0)"))
    return batch.where("sightings > 0").groupBy("key").agg(F.least(total, F.lit(S.MAX_LONG).cast("decimal(38,0)")).cast("long").alias("sightings"), F.bool_or("priority").alias("priority"))


def observed_known(items: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, key): live items that keys of the batch name, by the stored key if one has it, else by any alias."""
    live = catalogue.visible(items)
    exact = batch.join(live.select("key", "id"), "key").select("id", "key")
    rest = batch.join(exact.select("key").distinct(), "key", "left_anti")
    other = rest.join(catalogue.aliases(live), rest["key"] == F.col("alias")).select("id", "key").distinct()
    return exact.unionByName(other)


def bump_seen(items: DataFrame, batch: DataFrame, as_of: Column, last_seq: int) -> DataFrame:
    """Items with sightings added; ``change_seq`` moves only where the count's highest bit does.

    Two keys of a batch that name one item both count.
    """
    known = observed_known(items, batch).join(batch.select("key", "sightings"), "key")
    added = known.groupBy("id").agg(F.sum(F.col("sightings").cast("decimal(38,0)")).alias("n"))
    added = added.select("id", F.least("n", F.lit(S.MAX_LONG).cast("decimal(38,0)")).cast("long").alias("__n"))
    joined = items.join(added, "id", "left")
    new = S.saturating_add(F.col("seen_count"), F.col("__n"))
    moved = F.col("__n").isNotNull() & S.bucket_changed(F.col("seen_count"), new)
    numbers = _numbered(joined.where(moved).select("id"), ["id"], F.lit(last_seq).cast("long"), "__seq")
    return (
        joined.join(numbers, "id", "left")
        .withColumn("seen_count", F.coalesce(F.when(F.col("__n").isNotNull(), new), "seen_count"))
        .withColumn("last_seen_at", F.when(F.col("__n").isNotNull(), as_of).otherwise(F.col("last_seen_at")))
        .withColumn("change_seq", F.coalesce("__seq", "change_seq"))
        .select(*items.columns)
    )


def gate(depth: int, most: int) -> str:
    """open; priority_only from ``most``; closed from twice that."""
    return "closed" if depth >= 2 * most else "priority_only" if depth >= most else "open"


def enqueue(queue: DataFrame, unknown: DataFrame, as_of: Column, state: str = "open") -> DataFrame:
    """The queue with keys of the batch added or counted, and ``__change``: inserted, counted, or null. Shut keys are in neither."""
    batch = unknown.select("key", "sightings", "priority")
    both = queue.join(batch, "key", "full_outer")
    fresh = F.col("discovered_at").isNull()
    admitted = F.lit(True) if state == "open" else F.col("priority") if state == "priority_only" else F.lit(False)
    kept = both.where(~fresh | admitted)
    change = F.when(fresh, "inserted").when(F.col("sightings").isNotNull(), "counted")
    count = F.when(fresh, F.col("sightings")).when(F.col("sightings").isNotNull(), S.saturating_add(F.col("seen_count"), F.col("sightings"))).otherwise(F.col("seen_count"))
    return kept.select(
        "key",
        F.coalesce("discovered_at", as_of).alias("discovered_at"),
        count.alias("seen_count"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("next_attempt_at", as_of).alias("next_attempt_at"),
        "lease_until",
        "last_attempt_at",
        F.coalesce("gave_up", F.lit(False)).alias("gave_up"),
        "seeders_est",
        change.alias("__change"),
    )


def observe(items: DataFrame, queue: DataFrame, batch: DataFrame, as_of: Column, last_seq: int, depth: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, queue, outcome): the whole rule; outcome is one row of known, queued, dropped. Tombstoned items fall through to the queue."""
    merged = merge_observations(batch)
    known = observed_known(items, merged).select("key").distinct()
    unknown = merged.join(known, "key", "left_anti")
    queued = enqueue(queue, unknown, as_of, gate(depth, most))
    counts = known.agg(F.count("*").alias("known")).crossJoin(queued.agg(F.count_if(F.col("__change") == "inserted").alias("queued"), F.count_if(F.col("__change") == "counted").alias("c")))
    counts = counts.crossJoin(unknown.agg(F.count("*").alias("u"))).select("known", "queued", (F.col("u") - F.col("queued") - F.col("c")).alias("dropped"))  # one row each
    return bump_seen(items, merged, as_of, last_seq), queued.drop("__change"), counts


# --- lease queue

def claimable(as_of: Column) -> Column:
    return ~F.col("gave_up") & (F.col("next_attempt_at") <= as_of) & (F.col("lease_until").isNull() | (F.col("lease_until") <= as_of))


def claim(queue: DataFrame, n: int, as_of: Column, live_only: bool = False) -> DataFrame:
    """The n keys that are due first: fewest attempts, highest estimate (unknown last), longest due, key."""
    due = queue.where(claimable(as_of))
    due = due.where("seeders_est > 0") if live_only else due
    return due.orderBy(F.col("attempts").asc(), F.col("seeders_est").desc_nulls_last(), F.col("next_attempt_at").asc(), F.col("key").asc()).limit(min(n, MOST_CLAIMED))


def claim_live_first(queue: DataFrame, n: int, as_of: Column) -> DataFrame:
    """Live keys first, then others, each in claim order: two blocks by one top-k."""
    block = F.when(F.col("seeders_est") > 0, 0).otherwise(1)
    order = [block, F.col("attempts").asc(), F.col("seeders_est").desc_nulls_last(), F.col("next_attempt_at").asc(), F.col("key").asc()]
    return queue.where(claimable(as_of)).orderBy(*order).limit(min(n, MOST_CLAIMED))


def _touched(queue: DataFrame, keys: DataFrame) -> DataFrame:
    return queue.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")


def lease(queue: DataFrame, claimed: DataFrame, until: Column) -> DataFrame:
    return _touched(queue, claimed).withColumn("lease_until", F.when(F.col("__hit"), until).otherwise(F.col("lease_until"))).select(*queue.columns)


def renew(queue: DataFrame, keys: DataFrame, until: Column, as_of: Column) -> DataFrame:
    """Longer leases, never shorter, and none that has run out."""
    on = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("lease_until") > as_of) & ~F.col("gave_up")
    return _touched(queue, keys).withColumn("lease_until", F.when(on, F.greatest("lease_until", until)).otherwise(F.col("lease_until"))).select(*queue.columns)


def fail(queue: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """One more attempt each, later next time; given up at the last. Rows already given up stay."""
    on = F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col("gave_up")
    attempts = F.col("attempts") + 1
    at = as_of.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), S.backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return (
        _touched(queue, keys)
        .withColumns(
            {
                "next_attempt_at": F.when(on, at).otherwise(F.col("next_attempt_at")),
                "gave_up": F.when(on, S.gives_up(attempts)).otherwise(F.col("gave_up")),
                "lease_until": F.when(on, F.lit(None)).otherwise(F.col("lease_until")),
                "last_attempt_at": F.when(on, as_of).otherwise(F.col("last_attempt_at")),
                "attempts": F.when(on, attempts).otherwise(F.col("attempts")),
            }
        )
        .select(*queue.columns)
    )


def give_up(queue: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    on = F.coalesce(F.col("__hit"), F.lit(False))
    changed = {"gave_up": F.col("gave_up") | on, "lease_until": F.when(on, F.lit(None)).otherwise(F.col("lease_until")), "last_attempt_at": F.when(on, as_of).otherwise(F.col("last_attempt_at"))}
    return _touched(queue, keys).withColumns(changed).select(*queue.columns)


def purge_given_up(queue: DataFrame, before: Column) -> DataFrame:
    """Without rows given up that long ago, or never stamped."""
    return queue.where(~(F.col("gave_up") & (F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") < before))))


# --- completed items

CONTENT = ("v1", "v2", "name", "total_size", "file_count", "files", "files_truncated", "piece_length")


def item_errors(name: Column, files: Column, total_size: Column, file_count: Column, piece_length: Column) -> Column:
    """Names of the rules that an item breaks."""
    checks = {
        "name": F.char_length(name).between(1, 1024),
        "files": F.size(files) <= 2000,
        "paths": F.forall(files, lambda f: F.char_length(f["path"]) <= 4096),
        "sizes": (total_size >= 0) & (file_count >= 0) & F.forall(files, lambda f: f["size"] >= 0),
        "piece_length": piece_length.isNull() | (piece_length > 0),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name_) for name_, ok in checks.items())))


def resolve(batch: list[dict], stored: list[dict], last_id: int) -> tuple[list[dict], set[bytes]]:
    """For each fetched item, in order: the row it goes to (``id``, ``fresh``), the hashes that row then has, and whether it takes the
    queue's row; and all names whose removal is forgotten.

    An item goes to the row with its key, else to the least one with one of its hashes, as the rows are after the items before
    it; else it is a new row. A hash that another of these rows owns is not taken over, the row then keeps its own.
    """
    rows = {r["id"]: dict(r) for r in stored}
    owners: dict[tuple, set[int]] = {}
    for r in stored:
        for kind in ("key", "v1", "v2"):
            owners.setdefault((kind, r[kind]), set()).add(r["id"])
    steps, names, taken = [], set(), set()
    for item in batch:
        met = sorted(set().union(*(owners.get((k, item[k]), ()) for k in ("key", "v1", "v2") if item[k] is not None)))
        named = [item, *(rows[i] for i in met)]
        names |= {n for r in named for n in (r["key"], r["v1"], r["v2"] and r["v2"][:20]) if n is not None}
        fresh = not met
        if fresh:
            last_id += 1
            at = last_id
            rows[at] = {"id": at, "key": item["key"], "v1": None, "v2": None}
            owners.setdefault(("key", item["key"]), set()).add(at)
        else:
            at = next((i for i in met if rows[i]["key"] == item["key"]), met[0])
        for h in ("v1", "v2"):
            if item[h] is None or not any(i != at and rows[i][h] == item[h] for i in met):
                owners.setdefault((h, rows[at][h]), set()).discard(at)
                rows[at][h] = item[h]
                owners.setdefault((h, item[h]), set()).add(at)
        steps.append({"pos": item["pos"], "id": at, "fresh": fresh, "v1": rows[at]["v1"], "v2": rows[at]["v2"], "takes": item["key"] not in taken})
        taken.add(item["key"])
    return steps, names


def complete_batch(
    items: DataFrame, queue: DataFrame, removed: DataFrame, batch: DataFrame, as_of: Column, last_id: int, last_seq: int, most: int = MOST_COMPLETED
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, queue, removed, stored) after storing fetched items (``pos``, key and CONTENT) one after the other by ``pos``.

    ``resolve`` says which row an item goes to. A row's first sighting stays, sightings of the queue row are added, a tombstone is
    revived, and ``change_seq`` moves only with content, to the number of the last item that changed it. Queue rows of the
    keys and removal memory of all names go. ``stored``: pos, id and whether the item counts as fetched. The names of a
    batch of at most ``most`` items come to the driver, contents do not. An invalid item, or a longer batch, is an error.
    """
    spark = batch.sparkSession
    broken = item_errors(F.col("name"), F.col("files"), F.col("total_size"), F.col("file_count"), F.col("piece_length"))
    given = [r.asDict() for r in batch.select("pos", "key", "v1", "v2", broken.alias("errors")).orderBy("pos").limit(most + 1).collect()]
    if len(given) > most:
        raise ValueError(f"a batch has at most {most} items")
    if bad := [g["pos"] for g in given if g["errors"] or g["key"] is None]:
        raise ValueError(f"invalid items at {bad[:10]}")
    kinds = ("key", "v1", "v2")
    mine = F.broadcast(batch.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds))).alias("n")).select("n.*").distinct())
    each = items.select("id", *kinds, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds))).alias("n")).select("id", *kinds, "n.*")
    met = each.join(mine, ["kind", "name"]).select("id", *kinds).distinct()  # a name has one owner: three rows an item at most
    plain = lambda r: {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()}
    steps, names = resolve([plain(g) for g in given], [plain(r.asDict()) for r in met.collect()], last_id)
    schema = f"pos {dict(batch.dtypes)['pos']}, id long, fresh boolean, v1 {dict(items.dtypes)['v1']}, v2 {dict(items.dtypes)['v2']}, takes boolean"
    plan = F.broadcast(spark.createDataFrame([tuple(s.values()) for s in steps], schema))
    gone = F.broadcast(spark.createDataFrame([(n,) for n in sorted(names)], f"key {dict(items.dtypes)['key']}"))
    waiting = queue.select("key", F.col("seen_count").alias("q_seen"), F.col("discovered_at").alias("q_at"))
    fetched = batch.select("pos", "key", *(c for c in CONTENT if c not in kinds)).join(plan, "pos").join(waiting, "key", "left")
    fetched = fetched.withColumns({c: F.when(F.col("takes"), F.col(c)) for c in ("q_seen", "q_at")})
    # Contents one after the other, the stored one first; a row's content is compared with that before it.
    before = items.join(F.broadcast(plan.select("id").distinct()), "id", "left_semi").select("id", F.lit(-1).cast("long").alias("n"), F.struct(*CONTENT).alias("content"))
    order = spark.createDataFrame([(s["pos"], n) for n, s in enumerate(steps)], f"pos {dict(batch.dtypes)['pos']}, n long")
    after = fetched.join(F.broadcast(order), "pos").select("id", "n", F.struct(*CONTENT).alias("content"), "pos", "key", "fresh", "q_seen", "q_at")
    line = before.unionByName(after, allowMissingColumns=True).withColumn("was", F.lag("content").over(Window.partitionBy("id").orderBy("n")))
    moved = (F.col("n") >= 0) & ~F.col("content").eqNullSafe(F.col("was"))
    numbered = line.withColumn("moved", moved).withColumn("seq", F.when(F.col("moved"), F.lit(last_seq) + F.sum(F.col("moved").cast("long")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))))
    seen = F.when(F.col("fresh"), F.greatest(F.coalesce("q_seen", F.lit(0)), F.lit(1))).otherwise(F.coalesce("q_seen", F.lit(0)))
    last = numbered.where("n >= 0").groupBy("id").agg(
        F.max_by("content", "n").alias("c"), F.max("seq").alias("new_seq"), F.sum(seen.cast("decimal(38,0)")).alias("more"), F.min_by(F.struct("key", "q_at"), "n").alias("first")
    )
    last = last.withColumn("more", F.least("more", F.lit(S.MAX_LONG).cast("decimal(38,0)")).cast("long")).withColumnRenamed("id", "new_id")
    both = items.join(last, F.col("id") == F.col("new_id"), "full_outer")
    hit, new = F.col("new_id").isNotNull(), F.col("id").isNull()
    kept = {c: F.when(hit, F.col(f"c.{c}")).otherwise(F.col(c)) for c in CONTENT}
    kept |= {
        "id": F.coalesce("id", "new_id"),
        "key": F.when(new, F.col("first.key")).otherwise(F.col("key")),
        "seen_count": F.when(new, F.col("more")).when(hit, S.saturating_add(F.col("seen_count"), F.col("more"))).otherwise(F.col("seen_count")),
        "first_seen_at": F.when(new, F.coalesce("first.q_at", as_of)).otherwise(F.col("first_seen_at")),
        "last_seen_at": F.when(hit, as_of).otherwise(F.col("last_seen_at")),
        "deleted_at": F.when(hit, F.lit(None)).otherwise(F.col("deleted_at")),
        "change_seq": F.coalesce("new_seq", "change_seq"),
        "scrape_failures": F.coalesce("scrape_failures", F.lit(0)),
    }
    types = dict(items.dtypes)
    stored = fetched.select("pos", "id", (F.col("fresh") | F.col("q_seen").isNotNull()).alias("counted"))
    keys = F.broadcast(batch.select("key").distinct())
    return both.select(*(kept.get(c, F.col(c)).cast(types[c]).alias(c) for c in items.columns)), queue.join(keys, "key", "left_anti"), removed.join(gone, "key", "left_anti"), stored


def complete(items: DataFrame, queue: DataFrame, removed: DataFrame, batch: DataFrame, as_of: Column, last_id: int, last_seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, queue, removed) of ``complete_batch``, with the batch in the order of its keys."""
    ordered = batch.withColumn("pos", F.row_number().over(Window.orderBy("key")).cast("long"))
    return complete_batch(items, queue, removed, ordered, as_of, last_id, last_seq)[:3]


def complete_each(items: DataFrame, queue: DataFrame, removed: DataFrame, batch: DataFrame, as_of: Column, last_id: int, last_seq: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ``complete_batch`` with the valid items; keys of the invalid ones give up at once and are returned with their errors."""
    broken = item_errors(F.col("name"), F.col("files"), F.col("total_size"), F.col("file_count"), F.col("piece_length"))
    judged = batch.withColumn("errors", F.when(F.col("key").isNull(), F.array(F.lit("key"))).otherwise(broken))
    bad = judged.where(F.size("errors") > 0).select("pos", "key", "errors")
    done = complete_batch(items, queue, removed, judged.where(F.size("errors") == 0).drop("errors"), as_of, last_id, last_seq)
    return done[0], give_up(done[1], bad, as_of), done[2], done[3], bad


def last_wins(batch: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """One row a key: the value at the greatest position."""
    return batch.groupBy(key).agg(F.max_by(value, position).alias(value))


# --- scrapes, tombstones, purges

def scrape_due(items: DataFrame, n: int, as_of: Column, unknown_seconds: int, live_seconds: int) -> DataFrame:
    """Live items to scrape: never scraped, or unknown or estimated for longer than their interval; longest ago first."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_scraped_at").cast("timestamp"))
    due = F.col("last_scraped_at").isNull() | (F.col("seeders_est").isNull() & (age > unknown_seconds)) | (F.col("seeders_est").isNotNull() & (age > live_seconds))
    return catalogue.visible(items).where(due).orderBy(F.col("last_scraped_at").asc_nulls_first(), "id").limit(n)


def record_scrapes(items: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Estimates (id, pos, verdict, est), the last of an id: live resets failures, dead adds one, unknown keeps all.

    Statistics never move ``change_seq``, and leave tombstones alone.
    """
    last = batch.groupBy("id").agg(F.max_by(F.struct("verdict", "est"), "pos").alias("__s"))
    joined = items.join(last, "id", "left")
    on = F.col("__s").isNotNull() & F.col("deleted_at").isNull()
    v = F.col("__s.verdict")
    return joined.withColumns(
        {
            "last_scraped_at": F.when(on, as_of).otherwise(F.col("last_scraped_at")),
            "seeders_est": F.when(on & (v == "live"), F.col("__s.est")).when(on & (v == "dead"), 0).otherwise(F.col("seeders_est")).cast("int"),
            "scrape_failures": F.when(on & (v == "live"), 0).when(on & (v == "dead"), F.col("scrape_failures") + 1).otherwise(F.col("scrape_failures")).cast("int"),
        }
    ).select(*items.columns)


def tombstone(items: DataFrame, removed: DataFrame, batch: DataFrame, as_of: Column, last_seq: int) -> tuple[DataFrame, DataFrame]:
    """(items, removed): compare-and-set wipe of (id, last_seen_at, change_seq); a row that has moved on stays, and is not remembered."""
    won = batch.join(catalogue.visible(items), ["id", "last_seen_at", "change_seq"], "left_semi").select("id").distinct()
    numbers = _numbered(won, ["id"], F.lit(last_seq).cast("long"), "__seq")
    joined = items.join(numbers, "id", "left")
    hit = F.col("__seq").isNotNull()
    empty = F.array().cast(dict(items.dtypes)["files"])
    wiped = joined.withColumns(
        {
            "name": F.when(hit, "").otherwise(F.col("name")),
            "files": F.when(hit, empty).otherwise(F.col("files")),
            "total_size": F.when(hit, 0).otherwise(F.col("total_size")).cast("long"),
            "file_count": F.when(hit, 0).otherwise(F.col("file_count")).cast("long"),
            "deleted_at": F.when(hit, as_of).otherwise(F.col("deleted_at")),
            "change_seq": F.coalesce("__seq", "change_seq"),
        }
    ).select(*items.columns)
    names = catalogue.aliases(items.join(won, "id", "left_semi")).select(F.col("alias").alias("key")).distinct()
    return wiped, note_removals(removed, names, as_of)


def note_removals(removed: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """Removal memory with one more removal of each key, its sightings forgotten."""
    both = removed.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "full_outer")
    return both.select(
        "key",
        F.when(F.col("__hit"), as_of).otherwise(F.col("removed_at")).alias("removed_at"),
        (F.coalesce("removals", F.lit(0)) + F.when(F.col("__hit"), 1).otherwise(0)).cast("int").alias("removals"),
        F.when(F.col("__hit"), 0).otherwise(F.col("sightings")).cast("long").alias("sightings"),
    )


def note_sightings(removed: DataFrame, batch: DataFrame) -> DataFrame:
    """Sightings added to rows that exist."""
    added = batch.groupBy("key").agg(F.sum("sightings").alias("__n"))
    joined = removed.join(added, "key", "left")
    return joined.withColumn("sightings", S.saturating_add(F.col("sightings"), F.coalesce("__n", F.lit(0)))).select(*removed.columns)


def trim_oldest(removed: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows, the newest (ties by key); a negative cap keeps all. The surplus is a top-k, so nothing is sorted whole."""
    surplus = max(removed.count() - cap, 0) if cap >= 0 else 0
    if not surplus:
        return removed
    oldest = removed.orderBy(F.col("removed_at").asc(), F.col("key").asc()).limit(surplus).select("key")
    return removed.join(oldest, "key", "left_anti")


def purge(items: DataFrame, purged: DataFrame, before: Column, n: int, as_of: Column, last_seq: int, keep_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(items, purged): up to n tombstones older than the grace, biggest first, move to the purge feed, from which old entries go."""
    gone = items.where(F.col("deleted_at") < before).orderBy(F.col("total_size").desc(), "id").limit(n).select("id")
    entries = _numbered(gone, ["id"], F.lit(last_seq).cast("long"), "purged_seq").select(F.col("id").alias("item_id"), "purged_seq", as_of.alias("purged_at"))
    old = F.col("purged_at") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(keep_days))
    return items.join(gone, "id", "left_anti"), purged.where(~old).unionByName(entries)


def refresh_clock(items: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """A seed announced itself: live items of any alias count as scraped now, without failures."""
    ids = catalogue.aliases(catalogue.visible(items)).join(keys.select(F.col("key").alias("alias")).distinct(), "alias").select("id").distinct().withColumn("__hit", F.lit(True))
    joined = items.join(ids, "id", "left")
    changed = {"last_scraped_at": F.when(F.col("__hit"), as_of).otherwise(F.col("last_scraped_at")), "scrape_failures": F.when(F.col("__hit"), 0).otherwise(F.col("scrape_failures")).cast("int")}
    return joined.withColumns(changed).select(*items.columns)


# --- small sinks

def bump_daily(days: DataFrame, counts: DataFrame, columns: tuple[str, ...] = ("discovered", "fetched", "fetch_failed")) -> DataFrame:
    """Counters by UTC day with a batch (day, columns) added; values under 1 are ignored."""
    positive = counts.select("day", *(F.when(F.col(c) > 0, F.col(c)).otherwise(0).cast("long").alias(c) for c in columns))
    return days.select("day", *columns).unionByName(positive).groupBy("day").agg(*(F.sum(c).alias(c) for c in columns)).where(" OR ".join(f"{c} > 0" for c in columns))


def set_setting(settings: DataFrame, audit: DataFrame, key: str, value: str, actor: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(settings, audit): an audit row with old and new only where the value changes."""
    if not (1 <= len(key) <= 64 and len(value) <= 1024):
        raise ValueError("a setting's key has 1 to 64 characters and its value up to 1024")
    spark = settings.sparkSession
    new = spark.createDataFrame([(key, value)], "key string, new string")
    both = settings.join(new, "key", "full_outer")
    rows = both.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("value")))
    detail = F.to_json(F.struct(F.col("value").alias("old"), F.col("new")))
    entry = rows.select(as_of.alias("at"), F.lit(actor).alias("actor"), F.lit("set_setting").alias("action"), F.col("key").alias("subject"), detail.alias("detail"))
    return both.select("key", F.coalesce("new", "value").alias("value")), audit.unionByName(entry.select(*audit.columns))


def append_audit(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """``audit`` with rows (at, actor, action, subject, detail) added; one of the wrong length is an error, and then none is."""
    length = {c: F.char_length(F.coalesce(c, F.lit(""))) for c in AUDIT}
    wrong = F.lit(False)
    for c, (least, most) in AUDIT.items():
        wrong |= ~length[c].between(least, most)
    if bad := rows.where(wrong).limit(3).collect():
        raise ValueError(f"audit rows with texts too short or too long: {bad}")
    return audit.unionByName(rows.select(*audit.columns))
