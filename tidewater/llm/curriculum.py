r"""Op 4. Mixing sources to target weights along a time-varying curriculum.

Targets: source weights share the corpus' words; a target stops at ``max_epochs`` times its source's size and
the excess goes to the others by weight (water filling, in closed form over the sources sorted by cap / weight).
Schedules: each source has a weight over training time, linear between knots. Its integral, scaled to the target,
is the source's cumulative demand; inverting that gives the training time at which a given word of the source is due.
Documents of a source are taken in the order of a hash, whole, pass after pass. A document's offset in its source
(a prefix sum) is inverted to its position, and ``schedule`` range-sorts the occurrences by position.

The prefix sums are in two levels: sums of buckets of about ``BUCKET_ROWS`` documents, accumulated per source, and
running sums within a bucket. So no task sorts a hot source; a bucket's size does not grow with the corpus.

A query's rows are read off the sorted mix: ``digest`` has one for each document, with its first position and that one's rank.

Size is the number of [^\x20\x09-\x0D]+ in the text; null and empty texts have size 0 and are taken 0 times. A null
source is a source of its own, last in order. Rows are told apart by doc_id and text; repeated rows are taken
separately, their order makes no difference. An empty table gives an empty result. ``schedule`` passes any further columns on,
whatever their names; the others return columns of their own alone. A very long text is counted, and else only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater import shared

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 4096
#: Sources up to this many are joined by broadcast: a row is under 1 KB.
BROADCAST_SOURCES = 20_000
#: Knots (time, weight) of each weight class' schedule: light sources early, heavy ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.8), (1.0, 1.9)))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _segments(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """(begin, end, weight at begin, slope, integral up to begin, integral of all) of each linear piece; the integral is the exact trapezoid."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), area))
        area += (t1 - t0) * (w0 + w1) / 2
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    return [(*p, area) for p in pieces]


def due(fraction: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the given fraction of the demand has been met."""
    pieces = _segments(schedule)
    found = None
    for t0, t1, w0, slope, before, area in reversed(pieces):
        rest = fraction * F.lit(area) - F.lit(before)
        if slope == 0:
            time = F.lit(t0) + rest / F.lit(w0 or 1.0)
        else:
            time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        time = F.least(F.greatest(time, F.lit(t0)), F.lit(t1))
        found = time if found is None else F.when(rest < F.lit((t1 - t0) * (w0 + slope * (t1 - t0) / 2)), time).otherwise(found)
    return found


def sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size and row count, weight class and target. Only this table, of a row per source, is in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn("class", (F.row_number().over(rank) - 1) % len(weights)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    levels = weighted.withColumn(
        "level",
        (F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(after).cast("double"),
    )
    # The first source, from the least cap a weight, that its level does not fill up sets the level of all after it.
    open_ = levels.withColumn("open", max_epochs * F.col("source_size") > F.col("level") * F.col("weight"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return open_.withColumn("target", F.least((max_epochs * F.col("source_size")).cast("double"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "source_size", "source_rows", "class", "target"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as ``__c0``, ``__c1``, ..., so that no name clashes, with ``__id, __size, __source, __hash``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)),
        F.col("doc_id").alias("__id"),
        word_count("text").alias("__size"),
        F.col("source").cast("string").alias("__source"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)).alias("__hash"),
    )


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (see ``keyed``) with ``__source_size, __target, __positions`` (times of its occurrences, ascending)."""
    table, _ = shared.written(sources(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, max_epochs), "sources")
    table = table.select(*(F.col(c).alias(f"__{c}") for c in table.columns)).withColumnRenamed("__source", "__source_key")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    placed = rows.join(table, F.col("__source").eqNullSafe(F.col("__source_key")), "inner").withColumn(
        "__bucket", F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * F.ceil(F.col("__source_rows") / bucket_rows) / F.lit(2.0**32))
    )
    sums = placed.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum"))
    up_to = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(up_to), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("__inner", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    located = running.join(bases, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")), "inner").withColumn("__offset", F.col("__base") + F.col("__inner"))
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    located = located.withColumn("__whole", whole)
    more = (F.col("__offset") + F.col("__size") / 2.0 <= F.col("__target") - (F.col("__whole") * F.col("__source_size")).cast("double")) & (F.col("__whole") < max_epochs)
    located = located.withColumn("__copies", F.when(F.col("__size") > 0, F.col("__whole") + F.when(more, 1).otherwise(0)).otherwise(0).cast("long"))
    times = None
    for k, schedule in enumerate(schedules):
        fraction = lambda i: (i * F.col("__source_size") + F.col("__offset")).cast("double") / F.col("__target")
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1), lambda i: due(fraction(i), schedule))  # noqa: B023
        times = each if times is None else F.when(F.col("__class") % len(schedules) == k, each).otherwise(times)
    empty = F.array().cast("array<double>")
    located = located.withColumn("__positions", F.when(F.col("__copies") > 0, times).otherwise(empty))
    return located.select(*rows.columns, "__source_size", "__target", "__positions")


def _in_order(placed: DataFrame, outer: bool = False) -> DataFrame:
    """Every occurrence as a row with ``__copy`` and ``__position``, range-sorted by that; ``outer``: rows without one come last."""
    spread = F.posexplode_outer if outer else F.posexplode
    rows = placed.select("*", spread("__positions").alias("__copy", "__position"))
    order = [F.col("__position").asc_nulls_last(), F.col("__id"), F.col("__copy"), F.col("__hash")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every occurrence as a row with the columns of ``docs``, range-sorted by training position."""
    return _in_order(plan(keyed(docs), **options)).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _ranked(docs: DataFrame, **options) -> DataFrame:
    """Every occurrence, and each document without one, with its rank in the sorted mix (null without one). Words are counted once."""
    sized, _ = shared.written(keyed(docs.select("doc_id", "source", "text")).select("__id", "__size", "__source", "__hash"), "sized")
    mix = _in_order(plan(sized, **options), outer=True).withColumn("__taken", F.col("__size") * F.size("__positions")).drop("__positions")
    # The id counts the rows of a partition from its number in the bits above 33; it is written before it is used.
    rows, _ = shared.written(mix.withColumn("__row", F.monotonically_increasing_id()), "mix")
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    bases = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = rows.join(F.broadcast(bases), "__part")
    return ranked.withColumn("__rank", F.when(F.col("__position").isNotNull(), F.col("__base") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns for every document, its first position and that one's rank, all read off the sorted mix."""
    first = _ranked(docs, **options).where("coalesce(__copy, 0) = 0")
    return first.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
        F.col("__position").alias("first_position"),
        F.col("__rank").alias("first_rank"),
    )


def order(docs: DataFrame, **options) -> DataFrame:
    """doc_id, copy (from 0), position and rank (from 0, over the whole mix) of every occurrence, read off the sorted mix."""
    rows = _ranked(docs, **options).where("__copy IS NOT NULL")
    return rows.select(F.col("__id").alias("doc_id"), F.col("__copy").cast("long").alias("copy"), F.col("__position").alias("position"), F.col("__rank").alias("rank"))


def due_sql(fraction: str, schedule: tuple[tuple[float, float], ...]) -> str:
    """What ``due`` says, as DuckDB's SQL."""
    number = lambda x: f"'{x!r}'::DOUBLE"
    found = ""
    for t0, t1, w0, slope, before, area in reversed(_segments(schedule)):
        rest = f"({fraction} * {number(float(area))} - {number(float(before))})"
        move = f"(sqrt(greatest({number(w0 * w0)} + {number(2 * slope)} * {rest}, '0'::DOUBLE)) - {number(w0)}) / {number(slope)}" if slope else f"{rest} / {number(w0 or 1.0)}"
        time = f"least(greatest({number(t0)} + {move}, {number(t0)}), {number(t1)})"
        found = f"CASE WHEN {rest} < {number((t1 - t0) * (w0 + slope * (t1 - t0) / 2))} THEN {time} ELSE {found} END" if found else time
    return found


ORACLE = (
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class, 1 + class AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
o AS (SELECT min_by(level, source_size / weight) AS level FROM l WHERE 3 * source_size > level * weight),
t AS (SELECT source, class, source_size, least((3 * source_size)::DOUBLE, coalesce(o.level, 'Infinity'::DOUBLE) * weight) AS target FROM l LEFT JOIN o ON true),
r AS (SELECT row_number() OVER () AS rid, h, class, doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN whole < 3 AND off + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies FROM r),
f AS (SELECT *, (i * source_size + off)::DOUBLE / target AS part FROM (SELECT *, unnest(range(copies)) AS i FROM n)),
p AS (SELECT *, CASE class """
    + " ".join(f"WHEN {k} THEN {due_sql('part', s)}" for k, s in enumerate(SCHEDULES))
    + r""" END AS position FROM f),
k AS (SELECT rid, i, position, row_number() OVER (ORDER BY position, doc_id NULLS FIRST, i, h) - 1 AS rank FROM p)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, position AS first_position, rank AS first_rank
FROM n LEFT JOIN k ON n.rid = k.rid AND k.i = 0
"""
)
