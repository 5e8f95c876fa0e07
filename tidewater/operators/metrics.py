"""Counters: totals over snapshots, counts observed on the way through a plan, and the text format that monitors read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def totals(snapshots: DataFrame, counters: list[str], *by: str) -> DataFrame:
    """Sums of the counters of all families (rows), or by some columns; a missing value counts as 0."""
    return snapshots.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters))


def observed(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, Observation]:
    """``df``, and what is counted while it is computed: no second pass."""
    watch = Observation(name)
    return df.observe(watch, *(c.alias(k) for k, c in values.items())), watch


def _escaped(value: Column) -> Column:
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def exposition(df: DataFrame, metric: str, kind: str, labels: list[str], value: str) -> DataFrame:
    """(n, line): a type line, and a line for each row in the order of its labels. The rows of one metric are few."""
    pairs = [F.concat(F.lit(f'{name}="'), _escaped(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit('"')) for name in labels]
    inside = F.concat(F.lit("{"), F.array_join(F.array(*pairs), ","), F.lit("}")) if pairs else F.lit("")
    lines = df.select(F.lit(1).alias("n"), F.concat(F.lit(metric), inside, F.lit(" "), F.col(value).cast("string")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, f"# TYPE {metric} {kind}")], "n int, line string")
    return head.unionByName(lines).orderBy("n", "line")


def exposed_histogram(df: DataFrame, metric: str, bounds: DataFrame, total: float) -> DataFrame:
    """Lines of a histogram from its cumulative counts (le, n) and the sum of its values."""
    label = F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.col("le").cast("string"))
    buckets = bounds.select(F.lit(1).alias("n"), F.col("le").alias("at"), F.concat(F.lit(f'{metric}_bucket{{le="'), label, F.lit('"} '), F.col("n").cast("string")).alias("line"))
    rest = df.sparkSession.createDataFrame([(0, f"# TYPE {metric} histogram"), (2, f"{metric}_sum {total}")], "n int, line string").withColumn("at", F.lit(0.0))
    count = bounds.where(F.col("le") == float("inf")).select(F.lit(3).alias("n"), F.lit(0.0).alias("at"), F.concat(F.lit(f"{metric}_count "), F.col("n").cast("string")).alias("line"))
    return rest.unionByName(buckets).unionByName(count).orderBy("n", "at").select("n", "line")
