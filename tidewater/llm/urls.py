r"""Op 2. URL filter: rules by host and path, else logistic regression on hashed character n-grams.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. Null, or no ``://``: both empty, no rule, judged by the model like any other. A rule fits its host and all
subdomains of it if the path starts with the rule's; of several the longest wins.

The model is trained here, from the small labelled table below, by full-batch gradient descent written as one SQL
expression over a single row; it is ``BUCKETS`` + 1 numbers, put into the scoring expression as a literal. Everything is
Catalyst expressions: no Python runs on executors, and scoring is a projection of the scan without a shuffle.
A labelled table of one's own may be given; at most ``MAX_LABELLED`` rows of it are used (the first by url).
Repeated rows are judged one by one, empty tables give empty results. A very long url is one row of n-grams. ``digest`` reads its two
columns only; ``features`` and ``judge`` add columns that begin with two underscores and replace the input's of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
EPOCHS = 150
RATE = 4.0
DECAY = 0.0005
MAX_LABELLED = 1000
NGRAMS = (3, 4)

#: Fixed values of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The labelled table: urls of unwanted pages, then of wanted ones.
UNWANTED = (
    "http://megaspam.test/en/1", "https://www.spammy-offers.test/fr/31", "http://spam4u.test/x", "https://linkfarm9.test/de/3", "http://m.farm-of-links.test/en/8",
    "https://royal-casino.test/slots", "http://casino777.test/en/play?bonus=1", "https://poker-casinos.test/de/2", "http://winbig-casino.test/es/9", "https://jackpot-win.test/fr/4",
    "https://betting-tips.test/odds", "http://www.bets24.test/en/6", "https://sportsbet.test/live", "http://free-bet-bonus.test/es/1", "https://bookie-bets.test/fr/77",
    "http://discount-pills.test/order", "https://pillstore.test/en/12", "http://cheapmeds.test/de/5", "https://www.cheap-drugs-pills.test/fr/2", "http://rx-pills24.test/en/30.html",
    "https://adultvideos.test/en/1", "http://www.adults-only.test/x/2", "https://xxxcams.test/live", "http://hot-adult-chat.test/es/4", "https://sex-adult.test/en/5",
    "https://ads-server.test/click?id=1", "http://adsnet.test/en/pixel", "https://track.adtrack.test/p", "http://trackers-ads.test/de/9", "https://m.click-track.test/en/3",
    "https://fast-payday.test/apply", "http://cheap-loans.test/en/2", "https://prize-winner.test/claim", "http://winner-lottery.test/fr/5", "https://replica-watches.test/buy",
)
WANTED = (
    "https://news.test/2024/05/city-council", "http://www.publiclibrary.test/catalogue/77", "https://docs.test/en/reference.html", "http://university.test/fr/departments",
    "https://museum.test/es/collection/4", "http://blog.gardener.test/en/tomatoes", "https://weather.test/de/berlin", "http://recipes.test/en/bread.html",
    "https://www.history.test/fr/1848", "http://m.travelling.test/es/madrid", "https://physics.test/en/optics#top", "http://forum.test/en/thread/901",
    "https://thomson.test/en/6", "http://blog.northern.test/de/12", "https://theatre.test/fr/3/", "http://www.nation.test/en/44", "https://station.test/es/8?page=2&ref=x",
    "http://mother.test/en/15?utm_source=feed", "https://m.weatherman.test/en/2#top", "http://thunder.test/en/480.html", "https://thinking.test/en/7", "http://blog.method.test/fr/9/",
    "https://education.test/en/5", "http://national-parks.test/en/11", "https://the-herald.test/de/21", "http://www.thesis.test/en/300", "https://athens.test/es/6?page=2",
    "http://translation.test/fr/18", "https://m.other-things.test/en/1", "http://stonebridge.test/de/2.html", "https://shanghai.test/en/9", "http://hearth.test/en/64",
    "https://blog.string-theory.test/en/4", "http://thirteen.test/fr/13", "https://motion.test/en/70",
)


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*((u, 1.0) for u in UNWANTED), *((u, 0.0) for u in WANTED)], "url string, label double")


def host(url: Column) -> Column:
    """'' for null and for text without '://'."""
    raw = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: str, buckets: int = BUCKETS) -> str:
    """SQL of the distinct hashed n-grams, as 1-based buckets, of a string column; of a text shorter than that, none."""
    each = [f"CASE WHEN char_length({text}) >= {n} THEN transform(sequence(1, char_length({text}) - {n - 1}), i -> cast(pmod(xxhash64(substring({text}, i, {n})), {buckets}) AS int) + 1) ELSE array() END" for n in NGRAMS]
    return f"array_distinct(concat({', '.join(each)}))"


def features(pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``pages`` with ``__host, __path, __x``: host and path are marked off, so that their n-grams differ."""
    parts = pages.withColumn("__host", host(F.col("url"))).withColumn("__path", path(F.col("url")))
    marked = parts.withColumn("__marked", F.concat(F.lit("^"), F.col("__host"), F.lit("|"), F.regexp_replace("__path", "[0-9]+", "0")))
    return marked.withColumn("__x", F.expr(grams("__marked", buckets))).drop("__marked")


def train(spark: SparkSession, table: DataFrame | None = None, buckets: int = BUCKETS, epochs: int = EPOCHS) -> list[float]:
    """Weights by bucket, the bias last. The sample is bounded, so one row holds it."""
    table = labelled(spark) if table is None else table
    rows = features(table.where("url IS NOT NULL AND label IS NOT NULL").orderBy("url", "label").limit(MAX_LABELLED), buckets)
    # A repartition of the one row keeps what is above it from being worked out again inside the loops below it.
    row = rows.agg(F.sort_array(F.collect_list(F.struct("url", "label", "__x"))).alias("r")).repartition(1)
    by_row = row.select(F.expr("transform(r, e -> e.label)").alias("y"), F.expr("transform(r, e -> e.__x)").alias("x")).repartition(1)
    # For each bucket the rows that have it, so that a gradient is a sum over those.
    turned = f"transform(sequence(1, {buckets}), b -> filter(sequence(1, size(x)), i -> array_contains(x[i - 1], b)))"
    both = by_row.select("y", "x", F.expr(turned).alias("t")).repartition(1)
    predict = "transform(x, f -> aggregate(f, w[{0}], (a, b) -> a + w[b - 1] / sqrt(size(f)), z -> 1 / (1 + exp(-z))))".format(buckets)
    step = f"""aggregate(sequence(1, {epochs}), transform(sequence(0, {buckets}), i -> cast(0 AS double)), (w, e) ->
        transform(array({predict}), p ->
            transform(sequence(0, {buckets}), b ->
                w[b] * (1 - {DECAY}) - {RATE} / greatest(size(x), 1) * CASE WHEN b = {buckets}
                    THEN aggregate(sequence(1, size(y)), cast(0 AS double), (a, i) -> a + p[i - 1] - y[i - 1])
                    ELSE aggregate(t[b], cast(0 AS double), (a, i) -> a + (p[i - 1] - y[i - 1]) / sqrt(size(x[i - 1]))) END))[0])"""
    return list(both.select(F.expr(step).alias("w")).first()["w"])


def score(weights: list[float]) -> Column:
    """Probability that a page is unwanted, from ``__x``. The weights are folded into one literal."""
    literal = f"cast(split('{','.join(map(repr, weights))}', ',') AS array<double>)"
    bias = repr(weights[-1])
    return F.expr(f"1 / (1 + exp(-aggregate(__x, cast({bias} AS double), (a, b) -> a + {literal}[b - 1] / sqrt(greatest(size(__x), 1)))))")


def judge(pages: DataFrame, weights: list[float] | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``__host, __path, __rule, __verdict, __score``."""
    weights = train(pages.sparkSession) if weights is None else weights
    rows = features(pages, len(weights) - 1).withColumn("__score", score(weights)).withColumn("__found", rule(F.col("__host"), F.col("__path"), rules))
    verdict = F.coalesce(F.col("__found.verdict"), F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    return rows.withColumn("__verdict", verdict).withColumn("__rule", F.col("__found.rule")).drop("__x", "__found")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page, with the model's score."""
    return judge(pages.select("page_id", "url")).select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.round("__score", 6).alias("score")
    )
