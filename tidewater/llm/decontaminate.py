r"""Op 7. Benchmark decontamination: n-gram windows of the benchmark as a hash set, scanned over training texts.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased. The windows of a benchmark item are its runs
of 13 words; an item of fewer words, but not none, is one window. All is Catalyst expressions:

1. scan: each window of a text is hashed in place and looked up in the set of the benchmark's hashes. The set is broadcast if it
   has ``SET_ROWS`` hashes at most, counted before; beyond that the same join deals windows and set by hash. Nothing else differs.
2. verify: windows that hit are compared with the benchmark's, word for word, folded as the contract says.
3. decide: positions covered by hits, the items, and the share of words hit.

A verdict depends on the text alone, so it is made once for each text (by MD5 of its bytes), whatever its copies, and written
to the shared folder; rows find theirs by that key. Null and empty texts have no words and are never contaminated. A very
long text is held once, as an array of its words. Empty tables give no hits. A null item_id is reported as an
empty string. Repeated items count once by item_id; repeated documents are judged one by one. ``digest`` reads its two columns of
each table alone; the others take any further columns, whatever their names, and return them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import shared

WINDOW = 13
#: Rows of one hash that may go to every executor: about 32 bytes each.
SET_ROWS = 4_000_000
#: Rows of one text's verdict that may: under 200 bytes each.
VERDICT_ROWS = 500_000
SHARE = 20  #: contaminated where SHARE * n_hit >= n_words
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
BREAKS = rf"[^{WORD}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as they stand (only breaks at its ends give empty strings)."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS), "")


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def window_hash(array: str, first: Column, span: Column, spans: list[int]) -> Column:
    """The hash of ``span`` words from the place ``first`` (from 0) on; plain element reads, which are compiled where a lambda is not."""
    found = None
    for n in spans:
        one = F.xxhash64(*(F.get(array, first + k) for k in range(n)))
        found = one if found is None else F.when(span == n, one).otherwise(found)
    return found


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (item, window text, words in it, scan hash)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(fold(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    hashed = window_hash("win", F.lit(0), F.size("win"), list(range(1, size + 1)))
    return cut.select("item", F.array_join("win", " ").alias("window"), F.size("win").alias("span"), hashed.alias("hash")).distinct()


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has so many rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def hits(texts: DataFrame, benchmark: DataFrame, set_rows: int = SET_ROWS) -> DataFrame:
    """Distinct (key, at, span, item) of the verified hits in ``texts`` (key, text); ``at`` is the 1-based word position."""
    windows, _ = shared.written(benchmark_windows(benchmark), "windows")
    known, _ = shared.written(windows.select("hash").distinct(), "hashes")
    spans = sorted(r.span for r in windows.select("span").distinct().collect()) or [WINDOW]  # WINDOW values at most
    # One generated row a place and span, which is compiled together with the look-up, so that the words are never copied for it. The outer
    # form has no filter made of it, which would be moved below the split and repeat that.
    cut = texts.select("key", words(fold(F.col("text"))).alias("w")).select("key", "w", F.posexplode_outer("w").alias("i", "word"))
    if len(spans) > 1:
        cut = cut.select("key", "w", "i", F.explode(F.array(*map(F.lit, spans))).alias("span"))
    else:
        cut = cut.select("key", "w", "i", F.lit(spans[0]).alias("span"))
    scanned = cut.where(F.col("i") + F.col("span") <= F.size("w")).withColumn("hash", window_hash("w", F.col("i"), F.col("span"), spans))
    found = scanned.join(_checked(known, set_rows), "hash", "left_semi")
    # Copies of a text give the same rows, which meet here before they are dealt.
    # Never null, or a test for null would be made of each window's text before the look-up.
    window = F.coalesce(F.array_join(F.slice("w", F.col("i") + 1, F.col("span")), " "), F.lit(""))
    lifted = found.select("key", (F.col("i") + 1).alias("at"), "span", "hash", window.alias("window")).distinct()
    return lifted.join(windows.select("hash", "window", "item"), ["hash", "window"]).select("key", "at", "span", "item")


def verdicts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """key, n_hit, items (sorted) and spans (sorted (at, span)) of each text of ``docs`` that holds a window; a written table."""
    texts = docs.select(key_of(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    by_text = hits(texts, benchmark, **options).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "span"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    cover = lambda a, h: F.struct(
        F.greatest(a["end"], h["at"] + h["span"] - 1).alias("end"),
        (a["n"] + F.greatest(h["at"] + h["span"] - 1 - F.greatest(a["end"], h["at"] - 1), F.lit(0))).cast("long").alias("n"),
    )
    return shared.written(by_text.select("key", F.aggregate("spans", start, cover)["n"].alias("n_hit"), "items", "spans"), "verdicts")[0]


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's columns for every document."""
    found = verdicts(docs.select("text"), benchmark.select("item_id", "text"), **options)
    told = found.select("key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), key_of(F.col("text")).alias("key"))
    joined = rows.join(_checked(told, VERDICT_ROWS), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated")
    )


def _with_key(docs: DataFrame, text_col: str) -> DataFrame:
    """Columns as ``__c0``, ``__c1``, ... so that no name clashes, and ``key``."""
    return docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), key_of(F.col(f"`{text_col}`")).alias("key"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    found = verdicts(docs, benchmark, text_col, **options)
    hit = docs.select(key_of(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")).join(_checked(found.select("key", "n_hit"), VERDICT_ROWS), "key")
    bad, _ = shared.written(hit.select("key", "n_hit", F.size(words(F.col("text"))).alias("n_words")).where(_contaminated(F.col("n_hit"), F.col("n_words"))).select("key").distinct(), "contaminated")
    rows = _with_key(docs, text_col).join(_checked(bad, VERDICT_ROWS), "key", "left_anti")
    return rows.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs``, with the words that a hit covers, and the breaks before them, cut out of the text."""
    at = docs.columns.index(text_col)
    rows = _with_key(docs, text_col).join(verdicts(docs, benchmark, text_col, **options).select("key", "spans"), "key", "left")
    pieces = F.regexp_extract_all(F.col(f"__c{at}").cast("string"), F.lit(rf"[^{WORD}]*[{WORD}]+|[^{WORD}]+$"), F.lit(0))
    rows = rows.withColumn("__pieces", F.when(F.size("spans") > 0, pieces))
    covered = lambda i: F.exists("spans", lambda h: (h["at"] <= i + 1) & (i + 1 < h["at"] + h["span"]))
    cut = F.array_join(F.filter("__pieces", lambda p, i: ~covered(i)), "")
    text = F.when(F.size("__pieces") > 0, cut).otherwise(F.col(f"__c{at}")).alias(text_col)
    return rows.select(*(text if i == at else F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = rf"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 12) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
spans AS (SELECT DISTINCT len(win) AS k FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, i, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT rid, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, spans)),
hit AS (SELECT rid, i, k, item FROM dw JOIN bw USING (win)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
