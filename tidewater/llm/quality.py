"""Op 3. Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit *i* is set
where rule *i* failed; a policy is a version name and a mask, so that a verdict is ``fail_bits & mask = 0`` and
a new policy needs no text. Ablations group the ledger by its bits (at most 2**rules groups, whatever the
corpus) and derive each rule's share, its sole failures and what would be kept without it.

Null and empty texts have no words; they fail ``few_words`` like any text of under ten words. Repeated rows are
judged one by one, an empty table gives an empty ledger. A very long text costs some 60 bytes a word. Columns of the input that clash with
ledger columns are replaced by the ledger's; ``keep_good`` returns all columns of the input as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.llm.textkit import SPACES, hash_words, mix, portions, release, window_hashes

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5
_SPACES = SPACES.decode()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule -> failing condition over the measurements. The order gives the bits and only ever grows at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines"),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


def measure(texts: list[str | None]) -> list[tuple[int, ...]]:
    """The measurements of whole texts, in the order of MEASURES. Words are runs of bytes outside SPACES, compared by 64-bit hashes."""
    rows = []
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for low, high in portions([len(d) for d in data]):
        words = hash_words(data[low:high])
        counts = np.diff(words.bounds)
        for text, n, covered in zip(texts[low:high], counts.tolist(), _repeated(words.hashes, words.bounds).tolist()):
            text = text or ""
            lines = [line for line in text.split("\n") if line.strip(_SPACES)]
            spaces, symbols = sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS))
            rows.append((n, len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), covered))
    return rows


def _repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, its words in windows that it has more than once; ``bounds`` are where texts begin."""
    n = len(hashes)
    covered = np.zeros(n + 1, np.int64)
    windows = window_hashes(hashes, WINDOW)
    if len(windows):
        text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        at = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])  # those within one text
        keys = windows[at] + mix(text[at] + np.uint64(1))
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[count[place] > 1]
        covered[at] += 1
        np.subtract.at(covered, at + WINDOW, 1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(covered[:n]) > 0)))
    return np.diff(total[bounds])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        rows = measure(batch.column(at).to_pylist())
        kept = [i for i in range(batch.num_columns) if i != at]
        columns = [pa.array([row[k] for row in rows], pa.int64()) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], [*(batch.schema.names[i] for i in kept), *MEASURES])
    release()


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits``: one row for each row of ``docs``, no shuffle."""
    keep = tuple(c for c in keep if c not in MEASURES)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{m} long" for m in MEASURES)])
    return source.mapInArrow(_measured, fields).withColumn("fail_bits", failed_bits())


def verdict(policy: str = CURRENT) -> Column:
    """Is a row of the ledger kept under the policy?"""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = CURRENT, weight: str | None = None) -> DataFrame:
    """For each rule of the policy: documents, how many fail it, fail it alone, are kept, and would be kept without it.

    ``rows`` is a ledger, or one already counted by its bits in the column ``weight``.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")).alias("bits")
    groups = rows.groupBy(bits).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(mask((rule,))).cast("long").alias("bit")) for rule in POLICIES[policy]))
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum("n").alias("n_docs"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_fail_alone"),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, with the bits beside them."""
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0).alias("base_failed"),
        verdict().alias("kept"),
        "n_lines",
        "fail_bits",
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they are."""
    columns = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)))
    judged = ledger(rows, f"__c{columns.index('text')}", tuple(rows.columns))
    return judged.where(verdict(policy)).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)))


def ablation_digest(docs: DataFrame) -> DataFrame:
    """Ablations of every version of the policy, from one ledger."""
    rows, _ = shared.written(ledger(docs.select("doc_id", "text")).groupBy("fail_bits").agg(F.count("*").alias("n")), "ledger")
    found = None
    for policy in POLICIES:
        one = ablations(rows, policy, "n").select(F.lit(policy).alias("policy"), "*")
        found = one if found is None else found.unionByName(one)
    return found


_BITS = " | ".join(f"(CASE WHEN {condition} THEN {1 << i} ELSE 0 END)" for i, condition in enumerate(RULES.values()))
_LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
hit AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
"""
ORACLE = rf"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       (fail_bits & {mask(POLICIES[CURRENT])}) = 0 AS kept, n_lines, fail_bits FROM b
"""
_BIT = {rule: 1 << i for i, rule in enumerate(RULES)}
ABLATION_ORACLE = f"""{_LEDGER}, p AS (SELECT * FROM (VALUES {', '.join(f"('{name}', '{rule}', {_BIT[rule]}, {mask(rules)})" for name, rules in POLICIES.items() for rule in rules)}) t(policy, rule, bit, mask))
SELECT policy, rule, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE fail_bits & bit <> 0)::BIGINT AS n_fail, count(*) FILTER (WHERE fail_bits & mask = bit)::BIGINT AS n_fail_alone,
       count(*) FILTER (WHERE fail_bits & mask = 0)::BIGINT AS n_kept, count(*) FILTER (WHERE fail_bits & mask IN (0, bit))::BIGINT AS n_kept_without FROM b, p GROUP BY policy, rule
"""
