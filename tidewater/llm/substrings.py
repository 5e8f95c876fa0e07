r"""Op 5. Substring dedup by compressed FM-indexes, one per shard.

Words are [^\x20\x09-\x0D]+ as they stand. A window is ``WINDOW`` consecutive words of a document; a word is removed if a
window that covers it also starts in a document with a smaller doc_id. Windows are judged on the input.

1. anchors: the least hash of the ``GRAM``-word runs in a window is its anchor, so equal windows have equal anchors, wherever
   they are. Neighbouring windows of one anchor are a segment. Only anchors of two or more documents go on.
2. shards: segments of equal content are collapsed to the least document that has them, and go, by anchor, to shards
   of about ``SHARD_WORDS`` words, for each of which an FM-index is built.
3. search: the shard's segments are streamed against its index; backward search gives matching statistics, and for each
   window, as an interval of suffixes, the least document that has it.
4. removal: each document drops the words of windows whose least document is smaller than itself.

The shuffles carry anchors, segments of shared anchors, and the text once. Groups of copies collapse before they meet. An
anchor with over ``SPLIT`` different segments (a frequent phrase in ever other surroundings) is divided by the second least hash
of its windows, then by the next two, four, and so on; equal windows have these in common too. After five such rounds all runs of
a window have been used, and only equal windows are left together. A segment is told apart by two 64-bit hashes: its anchor's and its content's.

doc_id must be an integer, or null; a text of another type is cast. A very long text is hashed in blocks and cut into segments; a task
holds one such text at a time with its words. Further columns are not read, whatever their names. An empty table gives no rows. Null and empty texts have no words. A null doc_id counts as larger than any other: it causes no removal, and only documents
with an id make it lose words. Rows with the same doc_id do not affect each other; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.llm.fmindex import FMIndex
from tidewater.llm.textkit import hash_words, mix, range_hashes, sliding_min, window_hashes

WINDOW = 50
GRAM = 25
SHARD_WORDS = 1_000_000
SPLIT = 1000
NEVER = (1 << 63) - 1  #: stands for a null doc_id


def segments(texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's place, anchor, content hash, first window, end of windows) of every segment."""
    words = hash_words(texts)
    least = sliding_min(window_hashes(words.hashes, gram), window - gram + 1)
    n = len(least)
    valid = np.zeros(n + 1, bool)
    doc = np.searchsorted(words.bounds, np.arange(n), "right") - 1
    valid[:n] = np.arange(n) + window <= words.bounds[doc + 1]
    same = np.zeros(n + 1, bool)  # is a window in the segment of the one before it?
    same[1:n] = (least[1:] == least[:-1]) & valid[: n - 1] if n > 1 else False
    begin = np.flatnonzero(valid & ~same)
    end = np.flatnonzero(valid[:n] & ~(valid[1:] & same[1:])) + 1
    content = range_hashes(words.hashes, begin, end + window - 1)
    of = doc[begin]
    return of, least[begin].view(np.int64), content.view(np.int64), begin - words.bounds[of], end - words.bounds[of]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, anchor, content, begin, end = segments(batch.column(2).to_pylist(), window, gram)
                dk, th = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in range(2))
                columns = [anchor, content, dk, th, begin.astype(np.int32), end.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "c", "dk", "th", "s", "e"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for dk, text, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = text.as_py().split()
                for p in parts.as_py():
                    for column, value in zip(out, (p["a"], p["c"], dk, b" ".join(words[p["s"] : p["e"] + window - 1]))):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["a", "c", "dk", "words"])

    return run


_RUNS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("owner", pa.int64())]))


def _runs(owners: np.ndarray) -> list[dict]:
    """Runs of equal owners; windows without one are left out."""
    if not len(owners):
        return []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)])).tolist()
    return [{"from": a, "to": b, "owner": int(owners[a])} for a, b in zip(cuts, cuts[1:]) if owners[a] != NEVER]


def owners_of(texts: list[bytes], owners: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """The least owner of each window of each text, by one FM-index over all of them."""
    ids: dict[bytes, int] = {}
    coded = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in t.split()), np.int64) for t in texts]
    index = FMIndex(coded, np.array(owners, np.int64), window)
    low, high, offsets = index.windows(coded)
    least = index.least_owner(low, high)
    return [least[a:b] for a, b in zip(offsets, offsets[1:])]


def _search(window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = owners_of([h[3] for h in held], [h[2] for h in held], window)
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([_runs(o) for o in found], _RUNS)], ["a", "c", "runs"]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_words and row[0] != held[-1][0]:  # an anchor is never divided
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 2
        if held:
            yield flush()

    return run


def finer(texts: list[bytes], level: int, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's place, hash, content hash, first window, end of windows) of the parts of segments whose windows have the same
    hashes of ``gram``-word runs from rank 2**(level - 1) up to 2**level, of 0 for the least."""
    words = hash_words(texts)
    grams = window_hashes(words.hashes, gram)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for i, (a, b) in enumerate(zip(words.bounds, words.bounds[1:])):
        n = b - a - window + 1
        if n < 1:
            continue
        key = np.zeros(n, np.uint64)
        views = np.lib.stride_tricks.sliding_window_view(grams[a : b - gram + 1], window - gram + 1)
        for at in range(0, n, _ROWS):
            for column in np.sort(views[at : at + _ROWS], axis=1).T[1 << (level - 1) : 1 << level]:
                key[at : at + _ROWS] = mix(key[at : at + _ROWS] * np.uint64(0xC2B2AE3D27D4EB4F) + column)
        begin = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        end = np.append(begin[1:], n)
        content = range_hashes(words.hashes[a:b], begin, end + window - 1)
        for column, value in zip(out, (np.full(len(begin), i), key[begin].view(np.int64), content.view(np.int64), begin, end)):
            column.append(value)
    return tuple(np.concatenate([*c, np.zeros(0, np.int64)]) for c in out)


_ROWS = 1 << 16  #: windows sorted at once
_PART = "a long, c long, f int, a2 long, c2 long, dk long, words binary"


def _divide(level: int, window: int, gram: int):
    """Parts of a crowded anchor's segments: the segment (a, c), the part's first window in it, its key, and the part's own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, c, dk, texts = (x.to_pylist() for x in batch.columns)
            of, key, content, begin, end = finer(texts, level, window, gram)
            with np.errstate(over="ignore"):
                under = mix(np.array(a, np.int64).view(np.uint64)[of] + mix(key.view(np.uint64))).view(np.int64)
            split = [t.split() for t in texts]
            parts = [b" ".join(split[i][x : y + window - 1]) for i, x, y in zip(of.tolist(), begin.tolist(), end.tolist())]
            pick = lambda v: pa.array([v[i] for i in of.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pick(a), pick(c), pa.array(begin.astype(np.int32)), pa.array(under), pa.array(content), pick(dk), pa.array(parts, pa.binary())], ["a", "c", "f", "a2", "c2", "dk", "words"]
            )

    return run


_OWNED = "a long, c long, runs array<struct<from:int,to:int,owner:long>>"


def owned_by(cut: DataFrame, window: int, gram: int, shard_words: int, split: int, level: int = 1) -> DataFrame:
    """(a, c, runs) of the segments ``cut`` (a, c, dk, words): the runs of windows with a common least owner."""
    crowded = cut.groupBy("a").count().where(F.col("count") > split).select("a")
    if 1 << (level - 1) <= window - gram:
        crowded, _ = shared.written(crowded, "crowded")
        if not crowded.isEmpty():
            parts, _ = shared.written(cut.join(crowded, "a", "left_semi").select("a", "c", "dk", "words").mapInArrow(_divide(level, window, gram), _PART), "parts")
            one = parts.groupBy(F.col("a2").alias("a"), F.col("c2").alias("c")).agg(F.min("dk").alias("dk"), F.first("words").alias("words"))
            below = owned_by(one, window, gram, shard_words, split, level + 1).select(F.col("a").alias("a2"), F.col("c").alias("c2"), "runs")
            moved = F.transform("runs", lambda r: F.struct((r["from"] + F.col("f")).alias("from"), (r["to"] + F.col("f")).alias("to"), r["owner"].alias("owner")))
            back = parts.select("a", "c", "f", "a2", "c2").join(below, ["a2", "c2"]).select("a", "c", moved.alias("runs"))
            whole = back.groupBy("a", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # of one segment
            return owned_by(cut.join(crowded, "a", "left_anti"), window, gram, shard_words, split, window).unionByName(whole)
    return cut.select("a", "c", "dk", "words").repartition("a").sortWithinPartitions("a").mapInArrow(_search(window, shard_words), _OWNED)


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, split: int = SPLIT) -> DataFrame:
    """For each row of ``docs`` (dk, th, text; see ``keyed``) that loses words: dk, th and ``found``, an array of
    (s, runs): window s + from up to s + to has the owner."""
    anchors = docs.select("dk", "th", "text").mapInArrow(_anchors(window, gram), "a long, c long, dk long, th long, s int, e int")
    several = anchors.groupBy("a").agg(F.min("dk").alias("low"), F.max("dk").alias("high")).where("low < high").select("a")
    segs, _ = shared.written(anchors.join(several, "a"), "segments")
    one = segs.groupBy("a", "c").agg(F.min(F.struct("dk", "th", "s", "e")).alias("r")).select("a", "c", "r.*")
    wanted = one.groupBy("dk", "th").agg(F.collect_list(F.struct("a", "c", "s", "e")).alias("parts"))  # of one text
    once = docs.join(wanted, ["dk", "th"]).dropDuplicates(["dk", "th"]).select("dk", "text", "parts", *(c for c in ("doc_id",) if c in docs.columns))  # same columns, so same shuffle, as in deduplicate()
    cut = once.mapInArrow(_cut(window), "a long, c long, dk long, words binary")
    owned = owned_by(shared.written(cut, "cut")[0], window, gram, shard_words, split)
    lost = segs.join(owned, ["a", "c"]).where(F.exists("runs", lambda r: r["owner"] < F.col("dk")))
    mine = F.transform(F.filter("runs", lambda r: r["owner"] < F.col("dk")), lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to")))
    return lost.select("dk", "th", F.struct("s", mine.alias("runs")).alias("f")).groupBy("dk", "th").agg(F.collect_set("f").alias("found"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with dk (doc_id, null last), th (hash of the text) and text as bytes; a row is known by the first two."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("dk"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def keep_mask(n: int, found: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for f in found or ():
        for r in f["runs"]:
            edge[f["s"] + r["from"]] += 1
            edge[f["s"] + r["to"] - 1 + window] -= 1
    return np.cumsum(edge[:n]) == 0


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                words = text.as_py().split()
                n = len(words)
                if (found := found.as_py()) is not None:
                    words = [words[i] for i in np.flatnonzero(keep_mask(n, found, window))]
                joined = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), joined.decode("utf-8", "replace") if with_text else hashlib.sha256(joined).hexdigest())):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, with_text: bool = True, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and ``kept``: its kept words joined by spaces, or their sha256."""
    rows = keyed(docs)
    lost = removals(rows, **options)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = rows.join(lost, ["dk", "th"], "left").select("doc_id", "text", "found")
    return both.mapInArrow(_kept(options.get("window", WINDOW), with_text), f"doc_id {id_type}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return deduplicate(docs.select("doc_id", "text"), with_text=False).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS dk,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, dk, i, md5(list_aggregate(list_slice(w, i, i + 49), 'string_agg', ' ')) AS win
      FROM (SELECT rid, dk, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
hit AS (SELECT rid, i FROM g QUALIFY min(dk) OVER (PARTITION BY win) < dk),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM hit),
n AS (SELECT rid, count(*) AS n, list(p) AS ps FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x))) END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid)
"""
