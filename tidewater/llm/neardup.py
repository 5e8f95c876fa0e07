r"""Op 9. Near duplicates: DartMinHash signatures, banded joins, exact checks and connected components.

Words are [^\x20\x09-\x0D]+ as they stand; a text's shingles are the set of its runs of ``SHINGLE`` words, or all its words
if there are fewer. Two texts are linked if the Jaccard similarity of those sets (of 64-bit hashes) is ``SIMILARITY`` or more; a
class is a connected component, named by its least doc_id. ``weighting="tf"`` weights each shingle by its count, in the
signature and in the check (sum of lesser counts by sum of greater ones); ``"set"`` gives all the weight 1.

1. Equal texts are one node (by MD5 of the bytes), so copies never meet each other.
2. Each node's signature gives ``BANDS`` keys. A pair at the threshold shares one with a probability of 0.99995.
3. Nodes that share a key are compared with their bucket's leader: the node that meets most others in its buckets. Of edited
   copies of a text that is the text itself, so a bucket of copies with edits needs a row for each, not for each pair.
4. All nodes of the buckets that still hold several classes are joined with each other by ``prefix_pairs``, an exact filter on
   their rarest shingles, whatever bucket they are in. So each pair that shares a key is in one class, or compared, or proved to be unlike.
5. Texts without words stay alone.

Candidates of steps 3 and 4 are compared by their whole sets. A long text is hashed in blocks; its set must fit in a task's memory.
Repeated rows share a class. A null doc_id names a class only if all its doc_ids are null. Empty tables give empty results.
``classify`` and ``digest`` read doc_id and text alone; ``keep_one`` takes any further columns, whatever their names, and returns them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.llm.components import components
from tidewater.llm.dartminhash import bands, signature
from tidewater.llm.textkit import hash_words, mix, portions, range_hashes, release

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Sizes are in one class if they differ by less than this part, about.
SIZE_STEP = 0.02


def shingles(texts: list[bytes | None], size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, counts) of each text, in portions of bounded size."""
    for low, high in portions([len(t or b"") for t in texts]):
        words = hash_words(texts[low:high])
        for a, b in zip(words.bounds, words.bounds[1:]):
            n = max(b - a - size + 1, min(b - a, 1))
            begin = np.arange(a, a + n)
            yield np.unique(range_hashes(words.hashes[a:b], begin - a, np.minimum(begin - a + size, b - a)), return_counts=True)


def _sign(tf: bool, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            nodes, sizes, keys = [], [], []
            for text, (elements, counts) in zip(texts, shingles(texts)):
                sizes.append(int(counts.sum()) if tf else len(elements))
                nodes.append(hashlib.md5(text).digest() if len(elements) else None)
                keys.append(bands(signature(elements, n_bands * rows, counts.astype(float) if tf else None), rows).tolist() if len(elements) else None)
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip((nodes, sizes, keys), kinds))], ["doc_id", "node", "n_shingles", "keys"])
        release()

    return run


def _repeated(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An element for each occurrence; the sets of two texts then share the lesser count of each shingle."""
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(elements, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(tf: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [(_repeated(elements, counts) if tf else elements).view(np.int64) for elements, counts in shingles(batch.column(1).to_pylist())]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["node", "shingles"])
        release()

    return run


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    both = pairs.join(u, "u").join(v, "v").withColumn("n", F.size(F.array_intersect("su", "sv")))
    return both.where(F.col("n") >= similarity * (F.size("su") + F.size("sv") - F.col("n"))).select(*pairs.columns)


def _need(n: Column, m: Column, similarity: float) -> Column:
    """How many shingles sets of n and m must share."""
    return F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def prefix_pairs(pool: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (u, v, ru, rv) of nodes of ``pool`` (node, root) with unlike roots that may be similar enough; no other pair is.

    Shingles are ordered by the number of the pool's nodes that hold them, rarest first. If a set of n shingles is similar to
    one of m >= n, the first shingle that they share, at p and q, leaves at least ``_need(n, m)`` in either: p <= n - need and
    q <= m - need. So a set is entered under (shingle, class of its size) for the p that an equal size allows, and asks
    for each class of sizes under its own with the q which that class allows. Shingles of one node only are counted,
    but not entered. Entries of one root under a key aren't paired: the others meet the root that has most entries, and
    each other.
    """
    step = F.lit(SIZE_STEP)
    elements = sets.join(pool, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = elements.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared_ = elements.join(common, "shingle").groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    n, p = F.col("n"), F.col("p")
    single = n - F.size("held")
    longest = n - _need(n, F.ceil(n * F.lit(similarity) - F.lit(1e-9)), similarity) + 1  # of any class
    head = shared_.withColumn("single", single).withColumn("head", F.slice("held", 1, F.greatest((longest - single).cast("int"), F.lit(0))))
    entries = head.select("node", "root", "n", "single", F.posexplode("head").alias("i", "held")).select("node", "root", "n", (F.col("single") + F.col("i")).alias("p"), F.col("held.shingle").alias("shingle"))
    own = F.floor(F.log(n.cast("double")) / step)
    low = F.floor(F.log(F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("double")) / step)
    dealt = entries.withColumn("own", own).withColumn("kind", F.explode(F.sequence(low, F.col("own"))))
    least = F.greatest(n * F.lit(similarity), F.exp(F.col("kind") * step) * F.lit(1 - 1e-9))
    entered = dealt.where(p <= n - _need(n, least, similarity)).select("shingle", "kind", "node", "root", "n", "p", ((F.col("own") == F.col("kind")) & (p <= n - _need(n, n, similarity))).alias("inside"))
    by_root = entered.groupBy("shingle", "kind", "root").agg(F.count("*").alias("c"))
    live = by_root.groupBy("shingle", "kind").agg(F.count("*").alias("r"), F.max(F.struct("c", "root"))["root"].alias("most")).where("r > 1").drop("r")
    alive = entered.join(live, ["shingle", "kind"])
    other = alive.where(F.col("root") != F.col("most")).select("shingle", "kind", *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "n", "p", "inside")))
    need = _need(n, F.col("o_n"), similarity)
    fits = (p <= n - need) & (F.col("o_p") <= F.col("o_n") - need)
    role = (F.col("inside") & (n <= F.col("o_n"))) | (F.col("o_inside") & (F.col("o_n") <= n))
    met = alive.join(other, ["shingle", "kind"]).where((F.col("root") != F.col("o_root")) & fits & role)
    return met.select(F.least("node", "o_node").alias("u"), F.greatest("node", "o_node").alias("v"), F.least("root", "o_root").alias("ru"), F.greatest("root", "o_root").alias("rv")).distinct()


def links(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, tf: bool = False) -> DataFrame:
    """(node, root) of all nodes that are in a class of several."""
    spark = docs.sparkSession
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    members = nodes.select(F.explode("keys").alias("key"), "node", "n")
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met, met_path = shared.written(members.join(crowded, "key"), "members")
    # n1 orders nodes, the one that meets most others first: among edited copies of a text that is the text itself. Equal ranks
    # only cost a leader more.
    score = F.least(F.sum("size"), F.lit(1 << 29)) * F.lit(1 << 33) + F.pmod(F.xxhash64("node"), F.lit(1 << 33))
    ranked = met.groupBy("node").agg((-score).alias("n1"))
    placed = met.join(ranked, "node").select("key", "node", "n1", "n")
    table, table_path = shared.written(placed.join(placed.groupBy("key").agg(F.min("n1").alias("lead")), "key"), "ranked")
    shared.remove(spark, met_path)
    wanted = table.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.cast("binary").alias("text"), F.unhex(F.md5(text)).alias("node"))
    mine = texts.join(wanted.select("node", F.col("doc_id").alias("__doc")), (texts["node"] == wanted["node"]) & F.col("doc_id").eqNullSafe(F.col("__doc"))).select(texts["node"], "doc_id", "text")
    once = mine.groupBy("node", "doc_id").agg(F.first("text").alias("text")).select("node", "text")
    sets, sets_path = shared.written(once.mapInArrow(_sets(tf), "node binary, shingles array<long>"), "shingles")

    near = F.least("n", "ln") >= similarity * F.greatest("n", "ln")  # else the sets can't be similar enough
    leaders = table.where("n1 = lead").select("key", F.col("node").alias("leader"), F.col("n").alias("ln"))
    led = table.join(leaders, "key").where((F.col("node") != F.col("leader")) & near)
    pairs = led.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()
    roots, roots_path = shared.written(components(_checked(pairs, sets, similarity)), "roots")
    tables = [table_path, sets_path]
    # What a leader has not settled: buckets whose other nodes are of several classes.
    rest = table.where("n1 <> lead").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    label = F.xxhash64("root")
    open_ = rest.groupBy("key").agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select("key")
    pool, path = shared.written(rest.join(open_, "key").select("node", "root").distinct(), "pool")
    tables.append(path)
    more, path = shared.written(_checked(prefix_pairs(pool, sets, similarity), sets, similarity).select("ru", "rv").distinct(), "links")
    tables.append(path)
    if not more.isEmpty():
        merged, path = shared.written(components(more.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("new")), "merged")
        moved = roots.join(merged, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        # A class of one node is in no row of roots yet.
        single = merged.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))
        tables += [path, roots_path]
        roots, _ = shared.written(moved.unionByName(single), "roots")
    for path in tables:
        shared.remove(spark, path)
    return roots


def classify(docs: DataFrame, weighting: str = "set", similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, node, n_shingles and root of each row of ``docs`` (doc_id, text). Classes with the same least doc_id
    share a class_id; root tells them apart."""
    ids = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = ids.select("doc_id", F.col("text").cast("binary")).mapInArrow(_sign(weighting == "tf", n_bands, rows), f"doc_id {kind}, node binary, n_shingles long, keys array<long>")
    signed, _ = shared.written(raw, "signatures")
    roots = links(ids, signed, similarity, weighting == "tf")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "root", "class_id")
    return signed.join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node", "n_shingles", "root")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its class' id and its number of shingles."""
    return classify(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_shingles")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one for each class: that with the least doc_id (of repeated ones, the one with the least text hash).

    Texts without words, and classes without a doc_id, are all kept. All columns stay as they are.
    """
    columns = docs.columns
    classes = classify(docs.select("doc_id", "text"), **options)
    # Nodes that hold their class' least doc_id; several only if a doc_id is repeated.
    heads = classes.where("node IS NOT NULL AND class_id IS NOT NULL AND doc_id = class_id").groupBy("root", "class_id").agg(F.min("node").alias("head"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)), F.col("doc_id").alias("__id"), F.unhex(F.md5(text)).alias("__node"))
    kept = rows.join(heads, (F.col("__id") == F.col("class_id")) & (F.col("__node") == F.col("head"))).dropDuplicates(["__id", "__node"])
    loose = classes.where("node IS NOT NULL AND class_id IS NULL").select(F.col("node").alias("head")).distinct()
    alone = rows.where(~text_has_word("__c" + str(columns.index("text"))))
    without = rows.where(F.col("__id").isNull()).join(loose, F.col("__node") == F.col("head"), "left_semi")
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]
    return kept.select(*names).unionByName(alone.select(*names)).unionByName(without.select(*names))


def text_has_word(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
