"""Full-text search: an inverted index as Parquet tables, boolean retrieval, phrases, prefixes, BM25, pages.

``docs``: id, name, files, size, created, seen, file_count. ``postings``: field, term, id, tf, positions, len; a row a term and
document, clustered by term so that a query's scan reads few row groups. ``terms``: field, term, df. ``fields``: field, n, avg_len.
A query is planned on the driver from its words (at most 12 of 16 tokens) and runs as one plan over the postings of its terms.
Items' texts are indexed up to ``INDEX_BYTES``, which stored ones never reach; ``limit=None`` indexes whole texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.functions import text as X
from tidewater.functions.grammar import MAX_PAGE, MAX_PER_PAGE, PER_PAGE, Word, parse

K1, B = 1.2, 0.75
NAME_BOOST, PREFIX_BOOST = 3.0, 0.5
EXPANSIONS = 200
FIELDS = {"name": ("name", False), "files": ("files", False), "name_cjk1": ("name", True), "files_cjk1": ("files", True)}


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame


def tokens_of(docs: DataFrame, field: str, limit: int | None = X.INDEX_BYTES) -> DataFrame:
    """(id, len, term, position) of a field, len the number of its tokens. Latin texts are tokenised in the JVM, only others in Python."""
    column, single = FIELDS[field]
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select("id", (text if limit is None else X.truncated(text, limit)).alias("text"))
    plain = X.is_latin(F.col("text"))
    each = lambda part, tokens: part.select("id", tokens.alias("ts")).select("id", F.size("ts").alias("len"), F.explode("ts").alias("t")).select("id", "len", "t.term", "t.position")
    other = each(rows.where(~plain), X.tokens(F.col("text"), single))
    # Latin texts have no CJK characters.
    return other if single else each(rows.where(plain), X.latin_tokens(F.col("text"))).unionByName(other)


def postings_of(docs: DataFrame, limit: int | None = X.INDEX_BYTES) -> DataFrame:
    """Postings of all fields. A document's positions of a term are gathered, never a term's documents."""
    each = [tokens_of(docs, f, limit).withColumn("field", F.lit(f)) for f in FIELDS]
    tokens = reduce(DataFrame.unionByName, each)
    grouped = tokens.groupBy("field", "id", "term").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("len").cast("long").alias("len"))
    return grouped.select("field", "term", "id", F.size("positions").alias("tf"), "positions", "len")


def build(docs: DataFrame, limit: int | None = X.INDEX_BYTES) -> Index:
    return of_postings(docs, postings_of(docs, limit))


def of_postings(docs: DataFrame, postings: DataFrame) -> Index:
    lengths = postings.groupBy("field", "id").agg(F.first("len").alias("len"))
    return Index(docs, postings, terms_of(postings), fields_of(lengths, docs))


def terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def fields_of(lengths: DataFrame, docs: DataFrame) -> DataFrame:
    """Number of documents, and average length over all of them, by field."""
    n = docs.agg(F.count("*").alias("n"))
    totals = lengths.groupBy("field").agg(F.sum("len").alias("total"))
    every = docs.sparkSession.createDataFrame([(f,) for f in FIELDS], "field string")
    return F.broadcast(n).crossJoin(every).join(totals, "field", "left").select("field", "n", (F.coalesce("total", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg_len"))  # one row by four


def expand(index: Index, field: str, prefix: str, n: int = EXPANSIONS) -> list[str]:
    """The n least terms of a field with the prefix; none for an empty prefix."""
    if not prefix:
        return []
    rows = index.terms.where((F.col("field") == field) & F.col("term").startswith(prefix)).orderBy("term").limit(n)
    return [r.term for r in rows.select("term").collect()]  # at most n


def expansions(index: Index, prefix: str, fields: tuple[str, ...] = ("name", "files"), n: int = EXPANSIONS) -> list[str]:
    """The union of the fields' expansions, sorted."""
    return sorted(set().union(*(expand(index, f, prefix, n) for f in fields)))


def _matches(index: Index, field: str, tokens: tuple[str, ...]) -> DataFrame:
    """(id, tf, len, idf) of a term, or of a phrase: places where token i stands i after the first, in one pass over postings.

    A phrase's idf is the sum of its terms'.
    """
    here = index.postings.where((F.col("field") == field) & F.col("term").isin(list(dict.fromkeys(tokens))))
    stats = F.broadcast(index.fields.where(F.col("field") == field).select("n", "avg_len"))
    wanted = index.terms.where((F.col("field") == field) & F.col("term").isin(list(dict.fromkeys(tokens)))).select("term", "df")
    idf = wanted.crossJoin(stats).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # a query's terms by one row
    if len(tokens) == 1:
        return here.join(F.broadcast(idf), "term").select("id", "tf", "len", "idf")
    spots = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(tokens)))
    mine = F.filter(spots, lambda s: s["term"] == F.col("term"))
    starts = F.flatten(F.transform(mine, lambda s: F.transform("positions", lambda p: p - s["i"])))
    found = here.select("id", "len", F.explode(starts).alias("start")).groupBy("id", "len", "start").agg(F.count("*").alias("c")).where(F.col("c") == len(tokens))
    total = F.broadcast(idf.agg(F.sum("idf").alias("idf")))
    return found.groupBy("id", "len").agg(F.count("*").alias("tf")).crossJoin(total).select("id", "tf", "len", "idf")


def _scored(index: Index, field: str, matches: DataFrame) -> DataFrame:
    stats = F.broadcast(index.fields.where(F.col("field") == field).select("n", "avg_len"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1e-9)))
    return matches.crossJoin(stats).select("id", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))


def _prefix(index: Index, field: str, tokens: tuple[str, ...]) -> DataFrame:
    """(id, score) of a prefix word: exact matches, and a constant for documents with an expansion in the last place."""
    more = expand(index, field, tokens[-1])
    constant = F.lit(PREFIX_BOOST)
    here = index.postings.where(F.col("field") == field)
    if len(tokens) == 1:
        exact = _scored(index, field, _matches(index, field, tokens))
        wide = here.where(F.col("term").isin(more)).select("id").distinct().withColumn("score", constant)
        return exact.unionByName(wide).groupBy("id").agg(F.sum("score").alias("score"))
    last = len(tokens) - 1
    spots = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(tokens[:-1])))
    fixed = F.transform(F.filter(spots, lambda s: s["term"] == F.col("term")), lambda s: s["i"])
    places = F.concat(fixed, F.when(F.col("term").isin(more), F.array(F.lit(last))).otherwise(F.array().cast("array<int>")))
    rows = here.where(F.col("term").isin([*tokens[:-1], *more])).select("id", "positions", F.explode(places).alias("i"))
    starts = rows.select("id", "i", F.explode("positions").alias("p")).select("id", "i", (F.col("p") - F.col("i")).alias("start")).distinct()
    full = starts.groupBy("id", "start").agg(F.count("*").alias("c")).where(F.col("c") == len(tokens))
    return full.select("id").distinct().withColumn("score", constant)


def word_scores(index: Index, word: Word) -> DataFrame:
    """(id, score): either field, the name's score boosted."""
    each = []
    for field, boost in zip(word.fields, (NAME_BOOST, 1.0)):
        one = _prefix(index, field, word.tokens) if word.prefix else _scored(index, field, _matches(index, field, word.tokens))
        each.append(one.withColumn("score", F.col("score") * boost))
    return each[0].unionByName(each[1]).groupBy("id").agg(F.sum("score").alias("score"))


def matching(index: Index, words: tuple[Word, ...]) -> DataFrame:
    """(id, score) of documents with every word that isn't excluded and no excluded one."""
    must = [word_scores(index, w) for w in words if not w.exclude]
    # One aggregate instead of a join a word: a document needs them all.
    tagged = reduce(DataFrame.unionByName, (m.withColumn("w", F.lit(i)) for i, m in enumerate(must)))
    found = tagged.groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("c")).where(F.col("c") == len(must)).select("id", "score")
    for w in words:
        if w.exclude:
            out = reduce(DataFrame.unionByName, (_matches(index, f, w.tokens).select("id") for f in w.fields))
            found = found.join(out, "id", "left_anti")
    return found


def ranked(index: Index, query: str, sort: str = "relevance") -> DataFrame:
    """(id, score, value) of all matches. Relevance has a score and the other sorts a value; ties go to the larger id."""
    found = matching(index, parse(query))
    keys = {"size": "size", "newest": "created", "seen": "seen", "seeders": "seen"}
    full = found.join(index.docs.select("id", "size", "created", "seen"), "id")
    if sort == "relevance":
        return full.select("id", (F.col("score") * S.popularity(F.col("seen"))).alias("score"), F.lit(0).cast("long").alias("value"))
    return full.select("id", F.lit(0.0).alias("score"), F.col(keys[sort]).cast("long").alias("value"))


def page(hits: DataFrame, page_: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """(rank, id, score, value) of one page, by a distributed top-k."""
    if not (1 <= page_ <= MAX_PAGE and 1 <= per_page <= MAX_PER_PAGE):
        raise ValueError("no such page")
    start = (page_ - 1) * per_page
    top = hits.orderBy(F.desc("score"), F.desc("value"), F.desc("id")).limit(start + per_page)
    number = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("value"), F.desc("id"))).cast("long")  # of at most 2500 rows
    return top.withColumn("rank", number).where(F.col("rank") > start).select("rank", "id", "score", "value")


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def rerank(page_: DataFrame, sort: str) -> DataFrame:
    """A hydrated page (with ``estimate``) again: by estimate, unknown last, or by relevance with the estimate's boost. Stable."""
    if sort == "seeders":
        return page_.orderBy(F.col("estimate").desc_nulls_last(), "rank")
    if sort == "relevance":
        return page_.orderBy((F.col("score") * S.seeder_boost(F.col("estimate"))).desc(), "rank")
    return page_.orderBy("rank")
