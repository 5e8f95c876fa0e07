"""Op 6. Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-sorted by doc_id (ties by a hash of the text, then the text; a null doc_id comes first), or keep the
order of the rows of a table (``by_row``), as a mix's must. Each partition is one file of ids, of the smallest unsigned type that holds the vocabulary, one of offsets (``<u8``, one more
than documents) and one of document ids. A partition's base is the prefix sum of the sizes before it, over one row a
partition, and stands in ``manifest.json``. An attempt's files have names of their own, so a lost executor's tasks are simply repeated.

A text is encoded whole. Where the tokenizer's file says that it cuts bytes by the usual pattern and normalises nothing (``cuts_at_spaces``), no
token spans a single space between words, so a text is cut before such spaces and the pieces' ids are looked up in a bounded cache;
pieces not in it are encoded by the library, and so are whole texts for any other tokenizer. ``encode`` gives what the library
gives for the whole text. Null and empty texts hold the end id alone. A very long text, its pieces and its ids are held once, in one task.

doc_id must be an integer, or null; a text of another type is cast. Repeated rows are written each. An empty table makes a manifest
without parts, and no rows. Only doc_id and text are read, so further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.llm import files
from tidewater.llm.textkit import portions, release

END = 2
CACHE = 1_000_000  #: pieces; about 200 bytes each
TEXT_BYTES = 8 << 20  #: of texts that are encoded together, so that each piece is looked up once; a longer text is one portion
AT_ONCE = 4096  #: pieces or texts that the library encodes in one call
SIGHTS = 1 << 24  #: bits, one by hash for each piece that has been met; a shared bit only keeps a piece too early
READ_IDS = 1 << 22  #: ids taken at once when files are read back
_IDS = np.dtype([("id", "<i8"), ("null", "u1")])


class Keep(NamedTuple):
    """What a worker process holds."""

    cache: int = CACHE  #: pieces
    sights: int = 1  #: a piece is kept from this one on
    texts: int = TEXT_BYTES
    after: bool = True  #: the encoder stays for the worker's next task


#: For workers that have other things to hold, or stages after this: fewer pieces, smaller portions, nothing after the task. It takes longer.
LEAN = Keep(400_000, 2, 1 << 20, False)
#: A space between characters that are no white space: no pre-token spans it, and it begins the next one.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts_at_spaces(made: dict) -> bool:
    """Does a tokenizer (its JSON) never join what a single space divides?"""
    before, special = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(plain and not made.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in special))


class Encoder:
    """Whole-text encoding through a cache of pieces."""

    def __init__(self, path: str, end: int = END, cache: int = CACHE, sights: int = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.dtype = dtype_of(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.end = np.array([end], self.dtype).tobytes()
        # Most pieces are met once. With two sights a piece is kept when it is met in a second call.
        self.limit, self.sights, self.known, self.met = cache, sights, {}, bytearray(SIGHTS // 8)

    def _library(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        # The library's results are a hundred times as large as the ids, so only some are held at once.
        coded = [array(code, e.ids) for a in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in coded:
                a.byteswap()
        return [a.tobytes() for a in coded]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        texts = [t or "" for t in texts]
        if not self.cuts:
            return [ids + self.end for ids in self._library(texts)]
        pieces = [t.split(" ") for t in texts]
        tails = [""] * len(texts)
        new = set().union(*(p[1:] for p in pieces)).difference(self.known)
        # A piece with white space at an end is part of a longer run, which must not be divided. It is never cached.
        bad = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        for i, p in enumerate(pieces):
            if len(p) > 1 and (not p[0] or p[0][-1].isspace() or (bad and not bad.isdisjoint(p))):
                pieces[i] = p = _CUT.split(texts[i])
                tails[i] = " " + p.pop() if len(p) > 1 else ""
                new.update(p[1:])
        if len(self.known) > self.limit:
            self.known, self.met = {}, bytearray(SIGHTS // 8)
            new = set().union(*(p[1:] for p in pieces))
        todo = [p for p in new if p not in bad and p not in self.known]
        found = dict(zip(todo, self._library([" " + p for p in todo])))
        met, once = self.met, []
        for p in todo if self.sights > 1 else ():
            h = hash(p) & (SIGHTS - 1)
            if not met[h >> 3] >> (h & 7) & 1:
                met[h >> 3] |= 1 << (h & 7)
                once.append(p)
        ends = self._library([p[0] for p in pieces] + tails)
        # One mapping for both: those of this call in the cache for as long as it lasts.
        self.known.update(found)
        find = self.known.__getitem__
        coded = [ends[i] + b"".join(map(find, p[1:])) + ends[len(pieces) + i] + self.end for i, p in enumerate(pieces)]
        for p in once:
            del self.known[p]
        return coded


@lru_cache(maxsize=1)
def encoder_of(path: str, end: int, cache: int, sights: int) -> Encoder:
    """One for a worker process, so that tasks after the first find its cache filled."""
    return Encoder(path, end, cache, sights)


def dtype_of(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _writer(folder: str, tokenizer: str, end: int, keep: Keep):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        context = TaskContext.get()
        # Each attempt has files of its own; those of the one that counts are in the manifest.
        part = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        name = f"{folder}/{part}"
        total = docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer, end, keep.cache, keep.sights)
                ids, offsets, keys = (files.Atomic(f"{name}.{x}", context.taskAttemptId()) for x in ("ids", "offsets", "docs"))
                offsets.write(np.array([0], "<u8").tobytes())
            texts, lengths = batch.column(1), []
            for a, b in portions([len(t.as_buffer()) if t.is_valid else 0 for t in texts], keep.texts):
                coded = encoder.encode(texts.slice(a, b - a).to_pylist())
                ids.write(b"".join(coded))
                lengths += map(len, coded)
            sizes = np.array(lengths, np.int64) // encoder.dtype.itemsize
            offsets.write((total + np.cumsum(sizes)).astype("<u8").tobytes())
            key = np.zeros(len(lengths), _IDS)
            column = batch.column(0)
            key["null"] = column.is_null().to_numpy(zero_copy_only=False)
            key["id"] = column.fill_null(0).to_numpy(zero_copy_only=False)
            keys.write(key.tobytes())
            total += int(sizes.sum())
            docs += len(lengths)
        if encoder is not None:
            for f in (ids, offsets, keys):
                f.done()
            dtype = encoder.dtype
            if not keep.after:
                encoder = coded = None
                encoder_of.cache_clear()
                release()
            yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "name": part, "docs": docs, "ids": total, "dtype": dtype.str}])

    return write


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` (a Parquet table that Spark wrote) with ``__part``, ``__file`` and ``__at``: where each row stands in it.

    A scan deals files to tasks by size, so the order of its partitions is not that of the table.
    """
    name = F.col("_metadata.file_name")
    place = {"__part": F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), "__file": name, "__at": F.col("_metadata.row_index")}
    return docs.select("doc_id", "text", *(c.alias(k) for k, c in place.items()))


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, by_row: bool = False, keep: Keep = Keep()) -> dict:
    """Encode ``docs`` (doc_id, text) into ``folder``; the manifest, which is also written there."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if by_row:
        order = ["__part", "__file", "__at"]
        dealt = _by_row(docs).select(*columns, *order).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    else:
        order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
        dealt = docs.select(*columns).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    # One row a partition comes back.
    parts = dealt.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end, keep), "part long, name string, docs long, ids long, dtype string").collect()
    base, listed = [0, 0], []
    for p in sorted(parts, key=lambda p: p.part):
        listed.append({"name": p.name, "docs": p.docs, "ids": p.ids, "first_doc": base[0], "first_id": base[1]})
        base = [base[0] + p.docs, base[1] + p.ids]
    manifest = {"dtype": parts[0].dtype if parts else "<u2", "end": end, "docs": base[0], "ids": base[1], "parts": listed}
    files.write_json(f"{folder}/manifest.json", manifest)
    return manifest


def _reader(folder: str, dtype: str):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame.itertuples():
                name = f"{folder}/{part.name}"
                offsets = files.read_array(f"{name}.offsets", "<u8", 0, part.docs + 1).astype(np.int64)
                keys = files.read_array(f"{name}.docs", _IDS, 0, part.docs)
                at = 0
                while at < part.docs:
                    to = max(int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1, at + 1)
                    ids = files.read_array(f"{name}.ids", dtype, offsets[at], offsets[to] - offsets[at]).astype("<u4")
                    cut = offsets[at : to + 1] - offsets[at]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                    key = keys[at:to]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.Series(key["id"], dtype="Int64").mask(key["null"] != 0),
                            "start": offsets[at:to] + part.first_id,
                            "n_tokens": np.diff(cut),
                            "ids_crc32": crc,
                        }
                    )
                    at = to

    return read


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers."""
    manifest = files.read_json(f"{folder}/manifest.json")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    rows = [(p["name"], p["docs"], p["first_id"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "name string, docs long, first_id long")
    return parts.mapInPandas(_reader(folder, manifest["dtype"]), schema)


def document(folder: str, i: int) -> np.ndarray:
    """The ids of the i-th document of the whole, by memory map."""
    manifest = files.read_json(f"{folder}/manifest.json")
    part = next(p for p in manifest["parts"] if p["first_doc"] <= i < p["first_doc"] + p["docs"])
    a, b = files.read_array(f"{folder}/{part['name']}.offsets", "<u8", i - part["first_doc"], 2).astype(np.int64)
    return files.read_array(f"{folder}/{part['name']}.ids", manifest["dtype"], a, b - a)


def digest(docs: DataFrame, by_row: bool = False, **options) -> DataFrame:
    """Write all documents' ids to new files in the shared folder and read the contract's columns back from them."""
    spark = docs.sparkSession
    folder = shared.new_path(spark, "tokens")
    write(docs, folder, by_row=by_row, **options)
    return read(spark, folder)
