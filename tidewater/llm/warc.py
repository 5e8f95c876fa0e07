r"""Op 10. WARC: archives from pages, and the normaliser of monolithic gzip archives.

``write`` makes archives that are one gzip stream each, as some crawlers leave them. ``normalise`` inflates such a stream
once, whatever its members are, and writes every record as a gzip member of its own with a sidecar index of offsets, so
that a record can be read by one seek. ``read`` reads normalised archives through their indexes.

Of records with equal payloads the one with the largest page_id is a ``response``; the others are ``revisit`` records
that refer to it and hold the HTTP header only. Payloads under ``least`` bytes are all responses. Repeated rows with the
largest page_id are each a response; a null page_id is never the largest unless all are null, and then all are
responses. A null html is an empty payload, a null url is left out of the header.

A payload's group is decided by an aggregate on its digest. Digests with over a part in ``HEAVY`` of all pages, of which there
are fewer than ``HEAVY``, are broadcast and their pages are dealt by page; the pages of the others meet theirs by digest. So a payload
that a third of all pages have is no task of its own. Archives are written by partition, in streams of bounded memory; a
very long payload is held once while its record is made. A torn stream is an error. Further columns, whatever their names, are
not read. An empty table makes no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import shared
from tidewater.llm import files

CHUNK = 1 << 20
HEAVY = 50_000
HEAVY_ROWS = 1000  #: and no digest of fewer pages is heavy
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("8a1f2c5e-6f2b-4f55-9d0a-3d7d0f6f3a11")
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, owner: int | None, owner_url: str | None) -> bytes:
    """One WARC/1.1 record."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(owner, owner_url)}", f"X-Refers-To-Page-ID: {owner}"]
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is under ''."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields = {"": first}
    for line in rest:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces of at most CHUNK."""
    stream, open_ = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            if stream.eof:
                stream, open_ = zlib.decompressobj(31), False
            piece = stream.decompress(data, CHUNK)
            open_ = True
            if piece:
                yield piece
            data = stream.unused_data if stream.eof else stream.unconsumed_tail
    while open_ and not stream.eof:
        piece = stream.decompress(stream.unconsumed_tail, CHUNK)
        if not piece:
            raise ValueError("the archive ends within a gzip member")
        yield piece


def members(pieces: Iterator[bytes], level: int = 6) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """For each record: its header, and the compressed bytes of its own member, which must be used up first."""
    buffer = b""

    def fill(need: int) -> bool:
        nonlocal buffer
        parts = [buffer]
        have = len(buffer)
        while have < need and (more := next(pieces, None)) is not None:
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= need

    def body(head: bytes, left: int) -> Iterator[bytes]:
        nonlocal buffer
        packer = zlib.compressobj(level, wbits=31)
        yield packer.compress(head)
        while left:
            if not buffer and not fill(1):
                raise ValueError("the archive ends within a record")
            take, buffer = buffer[:left], buffer[left:]
            left -= len(take)
            yield packer.compress(take)
        yield packer.flush()

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head, buffer = buffer[: end + 4], buffer[end + 4 :]
        fields = parse_head(head[:-4].lstrip(b"\r\n"))
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {fields['']!r:.80}")
        yield fields, body(head.lstrip(b"\r\n"), int(fields["content-length"]) + 4)


def normalise(source: str, target: str, attempt: int = 0, level: int = 6) -> int:
    """Rewrite a gzip archive with a member for each record, and ``target.index`` (offset and length, ``<u8``); the number of records."""
    store, path = files.open_path(files.normal(source))
    out, index = files.Atomic(target, attempt), files.Atomic(target + ".index", attempt)
    n = at = 0
    with store.open_input_stream(path, compression=None) as stream:
        for _, member in members(inflate(iter(lambda: stream.read(CHUNK), b"")), level):
            begin = at
            for piece in member:
                out.write(piece)
                at += len(piece)
            index.write(begin.to_bytes(8, "little") + (at - begin).to_bytes(8, "little"))
            n += 1
    out.done()
    index.done()
    return n


def read_record(data: bytes) -> dict:
    """What a member holds, checked against its own header."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(parse_head(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id")}


def marked(pages: DataFrame, least: int = 0, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """page_id, url, payload, kind, and the id and url of the response that a revisit refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("owner"), F.max(F.struct("page_id", "url")).alias("last")).where("n > 1")
    owners, _ = shared.written(groups.select("digest", "n", "owner", F.col("last.url").alias("owner_url")), "owners")
    bound = max(heavy_rows, pages.count() // HEAVY)  # so fewer than HEAVY digests are heavy
    heavy = owners.where(F.col("n") > bound).select("digest", F.struct("owner", "owner_url").alias("h"))
    light = owners.where(F.col("n") <= bound).select(F.col("digest").alias("key"), F.struct("owner", "owner_url").alias("l"))
    own = F.concat(F.lit("page ").cast("binary"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    first = rows.join(F.broadcast(heavy), "digest", "left").withColumn("key", F.when(F.col("h").isNull(), F.concat(F.lit("digest ").cast("binary"), F.col("digest"))).otherwise(own))
    both = first.join(light.withColumn("key", F.concat(F.lit("digest ").cast("binary"), F.col("key"))), "key", "left")
    both = both.withColumns({"owner": F.coalesce("h.owner", "l.owner"), "owner_url": F.when(F.col("h").isNotNull(), F.col("h.owner_url")).otherwise(F.col("l.owner_url"))})
    revisit = (F.octet_length("payload") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return both.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("owner")).alias("owner"), F.when(revisit, F.col("owner_url")).alias("owner_url"))


def _writer(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, out, n = TaskContext.get(), None, 0
        name = f"raw-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"  # of this attempt
        none = lambda v: None if v is None or v != v else v
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    out, packer = files.Atomic(f"{folder}/{name}", context.taskAttemptId()), zlib.compressobj(1, wbits=31)
                ids = [None if none(v) is None else int(v) for v in (row.page_id, row.owner)]
                out.write(packer.compress(record(ids[0], none(row.url), bytes(row.payload), row.kind, ids[1], none(row.owner_url))))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.done()
            yield pd.DataFrame({"name": [name], "records": [n]})

    return write


def write(pages: DataFrame, folder: str, least: int = 0) -> list[str]:
    """Write one monolithic archive a partition into ``folder``; their names, sorted."""
    rows = marked(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "owner")})  # pandas makes longs with nulls floats
    return sorted(r.name for r in rows.mapInPandas(_writer(folder), "name string, records long").collect())  # one row a partition


def _each(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.parallelize([(n,) for n in names], max(len(names), 1)), "name string")


def normalise_all(spark: SparkSession, folder: str, names: list[str], target: str) -> list[tuple[str, int]]:
    """Normalise archives in parallel; (name, records) of each that is made. Names tell attempts apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["name"]:
                made = f"{name.removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                n = normalise(f"{folder}/{name}", f"{target}/{made}", TaskContext.get().taskAttemptId())
                yield pd.DataFrame({"name": [made], "records": [n]})

    return sorted((r.name, r.records) for r in _each(spark, names).mapInPandas(run, "name string, records long").collect())


def read(spark: SparkSession, folder: str, names: list[str], batch: int = 1000) -> DataFrame:
    """The records of normalised archives, each read by its offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["name"]:
                index = files.read_array(f"{folder}/{name}.index", "<u8").reshape(-1, 2)
                store, path = files.open_path(files.normal(f"{folder}/{name}"))
                with store.open_input_file(path) as f:
                    for at in range(0, len(index), batch):
                        rows = []
                        for offset, length in index[at : at + batch].tolist():
                            f.seek(offset)
                            rows.append(read_record(f.read(length)))
                        yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _each(spark, names).mapInPandas(run, SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages; the contract's columns, from the records read."""
    spark = pages.sparkSession
    raw, clean = shared.new_path(spark, "warc-raw"), shared.new_path(spark, "warc")
    names = [name for name, _ in normalise_all(spark, raw, write(pages, raw), clean)]
    shared.remove(spark, raw)
    return read(spark, clean, names)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS owner, sha1(t) AS hex FROM p),
n AS (SELECT *, ('0x' || substr(hex, 1, 10))::BIGINT AS a, ('0x' || substr(hex, 11, 10))::BIGINT AS b,
             ('0x' || substr(hex, 21, 10))::BIGINT AS c, ('0x' || substr(hex, 31, 10))::BIGINT AS d FROM g)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> (5 * (7 - i))) & 31)::INT, 1)
                                FOR i IN range(8)] FOR x IN [a, b, c, d]]), 'string_agg', '') AS payload_digest,
       CASE WHEN owner IS NULL OR page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner IS NULL OR page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to FROM n
"""
