r"""Op 8. Secret scan with multipart credential linking.

Base spans, leftmost and non-overlapping per kind: ``assign`` (key = value, value of 6 or more), ``access`` (AKIA...) and
``hex`` (24 or more). They are always reported. Weak candidates are parts that prove nothing alone: account names
(``account``), 40-character mixed tokens (``opaque``) and service addresses (``endpoint``). Parts are joined by interval
within scopes of ``REACH`` code points around each identifier, and a weak one is reported only where its complement is
there too: an opaque token with an identifier, an account with a secret, an endpoint with both.

A span is the whole match in code points, end exclusive. Null and empty texts have none; every row is scanned whole and
by itself, so no shuffle and nothing shared between repeated rows. The work on a text is linear but for sorting its parts, however long
it is. An empty table gives no rows. Only doc_id and text are read, so further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "account", "opaque", "endpoint")
IDENTIFIERS, SECRETS = ("access", "account"), ("assign", "hex", "opaque")
REACH = 256

# The base patterns of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is taken whole, so 20 or more as a whole
_HEX = re.compile(r"[0-9a-f]{24,}")
_ACCOUNT = re.compile(r"""(?<![A-Za-z0-9])(user(?:name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.IGNORECASE | re.ASCII)
_ACCOUNT_HINTS = ("user", "login", "account", "client", "access")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])")
_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![\w.-])[A-Za-z0-9.-]{1,200}\.amazonaws\.com\b""", re.ASCII)

Span = tuple[int, int, int]  #: start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found: list[Span] = []
    # lower() may make non-ASCII letters ASCII but never takes ASCII ones away, so no hint is missed.
    if any(h in low for h in _ASSIGN_HINTS):
        found += ((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        found += ((m.start(), 1, m.end()) for m in _ACCESS.finditer(text))
    found += ((m.start(), 2, m.end()) for m in _HEX.finditer(text))
    return found


def weak_spans(text: str) -> list[Span]:
    low = text.lower()
    found: list[Span] = []
    if any(h in low for h in _ACCOUNT_HINTS):
        found += ((m.start(), 3, m.end()) for m in _ACCOUNT.finditer(text))
    for m in _OPAQUE.finditer(text):
        t = m[0]
        if any(c.isupper() for c in t) and any(c.islower() for c in t) and any(c.isdigit() for c in t):
            found.append((m.start(), 4, m.end()))
    found += ((m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text))
    return found


class _Near:
    """Spans of some kinds, to ask for those that overlap a range. Those of a kind overlap nowhere, so their ends ascend too."""

    def __init__(self, spans: list[Span], kinds: tuple[str, ...]):
        self.spans = sorted(s for s in spans if KINDS[s[1]] in kinds)
        each = [[s for s in self.spans if KINDS[s[1]] == k] for k in kinds]
        self.kinds = [(x, [s[0] for s in x], [s[2] for s in x]) for x in each if x]

    def within(self, low: int, high: int) -> list[Span]:
        return sorted(s for x, starts, ends in self.kinds for s in x[bisect_left(ends, low) : bisect_right(starts, high)])


def link(spans: list[Span]) -> tuple[list[Span], list[tuple[Span, Span, Span | None]]]:
    """Weak spans to report, and (identifier, nearest secret, nearest endpoint) for each identifier with a secret in its scope."""
    identifiers, secrets, endpoints = _Near(spans, IDENTIFIERS), _Near(spans, SECRETS), _Near(spans, ("endpoint",))
    reported: set[Span] = set()
    links = []
    gap = lambda a, b: max(b[0] - a[2], a[0] - b[2], 0)
    for one in identifiers.spans:
        near = secrets.within(one[0] - REACH, one[2] + REACH)
        if not near:
            continue
        where = endpoints.within(one[0] - REACH, one[2] + REACH)
        reported.update((one, *near, *where))
        links.append((one, min(near, key=lambda s: (gap(one, s), s)), min(where, key=lambda s: (gap(one, s), s), default=None)))  # noqa: B023
    return sorted(s for s in reported if s[1] >= len(BASE)), links


def scan(text: str | None) -> tuple[list[Span], list[tuple[Span, Span, Span | None]]]:
    """Reported spans in order (start, then kind), and links."""
    if not text:
        return [], []
    base = base_spans(text)
    weak, links = link(base + weak_spans(text))
    return sorted(base + weak), links


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links")}
        for text in batch.column(1):
            spans, links = scan(text.as_py())
            base = [s for s in spans if s[1] < len(BASE)]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
            out["spans"].append(spell(spans))
            out["n_links"].append(len(links))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["doc_id", *out])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, with the number of linked credentials."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digests, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, rest = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = text.as_py()
            for one, secret, where in scan(t)[1]:
                ids.append(doc_id)
                texts.append([t[s[0] : s[2]] if s else None for s in (one, secret, where)])
                rest.append((KINDS[one[1]], one[0], KINDS[secret[1]], secret[0]))
        columns = [pa.array(ids, batch.schema.field(0).type)]
        columns += [pa.array([r[i] for r in rest], pa.string() if i % 2 == 0 else pa.int64()) for i in range(4)]
        columns += [pa.array([x[i] for x in texts], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "identifier_kind", "identifier_start", "secret_kind", "secret_start", "identifier", "secret", "endpoint"])


def credentials(docs: DataFrame) -> DataFrame:
    """A row for each identifier that a secret was found near, with the texts of its parts."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _links,
        f"doc_id {id_type}, identifier_kind string, identifier_start long, secret_kind string, secret_start long, identifier string, secret string, endpoint string",
    )
