"""Bencode: strict decoding within limits, canonical encoding. Iterative, so depth costs no stack."""

from __future__ import annotations

from dataclasses import dataclass


class BencodeError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    depth: int
    items: int
    length: int


# Limits of messages, peer messages and metadata.
KRPC, PEER, METADATA = Limits(8, 512, 2048), Limits(8, 1024, 64 << 10), Limits(64, 1_000_000, 8 << 20)
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def _number(data: bytes, at: int, stop: bytes, signed: bool) -> tuple[int, int]:
    end = data.find(stop, at, at + 22)
    if end < 0:
        raise BencodeError("a number has no end")
    text = data[at:end]
    digits = text[1:] if signed and text[:1] == b"-" else text
    if not digits.isdigit() or (len(digits) > 1 and digits[:1] == b"0") or text == b"-0":
        raise BencodeError("a number is not in its only form")
    value = int(text)
    if not _MIN <= value <= _MAX:
        raise BencodeError("a number is out of range")
    return value, end + 1


def decode_prefix(data: bytes, limits: Limits = METADATA, spans: dict[tuple, tuple[int, int]] | None = None):
    """(value, where it ends). Dictionaries keep their order; ``spans`` gets the byte span of each top-level key's value.

    Keys are strings and unique; scalars and keys count as one level deeper and as items.
    """
    at, items = 0, 0
    stack: list[list] = []  # [container, pending key or None, begin of the value]
    while True:
        if at >= len(data):
            raise BencodeError("the data end early")
        items += 1
        if items > limits.items:
            raise BencodeError("too many items")
        if len(stack) + 1 > limits.depth:
            raise BencodeError("too deep")
        begin, c = at, data[at : at + 1]
        top = stack[-1] if stack else None
        want_key = top is not None and isinstance(top[0], dict) and top[1] is None
        if c == b"e" and top is not None and (want_key or isinstance(top[0], list)):
            items -= 1
            at += 1
            value = stack.pop()[0]
            begin = top[2]
        elif c.isdigit():
            size, start = _number(data, at, b":", False)
            if size > limits.length or start + size > len(data):
                raise BencodeError("a string is too long")
            value, at = data[start : start + size], start + size
            if want_key:
                if value in top[0]:
                    raise BencodeError("a key is repeated")
                top[1] = value
                continue
        elif want_key:
            raise BencodeError("a key is no string")
        elif c == b"i":
            value, at = _number(data, at + 1, b"e", True)
        elif c in (b"l", b"d"):
            stack.append([[] if c == b"l" else {}, None, begin])
            at += 1
            continue
        else:
            raise BencodeError("an unknown type")
        if not stack:
            return value, at
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        else:
            if spans is not None and len(stack) == 1:
                spans[(top[1],)] = (begin, at)
            top[0][top[1]] = value
            top[1] = None


def decode(data: bytes, limits: Limits = METADATA, spans: dict | None = None):
    value, end = decode_prefix(data, limits, spans)
    if end != len(data):
        raise BencodeError("bytes follow the value")
    return value


def encode(value) -> bytes:
    """Canonical form: keys sorted."""
    out: list[bytes] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw):
            out.append(v.data)
        elif isinstance(v, bytes):
            out.append(b"%d:%s" % (len(v), v))
        elif isinstance(v, int) and not isinstance(v, bool):
            out.append(b"i%de" % v)
        elif isinstance(v, list):
            out.append(b"l")
            todo += [_Raw(b"e"), *reversed(v)]
        elif isinstance(v, dict):
            out.append(b"d")
            pairs = [x for k in sorted(v) for x in (k, v[k])]
            todo += [_Raw(b"e"), *reversed(pairs)]
        else:
            raise BencodeError(f"cannot encode {type(v).__name__}")
    return b"".join(out)


@dataclass(frozen=True)
class _Raw:
    data: bytes
