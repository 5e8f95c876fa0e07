"""Text rules that Spark SQL has no functions for: NFC/NFKC cleaning, script classes, tokens, charsets.

Each rule is a plain function (the definition, and what tests hold on to) and a pandas UDF over it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_CHARS, PATH_CHARS, COMPONENT_LIMIT, TOKEN_BYTES, INDEX_BYTES = 1024, 4096, 255, 64, 64 * 1024
UNNAMED = "(unnamed)"

# Characters that must not be displayed (bidi controls, controls other than white space, zero-width, BOM, non-characters).
_UNWANTED = regex.compile(
    r"[\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069\u200B-\u200D\u2060\uFEFF\uFFF9-\uFFFB\uFDD0-\uFDEF]|(?!\p{White_Space})\p{Cc}"
)
_SPACE = regex.compile(r"\p{White_Space}+")
_CJK = regex.compile(r"[\p{scx=Han}\p{scx=Hiragana}\p{scx=Katakana}\p{scx=Hangul}]")
_GENERAL = regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")
_LATIN = regex.compile(r"\p{Script=Latin}")
# Latin letters whose ASCII form is not their base letter.
_SPECIAL = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "n", "ſ": "s",
    "ƒ": "f", "ĸ": "q", "ŧ": "t", "ə": "a", "ǝ": "e", "ɛ": "e", "ɩ": "i", "ɔ": "o", "ʒ": "z", "ɑ": "a",
}


def is_unwanted(c: str) -> bool:
    return bool(_UNWANTED.match(c)) or ord(c) & 0xFFFE == 0xFFFE


def is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def is_cjk(c: str) -> bool:
    """By script extensions, so that the prolonged sound mark is Katakana."""
    return bool(_CJK.match(c)) and not _GENERAL.match(c)


def contains_cjk(token: str) -> bool:
    return any(map(is_cjk, token))


def is_cjk_unigram(token: str) -> bool:
    """One CJK character and marks."""
    return bool(token) and is_cjk(token[0]) and all(map(is_mark, token[1:]))


def sanitize_display(s: str | None, limit: int = NAME_CHARS) -> str | None:
    """NFC without unwanted characters, white space runs as one space, trimmed, at most ``limit`` characters and no space at the cut."""
    if s is None:
        return None
    clean = "".join(c for c in unicodedata.normalize("NFC", s) if not is_unwanted(c))
    return _SPACE.sub(" ", clean).strip(" ")[:limit].rstrip(" ")


def sanitize_component(s: str | None) -> str | None:
    """A component of a path: no separators, within 255 characters and bytes; null for '', '.' and '..'."""
    if s is None:
        return None
    clean = sanitize_display(s.replace("/", "_").replace("\\", "_"), COMPONENT_LIMIT)
    clean = truncate_bytes(clean, COMPONENT_LIMIT).rstrip()
    return None if clean in ("", ".", "..") else clean


def truncate_bytes(s: str | None, limit: int = INDEX_BYTES) -> str | None:
    """The longest prefix of whole characters within ``limit`` bytes."""
    return None if s is None else s if len(s) * 4 <= limit else s.encode("utf-8", "replace")[:limit].decode("utf-8", "ignore")


def decode_bytes(data: bytes | None, label: str | None = None) -> str | None:
    """UTF-8; else the labelled charset, else GB18030, where that loses nothing; else UTF-8 with replacements."""
    if data is None:
        return None
    for charset in ("utf-8", label, "gb18030"):
        try:
            if charset:
                return bytes(data).decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return bytes(data).decode("utf-8", "replace")


def fold(word: str) -> str:
    """Latin letters as ASCII; letters of other scripts keep their accents."""
    out = []
    for c in word:
        if c in _SPECIAL:
            out.append(_SPECIAL[c])
        elif c > "\x7f" and _LATIN.match(c):
            base = unicodedata.normalize("NFKD", c)
            plain = "".join(_SPECIAL.get(b, b) for b in base if not is_mark(b))
            out.append(plain if plain.isascii() else c)
        else:
            out.append(c)
    return "".join(c for c in "".join(out) if _ALNUM.match(c) or is_mark(c))


Token = tuple[str, int, int, int]  #: term, position, and byte span in the text


def _characters(text: str) -> Iterator[tuple[str, int, int]]:
    """Normalised characters with the byte span of their cluster: NFKC by cluster, then lower case by character."""
    at = 0
    for m in _CLUSTER.finditer(text):
        cluster = m[0]
        to = at + len(cluster.encode("utf-8", "surrogatepass"))
        for n in unicodedata.normalize("NFKC", cluster):
            for c in n.lower():
                yield c, at, to
        at = to


def _segments(text: str) -> Iterator[tuple[bool, list[tuple[str, int, int]]]]:
    """Runs of word characters of one class, as units of a character and its marks; True for CJK."""
    units: list[tuple[str, int, int]] = []
    cjk = False
    for c, a, b in _characters(text):
        if is_mark(c):
            if units:  # a leading mark is dropped
                units[-1] = (units[-1][0] + c, units[-1][1], b)
            continue
        if not _ALNUM.match(c):
            if units:
                yield cjk, units
                units = []
            continue
        if units and is_cjk(c) != cjk:
            yield cjk, units
            units = []
        cjk = is_cjk(c)
        units.append((c, a, b))
    if units:
        yield cjk, units


def tokenize(text: str | None, unigrams: bool = False) -> list[Token]:
    """Words and CJK bigrams (a lone CJK character is itself); with ``unigrams`` CJK characters only.

    A token over 64 bytes is left out, but its position is used up.
    """
    found: list[Token] = []
    position = 0
    for cjk, units in _segments(text or ""):
        if cjk and (unigrams or len(units) == 1):
            terms = units
        elif cjk:
            terms = [(a[0] + b[0], a[1], b[2]) for a, b in zip(units, units[1:])]
        elif unigrams:
            continue
        else:
            word = "".join(u[0] for u in units)
            terms = [(word if word.isascii() else fold(word), units[0][1], units[-1][2])]
        for term, a, b in terms:
            if term and len(term.encode("utf-8", "surrogatepass")) <= TOKEN_BYTES:
                found.append((term, position, a, max(a, b)))
            position += 1
    return found


TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def _map(f, series: pd.Series, *args) -> pd.Series:
    return pd.Series([f(v, *args) for v in series], dtype=object)


@F.pandas_udf(TOKENS)
def _tokens_udf(text: pd.Series) -> pd.Series:
    return _map(tokenize, text)


@F.pandas_udf(TOKENS)
def _unigrams_udf(text: pd.Series) -> pd.Series:
    return _map(tokenize, text, True)


def tokens(text: Column, unigrams: bool = False) -> Column:
    """The tokens of any text, by Arrow batches."""
    return (_unigrams_udf if unigrams else _tokens_udf)(text)


def ascii_tokens(text: Column) -> Column:
    """The same for texts of ASCII only, without Python; positions are those of ``tokenize``."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))
    placed = F.transform(runs, lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("position")))
    return F.filter(placed, lambda t: F.octet_length(t["term"]) <= TOKEN_BYTES)


def _latin() -> dict[str, str]:
    """What ``tokenize`` makes of each accented Latin letter that it neither drops nor takes for a break."""
    found = {}
    for c in map(chr, range(0xC0, 0x180)):
        made = tokenize(f"a{c}a")
        if len(made) == 1 and made[0][0].isascii() and len(made[0][0]) > 2:
            found[c] = made[0][0][1:-1]
    return found


LATIN = _latin()
_ONE = {c: x for c, x in LATIN.items() if len(x) == 1}
_MORE = {c: x for c, x in LATIN.items() if len(x) > 1}


def _ranges(chars: str) -> str:
    """Sorted characters as ranges of a character class, which is then tried by a few comparisons instead of one a character."""
    found: list[list[str]] = []
    for c in sorted(chars):
        if found and ord(c) == ord(found[-1][1]) + 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"{a}-{b}" for a, b in found)


def is_latin(text: Column) -> Column:
    """Only ASCII and letters of LATIN: texts that ``latin_tokens`` takes."""
    return text.rlike(f"^[\\x00-\\x7F{_ranges(''.join(LATIN))}]*$")


def latin_tokens(text: Column) -> Column:
    """The tokens of such a text, without Python."""
    for c, x in _MORE.items():
        text = F.replace(text, F.lit(c), F.lit(x))
    return ascii_tokens(F.translate(text, "".join(_ONE), "".join(_ONE.values())))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.pandas_udf(T.StringType())
def _display_udf(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([sanitize_display(s, int(n)) for s, n in zip(text, limit)], dtype=object)


def display(text: Column, limit: int = NAME_CHARS) -> Column:
    return _display_udf(text, F.lit(limit))


def display_ascii(text: Column, limit: int = NAME_CHARS) -> Column:
    """``display`` for ASCII texts, as built-in functions."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    return F.rtrim(F.left(F.trim(F.regexp_replace(clean, r"[ \t\n\x0B\f\r]+", " ")), F.lit(limit)))


@F.pandas_udf(T.StringType())
def component(text: pd.Series) -> pd.Series:
    return _map(sanitize_component, text)


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(d, c) for d, c in zip(data, label)], dtype=object)


@F.pandas_udf(T.StringType())
def _truncated_udf(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([truncate_bytes(s, int(n)) for s, n in zip(text, limit)], dtype=object)


def truncated(text: Column, limit: int = INDEX_BYTES) -> Column:
    return F.when(F.octet_length(text) <= limit, text).otherwise(_truncated_udf(text, F.lit(limit)))
