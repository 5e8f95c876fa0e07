"""Tokens, cleaning and the query grammar against fixed expectations."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import grammar as G
from tidewater.functions import text as X


def terms(s, single=False):
    return [t[0] for t in X.tokenize(s, single)]


@pytest.mark.parametrize(
    "given, want",
    [
        ("Ubuntu-22.04_desktop[amd64].iso", ["ubuntu", "22", "04", "desktop", "amd64", "iso"]),
        (".-_[]()!@#", []),
        ("Café Straße Ångström", ["cafe", "strasse", "angstrom"]),
        ("ＵＢＵＮＴＵ　２２", ["ubuntu", "22"]),
        ("ｶﾀｶﾅ", ["カタ", "タカ", "カナ"]),
        ("東京大学", ["東京", "京大", "大学"]),
        ("猫", ["猫"]),
        ("Ubuntu東京2024", ["ubuntu", "東京", "2024"]),
        ("ラーメン", ["ラー", "ーメ", "メン"]),
        ("a゙", ["a゙"]),
        ("ΟΔΟΣ", ["οδοσ"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(given, want):
    assert terms(given) == want


def test_long_tokens_leave_a_gap():
    assert [(t[0], t[1]) for t in X.tokenize("x " + "a" * 65 + " " + "b" * 64)] == [("x", 0), ("b" * 64, 2)]


def test_single_cjk_characters():
    assert terms("Ubuntu東京2024 한국-ｶﾅ!", True) == ["東", "京", "한", "국", "カ", "ナ"]
    assert terms("café", True) == [] and terms("が", True) == ["が"]
    assert X.is_cjk_unigram("学́") and not X.is_cjk_unigram("ab")


def test_ascii_tokens_in_the_jvm_are_the_same(spark):
    given = ["Ubuntu-22.04_desktop", "", "x " + "a" * 70 + " y", "don't", " \t\n"]
    rows = spark.createDataFrame([(s,) for s in given], "s string").select("s", X.ascii_tokens(F.col("s")).alias("t")).collect()
    assert all([(t.term, t.position) for t in r.t] == [t[:2] for t in X.tokenize(r.s)] for r in rows)


def test_display():
    assert X.sanitize_display(" a‮​ \n\t b\x07 ") == "a b"
    assert X.sanitize_display("ab cd", 3) == "ab" and X.sanitize_display("é") == "é" and X.sanitize_display(None) is None
    assert X.sanitize_component("..") is None and X.sanitize_component("a/b\\c") == "a_b_c" and len(X.sanitize_component("é" * 300).encode()) <= 255


def test_display_ascii_is_display(spark):
    given = [" a \n b ", "x" * 100, "a\x00b", "ab cd ef"]
    rows = spark.createDataFrame([(s,) for s in given], "s string").select("s", X.display_ascii(F.col("s"), 7).alias("d"), X.display(F.col("s"), 7).alias("e")).collect()
    assert all(r.d == r.e for r in rows)


def test_charsets():
    assert X.decode_bytes("日".encode("shift-jis"), "shift-jis") == "日" and X.decode_bytes("你".encode("gb18030")) == "你"
    assert X.decode_bytes(b"\xff") == "�" and X.truncate_bytes("éé", 3) == "é"


def test_grammar():
    words = G.parse('foo -bar "a b" baz')
    assert [(w.tokens, w.exclude, w.quoted, w.prefix) for w in words] == [(("foo",), False, False, False), (("bar",), True, False, False), (("a", "b"), False, True, False), (("baz",), False, False, True)]
    for text in ("baz ", "b", "東京", '"baz"', "foo !!!", "foo -", 'foo ""', 'foo "', "é", "foo "):
        assert not G.parse(text)[0].prefix, text
    for text in ("foo", "ß", "22.0"):
        assert G.parse(text)[0].prefix, text
    assert not G.parse("-".join("abcdefghijklmnopqrst"))[0].prefix
    assert G.parse("学")[0].fields == ("name_cjk1", "files_cjk1")
    for text in ("", "   ", "-foo -bar", '* . -- ""', "a" * 201, " ".join(["w"] * 13)):
        with pytest.raises(G.QueryError):
            G.parse(text)
    assert len(G.parse(" ".join(["w"] * 12))) == 12 and len(G.parse("東" * 200)[0].tokens) == 16


def test_pages():
    assert G.bounded(" ", 20, 50) == 20 and G.bounded("7", 20, 50) == 7
    with pytest.raises(ValueError):
        G.bounded("51", 20, 50)
    assert G.has_next(1, 20, 21) and not G.has_next(1, 20, 20) and not G.has_next(50, 20, 10**6)
