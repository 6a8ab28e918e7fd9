import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.functions import html, text, url


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_tokenize_golden(spark):
    assert one(spark, text.tokenize(F.lit("The Rust-powered Search Engine!"))) == ["rustpowered", "search", "engine"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, text.tokenize(F.lit(""))) == []


@pytest.mark.parametrize(("raw", "wanted"), [("snake_case", "snakecase"), ("ΟΔΟΣ", "οδοσ"), ("İx", "i̇x"), ("1½", "1½")])
def test_normalize(spark, raw, wanted):
    assert one(spark, text.normalize_token(F.lit(raw))) == wanted


def test_splits_on_unicode_space(spark):
    assert one(spark, text.tokenize(F.lit("x y\u0085z\u000bu　v\u001cw​q"))) == ["x", "y", "z", "u", "vwq"]


def test_tokenize_is_idempotent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = docs.select(text.tokenize(F.col("text")).alias("t"))
    assert once.where(F.col("t") != text.tokenize(F.array_join("t", " "))).count() == 0


def test_bm25_and_tfidf_goldens(spark):
    c = [F.lit(x) for x in (3, 100)]
    assert math.isclose(one(spark, text.bm25(*c, F.lit(80.0), F.lit(10), F.lit(2))), 2.209850840700525)
    assert math.isclose(one(spark, text.tfidf(*c, F.lit(10), F.lit(2))), 0.038978489523907825)
    assert one(spark, text.tfidf(F.lit(0), F.lit(100), F.lit(10), F.lit(2))) == 0.0
    assert one(spark, text.tfidf(F.lit(3), F.lit(100), F.lit(10), F.lit(10))) == 0.0


def test_snippet_goldens():
    assert "search engine" in text.snippet_of("alpha beta gamma rust search engine delta epsilon", ["search"])
    found = text.snippet_of("x" * 100 + " rust " + "y" * 300, ["rust"])
    assert len(found) == 239 and found.index("rust") == 80 - 0
    assert len(text.snippet_of("z" * 240, [])) == 239 and len(text.snippet_of("z" * 239, [])) == 239
    assert text.snippet_of("Rust-powered engine", ["rustpowered"]).startswith("Rust")
    assert text.snippet_of(None, ["x"]) is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.text(min_size=1, max_size=4))
def test_snippet_is_bounded(body, term):
    assert len(text.snippet_of(body, [term])) <= 239


def test_trim_and_collapse(spark):
    assert one(spark, text.trim_unicode(F.lit("  a b 　"))) == "a b"
    assert one(spark, text.collapse(F.lit("\n a \t b c "))) == "a b c"
    assert one(spark, text.ascii_lower(F.lit("AK"))) == "aK"


def test_urls():
    assert url.normalize("HTTP://H.X:80/a/../b?q#f") == "http://h.x/b?q#f"
    assert url.normalize("http://h.x?q") == "http://h.x/?q"
    assert url.normalize("http://h.x/für") == "http://h.x/f%C3%BCr"
    assert url.normalize("/a") is None and url.normalize(None) is None and url.normalize("http://") is None
    assert url.join("http://h.x/p/q", "../b") == "http://h.x/b"
    assert url.join("http://h.x/p/q", "//other.y/z") == "http://other.y/z"


def test_links_of_golden():
    page = html.Page('<a href="/a">one <b>two</b></a><a href="/a">again</a><a href="#t"> </a><a href="mailto:x@y">m</a><a href="../b">b</a><a name="n">n</a>')
    assert html.links_of(page, "http://h.x/p/q") == [("http://h.x/a", "one two"), ("http://h.x/p/q#t", None), ("http://h.x/b", "b")]


def test_body_text_golden():
    assert html.Page("<html><head><title> T </title></head><body>a<b>b</b>c<!--x--><script>s</script>&amp;").text() == "a b c s &"
    page = html.Page("<title> T </title><style>z</style><body>a")
    assert page.title() == "T" and page.text() == "a" and page.text(True) == "T z a"
    assert html.Page("").text() == "" and html.Page("").title() is None


def test_assets(spark):
    doc = '<link rel="stylesheet" href="s.css"><script src="/j.js"></script><img src="i.png" alt=" A "><img alt="none"><link rel="icon" href="x">'
    got = one(spark, html.page_assets(F.lit(doc), F.lit("http://h.x/d/")))
    assert [tuple(a) for a in got] == [("http://h.x/d/i.png", "image", "A"), ("http://h.x/j.js", "script", None), ("http://h.x/d/s.css", "stylesheet", None)]
    assert one(spark, html.page_assets(F.lit(None).cast("string"), F.lit("http://h.x/"))) == []


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT tokenize('The Rust-powered Search Engine!') AS t, normalize_token('A_b') AS n").first() == (["rustpowered", "search", "engine"], "ab")
