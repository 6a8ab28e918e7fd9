"""Text and scoring functions as Column expressions; nothing here leaves the JVM but snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as a Java pattern. Java's own \s is ASCII.
WS = r"\p{IsWhite_Space}"

#: Stop words of the current profile: fixed values.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()

#: Stop words of the legacy profile's queries, where no list is given.
LEGACY_STOP_WORDS_LANGUAGE = "english"


def normalize_token(token: Column) -> Column:
    """Letters and numbers only, each lower-cased on its own (so a final sigma stays a plain one)."""
    return F.translate(F.lower(F.regexp_replace(token, r"[^\p{IsAlphabetic}\p{N}]", "")), "ς", "σ")


def raw_words(text: Column) -> Column:
    """Words between Unicode white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Normalised words without empty ones and stop words; repeats stay.

    The text is normalised once as a whole, white space kept, and split afterwards, which is
    the same as word by word and cheaper.
    """
    stop = STOP_WORDS if stop_words is None else stop_words
    plain = F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{IsAlphabetic}}\p{{N}}{WS}]", "")), "ς", "σ")
    words = F.split(plain, f"{WS}+")
    keep = (lambda w: (w != "") & ~w.isin(*stop)) if stop else (lambda w: w != "")
    return F.filter(words, keep)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def content_path(digest: Column) -> Column:
    return F.concat(F.lit("content/"), digest, F.lit(".html"))


def result_line(number: Column, title: Column, url: Column, score: Column) -> Column:
    return F.format_string("%d. %s\n   URL: %s\n   Score: %.6f\n", number.cast("long"), F.coalesce(title, F.lit("Untitled")), url, score)


def bm25(tf: Column, doc_len: Column, avg_doc_len: Column, documents: Column, doc_freq: Column) -> Column:
    """Okapi BM25 with k1 = 1.2 and b = 0.75; the mean length counts as 1 at least; 0 if any count is 0."""
    n, df, t = documents.cast("double"), doc_freq.cast("double"), tf.cast("double")
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    norm = 0.25 + 0.75 * (doc_len.cast("double") / F.greatest(avg_doc_len, F.lit(1.0)))
    return F.when((tf > 0) & (doc_len > 0) & (documents > 0) & (doc_freq > 0), idf * (t * 2.2) / (t + 1.2 * norm)).otherwise(0.0)


def tfidf(tf: Column, doc_len: Column, documents: Column, doc_freq: Column) -> Column:
    value = tf.cast("double") / doc_len.cast("double") * F.log((documents.cast("double") + 1.0) / (doc_freq.cast("double") + 1.0))
    return F.when((tf > 0) & (doc_len > 0) & (documents > 0) & (doc_freq > 0), value).otherwise(0.0)


_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def snippet_of(text: str | None, terms: list[str]) -> str | None:
    """The text around the first term: from 80 bytes before it, 239 characters, spaces collapsed.

    Terms are looked up as substrings of the lower-cased text; without a hit the start counts.
    """
    if text is None:
        return None
    low = text.lower().encode("utf-8")
    hits = [at for t in terms if (at := low.find(t.encode("utf-8"))) >= 0]
    offset = max(0, min(hits, default=0) - 80)
    raw = text.encode("utf-8")
    while offset < len(raw) and (raw[offset] & 0xC0) == 0x80:
        offset += 1
    if offset >= len(raw):
        offset = 0
    return _WHITE.sub(" ", raw[offset:].decode("utf-8")[:239]).strip(" ")


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([snippet_of(t, list(q)) for t, q in zip(text, terms, strict=True)], dtype="object")


def register(spark: SparkSession) -> None:
    """Makes the text functions available to SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION normalize_token(t STRING) RETURNS STRING RETURN translate(lower(regexp_replace(t, '[^\\p{IsAlphabetic}\\p{N}]', '')), 'ς', 'σ')")
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(translate(lower(regexp_replace(coalesce(t, ''), '[^\\p{{IsAlphabetic}}\\p{{N}}\\p{{IsWhite_Space}}]', '')), 'ς', 'σ'), '\\p{{IsWhite_Space}}+'), w -> w <> '' AND w NOT IN ({stop}))")
    spark.udf.register("snippet", snippet)
    from tarnweave.functions import html, url

    spark.udf.register("html_text", html.body_text)
    spark.udf.register("html_links", html.page_links)
    spark.udf.register("url_join", url.join_urls)
