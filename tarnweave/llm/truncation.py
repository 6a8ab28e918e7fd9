"""Texts that were cut short, by a backward character n-gram model.

For the final context of each value the model compares two counts over the whole column: how
often a text ends after this context, and how often it goes on. Contexts are read backwards from
the end, in two alphabets:

* characters by their class: a run of letters is one symbol by the case of its first, digits are
  symbols one by one, an address is one by the length of its path, other signs stand for themselves, quotation marks
  are left out. The longest of the contexts of ORDERS symbols that is seen often enough decides on
  a text that doesn't end as a sentence: after a signature, a source, a tag line or a
  sentence that has dots of its own texts end about as often as they go on, after the middle
  of a sentence they hardly ever do;
* the last 3 and 5 characters as they are, per language. They decide on texts that end with a full
  stop: one after which texts go on far more often than they end (an abbreviation, an initial, an
  ordinal number) is inside a sentence.

A mark of omission at the end is one symbol of the end, and no part of what a text goes on after.
Counters are hashed, of a fixed size, and summed over all texts; a context is used only if it
is seen more often than others that meet in its counter explain, else a shorter one is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.counters import SCHEMA, packed, summed
from tarnweave.llm.samples import spread
from tarnweave.llm.words import slices

_BITS = 20
_SIZE = 1 << _BITS
_ALL = (1 << 64) - 1
#: Lengths of the contexts, in symbols of the classes.
ORDERS = (6, 9, 12, 16, 20, 24)
#: Lengths of the contexts, in characters, of a full stop.
DOT_ORDERS = (3, 5)
#: A context must be seen so often, besides the text itself and besides collisions, to be used.
SUPPORT = 8
#: Log-odds above an average character's from which an end that is no sentence's is a usual one.
MARGIN = 4.5
#: Log-odds above an average character's from which a full stop can end a text.
DOT_MARGIN = 1.0
#: Times that the longer context of a full stop must be seen to be used.
DOT_SUPPORT = 150
ROWS = 2 * len(ORDERS) + 2

_CLOSERS = "”\"»’')]"
#: Usual notes that a text goes on elsewhere (fixed values).
_MORE = r"(?:read more|continue reading|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|leggi tutto|continua a leggere|leia mais|ler mais|читать далее|далее)"
_CONTINUED = r"\((?:continued|to be continued|cont\.?|fortsetzung(?: folgt)?|à suivre|suite|continuará|continúa|continua|продолжение(?: следует)?)\)"
_OMISSION = re.compile(rf"\s*(?:\[\s*(?:…|\.\.\.+)\s*\]|\(\s*(?:…|\.\.\.+)\s*\)|…|\.\.\.+|{_CONTINUED})\s*[”\"»]*\s*(?:\[?{_MORE}\]?\s*[»>→]?)?\s*$", re.I)
_PLAIN = re.compile(r"\s*(?:…|\.\.\.+)[”\"»]*\s*$")
_TERMINATED = re.compile(r"[.!?。][”\"»’')\]]*$")
_ADDRESS = re.compile(r"https?://[^\s/“”\"»’]+(/[^\s“”\"»’]*)?")
#: A full stop, then brackets up to the end: '(Photo: X)' ends with a bracket of its own, not with a sentence.
_OWN_BRACKET = re.compile(r"[.!?]\s+[“\"«]?\([^()]*\)[”\"»]*$")

_DROP, _START, _LOWER, _UPPER, _SPACE, _DIGIT, _DOTS, _EDITED = range(8)


def _address(found: re.Match) -> str:
    """One sign for an address, by the length of its path; from the private plane."""
    return chr(0xE000 + min(len(found.group(1) or ""), 255))


def _class(c: str) -> int:
    if c in "“”\"«»‘’'„‹›":
        return _DROP
    if c == "\x00":
        return _START
    if c.isalpha():
        return _UPPER if c.isupper() else _LOWER
    if c.isdigit():
        return _DIGIT
    return _SPACE if c.isspace() else 16 + ord(c)


#: The class of each character of the first plane; the others stand for themselves.
_CLASSES = np.array([_class(chr(i)) for i in range(1 << 16)], dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each after as many start signs as the longest order, and where each text's symbols end."""
    shown = (t.replace("\x00", " ") for t in texts)  # NUL is the sign of a start
    joined = "".join(f"\x00{_ADDRESS.sub(_address, t) if '://' in t else t}" for t in shown)
    codes = _codes(joined)
    kinds = np.where(codes < (1 << 16), _CLASSES[np.minimum(codes, (1 << 16) - 1)], codes.astype(np.uint64) + np.uint64(16))
    kinds = kinds[kinds != _DROP]
    letter = (kinds == _LOWER) | (kinds == _UPPER)
    group = np.where(letter, 1, np.where(kinds == _SPACE, 2, 0))
    begins = np.ones(len(kinds), dtype=bool)
    begins[1:] = (group[1:] != group[:-1]) | (group[1:] == 0)
    kinds = kinds[begins]
    out = np.repeat(kinds, np.where(kinds == _START, ORDERS[-1], 1))
    starts = np.flatnonzero(kinds == _START) + np.arange(len(texts)) * (ORDERS[-1] - 1)
    return out, np.append(starts[1:], len(out)).astype(np.int64)


class _Ending:
    """The end of one text, as the model sees it."""

    __slots__ = ("broken", "final", "language", "mark", "terminated")

    def __init__(self, text: str, language: str):
        end = text.rstrip()
        self.language = language
        self.broken = end.endswith("�")
        found = _OMISSION.search(end)
        self.final = end[: found.start()].rstrip() if found else end
        self.mark = 0 if not found else _DOTS if _PLAIN.fullmatch(end[found.start() :]) else _EDITED
        self.terminated = not found and bool(_TERMINATED.search(self.final)) and not _OWN_BRACKET.search(self.final)

    def dot_key(self, n: int) -> int | None:
        """The counter of the last characters of a text that ends with a full stop."""
        if len(self.final) < n or self.final[-1] != ".":
            return None
        last = self.final[-n:].lower()
        return _context_hash(last, self.language) if len(last) == n else None


def _context_hash(chars: str, language: str) -> int:
    """The same hash of one context."""
    h = xxhash.xxh3_64_intdigest(language) ^ len(chars)
    for c in chars:
        h = ((h ^ ord(c)) * 0x100000001B3) & _ALL
        h ^= h >> 32
    return ((h * 0x9E3779B97F4A7C15) & _ALL) >> (64 - _BITS)


def _context_hashes(codes: np.ndarray, n: int, language: str) -> np.ndarray:
    h = np.full(max(0, len(codes) - n + 1), xxhash.xxh3_64_intdigest(language) ^ n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ codes[j : j + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(32)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _class_keys(stream: np.ndarray) -> dict[int, np.ndarray]:
    """For each order, the counter of the context that ends with each symbol of the stream.

    Symbols are added backwards, so a longer context goes on from the hash of the shorter one.
    """
    h = np.zeros(len(stream), dtype=np.uint64)
    out = {}
    with np.errstate(over="ignore"):
        for j in range(ORDERS[-1]):
            h[j:] = (h[j:] ^ stream[: len(stream) - j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            if j + 1 in ORDERS:
                out[j + 1] = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)
    return out


def _end_keys(endings: list[_Ending]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order: the counters of how the texts end, with their marks, and of what goes on there."""
    tails = [e.final[-_TAIL:] for e in endings]
    stream, ends = symbols(tails)
    windows = np.stack([stream[ends - 1 - j] for j in range(ORDERS[-1])]) if len(endings) else np.empty((ORDERS[-1], 0), np.uint64)
    short = np.flatnonzero((windows == _START).any(axis=0))
    for i in short:  # the start of the tail must be that of the text, not one inside it
        if len(tails[i]) < len(endings[i].final):
            own, _ = symbols([endings[i].final])
            windows[:, i] = own[::-1][: ORDERS[-1]]
    marks = np.array([e.mark for e in endings], dtype=np.uint64)
    marked = np.where(marks > 0, np.concatenate([marks[None, :], windows[:-1]]), windows)
    return _window_keys(marked), _window_keys(windows)


#: Characters of an end that are read first for its last symbols; a longer part is read if these have too few.
_TAIL = 400


def _window_keys(windows: np.ndarray) -> list[np.ndarray]:
    h = np.zeros(windows.shape[1], dtype=np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for j in range(ORDERS[-1]):
            h = (h ^ windows[j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            if j + 1 in ORDERS:
                out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64))
    return out


def _count(docs: DataFrame) -> np.ndarray:
    """[ends, continuations] for each order of classes, then those of characters with a full stop at their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ROWS, _SIZE), dtype=np.int64)
        for batch in batches:
            texts, languages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, z in slices(texts):
                _add(sums, [_Ending(t, lang) for t, lang in zip(texts[a:z], languages[a:z], strict=True)])
        if sums.any():
            yield packed(np.maximum(sums, 0).reshape(-1))

    return summed(docs.mapInArrow(run, SCHEMA), ROWS * _SIZE, np.float32).reshape(ROWS, _SIZE)


def _add(sums: np.ndarray, endings: list[_Ending]) -> None:
    stream, _ = symbols([e.final for e in endings])
    inside = stream != _START
    keys = _class_keys(stream)
    marked, plain = _end_keys(endings)
    for k, n in enumerate(ORDERS):
        sums[2 * k] += np.bincount(marked[k], minlength=_SIZE)
        # What goes on after a context is every place of it but the end.
        sums[2 * k + 1] += np.bincount(keys[n][inside], minlength=_SIZE)
        sums[2 * k + 1] -= np.bincount(plain[k], minlength=_SIZE)
    by_language: dict[str, list[str]] = {}
    for e in endings:
        by_language.setdefault(e.language, []).append(e.final.lower())
        for n in DOT_ORDERS:
            key = e.dot_key(n)
            if key is not None:
                sums[-2, key] += e.terminated
                sums[-1, key] -= 1  # the scan below counts the end as well
    for language, texts in by_language.items():
        codes = _codes("\x00".join(texts)).astype(np.uint64)
        dots = np.flatnonzero(codes == ord("."))
        for n in DOT_ORDERS:
            at = dots[dots >= n - 1] - (n - 1)
            sums[-1] += np.bincount(_context_hashes(codes, n, language)[at], minlength=_SIZE)


def _class_scores(counts: np.ndarray, load: np.ndarray, endings: list[_Ending]) -> np.ndarray:
    """Log-odds that each text ends where it does, in the longest context that is seen often enough.

    The next shorter one is asked as well and the higher of both holds, as a frequent context of the
    middle of a text may share a counter with a rare one of its end.
    """
    marked, plain = _end_keys(endings)
    score = np.full(len(endings), -9.0)
    asked = np.zeros(len(endings), dtype=np.int8)
    for k in reversed(range(len(ORDERS))):
        ends, on = np.maximum(counts[2 * k][marked[k]] - 1, 0), counts[2 * k + 1][plain[k]]
        seen = (asked < 2) & (ends + on >= (SUPPORT + 2 * load[k] if k else 1))
        score[seen] = np.maximum(score[seen], np.log((ends[seen] + 0.5) / (on[seen] + 0.5)))
        asked += seen
    return score


def _dot_score(counts: np.ndarray, e: _Ending) -> float:
    """Log-odds that a text ends after a full stop with these characters before it."""
    for n in reversed(DOT_ORDERS):
        k = e.dot_key(n)
        if k is not None:
            ends, on = max(float(counts[-2, k]) - 1, 0.0), float(counts[-1, k])
            if ends + on >= DOT_SUPPORT or n == DOT_ORDERS[0]:
                return float(np.log((ends + 0.5) / (on + 0.5)))
    return 0.0


def language_bucket(label: Column) -> Column:
    """First two letters of a label in lower case, 'und' if it has none: 677 at most. A wrong label costs some counts, no more."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2})", 1), F.lit("")), F.lit("und"))


def ending_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", language: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., log_odds, truncated, reason) for every text that isn't blank.

    log_odds compares ending with going on after the final context; below the threshold of its
    language the text is truncated. Thresholds refer to the log-odds that a text of the language
    ends after an average character, so that long texts are not judged by short ones. Texts that end
    as a sentence, but not with a full stop, are whole. ``language`` is a label, of which the
    first two letters count. Blank and null texts aren't truncated and give no
    row; null ids are kept as they are; repeated texts are judged alike, and don't vouch for one
    another's end; ``keep`` names other columns to pass through.
    """
    spark = docs.sparkSession
    keep = keep or []
    lang = language_bucket(language if language is not None else F.lit(None).cast("string"))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    base = spread(base.where(F.col("_text").isNotNull() & F.col("_text").rlike(r"\S")))
    # Copies of a text don't vouch for its end: each text is counted once, under the first of its languages.
    distinct = base.groupBy("_text").agg(F.min("_lang").alias("_lang"))
    counts = _count(distinct)
    load = counts[1 : 2 * len(ORDERS) : 2].mean(axis=1, dtype=np.float64)
    model = spark.sparkContext.broadcast((counts, load))
    average = F.log(F.count("*") / F.greatest(F.lit(1), F.sum(F.length("_text")))).alias("average")
    averages = spark.sparkContext.broadcast({r._lang: r.average for r in base.groupBy("_lang").agg(average).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, load), mean = model.value, averages.value
        for batch in batches:
            endings = [_Ending(t, lang) for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            by_class = _class_scores(counts, load, endings)
            scores, cut, why = [], [], []
            for e, score in zip(endings, by_class.tolist(), strict=True):
                least = mean.get(e.language, -6.5)
                if e.terminated:
                    score = _dot_score(counts, e)
                    is_cut = e.final[-1] == "." and score < least + DOT_MARGIN
                else:
                    is_cut = e.broken or score < least + MARGIN
                scores.append(float(score))
                cut.append(bool(is_cut))
                why.append(None if not is_cut else "broken character" if e.broken else "mark of omission" if e.mark else "within a word or sentence")
            arrays = [batch.column(0), *batch.columns[3:], pa.array(scores, pa.float64()), pa.array(cut, pa.bool_()), pa.array(why, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    from pyspark.sql import types as T

    fields = {f.name: f.dataType for f in base.schema.fields}
    out = T.StructType([T.StructField(id_col, fields["_id"]), *[T.StructField(c, fields[f"_keep_{i}"]) for i, c in enumerate(keep)], T.StructField("log_odds", T.DoubleType()), T.StructField("truncated", T.BooleanType()), T.StructField("reason", T.StringType())])
    return base.mapInArrow(run, out)


def truncation_rates(scores: DataFrame, source: Column) -> DataFrame:
    """Texts, truncated texts and their share, for each source."""
    return scores.groupBy(source.alias("source")).agg(F.count("*").alias("texts"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("rate"))
