"""Language of documents and of their segments, by language-bitmask n-gram filters.

The n-grams of each language go into a Bloom filter; the filters of all languages are stored
bit-sliced, one bit per language in each cell, so that one lookup returns the set of languages
that hold an n-gram. A text's n-grams are looked up at once; the count of hits per language,
less what the filter's fill makes expect by chance, decides. The filters are fitted on a bounded
sample of labelled texts and trimmed once by their own verdict, as labels may be wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.samples import bounded_sample, spread
from tarnweave.llm.words import slices

#: Cells of the filter (a power of two) and lookups per n-gram.
BITS, HASHES = 20, 2
SIZES = (3, 4, 5)
#: A sentence whose language leads by a smaller share of the hits tells nothing.
UNSURE = 0.2
#: Labelled texts per language that are used to fit the filters, at most.
SAMPLE = 500

#: Usual spellings of a language by its two-letter code: fixed values (ISO 639-1, 639-2 and names).
SPELLINGS = {
    "en": "en eng english englisch anglais inglés inglês inglese английский",
    "de": "de deu ger german deutsch allemand alemán alemão tedesco немецкий",
    "fr": "fr fra fre french français francais französisch francés francês francese французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spagnolo испанский",
    "it": "it ita italian italiano italienisch italien итальянский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portoghese португальский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}
_TO_CODE = {name: code for code, names in SPELLINGS.items() for name in names.split()}


def hint_languages(hint: Column) -> Column:
    """The two-letter codes that a hint names, in any usual spelling; an empty array for none.

    A hint may name several. A region after '-' or '_' is ignored.
    """
    names = F.create_map(*[x for name, code in _TO_CODE.items() for x in (F.lit(name), F.lit(code))])
    parts = F.split(F.lower(F.coalesce(hint, F.lit(""))), r"[,;/|+&\s]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.try_element_at(names, F.regexp_replace(p, r"[-_].*$", ""))), lambda c: c.isNotNull()))


_SENTENCE_END = re.compile(r"(?<=[.!?…])[”\"»’)]*\s+(?=[^\s])|(?<=[.!?…][”\"»’)])\s+|\n{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def _hashes(text_codes: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(text_codes) - n + 1), 0x51 * n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ text_codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _plain(text: str) -> str:
    """Lower-case words between single spaces; n-grams then know where words begin and end.

    A capitalised word that isn't the first may be a name, which has no language.
    """
    words = _LETTERS.findall(text)
    if sum(len(w) > 1 and w.isupper() for w in words) > 3:  # set in capitals, not names
        words = [w.lower() if w.isupper() else w for w in words]
    return " " + " ".join(w.lower() for i, w in enumerate(words) if i == 0 or not w[0].isupper()) + " "


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``cells[i]`` has one bit for each of ``languages``."""

    languages: list[str]
    cells: np.ndarray
    chance: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, list[str]], least: int = 3, share: float = 0.2) -> LanguageFilters:
        """An n-gram is a language's own if it is at least ``share`` times as frequent there as
        where it is most frequent, and occurs ``least`` times."""
        languages = sorted(texts)
        filters = cls._fit(languages, texts, least, share)
        kept = {c: [t for t in own if filters.best(t)[0] in (c, None)] for c, own in texts.items()}
        return cls._fit(languages, kept, least, share)

    @classmethod
    def _fit(cls, languages: list[str], texts: dict[str, list[str]], least: int, share: float) -> LanguageFilters:
        cells = np.zeros(1 << BITS, dtype=np.uint8 if len(languages) <= 8 else np.uint64)
        for n in SIZES:
            counted = {}
            for c in languages:
                all_codes = _codes("\x00".join(_plain(s) for t in texts[c] for s in sentences(t)))
                h, k = np.unique(_hashes(all_codes, n), return_counts=True) if len(all_codes) >= n else (np.empty(0, np.uint64), np.empty(0, np.int64))
                counted[c] = (h, k, max(1, k.sum()))
            every = np.unique(np.concatenate([h for h, _, _ in counted.values()])) if counted else np.empty(0, np.uint64)
            rates = np.zeros((len(languages), len(every)))
            raw = np.zeros_like(rates)
            for i, c in enumerate(languages):
                h, k, total = counted[c]
                at = np.searchsorted(every, h)
                rates[i, at], raw[i, at] = k / total, k
            top = rates.max(axis=0) if len(every) else rates
            for i in range(len(languages)):
                own = every[(raw[i] >= least) & (rates[i] >= share * top)]
                for cell in cls._cells_of(own):
                    cells[cell] |= cells.dtype.type(1 << i)
        fill = np.array([(cells >> cells.dtype.type(i) & cells.dtype.type(1)).mean() for i in range(len(languages))])
        return cls(languages, cells, fill**HASHES)

    @staticmethod
    def _cells_of(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(64 - BITS - 11 * k)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the corrected number of hits per language, and its number of n-grams."""
        codes = _codes("\x00".join(texts))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        found = np.zeros((len(texts), len(self.languages)))
        grams = np.zeros(len(texts))
        for n in SIZES:
            h = _hashes(codes, n)
            if not len(h):
                continue
            a, *more = self._cells_of(h)
            mask = self.cells[a]
            for b in more:
                mask = mask & self.cells[b]
            # n-grams that reach over a separator belong to no text.
            inside = np.ones(len(h), dtype=bool)
            for s in starts[1:] - 1:
                inside[max(0, s - n + 1) : s + 1] = False
            owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1
            grams += np.bincount(owner[inside], minlength=len(texts))
            for i in range(len(self.languages)):
                bit = (mask >> mask.dtype.type(i) & mask.dtype.type(1)).astype(bool) & inside
                found[:, i] += np.bincount(owner[bit], minlength=len(texts))
        return (found - grams[:, None] * self.chance) / (1 - self.chance), grams

    def verdicts(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each text; no language where too little or nothing fits."""
        plain = [_plain(t) for t in texts]
        parts = [self.hits(plain[a:z]) for a, z in slices(plain)]
        out = []
        for row, n in ((r, g) for found, grams in parts for r, g in zip(found, grams, strict=True)):
            share = row / max(n, 1)
            order = np.argsort(-share)
            first = share[order[0]]
            second = share[order[1]] if len(order) > 1 else 0.0
            if n < 8 or first < 0.5:
                out.append((None, 0.0))
            else:
                out.append((self.languages[order[0]], float(min(1.0, max(0.0, (first - second) / max(first, 1e-9))))))
        return out

    def best(self, text: str) -> tuple[str | None, float]:
        return self.verdicts([text])[0]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE_END.split(text) if s and s.strip()]


def fit_filters(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageFilters:
    """Filters from the ``sample`` texts of each language that come first by their hash."""
    code = hint_languages(F.col(label_col))
    rows = labelled.where(F.col(text_col).isNotNull()).select(code.alias("codes"), F.col(text_col).alias("t")).where(F.size("codes") == 1).select(F.col("codes")[0].alias("c"), "t")
    texts: dict[str, list[str]] = {}
    totals = {r.c: r.n for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row per language
    for language in SPELLINGS:
        if language in totals:
            texts[language] = [r.t for r in bounded_sample(rows.where(F.col("c") == language), "t", sample, totals[language]).collect()]
    return LanguageFilters.fit(texts)


def language_segments(docs: DataFrame, filters: LanguageFilters, *, id_col: str, text_col: str, min_words: int = 4) -> DataFrame:
    """(id, segment, lang_code, confidence, sentences, words, chars): runs of sentences of one language.

    Sentences too short or too mixed to tell join the run before them. A text whose sentences
    are all so has one segment with a null language and confidence 0. ``sentences`` counts the
    whole ones: at least ``min_words`` words, an end, and a language of their own. Null ids are
    kept, null and blank texts give no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    base = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: LanguageFilters = shared.value
        for batch in batches:
            at, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sentences(text)
                at.extend([i] * len(own))
                parts.extend(own)
            verdicts = f.verdicts(parts) if parts else []
            out: list[list] = []
            current = None
            for i, s, (code, sure) in zip(at, parts, verdicts, strict=True):
                words = len(s.split())
                whole = bool(words >= min_words and re.search(r"[.!?…][”\"»’)]*\s*$", s))
                if words < min_words or sure < UNSURE:
                    code = None
                whole = whole and code is not None
                if current is None or current[0] != i or (code is not None and current[1] is not None and current[1] != code):
                    current = [i, code, 0.0, 0, 0, 0, 0]
                    out.append(current)
                if code is not None:
                    current[1] = code
                    current[2] += sure * words
                    current[6] += words
                    current[3] += whole
                current[4] += words
                current[5] += len(s)
            ids = batch.column(0).to_pylist()
            numbers, last, n = [], None, 0
            for o in out:
                n = n + 1 if o[0] == last else 1
                last = o[0]
                numbers.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[o[0]] for o in out], batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] / o[6] if o[6] else 0.0 for o in out], pa.float64()), *[pa.array([o[j] for o in out], pa.int32()) for j in (3, 4, 5)]],
                names=[id_col, "segment", "lang_code", "confidence", "sentences", "words", "chars"],
            )

    return base.mapInArrow(run, f"{id_col} {kind}, segment int, lang_code string, confidence double, sentences int, words int, chars int")


def document_languages(segments: DataFrame, id_col: str) -> DataFrame:
    """The main language of each document by words, with its confidence and share of the words."""
    per = segments.groupBy(id_col, "lang_code").agg(F.sum("words").alias("w"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("c"))
    best = F.max(F.struct(F.col("lang_code").isNotNull().alias("known"), F.col("w").alias("w"), F.col("lang_code").alias("lang_code"), F.col("c").alias("c"))).alias("b")
    return per.groupBy(id_col).agg(best, F.sum("w").alias("all"), F.count("lang_code").alias("languages")).select(id_col, F.col("b.lang_code").alias("lang_code"), (F.col("b.c") * F.col("b.w") / F.col("all")).alias("confidence"), "languages")


def unhinted_languages(segments: DataFrame, hints: DataFrame, *, id_col: str, hint_col: str, least: int = 2) -> DataFrame:
    """(id, lang_code): languages with ``least`` whole sentences in a row that no hint row names.

    A missing, null or meaningless hint names none. Several hint rows of one id add up.
    """
    named = hints.where(F.col(id_col).isNotNull()).select(id_col, F.explode(hint_languages(F.col(hint_col))).alias("lang_code")).distinct()
    found = segments.where((F.col("sentences") >= least) & F.col("lang_code").isNotNull()).select(id_col, "lang_code").distinct()
    return found.join(named, [id_col, "lang_code"], "left_anti")
