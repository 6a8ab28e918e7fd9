"""Keyword-stuffed and link-list pages, by an n-gram model of word classes.

Prose alternates function words and content words in few patterns; lists of keywords, tags,
product codes and link titles don't. Each token is reduced to its class (a function word stands
for itself) and a trigram model of prose gives the perplexity of each stretch of a page. A page
is spam if most of its words are in stretches whose perplexity is abnormally high or low for
prose. An exact check then spares pages of ended sentences of the usual length: filler and
messages of a site are unlike the prose too, and no list of words.

The model is fitted on all texts of the prose, by counts that are summed over partitions; the
function words are those that occur in a large share of a language's texts. The bounds are exact
quantiles over the stretches of all texts, each under the counts of all others. Every page is
scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.samples import spread
from tarnweave.session import cut

#: A word is a function word if it is in this share of the texts of a language.
FUNCTION_SHARE = 0.05
#: Word endings that are classes of their own.
ENDINGS = 120
#: Tokens of a stretch, where no sentence ends before.
STRETCH = 14
#: Counters of a partition before they are handed on, and classes of tokens that are remembered.
FLUSH, KEEP = 500_000, 200_000
#: Added to the cost of a class that isn't known after two others, and after the one before it; the cost of one that isn't known.
RARER, RAREST, UNKNOWN = 1.2, 2.5, 9.0
#: Parts of the prose stretches that count as abnormally high and low.
HIGH, LOW = 0.995, 0.0005

#: Above this share of brackets and other signs a page is code or an unfilled template, not a list of words.
MOST_SIGNS = 0.15

#: Mean words of a sentence from which a page of ended sentences is one of sentences, even if no prose is like it.
SENTENCE_WORDS = 6.5

_ADDRESS = re.compile(r"https?://\S+")
_TOKEN = re.compile(r"#?[^\W_]+(?:[-'’.][^\W_]+)*|[^\w\s]")
_END = frozenset(".!?…")


class ClassCounts:
    """How often a class follows two others, and what is summed up from that."""

    def __init__(self, three: dict[tuple[str, str, str], int]):
        self.three = three
        self.two, self.one, self.before2, self.before1 = Counter(), Counter(), Counter(), Counter()
        for (a, b, c), n in three.items():
            self.two[b, c] += n
            self.one[c] += n
            self.before2[a, b] += n
            self.before1[b] += n
        self.every = max(1, sum(self.one.values()))

    def costs_apart(self, classes: list[str]) -> list[float]:
        """The costs of a text's classes under the counts without this text, which is one of those counted."""
        first, second = [".", ".", *classes[:-2]][: len(classes)], [".", *classes[:-1]][: len(classes)]
        own3, own1, ownb = Counter(zip(first, second, classes, strict=True)), Counter(classes), Counter(second)
        own2, ownab = Counter(zip(second, classes, strict=True)), Counter(zip(first, second, strict=True))
        three, two, one, before2, before1, log = self.three, self.two, self.one, self.before2, self.before1, math.log
        every, costs = max(1, self.every - len(classes)), {}
        for abc, n in own3.items():
            a, b, c = abc
            bc = (b, c)
            n1, n2 = one[c] - own1[c], two[bc] - own2[bc]
            if n2:
                pair = 0.8 * n2 / (before1[b] - ownb[b]) + 0.2 * n1 / every
                n3 = three[abc] - n
                costs[abc] = -log(0.7 * n3 / (before2[a, b] - ownab[a, b]) + 0.3 * pair) if n3 else -log(pair) + RARER
            else:
                costs[abc] = (-log(n1 / every) if n1 else UNKNOWN) + RAREST
        return [costs[x] for x in zip(first, second, classes, strict=True)]


@dataclass
class ProseModel:
    """Class trigrams with interpolation, and the bounds of normal perplexity."""

    function_words: frozenset[str]
    endings: frozenset[str] = frozenset()
    costs: dict[tuple[str, str, str], float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    singles: dict[str, float] = field(default_factory=dict)
    high: float = math.inf
    low: float = 0.0
    known: dict[str, str] = field(default_factory=dict, repr=False, compare=False)

    def classes(self, text: str) -> list[str]:
        """The classes of a text's tokens; those of tokens seen lately are remembered."""
        known, tokens = self.known, _TOKEN.findall(text)
        if len(known) > KEEP:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = self.class_of(t)
        return [known[t] for t in tokens]

    def class_of(self, token: str) -> str:
        low = token.lower()
        if low in self.function_words:
            return low
        first = token[0]
        if first == "#":
            return "#"
        if not first.isalnum():
            return "." if first in _END else "," if first in ",;:" else "|" if first in "|/•·>»–—-" else "~"
        if any(c.isdigit() for c in token):
            return "0" if token.isdigit() else "X"
        if first.isupper() and not (len(token) > 1 and token.isupper()):
            return "A"
        return f"-{low[-2:]}" if len(low) > 3 and low[-2:] in self.endings else "a"

    def rarer(self, b: str, c: str) -> float:
        """The cost of a class after one that it isn't known after with the class before."""
        known = self.pairs.get((b, c))
        return self.singles.get(c, UNKNOWN) + RAREST if known is None else known + RARER

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> ProseModel:
        frequency: dict[str, Counter] = defaultdict(Counter)
        for text, language in zip(texts, languages, strict=True):
            frequency[language].update({t.lower() for t in _TOKEN.findall(text) if t[0].isalpha()})
        totals = Counter(languages)
        words = {w for language, c in frequency.items() if totals[language] >= 20 for w, n in c.items() if n >= FUNCTION_SHARE * totals[language]}
        endings = Counter(t[-2:] for c in frequency.values() for t, n in c.items() if len(t) > 3 and n >= 3 and t not in words and t.islower())
        model = cls(frozenset(words), frozenset(sorted(endings, key=lambda e: (-endings[e], e))[:ENDINGS]))
        classes = [model.classes(text) for text in texts]
        counts = ClassCounts(Counter(x for own in classes for x in _triples(own)))
        model.learn(counts)
        scores = sorted(s for own in classes for s in model.scores_apart(counts, own))
        if scores:
            model.low, model.high = (scores[k] for k in _places(len(scores)))
        return model

    def learn(self, counts: ClassCounts) -> None:
        """The costs, from how often each class follows two others."""
        self.singles = {c: -math.log(n / counts.every) for c, n in counts.one.items()}
        self.pairs = {bc: -math.log(0.8 * n / counts.before1[bc[0]] + 0.2 * counts.one[bc[1]] / counts.every) for bc, n in counts.two.items()}
        self.costs = {abc: -math.log(0.7 * n / counts.before2[abc[:2]] + 0.3 * math.exp(-self.pairs[abc[1:]])) for abc, n in counts.three.items()}

    def scores_apart(self, counts: ClassCounts, classes: list[str]) -> list[float]:
        """The mean costs of a text's stretches under the counts of all other texts."""
        return [max(0.0, s / n) for s, n, _, _ in self.stretches(classes, counts.costs_apart(classes)) if n >= 5]

    def costs_of(self, classes: list[str]) -> list[float]:
        known = self.costs.get
        return [self.rarer(x[1], x[2]) if (cost := known(x)) is None else cost for x in _triples(classes)]

    def stretches(self, classes: list[str], costs: list[float] | None = None) -> Iterator[tuple[float, int, int, bool]]:
        """(cost, tokens, words that aren't function words, ended) of the stretches of a page."""
        total, n, content = 0.0, 0, 0
        for c, cost in zip(classes, self.costs_of(classes) if costs is None else costs, strict=True):
            total += cost
            n += 1
            content += c in ("a", "A", "0", "X", "#") or c[0] == "-"
            if (c == "." and n >= 3) or n >= STRETCH:
                yield total, n, content, c == "."
                total, n, content = 0.0, 0, 0
        if n:
            yield total, n, content, False

    def page(self, text: str) -> tuple[int, int, int, float, float]:
        """(tokens, abnormal ones, content words in them, mean cost, share of brackets and other signs)."""
        classes = self.classes(_ADDRESS.sub(" 0x ", text))
        words = abnormal = content = 0
        cost = 0.0
        for total, n, own, ended in self.stretches(classes):
            cost += total
            mean = total / n
            words += n
            if mean > self.high or mean < self.low:
                abnormal += n
                content += own
        return words, abnormal, content, cost / max(1, words), classes.count("~") / max(1, words)


#: Abnormal tokens that a page must have at least; fewer say nothing about a share.
SHORTEST = 12


def _triples(classes: list[str]) -> Iterator[tuple[str, str, str]]:
    """Each class after the two before it."""
    return zip([".", ".", *classes], [".", *classes], classes, strict=False)


def _places(n: int) -> tuple[int, int]:
    """The places of the lower and the upper bound among ``n`` sorted scores."""
    return int(LOW * n), min(n - 1, int(HIGH * n))


def _counted(rows: DataFrame, keys: list[str], count: Callable[[Counter, list], None]) -> DataFrame:
    """(keys, n): what ``count`` adds to a Counter for each batch, given its columns as lists, over all rows. Strings and nulls are keys."""
    schema = pa.schema([*((k, pa.string()) for k in keys), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*sums, strict=True)) or [[]] * len(keys)
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(sums.values()), pa.int64())], schema=schema)
            sums.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                count(sums, [c.to_pylist() for c in batch.slice(at, 500).columns])
                if len(sums) > FLUSH:
                    yield out()
        yield out()

    return rows.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def _count_words(sums: Counter, columns: list) -> None:
    """Texts that a word is in, by language, with its ending if it may be a class; without a word, texts."""
    for text, language in zip(*columns[:2], strict=True):
        sums[language, None, None] += 1
        sums.update((language, w, w[-2:] if len(w) > 3 and w.islower() else None) for w in {t.lower() for t in _TOKEN.findall(text) if t[0].isalpha()})


def _nth(scores: DataFrame, places: Callable[[int], tuple[int, ...]]) -> list[float]:
    """The scores at some places of their order, exactly; none if there are no scores.

    The bits of a number that isn't negative are in the order of the numbers. They are narrowed
    down by 24 and twice 20 of them, so no more than the counts of a range reach the driver.
    """
    found: list[tuple[int, int]] = []
    for shift in (40, 20, 0):
        part = F.shiftright("bits", shift).alias("part")
        rows = scores.where(F.shiftright("bits", shift + 20).isin([p for p, _ in found])) if found else scores
        counts = sorted((r.part, r.n) for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect())
        if not found:
            if not counts:
                return []
            found = [(0, k) for k in places(sum(n for _, n in counts))]
            inside = [counts] * len(found)
        else:
            inside = [[c for c in counts if c[0] >> 20 == p] for p, _ in found]
        narrowed = []
        for (_, k), own in zip(found, inside, strict=True):
            for p, n in own:
                if k < n:
                    narrowed.append((p, k))
                    break
                k -= n
        found = narrowed
    return np.array([p for p, _ in found], dtype=np.int64).view(np.float64).tolist()


def fit_prose_model(prose: DataFrame, *, text_col: str, language_col: str | None = None) -> ProseModel:
    """A model from all texts, a repeated one counting once. In rows with different languages its last one by name holds.

    What reaches the driver are the words that are in FUNCTION_SHARE of a language's texts, the
    endings, and a counter for each three classes that follow each other.
    """
    language = F.coalesce(F.substring(F.lower(F.trim(F.col(language_col))), 1, 2), F.lit("")) if language_col else F.lit("")
    texts = prose.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), language.alias("l"))
    texts = spread(cut(texts.groupBy("t").agg(F.max("l").alias("l"))))
    shared = prose.sparkSession.sparkContext.broadcast

    counts = cut(_counted(texts, ["l", "w", "e"], _count_words))
    totals = counts.where("w is null and n >= 20").select("l", F.col("n").alias("texts"))
    words = frozenset(r.w for r in counts.where("w is not null").join(F.broadcast(totals), "l").where(F.col("n") >= FUNCTION_SHARE * F.col("texts")).select("w").distinct().collect())
    endings = counts.where((F.col("n") >= 3) & F.col("e").isNotNull() & ~F.col("w").isin(list(words)))
    model = ProseModel(words, frozenset(r.e for r in endings.groupBy("e").agg(F.count("*").alias("words")).orderBy(F.desc("words"), "e").limit(ENDINGS).collect()))
    bare = shared(model)

    def count_classes(sums: Counter, columns: list) -> None:
        for t in columns[0]:
            sums.update(_triples(bare.value.classes(t)))

    found = _counted(texts.select("t"), ["a", "b", "c"], count_classes).toArrow()
    classes = [found.column(k).combine_chunks().dictionary_encode() for k in ("a", "b", "c")]  # a name is one string, not one a row
    three = dict(zip(zip(*(map(c.dictionary.to_pylist().__getitem__, c.indices.to_pylist()) for c in classes), strict=True), found.column("n").to_pylist(), strict=True))
    del found, classes
    every = shared(three)
    model.learn(ClassCounts(three))
    del three

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, all_counts = bare.value, ClassCounts(every.value)
        for batch in batches:
            found = np.array([s for t in batch.column(0).to_pylist() for s in m.scores_apart(all_counts, m.classes(t))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["bits"])

    bounds = _nth(cut(texts.select("t").mapInArrow(scores, "bits long")), _places)
    if bounds:
        model.low, model.high = bounds
    return model


def stuffing_scores(pages: DataFrame, model: ProseModel, *, id_col: str, text_col: str, links_col: str | None = None, share: float = 0.6, least_words: int = 45) -> DataFrame:
    """(id, words, abnormal_share, content_share, perplexity, links, stuffed) of each page with text.

    A page is stuffed by its share of abnormal tokens. Under ``least_words`` of them, SHORTEST at
    least, it also has to be without ended sentences, as short messages of a site are unusual prose.
    Null ids are kept; null and blank texts give no row; repeated rows are scored each; null
    link lists count as no links.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    links = F.coalesce(F.size(links_col), F.lit(0)) if links_col else F.lit(0)
    base = spread(pages.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.greatest(links, F.lit(0)).alias("_links")).where(F.col("_text").rlike(r"\S")))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ProseModel = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words, abnormal, content, cost, signs = m.page(text)
                part, full = abnormal / max(1, words), content / max(1, abnormal)
                out.append((words, part, full, math.exp(min(cost, 50)), (abnormal >= least_words or abnormal >= SHORTEST and _ended_share(text) < 0.1) and part > share and signs < MOST_SIGNS and not _of_sentences(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], batch.column(2).cast(pa.int32()), arrays[4]], names=[id_col, "words", "abnormal_share", "content_share", "perplexity", "links", "stuffed"])

    return base.mapInArrow(run, f"{id_col} {kind}, words int, abnormal_share double, content_share double, perplexity double, links int, stuffed boolean")


def _ended_share(text: str) -> float:
    """The share of words that stand in ended sentences of any length."""
    return sum(len(x.split()) for x in re.findall(r"[^.!?…]+[.!?…]+(?=\s|$)", text)) / max(1, len(text.split()))


def _of_sentences(text: str) -> bool:
    """Most words stand in ended sentences of the usual length."""
    ended = re.findall(r"[^.!?…]+[.!?…]+(?=\s|$)", text)
    words = [len(s.split()) for s in ended if s.lstrip()[:1].isupper()]
    return bool(words) and sum(words) > 0.6 * len(text.split()) and sum(words) / len(words) >= SENTENCE_WORDS and sorted(words)[len(words) // 2] <= 30
