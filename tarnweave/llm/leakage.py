"""Evaluation passages inside a training corpus, by the q-gram lemma.

A passage region of L characters that occurs with at most e edits shares at least
``L + 1 - q*(e+1)`` character q-grams with its copy, on diagonals (text position minus passage
position) that differ by at most e. Hits are counted in bands of diagonals that overlap by half,
bands below the bound are dropped, and the rest is verified by an alignment confined to the band.

The passages are a stated query set. They are taken in blocks of at most ``BLOCK_GRAMS`` q-grams,
so what is broadcast has a fixed bound, and every block is run against all texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.samples import spread
from tarnweave.llm.words import slices, split_words

Q = 12
BLOCK_GRAMS = 2_000_000
_BASE = np.uint64(0x100000001B3)
_SCHEMA = "doc_id long, item_id long, start_word int, run_words int, edits int, region_chars int"


def _normal(text: str | None) -> str:
    words = split_words(text)
    return f" {' '.join(words)} " if words else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(codes) - q + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            out = out * _BASE + codes[j : j + len(out)]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0x9E3779B97F4A7C15)


def align_in_bands(text: np.ndarray, passages: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, shortest: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of many regions at once, each confined to its band of ``width`` diagonals.

    Region r aligns passages[begin[r]:end[r]] with text[low[r]:high[r]] on the diagonals
    shift[r] .. shift[r] + width - 1 (text position minus passage position). Scores are +1 for equal signs and
    -2 for an edit, so a region ends where edits outweigh it. Returns, for each region, the edits
    and length of its best alignment that is at least ``shortest`` long with at most ``edits``
    edits for each such length (length 0 if none is), and the length and end in the text of its
    longest run of equal signs.
    """
    count = len(shift)
    steps = np.arange(width)
    score, cost, size, run = (np.zeros((count, width), dtype=np.int32) for _ in range(4))
    best, best_cost, best_size, best_run, run_end = (np.zeros(count, dtype=np.int64) for _ in range(5))
    rows = np.arange(count)
    for j in range(int((end - begin).max(initial=0))):
        place = begin + j
        inside = place < end
        at = (place + shift)[:, None] + steps
        ok = inside[:, None] & (at >= low[:, None]) & (at < high[:, None])
        same = ok & (text[np.clip(at, 0, len(text) - 1)] == passages[np.minimum(place, len(passages) - 1)][:, None])
        run = np.where(same, run + 1, 0)
        k = run.argmax(axis=1)
        longer = run[rows, k] > best_run
        best_run[longer], run_end[longer] = run[rows, k][longer], (at[rows, k] + 1)[longer]
        if not edits:
            continue
        diag, e, s = score + np.where(same, 1, -2), cost + ~same, size + 1
        up = np.full_like(score, -(10**6))
        up[:, :-1] = score[:, 1:] - 2  # a sign of the passage has no match
        take = up > diag
        above, longest = np.zeros_like(cost), np.zeros_like(size)
        above[:, :-1], longest[:, :-1] = cost[:, 1:] + 1, size[:, 1:] + 1
        diag, e, s = np.where(take, up, diag), np.where(take, above, e), np.where(take, longest, s)
        # Signs of the text without a match: the best cell to the left, 2 less for each step.
        raised = diag + 2 * steps
        top = np.maximum.accumulate(raised, axis=1)
        source = np.maximum.accumulate(np.where(raised == top, steps, 0), axis=1)
        diag = top - 2 * steps
        e = np.take_along_axis(e, source, 1) + (steps - source)
        s = np.take_along_axis(s, source, 1)
        dead = (diag <= 0) | ~ok
        score, cost, size = np.where(dead, 0, diag), np.where(dead, 0, e), np.where(dead, 0, s)
        good = np.where((size >= shortest) & (cost <= edits * (size // shortest)), score, 0)
        k = good.argmax(axis=1)
        better = good[rows, k] > best
        best[better], best_cost[better], best_size[better] = good[rows, k][better], cost[rows, k][better], size[rows, k][better]
    return best_cost, best_size, best_run, run_end


class _Passages:
    """The q-grams of one block of passages, sorted, with passage and position of each."""

    def __init__(self, items: list[tuple[int, str]], q: int, run_words: int, edits: int):
        self.q, self.edits = q, edits
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        hashes, owners, places, shortest, every = [], [], [], [], []
        for at, (_, passage) in enumerate(items):
            words = split_words(passage)
            codes = _codes(f" {' '.join(words)} ")
            every.append(codes)
            g = _grams(codes, q)
            hashes.append(g)
            owners.append(np.full(len(g), at, dtype=np.int64))
            places.append(np.arange(len(g), dtype=np.int64))
            ends = np.cumsum([0] + [len(w) + 1 for w in words])
            if len(words) >= run_words:
                shortest.append(int((ends[run_words:] - ends[:-run_words]).min()) + 1)
        empty = np.empty(0, dtype=np.uint64)
        h = np.concatenate([empty, *hashes])
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], np.concatenate([empty.astype(np.int64), *owners])[order], np.concatenate([empty.astype(np.int64), *places])[order]
        self.codes = np.concatenate([empty, *every])
        self.starts = np.cumsum([0, *map(len, every)])
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.shortest = min(shortest) if shortest else 10**9
        # The q-gram lemma for the shortest region of run_words words in any passage.
        self.least = max(1, self.shortest + 1 - q * (edits + 1))
        self.reach = self.shortest + edits
        self.width = max(4, 2 * edits)


def _often(keys: np.ndarray, size: int, least: int) -> np.ndarray:
    """Which entries have a key that occurs ``least`` times."""
    if size <= 8 * len(keys) + 1_000_000:
        return np.bincount(keys, minlength=size)[keys] >= least
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] >= least


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and normalised texts, in parts of bounded size."""
    for batch in batches:
        ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, z in slices(raw):
            yield ids[a:z], [_normal(t) for t in raw[a:z]]


#: Regions that are aligned at a time.
REGIONS = 4096


def _regions(p: _Passages, texts: list[str], codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(doc, passage, band, first hit, last hit) of the bands that reach the bound; positions in the joined texts."""
    g = _grams(codes, p.q)
    at = np.flatnonzero(p.filter[(g >> np.uint64(42)).astype(np.int64)])
    lo, hi = np.searchsorted(p.hash, g[at], "left"), np.searchsorted(p.hash, g[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    none = np.empty((0, 5), dtype=np.int64)
    if not len(at):
        return none
    hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(at, n)
    doc = np.searchsorted(starts, pos, "right") - 1
    # A pair without enough hits in all has no band with enough.
    pair = doc * len(p.ids) + p.owner[hit]
    enough = _often(pair, len(texts) * len(p.ids), p.least)
    pos, hit, doc, pair = pos[enough], hit[enough], doc[enough], pair[enough]
    band = ((pos - starts[doc]) - p.place[hit]) // p.width
    # Each diagonal is in two bands: band b holds the diagonals of cells b and b+1.
    low = int(band.min(initial=0)) - 1
    span = int(band.max(initial=0)) - low + 1
    keys, at = np.concatenate([pair * span + band - low, pair * span + band - 1 - low]), np.concatenate([pos, pos])
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    # A region has its hits close together: the bound holds within its own length.
    ahead = p.least - 1
    if len(keys) <= ahead:
        return none
    near = (keys[ahead:] == keys[: len(keys) - ahead]) & (at[ahead:] - at[: len(at) - ahead] <= p.reach)
    good = np.flatnonzero(near)
    if not len(good):
        return none
    # Windows that reach the bound and lie within a region's length of each other are one region.
    new = np.ones(len(good), dtype=bool)
    new[1:] = (keys[good[1:]] != keys[good[:-1]]) | (at[good[1:]] - at[good[:-1] + ahead] > p.reach)
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(good)) - 1
    key = keys[good[begin]]
    found = np.stack([key // span // len(p.ids), key // span % len(p.ids), key % span + low, at[good[begin]], at[good[finish] + ahead]], axis=1)
    # The same hits are in the band before, too, unless a diagonal of its own has some.
    again = np.zeros(len(found), dtype=bool)
    known = {(d, i, b, f, t) for d, i, b, f, t in found.tolist()}
    for r, (d, i, b, f, t) in enumerate(found.tolist()):
        again[r] = (d, i, b - 1, f, t) in known
    return found[~again]


def _scan(docs: DataFrame, block, run_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Passages = block.value
        for ids, texts in _parts(batches):
            codes = _codes("\x00".join(texts))
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            found = _regions(p, texts, codes, starts)
            if not len(found):
                continue
            spaces = np.concatenate([[0], np.cumsum(codes == ord(" "))])
            # Regions of about the same length are aligned together.
            found = found[np.argsort(found[:, 4] - found[:, 3], kind="stable")]
            rows = []
            for k in range(0, len(found), REGIONS):
                doc, passage, band, first, last = found[k : k + REGIONS].T
                # In coordinates of the joined texts and passages.
                shift = starts[doc] - p.starts[passage] + band * p.width
                begin = np.maximum(p.starts[passage], first - shift - 2 * p.reach)
                end = np.minimum(p.starts[passage + 1], last - shift + 2 * p.reach)
                edits, size, length, stop = align_in_bands(codes, p.codes, starts[doc], starts[doc + 1] - 1, shift, begin, end, 2 * p.width, p.shortest, p.edits)
                # Whole words in a run: what is between two of its spaces.
                words = np.maximum(0, spaces[stop] - spaces[stop - length] - 1)
                before = spaces[stop - length] - spaces[starts[doc]]
                leak = (words >= run_words) | (size > 0)
                exact = words >= run_words
                rows.append(np.stack([doc, passage, before, words, np.where(exact, 0, edits), np.where(exact, length, size)], axis=1)[leak])
            out = np.concatenate(rows)
            # One row for each pair: the longest run, then the longest region with the fewest edits.
            out = out[np.lexsort((out[:, 4], -out[:, 5], -out[:, 3], out[:, 1], out[:, 0]))]
            first = np.ones(len(out), dtype=bool)
            first[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
            out = out[first]
            arrays = [pa.array([ids[d] for d in out[:, 0].tolist()], pa.int64()), pa.array(p.ids[out[:, 1]]), *(pa.array(out[:, c].astype(np.int32)) for c in range(2, 6))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.mapInArrow(run, _SCHEMA)


def leaked_passages(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", run_words: int = 12, edits: int = 2, q: int = Q) -> DataFrame:
    """(doc_id, item_id, start_word, run_words, edits, region_chars) for each leak.

    A leak has ``run_words`` words in a row in common with the passage, or a region as long as
    the shortest run of so many words in any passage, with at most ``edits`` character edits for
    each such length. run_words in the result is the longest run in common within such a region, and
    start_word its place in the document. Null ids or texts never leak; passages of fewer than
    ``run_words`` words can't; repeated documents are reported under each id; several leaks of
    one item in one document are one row, that of the longest run; all passages of a repeated
    item id count; an empty side gives no rows.
    """
    spark = docs.sparkSession
    base = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()))
    side = items.select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("p")).where("i is not null and p is not null").distinct()
    grams = side.agg(F.sum(F.length("p") + 2).alias("n")).first().n or 0
    blocks = max(1, -(-grams // BLOCK_GRAMS))
    parts = []
    for b in range(blocks):
        rows = side.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "p").collect()  # at most about BLOCK_GRAMS characters
        block = spark.sparkContext.broadcast(_Passages([(r.i, r.p) for r in rows], q, run_words, edits))
        parts.append(_scan(base, block, run_words))
    every = functools.reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("run_words", "region_chars", (-F.col("edits")).alias("kept"), (-F.col("start_word")).alias("first"))).alias("b")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.first")).alias("start_word"), "b.run_words", (-F.col("b.kept")).alias("edits"), "b.region_chars")
