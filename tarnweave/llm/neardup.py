"""Near-duplicate records: an exact set-similarity self-join on runs of words.

Method: the document by n-gram incidence matrix A is multiplied with its transpose, sparsely
and in blocks, and the product's entries are overlap counts. What keeps the product small is
a bound that follows from the sizes of the two sets alone:

* All n-grams are brought into one global order, rarest first. For a Jaccard similarity of at
  least t, the larger of two sets shares at least l elements with the smaller one within its
  first ``|y| - ceil(t*|y|) + l`` elements, which in the smaller one are among the first
  ``|x| - ceil(2t/(1+t)*|x|) + l``. Only those entries of A are multiplied. Any global order
  gives the same result; rarity comes from a count sketch over all documents, sized to the input within a bound.
* Pairs whose sizes differ by more than t allows are left out of the product. Each entry brings a
  bitmap of its set's parities: where two bitmaps differ in more bits than the sets may differ in
  elements, the pair is dropped as it is built. Without that the pairs that are shuffled would grow
  almost as the square of the input. Of the others the overlap counts are accumulated, and pairs
  below l are discarded.
* What is left is verified exactly on the full sets.

Texts with the same words are one class and enter the product once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.counters import packed, summed
from tarnweave.llm.samples import spread
from tarnweave.llm.words import TextHasher, mix, ngram_hashes, slices
from tarnweave.session import cut

#: The fewest counters of the sketch; it grows with the input up to 2**26.
SKETCH_BITS = 22
#: Prefixes are lengthened so that a pair must share so many elements in them.
COMMON = 4
#: Entries of a column that are multiplied in one place, and pairs built at a time.
CELL_ROWS, PRODUCT_STEP = 4096, 1_000_000
#: 64-bit words of a set's parity bitmap.
SIGN_WORDS = 4
_FIXED = 1e-9


def _word_sets(texts: list[str | None], n: int, min_words: int, hasher: TextHasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index, word hashes and distinct sorted n-gram hashes of the texts that are long enough."""
    texts = [t or "" for t in texts]
    for start, stop in slices(texts):
        found = [(i, words) for i in range(start, stop) if len(words := hasher(texts[i])) >= max(min_words, n)]
        if found:
            grams, at = ngram_hashes(np.concatenate([words for _, words in found]), n), 0
            for i, words in found:
                yield i, words, np.unique(grams[at : at + len(words) - n + 1])
                at += len(words)


def _parities(grams: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each bit; two sets differ in as many elements as their bitmaps in bits, at least."""
    odd = np.bincount((grams & np.uint64(64 * SIGN_WORDS - 1)).astype(np.int64), minlength=64 * SIGN_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _signs(rows: np.ndarray) -> pa.Array:
    """Bitmaps as binary values of one length."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (8 * SIGN_WORDS)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bitmaps(column: pa.Array) -> np.ndarray:
    """The inverse of ``_signs``."""
    size = 8 * SIGN_WORDS
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=len(column) * size, offset=np.frombuffer(column.buffers()[1], np.int32)[column.offset]).view(np.uint64).reshape(-1, SIGN_WORDS) if len(column) else np.empty((0, SIGN_WORDS), np.uint64)


_SCAN = "doc long, text_key binary, chunk int, packed binary"


def _scan(docs: DataFrame, n: int, min_words: int, bits: int) -> DataFrame:
    """One reading of all texts for two results: rows (doc, text_key), and rows (chunk, packed) of counters.

    text_key is a 128-bit key of the word sequence, for texts of enough words. The counters say
    how often each hash bucket of n-grams occurs over all documents; there are 2**bits.
    """
    schema = pa.schema([("doc", pa.int64()), ("text_key", pa.binary()), ("chunk", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = TextHasher(), np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            ids, owners, keys, found = batch.column(0).to_pylist(), [], [], []
            for i, words, grams in _word_sets(batch.column(1).to_pylist(), n, min_words, hasher):
                owners.append(ids[i])
                keys.append(xxhash.xxh3_128_digest(words.tobytes()))
                found.append(grams)
            if found:
                at = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(sums, at, 1)
            nulls = pa.nulls(len(owners))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.binary()), nulls.cast(pa.int32()), nulls.cast(pa.binary())], schema=schema)
        counters = packed(sums)
        nulls = pa.nulls(counters.num_rows)
        yield pa.RecordBatch.from_arrays([nulls.cast(pa.int64()), nulls.cast(pa.binary()), *counters.columns], schema=schema)

    return docs.select("doc", "text").mapInArrow(run, _SCAN)


#: Steps of a counter's logarithm to base 2 that are told apart.
STEPS = 8


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counters as levels of one byte: 0, 8 for 1, 13 for 2, and eight more for twice as many."""
    return np.round(STEPS * np.log2(1.0 + counts)).astype(np.uint8)


def _entries(level: np.ndarray, load: float) -> np.ndarray:
    """What a level's counter has of one n-gram, less what others bring into a counter on average."""
    return np.maximum(np.exp2(level / STEPS) - 1 - load, 0).astype(np.int64)


def _sketch_bits(texts: DataFrame) -> int:
    """As many counters as there are about four n-grams to each, within bounds: 4 million to 64 million."""
    signs = texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    return min(26, max(SKETCH_BITS, math.ceil(math.log2(max(1, signs / 6 / 4)))))


def _prefix_rows(docs: DataFrame, n: int, min_words: int, t: float, sketch, bits: int, load: float) -> DataFrame:
    """(cell, k, doc, size, head, sign): the rarest n-grams of each set, as many as the bound asks for.

    ``k`` identifies the n-gram (44 hash bits and the level of its counter, which is a function of the
    hash). ``head``: it is in the shorter prefix that suffices for the smaller set of a pair.
    An n-gram whose counter is 1 occurs in no other document and is left out. A column with
    more than CELL_ROWS expected entries is cut into blocks of documents, and each entry goes to
    every cell (block, block) of its row, so that no task gets a whole hot column.
    """
    schema = pa.schema([("cell", pa.int64()), ("k", pa.int64()), ("doc", pa.int64()), ("size", pa.int32()), ("head", pa.bool_()), ("sign", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = TextHasher(), sketch.value
        for batch in batches:
            ids, ks, docs_, sizes, heads, signs = batch.column(0).to_pylist(), [], [], [], [], []
            for i, _, grams in _word_sets(batch.column(1).to_pylist(), n, min_words, hasher):
                size = len(grams)
                level = levels[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.sort((level << np.uint64(44)) | ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
                least = min(COMMON, math.ceil(t * size - _FIXED))
                key = key[: size - math.ceil(t * size - _FIXED) + least]
                head = np.arange(len(key)) < size - math.ceil(2 * t / (1 + t) * size - _FIXED) + least
                many = (key >> np.uint64(44)) > STEPS
                ks.append(key[many].astype(np.int64))
                heads.append(head[many])
                docs_.append(np.full(int(many.sum()), ids[i], dtype=np.int64))
                sizes.append(np.full(int(many.sum()), size, dtype=np.int32))
                signs.append(_parities(grams))
            if not ks:
                continue
            k, doc, size, head = (np.concatenate(x) for x in (ks, docs_, sizes, heads))
            sign, of = np.stack(signs), np.repeat(np.arange(len(ks)), [len(x) for x in ks])
            blocks = 1 + _entries(k >> 44, load) // CELL_ROWS
            cell = np.zeros(len(k), dtype=np.int64)
            hot = np.flatnonzero(blocks > 1)
            if len(hot):
                times = blocks[hot]
                own = _block(doc[hot], times)
                at, me, count = np.repeat(hot, times), np.repeat(own, times), np.repeat(times, times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                pair_cell = 1 + np.minimum(me, other) * count + np.maximum(me, other)
                keep = np.flatnonzero(blocks == 1)
                k, doc, size, head, of = (np.concatenate([x[keep], x[at]]) for x in (k, doc, size, head, of))
                cell = np.concatenate([cell[keep], pair_cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k), pa.array(doc), pa.array(size), pa.array(head), _signs(sign[of])], schema=schema)

    return docs.mapInArrow(run, "cell long, k long, doc long, size int, head boolean, sign binary")


def _block(doc: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of a document in a column that is cut into ``blocks``."""
    return (mix(doc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)


def _product(rows: DataFrame, t: float, load: float) -> DataFrame:
    """(x, y, least): an entry for each common prefix element of two documents, x having the smaller set.

    ``least`` is how many the pair must have: COMMON, or what a very small set can have.

    Entries of one column and cell lie together in a partition. Within it the pairs are built
    by index arithmetic, in steps of bounded size, as far as the larger set isn't too large. What
    is passed on are those whose bitmaps differ in no more bits than t lets the sets differ.
    """
    together = rows.repartition("cell", "k").sortWithinPartitions("k", "cell", "size", "doc")

    def pairs_of(k, cell, doc, size, head, sign) -> Iterator[pa.RecordBatch]:
        n = len(k)
        if n < 2:
            return
        group = np.append(0, np.cumsum((k[1:] != k[:-1]) | (cell[1:] != cell[:-1]))) << 40
        end = np.searchsorted(group + size, group + (size / t + _FIXED).astype(np.int64), "right")
        words = np.ascontiguousarray(sign.T)
        times = np.where(head, end - np.arange(n) - 1, 0)
        start = 0
        steps = np.cumsum(times)
        least = np.minimum(COMMON, np.ceil(t * size - _FIXED)).astype(np.int8)
        while start < n:
            base = steps[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(steps, base + PRODUCT_STEP, "right")))
            own = times[start:stop]
            left = np.repeat(np.arange(start, stop), own)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
            bits = np.zeros(len(left), dtype=np.uint16)
            for word in words:
                bits += np.bitwise_count(word[left] ^ word[right])
            near = bits <= (1 - t) / (1 + t) * (size[left] + size[right]) + _FIXED
            left, right = left[near], right[near]
            ok = doc[left] != doc[right]
            blocks = 1 + _entries(k[left] >> 44, load) // CELL_ROWS
            if (blocks > 1).any():
                a, b = _block(doc[left], blocks), _block(doc[right], blocks)
                ok &= (blocks == 1) | (1 + np.minimum(a, b) * blocks + np.maximum(a, b) == cell[left])
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[left[ok]]), pa.array(doc[right[ok]]), pa.array(least[left[ok]])], names=["x", "y", "least"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "cell", "doc", "size", "head")] + [_bitmaps(batch.column("sign"))]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
            k, cell = now[0], now[1]
            if not len(k):
                continue
            whole = int(np.flatnonzero((k != k[-1]) | (cell != cell[-1])).max(initial=-1)) + 1
            yield from pairs_of(*[x[:whole] for x in now])
            rest = [x[whole:] for x in now]
        if rest is not None:
            yield from pairs_of(*rest)

    return together.mapInArrow(run, "x long, y long, least byte")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, t: float) -> DataFrame:
    """Exact similarity of candidate pairs. Ships each text once per pair it is in, no more."""
    left = docs.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = TextHasher(), {}

        def grams(doc: int, text: str) -> np.ndarray:
            if doc not in known:
                if len(known) > 2000:
                    known.clear()
                known[doc] = np.unique(ngram_hashes(hasher(text), n))
            return known[doc]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = grams(a, ta), grams(b, tb)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                j = both / (len(x) + len(y) - both)
                if j >= t - _FIXED:
                    out.append((a, b, j))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double")


def similar_classes(docs: DataFrame, *, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 50, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the membership of documents in classes of one text.

    Returns ``(links, members)``: links(a, b, similarity) with a < b, both representatives;
    members(doc, rep), where rep is the smallest id of the class. Ids are whole numbers and are
    cast to BIGINT. Null ids and texts of fewer than ``max(min_words, n)`` words are in neither;
    repeated (id, text) rows count once; ties of similarity don't occur, as every pair at or
    above the threshold is kept. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    chosen = docs.where(where) if where is not None else docs
    base = chosen.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    base = spread(base)
    bits = _sketch_bits(base)
    scanned = cut(_scan(base, n, max(min_words, n), bits))
    keyed = scanned.where("text_key is not null").select("doc", "text_key")
    # The class key is computed with partial aggregation, so a class of any size is one row
    # per task before the shuffle.
    reps = keyed.groupBy("text_key").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"))
    members = keyed.join(reps.where("copies > 1"), "text_key").select("doc", "rep").distinct()
    members = cut(members)
    dropped = members.where("doc <> rep").select("doc")
    # Repeated rows of one id may stay: they raise a count that only chooses what is verified.
    unique = base.join(dropped, "doc", "left_anti")
    levels = summed(scanned.where("chunk is not null").select("chunk", "packed"), 1 << bits, np.uint8, _levels)
    load = float(np.mean(np.exp2(levels / STEPS, dtype=np.float32) - 1))
    rows = _prefix_rows(unique, n, min_words, threshold, spark.sparkContext.broadcast(levels), bits, load)
    overlap = _product(rows, threshold, load).groupBy("x", "y").agg(F.count("*").alias("c"), F.max("least").alias("least"))
    candidates = overlap.where("c >= least").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = _verified(candidates, unique, n, threshold).dropDuplicates(["a", "b"])
    return links, members


def near_duplicate_pairs(docs: DataFrame, *, id_col: str, text_col: str, n: int, threshold: float, min_words: int, full_copies: int | None = None, where: Column | None = None) -> DataFrame:
    """All pairs (id_a < id_b) of documents at or above the threshold, with their similarity.

    Links between different texts are expanded to every member of both classes, and exact copies
    to all pairs. With ``full_copies``, each member of a class of more members is paired with the
    representative only, which says the same in linear space, and its links to other texts are
    given for the representative.
    """
    links, members = similar_classes(docs, id_col=id_col, text_col=text_col, n=n, threshold=threshold, min_words=min_words, where=where)
    links = cut(links)
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    small = members if full_copies is None else members.join(sizes.where(F.col("copies") <= full_copies), "rep").select("doc", "rep")
    # Expansion of links: a class without a members row has its representative only.
    a = links.join(small.select(F.col("rep").alias("a"), F.col("doc").alias("doc_a")), "a", "left").withColumn("doc_a", F.coalesce("doc_a", "a"))
    ab = a.join(small.select(F.col("rep").alias("b"), F.col("doc").alias("doc_b")), "b", "left").withColumn("doc_b", F.coalesce("doc_b", "b"))
    different = ab.select(F.least("doc_a", "doc_b").alias("id_a"), F.greatest("doc_a", "doc_b").alias("id_b"), "similarity")
    within = small.alias("p").join(small.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.doc") < F.col("q.doc"))).select(F.col("p.doc").alias("id_a"), F.col("q.doc").alias("id_b"), F.lit(1.0).alias("similarity"))
    if full_copies is None:
        return different.unionByName(within)
    star = members.join(sizes.where(F.col("copies") > full_copies), "rep").where("doc <> rep").select(F.least("doc", "rep").alias("id_a"), F.greatest("doc", "rep").alias("id_b"), F.lit(1.0).alias("similarity"))
    return different.unionByName(within).unionByName(star)


def near_duplicate_groups(docs: DataFrame, *, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 50, where: Column | None = None, max_rounds: int = 60) -> DataFrame:
    """(doc, group_id, links): the connected group of every document that has a partner.

    group_id is the smallest id of the group; links is the number of different texts that the
    document's text is linked to. Labels spread by the smallest neighbour with pointer jumping,
    so the number of rounds grows with the logarithm of a chain's length; nothing is collected.
    """
    links, members = similar_classes(docs, id_col=id_col, text_col=text_col, n=n, threshold=threshold, min_words=min_words, where=where)
    links = cut(links.select("a", "b"))
    both = links.union(links.select("b", "a")).toDF("v", "w")
    degree = both.groupBy("v").agg(F.count("*").alias("links"), F.min("w").alias("least"))
    label = cut(degree.select("v", F.least("v", "least").alias("c"), "links"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("cw"))
        hooked = label.join(near, "v").select("v", F.least("c", "cw").alias("n"), "c", "links")
        jumped = hooked.join(hooked.select(F.col("v").alias("n"), F.col("n").alias("nn")), "n", "left")
        step = cut(jumped.select("v", F.least("n", F.coalesce("nn", "n")).alias("c"), F.col("c").alias("old"), "links"))
        moved = step.where("c <> old").limit(1).count()
        label = step.select("v", "c", "links")
        if not moved:
            break
    else:
        raise RuntimeError("the groups did not settle")
    all_docs = label.join(members.select("doc", F.col("rep").alias("v")), "v", "full")
    out = all_docs.select(F.coalesce("doc", "v").alias("doc"), F.coalesce("c", "v").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    reps = label.select(F.col("v").alias("doc"), F.col("c").alias("group_id"), "links")
    return out.unionByName(reps).distinct()
