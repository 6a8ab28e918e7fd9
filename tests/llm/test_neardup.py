import random

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import neardup
from tarnweave.llm.queries import p4_found
from tarnweave.llm.words import split_words


def brute(rows, n, t, least):
    sets = {}
    for i, text in rows:
        w = split_words(text)
        if i is not None and len(w) >= max(n, least):
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out, ids = set(), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                out.add((a, b))
    return out


def corpus(seed, documents=60, vocabulary=40):
    rng = random.Random(seed)
    rows = []
    for i in range(documents):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(8)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [f"w{rng.randrange(vocabulary)}"]
            if rng.random() < 0.3:
                k = rng.randrange(len(words))
                words = words[k:] + words[:k]
        else:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("n", "t", "least", "cells"), [(3, 0.6, 20, 4096), (5, 0.8, 10, 4096), (1, 0.6, 1, 4096), (3, 0.6, 20, 3)])
def test_equals_brute_force(spark, monkeypatch, n, t, least, cells):
    monkeypatch.setattr(neardup, "CELL_ROWS", cells)
    monkeypatch.setattr(neardup, "PRODUCT_STEP", 50)
    rows = [*corpus(n), (900, None), (901, ""), (None, "w1 " * 30), (902, "buy " * 60), (903, "Buy! " * 70), (904, "buy now " * 40), (905, "w1 w2"), (0, corpus(n)[0][1])]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("doc", F.lit("clash")).withColumn("text", F.lit(1))
    got = neardup.near_duplicate_pairs(df, id_col="id", text_col="body", n=n, threshold=t, min_words=least).collect()
    pairs = [(r.id_a, r.id_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, n, t, least)


def test_large_class_is_a_star(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(10)] + [(50, text + " more")], "id long, body string")
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, id_col="id", text_col="body", n=3, threshold=0.6, min_words=50, full_copies=4).collect()}
    assert got == {(0, i) for i in range(1, 10)} | {(0, 50)}


def test_the_query_gives_all_pairs_of_a_large_class(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(i, "stored", text) for i in range(70)] + [(100, "stored", text + " and four words more"), (101, "stored", "short")]
    spark.createDataFrame(rows, "seq long, outcome string, extracted_text string").write.parquet(f"{tmp_path}/crawl_records.parquet")
    got = {(r.seq_a, r.seq_b) for r in p4_found(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in [*range(70), 100] for b in [*range(70), 100] if a < b}


def test_groups(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join(base[:60] + [f"x{k}" for k in range(i)] + base[60 + i :])) for i in range(0, 12)]
    rows = [*chain, (100, chain[3][1]), (200, " ".join(f"z{i}" for i in range(70))), (201, " ".join(f"z{i}" for i in range(70))), (300, "alone " * 3)]
    got = {r.doc: r.group_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, body string"), id_col="id", text_col="body", n=3, threshold=0.8, min_words=50).collect()}
    assert got == {**dict.fromkeys([*range(12), 100], 0), 200: 200, 201: 200}


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, body string")
    assert neardup.near_duplicate_pairs(empty, id_col="id", text_col="body", n=3, threshold=0.6, min_words=50).count() == 0
    assert neardup.near_duplicate_groups(empty, id_col="id", text_col="body").count() == 0


def test_hot_columns_are_told_from_full_counters():
    """A counter that is as full as all others doesn't cut its n-grams into blocks; one that is much fuller does."""
    import numpy as np

    for load in (0.3, 37, 3650, 36_500):
        ordinary = np.random.default_rng(1).poisson(load, 10_000)
        copies = 1 + neardup._entries(neardup._levels(ordinary).astype(np.int64), load) // neardup.CELL_ROWS
        assert copies.mean() == 1
        hot = neardup._entries(neardup._levels(np.array([load + 500_000])).astype(np.int64), load)
        assert abs(hot[0] - 500_000) < 0.1 * (500_000 + load)
    assert (neardup._levels(np.array([0, 1, 2, 2**31])) == [0, 8, 13, 248]).all()


def _blocks_of_words(documents=300, blocks=60, seed=3):
    """Texts of seven of sixty passages: all runs are in many texts, but few texts have most of them in common."""
    rng = random.Random(seed)
    passages = [" ".join(f"b{b}w{k}" for k in range(10)) for b in range(blocks)]
    return [(i, " ".join(rng.sample(passages, 7))) for i in range(documents)]


def test_pairs_that_only_share_some_runs_are_dropped_where_they_are_built(spark):
    """What the product passes on doesn't grow with the square of the texts that share a passage."""
    import numpy as np

    rows = [*_blocks_of_words(), (900, _blocks_of_words()[5][1] + " and two")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    bits, t = neardup.SKETCH_BITS, 0.6
    levels = np.full(1 << bits, 40, dtype=np.uint8)
    entries = neardup._prefix_rows(docs, 3, 50, t, spark.sparkContext.broadcast(levels), bits, 0.0)
    passed = {tuple(sorted((r.x, r.y))) for r in neardup._product(entries, t, 0.0).collect()}
    true = brute(rows, 3, t, 50)
    assert (5, 900) in true and true <= passed and len(passed) < 0.02 * len(rows) ** 2 / 2


@pytest.mark.parametrize(("n", "t"), [(3, 0.6), (2, 0.3), (1, 0.8)])
def test_bitmaps_never_refuse_a_pair(n, t):
    """Two sets differ in as many elements as their bitmaps in bits, at least."""
    import numpy as np

    rng = np.random.default_rng(n)
    for size in (1, 5, 40, 300, 3000):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        y = np.unique(np.concatenate([x[: int(size * (1 - t / 2))], rng.integers(0, 2**63, size // 3, dtype=np.uint64)]))
        x = np.unique(x)
        assert np.bitwise_count(neardup._parities(x) ^ neardup._parities(y)).sum() <= len(np.setxor1d(x, y))


def test_words_are_those_of_split_words():
    from tarnweave.llm.words import TextHasher, WordHasher

    text = "Ein Über-Fall, o'clock  \u0130x ΟΔΟΣ -- snake_case ... 12.5 Straße\u00a0x\u2028y \x00z \U0001d7d9 "
    few = TextHasher(keep=1)
    for hasher in (TextHasher(), few, few):
        assert hasher(text).tolist() == WordHasher()(split_words(text)).tolist()
    assert TextHasher()("").tolist() == TextHasher()(" -- ").tolist() == []
