import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnweave.llm import mixing, vocab


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_term_counters_equal_sets(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(vocab, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(vocab, "COUNTERS_KEPT", 5)
    rng = random.Random(1)
    keys = ["Ab", "ab", "a-b", "c", "ü!", "--", "ß", "10", "x_y"]
    rows = [(i % 9, {rng.choice(keys): rng.randrange(-1, 4) for _ in range(rng.randrange(5))}) for i in range(40)] + [(None, {"c": 1}), (3, None), (77, None), (78, {"c": None})]
    df = spark.createDataFrame(rows, "id long, term_freqs map<string,bigint>").withColumn("term", F.lit("clash")).withColumn("freqs", F.lit(0))
    per = defaultdict(dict)
    for i, m in rows:
        own = defaultdict(int)
        for k, v in (m or {}).items():
            t = "".join(c for c in k if c.isalnum()).lower()
            if i is not None and t and v is not None and v >= 1:
                own[t] += v
        for t, v in own.items():
            per[t][i] = max(v, per[t].get(i, 0))
    got = {r.term: (r.occurrences, r.documents) for r in vocab.term_counters(df).collect()}
    assert got == {t: (sum(d.values()), len(d)) for t, d in per.items()}
    ids = len({i for i, _ in rows if i is not None})
    marks = {r.term: r.term_mark for r in vocab.marked_terms(df).collect()}
    assert marks == {t: "rare" if len(d) < 3 else "common" if len(d) > 0.15 * ids else None for t, d in per.items()}
    assert vocab.marked_terms(df.limit(0)).count() == 0


def simulate(docs, targets, budget):
    """Fair queueing, one document at a time."""
    heap = []
    for s, (weight, repeats) in targets.items():
        own = [d for d in docs if d[1] == s]
        at = 0
        for copy in range(1, repeats + 1):
            for d in own:
                at += d[2]
                heap.append((at / weight, s, copy, d[0], d[2]))
    total, out = 0, []
    for f, s, copy, i, size in sorted(heap):
        if total + size > budget:
            break
        total += size
        out.append((i, copy))
    return out


def test_mixing_equals_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BUCKETS", 3)
    rng = random.Random(2)
    docs = [(i, rng.choice(["A b", "a_b", " c", "C", "d"]), rng.randrange(1, 50)) for i in range(300)] + [(900, None, 9), (None, "c", 9), (901, "c", 0), (902, "c", None), (903, "zz", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("bucket", F.lit("clash")).withColumn("u", F.lit(1))
    targets = spark.createDataFrame([("a_b", 0.5, 2), ("c", 0.3, 4), ("d", 0.15, 1), ("none", 0.05, 9), ("zz", None, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(df, targets, budget=4000)
    order = [r.doc_id for r in df.where("doc_id is not null").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).substr(1, 10), "doc_id").collect()]
    size = {d[0]: d for d in docs}
    plain = [(i, mixing_name(size[i][1]), size[i][2]) for i in order if size[i][1] and size[i][2]]
    wanted = simulate(plain, {"a_b": (0.5, 2), "c": (0.3, 4), "d": (0.15, 1)}, 4000)
    assert sorted((r.doc_id, r.copy) for r in chosen.collect()) == sorted(wanted)
    rows = {r.source: r for r in shares.collect()}
    assert rows["none"].tokens == 0 and rows["none"].goal_share == 0
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9 and sum(r.tokens for r in rows.values()) <= 4000
    assert all(r.copy <= 4 for r in chosen.collect())


def mixing_name(s):
    return {"A b": "a_b", "a_b": "a_b", " c": "c", "C": "c", "d": "d", "zz": "zz"}[s]


def test_default_budget_meets_the_shares(spark, sf):
    sized = mixing.with_token_counts(spark.read.parquet(f"{sf}/documents.parquet"), "text")
    chosen, shares = mixing.mix_sources(sized, spark.read.parquet(f"{sf}/source_targets.parquet"))
    assert chosen.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert shares.count() == spark.read.parquet(f"{sf}/source_targets.parquet").count()
    empty, none = mixing.mix_sources(sized.limit(0), spark.read.parquet(f"{sf}/source_targets.parquet"))
    assert empty.count() == 0 and none.where("tokens > 0").count() == 0


def test_token_counts_round_trip(spark):
    df = spark.createDataFrame([("",), (None,), ("Hello world",), ("дом " * 50,)], "t string")
    assert [r.n_tokens for r in mixing.with_token_counts(df, "t").collect()][:3] == [0, 0, 2]


def test_a_source_of_tiny_share(spark):
    """Its finish times lie far beyond all others; they neither stretch the ranges nor enter the mixture."""
    docs = [(i, "big" if i % 3 else "tiny", 10) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.999999, 5), ("tiny", 0.000001, 1000)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(df, targets, budget=20_000)
    assert chosen.where("source = 'big'").count() == 2000 and chosen.where("source = 'tiny'").count() == 0
    assert {r.source: r.documents for r in shares.collect()} == {"big": 2000, "tiny": 0}


def test_finish_of_the_budget():
    assert mixing._finish_of([(0.5, 10.0), (0.5, 1000.0)], 20) == 20 and mixing._finish_of([(0.5, 10.0), (0.5, 1000.0)], 30) == 40
    assert mixing._finish_of([(0.5, 10.0)], 99) == 20 and mixing._finish_of([], 5) == 0
