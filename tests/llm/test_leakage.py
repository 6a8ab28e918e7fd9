import random

from pyspark.sql import functions as F

from tarnweave.llm import leakage
from tarnweave.llm.queries import p8_leaks
from tarnweave.llm.words import split_words


def longest_word_run(a, b):
    """The longest run of words that both have, by all pairs of places."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
        best, before = max(best, *now), now
    return best


def test_exact_runs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(12)] + [(50, None), (None, "x " * 20), (51, ""), (3, "another row of a known item")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randrange(0, 80))]
        source = split_words(items[rng.randrange(12)][1])
        k = rng.randrange(max(1, len(source)))
        part = source[k : k + rng.randrange(8, 20)]
        at = rng.randrange(len(body) + 1)
        docs.append((i, " ".join(body[:at] + [p.upper() + "," if rng.random() < 0.2 else p for p in part] + body[at:])))
    docs += [(500, None), (None, items[0][1]), (501, ""), (502, "z " * 3000 + items[5][1] + " y" * 3000), (502, "again")]
    kept = {i: split_words(p) for i, p in items[:12]}
    wanted = {(d, i) for d, t in docs if d is not None and t for i, p in kept.items() if longest_word_run(split_words(t), p) >= 12}
    ds = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    its = spark.createDataFrame(items[:-1], "item_id long, passage string").withColumn("text", F.lit("clash"))
    for block in (leakage.BLOCK_GRAMS, 300):
        monkeypatch.setattr(leakage, "BLOCK_GRAMS", block)
        got = leakage.leaked_passages(ds, its, edits=0).where("run_words >= 12")
        rows = got.collect()
        assert {(r.doc_id, r.item_id) for r in rows} == wanted
        for r in rows:
            texts = [t for d, t in docs if d == r.doc_id and t]
            assert r.run_words == max(longest_word_run(split_words(t), kept[r.item_id]) for t in texts)
            assert any(longest_word_run(split_words(t)[r.start_word : r.start_word + r.run_words], kept[r.item_id]) == r.run_words for t in texts)
    assert leakage.leaked_passages(ds.limit(0), its).count() == 0 and leakage.leaked_passages(ds, its.limit(0)).count() == 0


def test_edited_passage_is_found(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    passage = " ".join(words)
    edited = words[:]
    for k in (9, 19, 29):
        edited[k] = edited[k][:-1]
    other = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60))
    df = spark.createDataFrame([(1, f"{other} {' '.join(edited)} {other}"), (2, other)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    got = leakage.leaked_passages(df, items, edits=2).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].run_words < 12 and got[0].edits >= 1
    assert leakage.leaked_passages(df, items, edits=0).count() == 0


def test_few_hits_are_no_leak(spark):
    items = spark.createDataFrame([(1, " ".join(f"word{i} and" for i in range(40)))], "item_id long, passage string")
    shares = ["word1 and word2 and", " ".join(f"word{i} and" for i in range(4)) + " other " + " ".join(f"word{i} and" for i in range(20, 24)), "nothing", "word3 and " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(shares)], "doc_id long, text string")
    for one in (df, df.limit(1), df.where("doc_id = 2"), df.where("doc_id = 3")):
        assert leakage.leaked_passages(one, items, edits=0).count() == 0


def test_the_query_finds_two_edits(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(14)]
    edited = words[:]
    for k in (4, 9):
        edited[k] = edited[k][:2] + "z" + edited[k][3:]
    other = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60))
    spark.createDataFrame([(1, f"{other} {' '.join(edited)} {other}"), (2, other)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = p8_leaks(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 7, 2)]


def test_recall_of_planted_edits(spark):
    """Regions of a passage with up to two edits somewhere in their middle are all found; unrelated texts never."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    docs, wanted = [], set()
    for k in range(240):
        i, edits = k % 20, k % 3
        words = items[i][1].split()
        at = rng.randrange(0, 12)
        part = list(" ".join(words[at : at + 16]))
        for place in sorted(rng.sample(range(15, len(part) - 15), edits), reverse=True):
            part[place : place + rng.randrange(2)] = rng.choice("xyz")
        docs.append((k, " ".join([*(word() for _ in range(40)), "".join(part), *(word() for _ in range(40))])))
        wanted.add((k, i))
    docs += [(1000 + k, " ".join(word() for _ in range(90))) for k in range(60)]
    got = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted


def test_alignment_decides():
    """Regions by counted q-grams alone aren't leaks: the alignment takes those that differ too often out."""
    import numpy as np

    passage = "the quiet river follows the old road to the small house behind the tower"
    block = leakage._Passages([(1, passage)], leakage.Q, 12, 2)
    for text, leak in ((passage, True), (passage.replace("road", "rope"), True), ("the quiet river follows the new lane and the small house behind the hills", False)):
        whole = f" {text} "
        codes = leakage._codes(whole)
        found = leakage._regions(block, [whole], codes, np.array([0, len(whole) + 1]))
        assert len(found)
        shift = block.width * found[:, 2]
        zero, n = np.zeros(len(found), dtype=np.int64), np.full(len(found), len(block.codes))
        _, size, _, _ = leakage.align_in_bands(codes, block.codes, zero, zero + len(codes), shift, zero, n, 2 * block.width, block.shortest, 2)
        assert bool((size > 0).any()) == leak
