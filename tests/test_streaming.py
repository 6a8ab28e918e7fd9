from tarnweave.streaming import queue as Q


def test_dead_letters_and_dedup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"url": "http://a/", "source_seed": "s", "depth": 0}\nnot json\n\n{"url": "http://a/", "source_seed": "s", "depth": 1}\n{"depth": 3}\n')
    source = lambda: Q.read_messages(spark, str(tmp_path / "in"))
    Q.run_to_end(Q.dead_letters(source()), str(tmp_path / "dead"), str(tmp_path / "c1"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == ["not json", '{"depth": 3}']
    Q.run_to_end(Q.deduplicated(Q.good_items(source()), ["url"]), str(tmp_path / "good"), str(tmp_path / "c2"))
    (tmp_path / "in" / "b.txt").write_text('{"url": "http://a/", "source_seed": "t", "depth": 0}\n{"url": "http://b/", "source_seed": "t", "depth": 0}\n')
    Q.run_to_end(Q.deduplicated(Q.good_items(source()), ["url"]), str(tmp_path / "good"), str(tmp_path / "c2"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["http://a/", "http://b/"]


def test_state_over_batches(spark, tmp_path):
    schema = "k string, seq long, bad boolean"
    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        Q.run_to_end(Q.suppression(stream, key="k", order="seq", bad="bad", threshold=2), str(tmp_path / "out"), str(tmp_path / "c"))
        Q.consume(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sink, str(tmp_path / "c3"))
    sink = Q.UpsertSink(str(tmp_path / "t"), ["k"], "seq")
    add([("a", 1, True), ("a", 2, False)])
    add([("a", 3, True), ("a", 4, False), ("b", 5, False)])
    got = {r.seq: r.suppressed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert {r.k: r.seq for r in sink.latest(spark).collect()} == {"a": 4, "b": 5}


def test_upserts_rewrite_the_parts_they_touch(spark, tmp_path):
    sink = Q.UpsertSink(str(tmp_path / "t"), ["k"], "seq")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, seq long")
    first = [(f"k{i}", i) for i in range(300)]
    sink(rows(*first), 0)
    sink(rows(("k5", 1000), ("k6", 1)), 1)
    sink(rows(("k5", 1000), ("k6", 1)), 1)  # the same batch again
    sink(rows(("k7", 2000)), 5)
    want = dict(first) | {"k5": 1000, "k6": 1, "k7": 2000}
    assert {r.k: r.seq for r in sink.latest(spark).collect()} == want
    assert len(list((tmp_path / "t" / "v=1").glob("_bucket=*"))) <= 2 and len(list((tmp_path / "t" / "v=5").glob("_bucket=*"))) == 1
    sink(spark.createDataFrame([], "k string, seq long"), 6)
    assert sink.latest(spark).count() == 300
