import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.operators import classify, crawl, graph, index, ordering, orphans, search, tables
from tarnweave.schemas import CRAWL_RECORD
from tarnweave.sources import io


def record(seq, url, text="", links=(), outcome="stored", reason=None):
    return (seq, 2, url, url if outcome == "stored" else None, "s", None, 0, outcome, reason, None, 200, "text/html", 1, None, None, text, list(links), 0)


RECORD = T.StructType([T.StructField("seq", T.LongType()), *CRAWL_RECORD.fields])


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_classification_goldens(spark):
    shell = '<html><body><div id="root"></div>' + "<script></script>" * 3 + "</body></html>"
    page = "<html><body>" + "x" * 80 + "</body></html>"
    rows = [(1, "application/pdf", "<html>short"), (2, None, shell), (3, "TEXT/HTML; x", "<html><body>" + "x" * 79), (4, "text/html", page), (5, None, "<!DOCTYPE html><p>"), (6, None, None)]
    snaps = spark.createDataFrame(rows, "seq long, content_type string, html string").select("seq", F.lit("http://h.x/").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.lit("s").alias("source_seed"), F.lit(None).cast("string").alias("referrer"), F.lit(0).alias("depth"), F.lit(404).alias("status"), "content_type", "html")
    got = {r.seq: (r.outcome, r.skip_reason, r.content_hash is not None) for r in classify.classify(snaps, F.lit(5)).collect()}
    assert got == {1: ("skipped", "non_html", False), 2: ("skipped", "likely_javascript_required", False), 3: ("skipped", "empty_text", False), 4: ("stored", None, True), 5: ("skipped", "non_html", False), 6: ("skipped", "non_html", False)}


def test_penalty(spark):
    rows = spark.createDataFrame([("robots_txt",), ("likely_javascript_required",), (None,), ("bad_host_threshold",)], "r string")
    assert [x.p for x in rows.select(classify.should_penalize(F.col("r")).alias("p")).collect()] == [False, True, False, False]


def test_suppression_golden_and_random(spark):
    rng = random.Random(3)
    rows = [("h", i, i < 4) for i in range(5)] + [(f"g{rng.randrange(4)}", 10 + i, rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "host string, seq long, bad boolean")
    got = {r.seq: r.suppressed for r in ordering.suppressed_from(df, "host", "seq", F.col("bad"), 3).collect()}
    seen: dict = {}
    for host, seq, bad in sorted(rows, key=lambda r: r[1]):
        assert got[seq] == (seen.get(host, 0) >= 3)
        seen[host] = seen.get(host, 0) + bad
    assert [got[i] for i in range(5)] == [False, False, False, True, True]


def test_index_ignores_skipped(spark):
    rows = [record(1, "http://a/", "Rust search content with enough terms to index."), record(2, "http://b/", "this should not be indexed", outcome="skipped", reason="empty_text"), record(3, "http://c/", "   ")]
    built = index.build_index(records(spark, rows))
    terms = {r.term for r in built.terms.collect()}
    assert built.documents.count() == 1 and "rust" in terms and "should" not in terms
    assert index.health(built).first() == ("ok", 1, len(terms))
    empty = index.build_index(records(spark, []))
    assert index.health(empty).first() == ("ok", 0, 0)
    assert search.search(spark, empty, "rust").count() == 0


def links_of(edges):
    nodes = sorted({x for e in edges for x in e} | {"d"})
    return [record(i, n, links=[b for a, b in edges if a == n]) for i, n in enumerate(nodes)]


@pytest.mark.parametrize(("one_task", "hot"), [(0, 0.9), (0, 0.2), (10**6, 0.01)])
def test_pagerank_goldens(spark, monkeypatch, one_task, hot):
    monkeypatch.setattr(graph, "ONE_TASK_ROWS", one_task)
    monkeypatch.setattr(graph, "HOT_SHARE", hot)
    monkeypatch.setattr(graph, "PARTS", 3)
    rows = records(spark, links_of([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")]))
    got = {r.url: r.page_rank for r in graph.page_rank_current(rows).collect()}
    for k, v in {"a": 1.477296, "b": 0.818317, "c": 1.513911, "d": 0.190476}.items():
        assert math.isclose(got[k], v, abs_tol=1e-6)
    assert math.isclose(sum(got.values()), 4.0)
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "id long")
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 3), (3, 1), (None, 1)], "from_page_id long, to_page_id long")
    got = {r.page_id: r.page_rank for r in graph.page_rank_legacy(pages, links).collect()}
    for k, v in {1: 1.163375, 2: 0.644418, 3: 1.192206, 4: 0.15}.items():
        assert math.isclose(got[k], v, abs_tol=1e-6)


def test_pagerank_duplicate_records(spark):
    rows = [record(1, "a", links=["b", "b", "c"]), record(2, "b", links=["a"]), record(3, "a", links=["c"]), record(4, "c", links=["a", "zz", "c"]), record(5, "b", links=[])]
    got = {r.url: r.page_rank for r in graph.page_rank_current(records(spark, rows), iterations=3).collect()}
    # Links of all records count, out-degrees are those of the last record of a URL.
    kept = {"a": [["b", "b", "c"], ["c"]], "b": [["a"], []], "c": [["a", "c"]]}
    out = {u: len(v[-1]) for u, v in kept.items()}
    x = dict.fromkeys(kept, 1.0)
    for _ in range(3):
        spread = 0.85 * sum(x[u] for u in kept if not out[u]) / 3
        x = {v: 0.15 + spread + 0.85 * sum(x[u] / max(1, out[u]) for u in kept for links in kept[u] for t in links if t == v) for v in kept}
    assert all(math.isclose(got[u], x[u]) for u in x)
    assert graph.page_rank_current(records(spark, [])).count() == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "rust search rust"), (2, "search only here"), (3, None), (4, "rust search rust")], "id long, t string")
    built = index.index_texts(docs, id_col="id", text_col="t").persist()
    got = search.search(spark, built, "rust search", 10).collect()
    assert [r.id for r in got] == [1, 4, 2] and got[0].score == got[1].score
    twice = search.search(spark, built, "rust rust", 1, snippets=False).first()
    once = search.search(spark, built, "rust", 1, snippets=False).first()
    assert math.isclose(twice.bm25_score, 2 * once.bm25_score, abs_tol=2e-6)
    assert search.search(spark, built, "rust", 0).count() == 0 and search.search(spark, built, "the of").count() == 0
    with pytest.raises(ValueError):
        search.search(spark, built, "x", mode="other")
    many = search.search_many(built, spark.createDataFrame([(7, "rust"), (8, "the")], "query_id long, query string"), 1).collect()
    assert [(r.query_id, r.id) for r in many] == [(7, 1)]
    with pytest.raises(ValueError, match="no valid terms in search query"):
        search.legacy_query_terms("The of")


def test_dense_ids_and_keys(spark):
    df = spark.createDataFrame([(x,) for x in (90, 7, 1000, 8, None)], "o long")
    assert {r.o: r.id for r in ordering.dense_ids(df, "o").collect()} == {7: 0, 8: 1, 90: 2, 1000: 3, None: 4}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "k string, seq long, v string")
    assert sorted((r.k, r.seq, r.v) for r in ordering.last_per_key(rows, ["k"], "seq").collect()) == [("a", 3, None), ("b", 2, "y")]
    old = spark.createDataFrame([("a", 0, "old"), ("c", 0, "old")], "k string, seq long, v string")
    assert sorted((r.k, r.v) for r in tables.insert_ignore(old, rows, ["k"], "seq").collect()) == [("a", "old"), ("b", "y"), ("c", "old")]
    assert sorted((r.k, r.v) for r in tables.upsert(old, rows, ["k"], "seq").collect() if r.v) == [("b", "y"), ("c", "old")]


def test_events(spark):
    rows = [(1, "page_queued", "u", None, None, None), (2, "page_fetched", "u", None, 200, None), (3, "page_failed", "u", None, None, "boom"), (4, "page_fetched", "v", None, 200, None), (5, "link_found", "u", "v", None, None), (6, "link_found", "u", "v", None, None), (7, "page_queued", "u", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, kind string, url string, to_url string, http_status int, error string")
    for c in ("content_type", "title", "anchor_text", "html", "extracted_text", "content_hash", "asset_url", "asset_type", "alt_text"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = tables.apply_events(df)
    pages = {r.url: (r.id, r.status, r.http_status, r.error) for r in got["pages"].collect()}
    assert pages == {"u": (1, "failed", 200, "boom"), "v": (2, "queued", None, None)}
    assert [(r.from_page_id, r.to_page_id) for r in got["links"].collect()] == [(1, 2)]
    assert got["page_assets"].count() == 0 and got["page_contents"].count() == 0
    assets = spark.createDataFrame([(1, "asset_found", "u", "a.png", "image", "old"), (2, "asset_found", "u", "a.png", "image", "new"), (3, "asset_found", "v", "a.png", "image", None)], "seq long, kind string, url string, asset_url string, asset_type string, alt_text string")
    for c in ("to_url", "error", "content_type", "title", "anchor_text", "html", "extracted_text", "content_hash"):
        assets = assets.withColumn(c, F.lit(None).cast("string"))
    found = tables.apply_events(assets.withColumn("http_status", F.lit(None).cast("int")))["page_assets"].collect()
    assert sorted((r.page_id, r.asset_url, r.alt_text or "") for r in found) == [(1, "a.png", "new"), (2, "a.png", "")]


def model_crawl(pages, seeds, max_pages, max_depth, threshold):
    """The queue loop, item by item."""
    queue, visited, bad, out = [(s, 0) for s in dict.fromkeys(seeds)], set(seeds), {}, []
    while queue and len(out) < max_pages:
        url, depth = queue.pop(0)
        host = url.split("/")[2]
        if bad.get(host, 0) >= threshold:
            out.append((url, depth, "host_suppressed"))
            continue
        ok, links = pages.get(url, (None, []))
        if not ok:
            bad[host] = bad.get(host, 0) + 1
            out.append((url, depth, "fetch_failed" if ok is None else "skipped"))
            continue
        out.append((url, depth, "stored"))
        if depth < max_depth:
            for link in links:
                if link not in visited:
                    visited.add(link)
                    queue.append((link, depth + 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_equals_the_queue(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://h{i % 4}.x/{i}" for i in range(40)]
    pages = {u: (rng.random() < 0.7, rng.sample(urls, rng.randrange(6))) for u in urls if rng.random() < 0.9}
    html = {u: "<html><body>" + ("y" * 90 if ok else "y") + "".join(f'<a href="{x}">.</a>' for x in links) for u, (ok, links) in pages.items()}
    snaps = spark.createDataFrame([(u, None, 200, "text/html", h) for u, h in html.items()], "url string, final_url string, status int, content_type string, html string")
    seeds = [urls[0], urls[5], urls[0]]
    got = crawl.crawl(crawl.seed_items(spark, seeds), crawl.snapshot_source(snaps), max_pages=25, max_depth=2, threshold=3, now_ms=1)
    assert [(r.requested_url, r.depth, r.outcome) for r in got.orderBy("seq").collect()] == model_crawl(pages, seeds, 25, 2, 3)
    with pytest.raises(ValueError):
        crawl.seed_items(spark, [])


def test_orphan_matching(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (None, "a", "x"), (None, "c", "x"), (None, None, "x"), (1, None, "x"), (1, "a", "y")], "k long, l string, extra string")
    parents = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (2, None, 5)], "k long, l string, extra int")
    key = lambda df: sorted(((r.k, r.l) for r in df.collect()), key=str)
    assert key(orphans.orphan_keys(refs, parents, ["k", "l"])) == [(1, "b")]
    assert key(orphans.orphan_keys(refs, parents, ["k", "l"], "partial")) == [(1, "b"), (None, "c")]
    assert key(orphans.orphan_keys(refs, parents, ["k", "l"], "full")) == sorted([(1, "b"), (None, "a"), (None, "c"), (1, None)], key=str)
    assert orphans.orphan_keys(refs.limit(0), parents, ["k", "l"]).count() == 0
    assert key(orphans.orphan_keys(refs, parents.limit(0), ["k", "l"])) == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError):
        orphans.orphan_keys(refs, parents, ["k"], "some")
    rows = sorted(((r.k, r.l, r.extra) for r in orphans.orphan_references(refs.union(refs), parents, ["k", "l"], "partial").collect()), key=str)
    assert rows == [(1, "b", "x")] * 2 + [(None, "c", "x")] * 2
    many = spark.range(5000).select((F.col("id") % 7).alias("k"), F.lit("a").alias("l"), F.col("id").cast("string").alias("extra"))
    assert orphans.orphan_references(many, parents, ["k", "l"]).count() == sum(i % 7 not in (1, 2) for i in range(5000))


def test_reference_states_with_a_hot_key(spark):
    at = "timestamp'2025-02-03'"
    pages = spark.sql(f"SELECT * FROM VALUES (1L,'u1','fetched',{at}), (2L,'u2','deleted',{at}), (2L,'u2','fetched',null), (3L,'u3','fetched',timestamp'2025-01-01'), (3L,'u3','deleted',null) AS t(id, url, status, fetched_at)")
    late = spark.sql("SELECT 9L AS id, 'u9' AS url, 'queued' AS status")
    named = spark.sql("""SELECT 'links.to_page_id' AS ref_field, id AS holder_id, '2' AS missing_key, '2025-01' AS ref_month FROM range(1000)
      UNION ALL SELECT * FROM VALUES ('links.to_page_id', 5L, '1', '2025-01'), ('links.to_page_id', 5L, '3', '2025-01'), ('links.to_page_id', 5L, '9', '2025-02'), ('links.from_page_id', 5L, '77', '2025-02'), ('crawl_records.links', 8L, 'u9', null), ('crawl_records.links', 8L, 'u1', '2025-01'), ('crawl_records.links', 8L, 'nope', '2025-01'), ('links.to_page_id', 5L, null, '2025-02'), ('links.from_page_id', 5L, '77', '2025-02')""")
    by_url = F.col("ref_field") == "crawl_records.links"
    refs = named.select("ref_field", "holder_id", F.when(~by_url, F.col("missing_key")).cast("bigint").alias("page_id"), F.when(by_url, F.col("missing_key")).alias("page_url"), "ref_month")
    got = sorted((r.ref_field, r.missing_key, r.ref_state) for r in orphans.reference_states(refs, pages, late).where("missing_key <> '2'").collect())
    assert got == [("crawl_records.links", "nope", "missing"), ("crawl_records.links", "u9", "late"), ("links.from_page_id", "77", "missing"), ("links.to_page_id", "9", "late")]
    assert orphans.reference_states(refs, pages, late).where("missing_key = '2' and ref_state = 'deleted'").count() == 1000
    assert orphans.reference_states(refs.limit(0), pages, late).count() == 0


def test_io(spark, tmp_path):
    rows = records(spark, [record(1, "http://a/", "x", ["http://b/"]), record(2, "http://b/", outcome="fetch_failed", reason="fetch_error")])
    path = str(tmp_path / "r")
    io.append_records(rows, path)
    io.append_records(rows, path)
    assert io.read_records(spark, path).count() == 4
    line = rows.limit(1).transform(io.encode_records).first().record_json
    assert '"schema_version":2' in line and '"skip_reason":null' in line
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('\n{"requested_url": "u"\n')
    with pytest.raises(Exception):  # noqa: B017 - what Spark raises depends on the stage
        io.read_records(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "x.json").write_text('{"requested_url": "u"}\n')
    with pytest.raises(Exception):  # noqa: B017
        io.read_records(spark, str(tmp_path / "part")).collect()
    built = index.build_index(rows)
    io.write_index(built, str(tmp_path / "i"), 1)
    io.write_index(built, str(tmp_path / "i"), 2)
    assert io.active_version(spark, str(tmp_path / "i")) == 2
    assert index.health(io.read_index(spark, str(tmp_path / "i"))).first() == index.health(built).first()
    c = spark.createDataFrame([("h1", "a"), ("h1", "a")], "content_hash string, html string")
    io.write_contents(c, str(tmp_path / "c"))
    io.write_contents(c, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
