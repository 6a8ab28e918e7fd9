"""Core queries by name. Each reads whole tables of a directory and returns a DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import html as H
from tarnweave.functions import text as X
from tarnweave.functions.url import host, normalize_url
from tarnweave.operators import classify as C
from tarnweave.operators import crawl as CR
from tarnweave.operators import graph as G
from tarnweave.operators import index as I
from tarnweave.operators import search as S
from tarnweave.operators import tables as TB
from tarnweave.operators.ordering import first_per_key, last_per_key
from tarnweave.operators.orphans import MATCHES, newest_rows, orphan_references, orphan_report, page_references, reference_states
from tarnweave.session import checkpoint_dir, table
from tarnweave.sources import io
from tarnweave.streaming import queue as Q

#: Queries of the search examples, and one of the legacy profile.
QUERY, REPEATED, LEGACY_QUERY = "evening harbour library", "library library harbour", "what do we know about the harbour and its silent library"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_records")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _doc_index(spark: SparkSession, sf: str) -> I.SearchIndex:
    return I.index_texts(_docs(spark, sf), id_col="doc_id", text_col="text")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokenize_documents(spark, sf):
    tokens = X.tokenize(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"))


def term_frequencies(spark, sf):
    return _doc_index(spark, sf).postings.select(F.col("id").alias("doc_id"), "term", "tf")


def document_stats(spark, sf):
    tokens = X.tokenize(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(tokens).cast("long").alias("token_count"), F.size(F.array_distinct(tokens)).cast("long").alias("unique_terms"))


def document_frequency(spark, sf):
    return _doc_index(spark, sf).terms


def avg_doc_len(spark, sf):
    return _doc_index(spark, sf).stats.select("documents", F.round("average_doc_len", 6).alias("average_doc_len"))


def index_health(spark, sf):
    return I.health(_doc_index(spark, sf))


def _significant(c: str):
    """Ranks of pages with several records grow without bound, so they are compared by significant digits."""
    return F.format_string("%.7e", c).cast("double").alias(c)


def index_documents(spark, sf):
    records = _records(spark, sf)
    docs = I.build_index(records, G.page_rank_current(records)).documents
    return docs.select("id", "url", "title", "token_count", _significant("page_rank"))


def bm25_topk(spark, sf):
    index = _doc_index(spark, sf)
    scored = S._scores(index, spark.range(1).select(F.lit(0).alias("query_id"), F.lit(QUERY).alias("query")), True)
    return scored.orderBy(F.desc("bm25_score"), "id").limit(20).select(F.col("id").alias("doc_id"), "bm25_score")


def tfidf_topk(spark, sf):
    index = _doc_index(spark, sf)
    scored = S._scores(index, spark.range(1).select(F.lit(0).alias("query_id"), F.lit(QUERY).alias("query")), True)
    return scored.where("tfidf_score > 0").orderBy(F.desc("tfidf_score"), "id").limit(20).select(F.col("id").alias("doc_id"), "tfidf_score")


def _ranked(spark, sf):
    records = _records(spark, sf)
    return I.build_index(records, G.page_rank_current(records)).persist()  # a search reads it several times


def search_traditional(spark, sf):
    return S.search(spark, _ranked(spark, sf), QUERY, 20, snippets=False).select("id", "url", "title", _significant("score"), "bm25_score", "tfidf_score", _significant("page_rank"))


def search_repeated_terms(spark, sf):
    found = S.search(spark, _doc_index(spark, sf), REPEATED, 20, snippets=False)
    return found.select(F.col("id").alias("doc_id"), "score", "bm25_score", "tfidf_score")


def search_many(spark, sf):
    queries = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return S.search_many(_doc_index(spark, sf), queries, 5).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score")


def search_snippets(spark, sf):
    return S.search(spark, _ranked(spark, sf), QUERY, 20).select("id", "snippet")


def search_stored_index(spark, sf):
    index = I.stored_index(table(spark, sf, "indexed_documents"))
    return S.search(spark, index, QUERY, 20, snippets=False).select("id", "score", "bm25_score", "tfidf_score", "page_rank")


def _legacy_texts(spark, sf):
    return I.legacy_pages_to_index(table(spark, sf, "pages"), table(spark, sf, "page_contents"))


def legacy_postings(spark, sf):
    return I.legacy_postings(_legacy_texts(spark, sf))


def legacy_terms(spark, sf):
    return I.legacy_terms(I.legacy_postings(_legacy_texts(spark, sf))).select("term")


def legacy_document_stats(spark, sf):
    return I.legacy_document_stats(_legacy_texts(spark, sf))


def _pages(spark, sf):
    return newest_rows(table(spark, sf, "pages"), "id", "fetched_at", ["status", "url", "title", "content_type", "http_status"])


def _legacy_found(spark, sf, k=20):
    texts = _legacy_texts(spark, sf)
    postings = I.legacy_postings(texts)
    terms = I.legacy_terms(postings)
    pages = _pages(spark, sf)
    ranks = G.page_rank_legacy(pages, table(spark, sf, "links")).select("page_id", F.col("page_rank").alias("rank"))
    coded = postings.select(F.xxhash64("term").alias("term_id"), "page_id", "term_frequency")
    tables = {"pages": pages, "terms": terms, "postings": coded, "document_stats": I.legacy_document_stats(texts), "page_rank": ranks}
    return S.legacy_search(spark, tables, LEGACY_QUERY, k)


#: What the English stop words leave of the legacy example query, for its SQL.
LEGACY_TERMS = ["know", "harbour", "silent", "library"]


def legacy_search(spark, sf):
    return _legacy_found(spark, sf)


def legacy_result_lines(spark, sf):
    return S.result_lines(_legacy_found(spark, sf, 10)).select(F.col("rank").cast("long").alias("rank"), "line")


def content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("sha"), F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


def content_dedup(spark, sf):
    pages = table(spark, sf, "page_contents").where("html is not null").select(X.content_hash(F.col("html")).alias("content_hash"), "html")
    return TB.content_store(pages, stored_only=False).select("content_hash", F.char_length("html").cast("long").alias("chars"))


def _snapshots(spark, sf):
    pages = _pages(spark, sf).select(F.col("id").alias("page_id"), "url", "content_type", F.col("http_status").alias("status"))
    contents = last_per_key(table(spark, sf, "page_contents").where("html is not null").select("page_id", "stored_at", "html"), ["page_id"], "stored_at")
    return contents.join(pages, "page_id")


def page_title(spark, sf):
    return table(spark, sf, "page_contents").where("html is not null").select("page_id", F.unix_micros("stored_at").alias("stored_at"), H.title("html").alias("title"))


def page_text(spark, sf):
    return table(spark, sf, "page_contents").select("page_id", F.unix_micros("stored_at").alias("stored_at"), H.body_text("html").alias("text"))


def page_text_legacy(spark, sf):
    return table(spark, sf, "page_contents").select("page_id", F.unix_micros("stored_at").alias("stored_at"), H.document_text("html").alias("text"))


def page_links(spark, sf):
    return _snapshots(spark, sf).select("page_id", F.explode(H.page_links("html", "url")).alias("link"))


def page_anchors(spark, sf):
    return _snapshots(spark, sf).select("page_id", F.explode(H.page_anchors("html", "url")).alias("a")).select("page_id", "a.url", "a.anchor_text")


def page_assets(spark, sf):
    # The stored pages have no assets, so that some are put into each.
    script = F.concat(F.lit('<script src="/s/'), F.col("page_id").cast("string"), F.lit('.js"></script>'))
    images = F.concat(F.lit('<IMG alt=" Seen from the road " src="/i/'), F.col("page_id").cast("string"), F.lit(".png\"><img src=/i/plain.png /><img alt='no source'>"))
    shown = F.concat("html", script, images, F.lit('<link rel="icon" href="/x.ico"><link href="/c/site.css" rel="stylesheet"><script>"<img src=/no.png>"</script>'))
    return _snapshots(spark, sf).withColumn("html", shown).select("page_id", F.explode(H.page_assets("html", "url")).alias("a")).select("page_id", "a.asset_url", "a.asset_type", "a.alt_text")


def is_html(spark, sf):
    return _records(spark, sf).select("seq", C.is_html(F.col("content_type"), F.coalesce("extracted_text", F.lit(""))).alias("is_html"))


def js_required(spark, sf):
    c = table(spark, sf, "page_contents")
    return c.select("page_id", F.unix_micros("stored_at").alias("stored_at"), C.javascript_required(F.col("html"), F.col("extracted_text")).alias("js_required"), C.empty_text(F.col("extracted_text")).alias("empty_text"))


def _classified(spark, sf):
    s = _snapshots(spark, sf).select("page_id", F.col("url").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.col("url").alias("source_seed"), F.lit(None).cast("string").alias("referrer"), F.lit(0).alias("depth"), "status", "content_type", "html")
    return C.classify(s, F.lit(0))


def classify_pages(spark, sf):
    return _classified(spark, sf).select("page_id", "outcome", "skip_reason", "content_length", "content_hash", F.size("links").cast("long").alias("links"))


def outcome_summary(spark, sf):
    return C.outcome_summary(_records(spark, sf))


def penalize(spark, sf):
    return _records(spark, sf).select("seq", C.should_penalize(F.col("skip_reason")).alias("penalised"))


def host_suppression(spark, sf):
    items = _records(spark, sf).select("seq", "skip_reason", host(F.col("requested_url")).alias("host"))
    return CR.host_suppression(items, key="host", order="seq", reason="skip_reason").select("seq", "host", "suppressed")


def _replay(spark, sf, **kw):
    r = last_per_key(_records(spark, sf).where("final_url is not null").select("requested_url", "seq", "final_url", "status", "content_type", "extracted_text", "links"), ["requested_url"], "seq")
    anchors = F.array_join(F.transform("links", lambda u: F.concat(F.lit('<a href="'), u, F.lit('">.</a>'))), "")
    snapshots = r.select(F.col("requested_url").alias("url"), "final_url", "status", "content_type", F.concat(F.lit("<html><body>"), "extracted_text", anchors, F.lit("</body></html>")).alias("html"))
    seeds = _records(spark, sf).groupBy(F.col("source_seed").alias("url")).agg(F.min("seq").alias("seq")).select("url", F.col("url").alias("source_seed"), F.lit(None).cast("string").alias("referrer"), F.lit(0).cast("long").alias("depth"), "seq")
    return CR.crawl(seeds, CR.snapshot_source(snapshots), now_ms=0, **kw)


def frontier_bfs(spark, sf):
    return _replay(spark, sf, max_pages=10**9, suppress=False).select("seq", "requested_url", "depth", "outcome")


def frontier_budget(spark, sf):
    return _replay(spark, sf, max_pages=100).select("seq", "requested_url", "depth", "outcome", "skip_reason")


def url_dedup(spark, sf):
    items = _records(spark, sf).select(F.col("requested_url").alias("url"), "source_seed", "seq")
    return TB.enqueue_new(None, items, "seq").select("url_hash", "url", "source_seed", "seq")


def record_upsert(spark, sf):
    r = _records(spark, sf).select(TB.url_hash(F.col("requested_url")).alias("url_hash"), "seq", "outcome", F.col("status").cast("string").alias("status"))
    old, new = r.where("seq % 2 = 0"), r.where("seq % 2 = 1")
    return TB.upsert(last_per_key(old, ["url_hash"], "seq"), new, ["url_hash"], "seq")


def url_dedup_seen(spark, sf):
    """Queue items of odd seqs that those of even ones haven't seen."""
    items = _records(spark, sf).select(F.col("requested_url").alias("url"), "source_seed", "seq")
    seen = TB.enqueue_new(None, items.where("seq % 2 = 0"), "seq")
    return TB.enqueue_new(seen, items.where("seq % 2 = 1"), "seq").select("url_hash", "url", "source_seed", "seq")


def page_ids_known(spark, sf):
    """Ids go on from those of the even seqs."""
    urls = _records(spark, sf).select(F.col("requested_url").alias("url"), "seq")
    return TB.page_ids(TB.page_ids(None, urls.where("seq % 2 = 0"), "seq"), urls.where("seq % 2 = 1"), "seq")


def page_insert_ignore(spark, sf):
    """Late pages are added unless their id is known."""
    old, late = table(spark, sf, "pages"), table(spark, sf, "pages_late")
    known = first_per_key(old.select("id", "url"), ["id"], "url")
    return TB.insert_ignore(known, late.select("id", "url"), ["id"], "url")


def legacy_outcomes(spark, sf):
    return _records(spark, sf).select("seq", C.legacy_outcome(F.col("status"), F.col("content_type")).alias("outcome"))


def normalize_urls(spark, sf):
    """Requested URLs written carelessly, in their normal form again."""
    parts = F.regexp_extract("requested_url", "^(https?)://([^/?#]+)(.*)$", 1), F.regexp_extract("requested_url", "^(https?)://([^/?#]+)(.*)$", 2), F.regexp_extract("requested_url", "^(https?)://([^/?#]+)(.*)$", 3)
    port = F.when(parts[0] == "https", ":443").otherwise(":80")
    careless = F.concat(F.lit(" "), F.upper(parts[0]), F.lit("://"), F.upper(parts[1]), port, F.lit("/./x/.."), F.when(parts[2] == "", "/").otherwise(parts[2]), F.lit("\n"))
    return _records(spark, sf).select("seq", normalize_url(careless).alias("url"))


def fetch_fallback(spark, sf):
    """Odd pages come from the second snapshot table, what neither has isn't fetched."""
    snaps = _snapshots(spark, sf).select("page_id", "url", F.lit(None).cast("string").alias("final_url"), "status", "content_type", "html")
    source = CR.snapshot_source(snaps.where("page_id % 2 = 0"), snaps.where("page_id % 3 <> 0").withColumn("html", F.concat("html", F.lit("<!-- second -->"))))
    return source(_pages(spark, sf).select("url", F.col("id").alias("page_id"))).select("page_id", F.md5("html").alias("html_md5"), "final_url")


def index_json(spark, sf):
    path = _scratch(spark, "json")
    io.export_index_json(_doc_index(spark, sf), path)
    back = spark.read.schema("id long, token_count long, term_freqs map<string, long>").json(path)
    return back.select(F.col("id").alias("doc_id"), "token_count", F.coalesce(F.size("term_freqs"), F.lit(0)).cast("long").alias("n_terms"), F.coalesce(F.aggregate(F.map_values("term_freqs"), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).alias("occurrences"))


def search_read_index(spark, sf):
    """As search_traditional, over an index that was written and read."""
    root = _scratch(spark, "index")
    records = _records(spark, sf)
    io.write_index(I.build_index(records, G.page_rank_current(records)), root, 1)
    return S.search(spark, io.read_index(spark, root), QUERY, 20, snippets=False).select("id", "url", "title", _significant("score"), "bm25_score", "tfidf_score", _significant("page_rank"))


def _crawl_events(spark, sf):
    """Crawl events of all six kinds, made of the event table."""
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("page_queued", "page_fetched", "page_failed", "link_found", "page_content_found", "asset_found")]), (F.col("event_id") % 6 + 1).cast("int"))
    name = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), name("u", F.col("user_id")).alias("url"), name("u", (F.col("user_id") * 7 + F.col("event_id")) % 400).alias("to_url"), F.col("event_type").alias("anchor_text"),
        F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.col("props").alias("title"), F.col("event_type").alias("error"), F.col("props").alias("html"), F.col("event_type").alias("extracted_text"), F.md5("props").alias("content_hash"),
        name("a", F.col("event_id") % 20).alias("asset_url"), F.lit("image").alias("asset_type"), F.col("event_type").alias("alt_text"),
    )


def event_pages(spark, sf):
    return TB.apply_events(_crawl_events(spark, sf))["pages"].select("id", "url", "status", "http_status", "title", "error")


def event_links(spark, sf):
    return TB.apply_events(_crawl_events(spark, sf))["links"]


def event_contents(spark, sf):
    return TB.apply_events(_crawl_events(spark, sf))["page_contents"]


def event_assets(spark, sf):
    return TB.apply_events(_crawl_events(spark, sf))["page_assets"]


def url_status(spark, sf):
    urls = _records(spark, sf).select(TB.url_hash(F.col("requested_url")).alias("url_hash")).distinct().withColumn("status", F.lit("queued"))
    return TB.status_update(urls, _records(spark, sf).where("outcome <> 'fetch_failed'").select("requested_url", "outcome", "seq"), "seq")


def page_status_merge(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "page_failed").when(F.col("value") > 10, "page_fetched").otherwise("page_queued")
    rows = e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("to_url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.col("props").alias("title"), F.col("event_type").alias("error"))
    return TB.apply_page_events(rows).select("url", "status", "http_status", "title", "error")


def page_ids(spark, sf):
    return TB.page_ids(None, _records(spark, sf).select(F.col("requested_url").alias("url"), "seq"), "seq")


def link_insert_ignore(spark, sf):
    links = table(spark, sf, "links").groupBy("from_page_id", "to_page_id", "discovered_at").agg(F.max("anchor_text").alias("anchor_text"))
    return first_per_key(links, ["from_page_id", "to_page_id"], "discovered_at").withColumn("discovered_at", F.unix_micros("discovered_at"))


def content_upsert(spark, sf):
    c = table(spark, sf, "page_contents").groupBy("page_id", "stored_at").agg(F.max("content_hash").alias("content_hash"))
    return TB.upsert(None, c, ["page_id"], "stored_at").withColumn("stored_at", F.unix_micros("stored_at"))


def pagerank_current(spark, sf):
    return G.page_rank_current(_records(spark, sf)).select("url", _significant("page_rank"))


def pagerank_legacy(spark, sf):
    return G.page_rank_legacy(table(spark, sf, "pages"), table(spark, sf, "links")).select("page_id", F.round("page_rank", 6).alias("page_rank"))


def pagerank_by_joins(spark, sf):
    """As pagerank_current, on the way that graphs of any size take."""
    return G.page_rank_current(_records(spark, sf), one_task_rows=0).select("url", _significant("page_rank"))


def crawl_counts(spark, sf):
    return CR.crawl_counts(_records(spark, sf))


def expire_records(spark, sf):
    r = _records(spark, sf)
    newest = r.agg(F.max("fetched_at_ms").alias("now"))
    return TB.expire(r.crossJoin(F.broadcast(newest)), "fetched_at_ms", 7, F.col("now")).select("seq")


def records_roundtrip(spark, sf):
    path = _scratch(spark, "records")
    io.append_records(_records(spark, sf), path)
    back = io.read_records(spark, path)
    return back.select("requested_url", "final_url", "depth", "outcome", "skip_reason", F.col("schema_version").cast("int").alias("schema_version"), "fetched_at_ms", F.size("links").cast("long").alias("n_links"), F.md5("extracted_text").alias("text_md5"))


def record_table_decode(spark, sf):
    return io.decode_records(io.encode_records(_records(spark, sf))).select("requested_url", "outcome", F.size("links").cast("long").alias("n_links"))


def index_roundtrip(spark, sf):
    root = _scratch(spark, "index")
    io.write_index(_doc_index(spark, sf), root, 1)
    return I.health(io.read_index(spark, root))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/event[s].parquet")


def stream_dedup(spark, sf):
    out = _scratch(spark, "dedup")
    stream = Q.deduplicated(_event_stream(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type")
    Q.run_to_end(stream, f"{out}/data", f"{out}/log")
    return spark.read.parquet(f"{out}/data")


def stream_suppression(spark, sf):
    out = _scratch(spark, "suppression")
    stream = _event_stream(spark, sf).select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    Q.run_to_end(Q.suppression(stream, key="user_id", order="event_id", bad="bad"), f"{out}/data", f"{out}/log")
    return spark.read.parquet(f"{out}/data").select("user_id", "event_id", "suppressed")


def stream_dead_letters(spark, sf):
    out = _scratch(spark, "letters")
    e = table(spark, sf, "events")
    good = F.to_json(F.struct(F.concat(F.lit("http://h.test/"), F.col("user_id").cast("string")).alias("url"), F.lit("s").alias("source_seed"), F.lit(0).alias("depth")))
    e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(good).alias("value")).write.text(f"{out}/in")
    Q.run_to_end(Q.dead_letters(Q.read_messages(spark, f"{out}/in")), f"{out}/data", f"{out}/log")
    return spark.read.schema("value string").parquet(f"{out}/data")


def stream_upsert(spark, sf):
    out = _scratch(spark, "upsert")
    sink = Q.UpsertSink(f"{out}/data", ["user_id"], "event_id")
    Q.consume(_event_stream(spark, sf).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value")), sink, f"{out}/log")
    return sink.latest(spark)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    refs = page_references(table(spark, sf, "links"), table(spark, sf, "crawl_records"))
    return reference_states(refs, table(spark, sf, "pages"), table(spark, sf, "pages_late"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf))


def p5_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose (final_url, content_hash) no page with that content has, under each declared match."""
    refs = _records(spark, sf).select("seq", F.col("final_url").alias("url"), "content_hash")
    contents = table(spark, sf, "page_contents").select(F.col("page_id").alias("id"), "content_hash")
    parents = table(spark, sf, "pages").select("id", "url").distinct().join(contents, "id").select("url", "content_hash").distinct()
    each = [orphan_references(refs, parents, ["url", "content_hash"], m).select(F.lit(m).alias("declared_match"), "seq", "url", "content_hash") for m in MATCHES]
    return functools.reduce(DataFrame.unionByName, each)


NAMES = """
tokenize_documents term_frequencies document_stats document_frequency avg_doc_len index_health index_documents bm25_topk tfidf_topk
search_traditional search_repeated_terms search_many search_snippets search_stored_index legacy_postings legacy_terms legacy_document_stats
legacy_search legacy_result_lines content_hash content_dedup page_title page_text page_text_legacy page_links page_anchors page_assets is_html
js_required classify_pages outcome_summary penalize host_suppression frontier_bfs frontier_budget url_dedup record_upsert url_status
page_status_merge page_ids link_insert_ignore content_upsert pagerank_current pagerank_legacy url_dedup_seen page_ids_known page_insert_ignore legacy_outcomes normalize_urls fetch_fallback index_json search_read_index pagerank_by_joins
event_pages event_links event_contents event_assets crawl_counts expire_records records_roundtrip
record_table_decode index_roundtrip stream_dedup stream_suppression stream_dead_letters stream_upsert p5_found p5_report p5_composite
""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
