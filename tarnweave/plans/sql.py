"""SQL for the core queries: the same results from the same tables, for another engine."""

from __future__ import annotations

from tarnweave.functions.text import STOP_WORDS
from tarnweave.plans.page_sql import page_sql
from tarnweave.plans.registry import LEGACY_TERMS, QUERY, REPEATED

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = r"string_split_regex(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+')"
RAW = r"string_split_regex({}, '\s+')"


def _tokens(column: str) -> str:
    return f"list_filter({WORDS.format(f'coalesce({column}, $${''}$$)')}, lambda w: w <> '' AND w NOT IN ({_STOP}))".replace("$$$$", "''")


_DOCS = f"docs AS MATERIALIZED (SELECT doc_id AS id, {_tokens('text')} AS tokens FROM documents)"
_POSTINGS = "postings AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY id, term)"
_TERMS = "terms AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"
_STATS = "stats AS MATERIALIZED (SELECT count(*) AS n, coalesce(sum(len(tokens)) / count(*)::DOUBLE, 0) AS avgdl FROM docs)"
_INDEX = f"{_DOCS}, {_POSTINGS}, {_TERMS}, {_STATS}"

_BM25 = "ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * (dl / greatest(avgdl, 1e0))))"
_TFIDF = "tf / dl::DOUBLE * ln((n + 1e0) / (df + 1e0))"


def _scored(queries: str, rank: str = "1e0") -> str:
    """CTEs q(query_id, term, qtf) and scored(query_id, id, ...), over docs(id, tokens, ...)."""
    return f"""
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM ({queries})) GROUP BY query_id, term),
    parts AS (SELECT query_id, p.id, qtf * {_BM25} AS b, qtf * {_TFIDF} AS t
              FROM q JOIN terms USING (term) JOIN postings p USING (term) JOIN (SELECT id, len(tokens) AS dl FROM docs) USING (id) CROSS JOIN stats),
    sums AS (SELECT query_id, id, sum(b) AS b, sum(t) AS t FROM parts GROUP BY query_id, id),
    scored AS (SELECT query_id, s.id, round((b + t) * greatest({rank}, 0.1e0), 6) AS score, round(b, 6) AS bm25_score, round(t, 6) AS tfidf_score, round({rank}, 6) AS page_rank
               FROM sums s JOIN docs ON docs.id = s.id)"""


def _one(query: str) -> str:
    return f"SELECT 0 AS query_id, '{query}' AS query"


def _iterations(dangling: bool, steps: int = 20) -> str:
    """CTEs r0..r20 over nodes(node, dangling) and edges(src, dst, w)."""
    out = ["total AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT node, dangling, 1e0 AS r FROM nodes)"]
    for i in range(steps):
        spread = f"0.85e0 * (SELECT coalesce(sum(r), 0e0) FROM r{i} WHERE dangling) / (SELECT n FROM total)" if dangling else "0e0"
        out.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, dangling, 0.15e0 + {spread} + 0.85e0 * coalesce(f, 0e0) AS r FROM nodes LEFT JOIN (SELECT dst AS node, sum(r * w) AS f FROM edges JOIN r{i} ON node = src GROUP BY dst) USING (node))"
        )
    return ", ".join(out)


_RECORD_GRAPH = """
stored AS MATERIALIZED (SELECT seq, final_url AS src, coalesce(links, []::VARCHAR[]) AS links FROM crawl_records WHERE outcome = 'stored' AND final_url IS NOT NULL),
targets AS (SELECT DISTINCT src AS dst FROM stored),
kept AS MATERIALIZED (SELECT seq, src, dst FROM (SELECT seq, src, unnest(links) AS dst FROM stored) SEMI JOIN targets USING (dst)),
newest AS (SELECT src, max(seq) AS seq FROM stored GROUP BY src),
degree AS MATERIALIZED (SELECT n.src, count(k.dst) AS degree FROM newest n LEFT JOIN kept k ON k.src = n.src AND k.seq = n.seq GROUP BY n.src),
nodes AS MATERIALIZED (SELECT src AS node, degree = 0 AS dangling FROM degree),
edges AS MATERIALIZED (SELECT k.src, k.dst, count(*) / greatest(any_value(d.degree), 1)::DOUBLE AS w FROM kept k JOIN degree d ON d.src = k.src GROUP BY k.src, k.dst)"""

_TABLE_GRAPH = """
nodes AS MATERIALIZED (SELECT DISTINCT id AS node, false AS dangling FROM pages WHERE id IS NOT NULL),
pairs AS MATERIALIZED (SELECT DISTINCT from_page_id AS src, to_page_id AS dst FROM links WHERE from_page_id IS NOT NULL AND to_page_id IS NOT NULL),
edges AS MATERIALIZED (SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY src) AS w FROM pairs)"""

_CHOSEN = r"""chosen AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) - 1 AS id, final_url AS url, title, extracted_text AS text
  FROM crawl_records WHERE outcome = 'stored' AND final_url IS NOT NULL AND regexp_replace(coalesce(extracted_text, ''), '\s+', '', 'g') <> '')"""

_RANKED = f"""{_RECORD_GRAPH}, {_iterations(True)}, {_CHOSEN},
docs AS MATERIALIZED (SELECT id, url, title, {_tokens("text")} AS tokens, coalesce(r, 1e0) AS pr FROM chosen LEFT JOIN r20 ON node = url), {_POSTINGS}, {_TERMS}, {_STATS}"""

_LEGACY_TEXTS = """texts AS MATERIALIZED (SELECT page_id, text FROM (SELECT page_id, arg_min(extracted_text, stored_at) AS text FROM page_contents WHERE extracted_text IS NOT NULL AND page_id IS NOT NULL GROUP BY page_id) SEMI JOIN pages ON id = page_id)"""
_LEGACY_POSTINGS = f"lp AS MATERIALIZED (SELECT term, page_id, count(*) AS term_frequency FROM (SELECT page_id, unnest({RAW.format('text')}) AS term FROM texts) WHERE term <> '' GROUP BY term, page_id)"
_NEWEST_PAGES = """newest_pages AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at IS NOT NULL DESC, fetched_at DESC, status DESC) AS k FROM pages WHERE id IS NOT NULL) WHERE k = 1)"""
_LEGACY_WORDS = f"list_filter({RAW.format('text')}, lambda w: w <> '')"


def _legacy_found(k: int) -> str:
    words = ", ".join(f"'{w}'" for w in LEGACY_TERMS)
    return f"""WITH {_LEGACY_TEXTS}, {_LEGACY_POSTINGS}, {_NEWEST_PAGES}, {_TABLE_GRAPH}, {_iterations(False)},
    st AS (SELECT page_id, len({_LEGACY_WORDS}) AS wc FROM texts),
    df AS (SELECT term, count(*) AS df FROM lp GROUP BY term),
    found AS (SELECT g.id AS page_id, g.url, g.title, round(sum(term_frequency / wc::DOUBLE * ln(((SELECT count(*) FROM newest_pages) + 1e0) / (df + 1e0)) * coalesce(r, 1e0)), 6) AS score
      FROM lp JOIN df USING (term) JOIN newest_pages g ON g.id = lp.page_id JOIN st ON st.page_id = lp.page_id LEFT JOIN r20 ON node = lp.page_id
      WHERE term IN ({words}) AND wc > 0 GROUP BY g.id, g.url, g.title ORDER BY score DESC, page_id LIMIT {k})"""


_P5 = """WITH by_id AS (SELECT id, arg_max(status, (fetched_at IS NOT NULL, fetched_at, status)) AS status, any_value(url) AS url FROM pages WHERE id IS NOT NULL GROUP BY id),
refs AS (SELECT 'links.from_page_id' AS ref_field, to_page_id AS holder_id, from_page_id::VARCHAR AS missing_key, strftime(make_timestamp(epoch_us(discovered_at)), '%Y-%m') AS ref_month, 'id' AS space FROM links
  UNION SELECT 'links.to_page_id', from_page_id, to_page_id::VARCHAR, strftime(make_timestamp(epoch_us(discovered_at)), '%Y-%m'), 'id' FROM links
  UNION SELECT 'crawl_records.links', seq, u, strftime(make_timestamp(fetched_at_ms * 1000), '%Y-%m'), 'url' FROM (SELECT seq, fetched_at_ms, unnest(links) AS u FROM crawl_records)),
known AS (SELECT 'id' AS space, id::VARCHAR AS missing_key, coalesce(status = 'deleted', false) AS gone FROM by_id UNION ALL SELECT 'url', url, bool_and(coalesce(status = 'deleted', false)) FROM by_id WHERE url IS NOT NULL GROUP BY url),
late AS (SELECT 'id' AS space, id::VARCHAR AS missing_key FROM pages_late UNION SELECT 'url', url FROM pages_late),
found AS (SELECT DISTINCT ref_field, holder_id, missing_key, ref_month, CASE WHEN gone THEN 'deleted' WHEN l.missing_key IS NOT NULL THEN 'late' ELSE 'missing' END AS ref_state
  FROM refs LEFT JOIN known USING (space, missing_key) LEFT JOIN late l USING (space, missing_key) WHERE missing_key IS NOT NULL AND coalesce(gone, true))"""

#: Ranks of pages with several records grow without bound, so they are compared by significant digits.
_SIG = "printf('%.7e', {})::DOUBLE"
_BAD = "coalesce(skip_reason IN ('non_html', 'empty_text', 'likely_javascript_required', 'fetch_error'), false)"
_HOST = "lower(regexp_extract(requested_url, '^[a-z]+://([^/:?#]+)', 1))"
_KIND = "CASE WHEN event_type = 'error' THEN 'page_failed' WHEN value > 10 THEN 'page_fetched' ELSE 'page_queued' END"


def _base() -> dict[str, str]:
    found = f"WITH {_INDEX}, {_scored(_one(QUERY))}"
    return page_sql(_NEWEST_PAGES, _RANKED, _scored(_one(QUERY), "pr"), QUERY.split()) | {
        "tokenize_documents": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens, len({_tokens('text')})::BIGINT AS n_tokens FROM documents",
        "term_frequencies": f"WITH {_DOCS}, {_POSTINGS} SELECT id AS doc_id, term, tf FROM postings",
        "document_stats": f"WITH {_DOCS} SELECT id AS doc_id, len(tokens)::BIGINT AS token_count, len(list_distinct(tokens))::BIGINT AS unique_terms FROM docs",
        "document_frequency": f"WITH {_DOCS}, {_POSTINGS}, {_TERMS} SELECT term, df AS document_frequency FROM terms",
        "avg_doc_len": f"WITH {_DOCS}, {_STATS} SELECT n AS documents, round(avgdl, 6) AS average_doc_len FROM stats",
        "index_health": f"WITH {_INDEX} SELECT 'ok' AS status, n AS documents, (SELECT count(*) FROM terms) AS terms FROM stats",
        "index_roundtrip": f"WITH {_INDEX} SELECT 'ok' AS status, n AS documents, (SELECT count(*) FROM terms) AS terms FROM stats",
        "index_documents": f"WITH {_RANKED} SELECT id, url, title, len(tokens)::BIGINT AS token_count, {_SIG.format("pr")} AS page_rank FROM docs",
        "bm25_topk": f"{found} SELECT id AS doc_id, bm25_score FROM scored WHERE score > 0 ORDER BY bm25_score DESC, id LIMIT 20",
        "tfidf_topk": f"{found} SELECT id AS doc_id, tfidf_score FROM scored WHERE score > 0 AND tfidf_score > 0 ORDER BY tfidf_score DESC, id LIMIT 20",
        "search_traditional": f"WITH {_RANKED}, {_scored(_one(QUERY), 'pr')} SELECT s.id, url, title, {_SIG.format("score")} AS score, bm25_score, tfidf_score, {_SIG.format("page_rank")} AS page_rank FROM scored s JOIN docs ON docs.id = s.id WHERE s.score > 0 ORDER BY s.score DESC, s.id LIMIT 20",
        "search_repeated_terms": f"WITH {_INDEX}, {_scored(_one(REPEATED))} SELECT id AS doc_id, score, bm25_score, tfidf_score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 20",
        "search_many": f"WITH {_INDEX}, {_scored('SELECT item_id AS query_id, question AS query FROM eval_items')} SELECT query_id, rank, doc_id, score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id AS doc_id, score FROM scored WHERE score > 0) WHERE rank <= 5",
        "legacy_postings": f"WITH {_LEGACY_TEXTS}, {_LEGACY_POSTINGS} SELECT term, page_id, term_frequency FROM lp",
        "legacy_terms": f"WITH {_LEGACY_TEXTS}, {_LEGACY_POSTINGS} SELECT DISTINCT term FROM lp",
        "legacy_document_stats": f"WITH {_LEGACY_TEXTS} SELECT page_id, len({_LEGACY_WORDS})::BIGINT AS word_count, len(list_distinct({_LEGACY_WORDS}))::BIGINT AS unique_terms FROM texts",
        "content_hash": "SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents",
        "content_dedup": "SELECT sha256(html) AS content_hash, length(min(html))::BIGINT AS chars FROM page_contents WHERE html IS NOT NULL GROUP BY 1",
        "is_html": "SELECT seq, CASE WHEN content_type IS NOT NULL THEN lower(content_type) LIKE '%text/html%' ELSE starts_with(ltrim(coalesce(extracted_text, '')), '<!doctype html') OR coalesce(extracted_text, '') LIKE '%<html%' END AS is_html FROM crawl_records",
        "js_required": """SELECT page_id, epoch_us(stored_at) AS stored_at, short AND (len(regexp_extract_all(h, '<script')) >= 3 OR t LIKE '%enable javascript%' OR t LIKE '%requires javascript%' OR t LIKE '%please enable js%' OR h LIKE '%id="__next"%' OR h LIKE '%id="root"%') AS js_required, short AS empty_text
          FROM (SELECT page_id, stored_at, lower(coalesce(html, '')) AS h, lower(coalesce(extracted_text, '')) AS t, length(regexp_replace(coalesce(extracted_text, ''), '^\\s+|\\s+$', '', 'g')) < 80 AS short FROM page_contents)""",
        "outcome_summary": "SELECT outcome, skip_reason, count(*) AS records, count(*) FILTER (outcome = 'stored') AS stored FROM crawl_records GROUP BY ALL",
        "penalize": f"SELECT seq, {_BAD} AS penalised FROM crawl_records",
        "host_suppression": f"SELECT seq, host, coalesce(sum(bad::INT) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS suppressed FROM (SELECT seq, {_HOST} AS host, {_BAD} AS bad FROM crawl_records)",
        "url_dedup": "SELECT sha256(requested_url) AS url_hash, requested_url AS url, arg_min(source_seed, seq) AS source_seed, min(seq) AS seq FROM crawl_records GROUP BY requested_url",
        "record_upsert": """WITH r AS (SELECT sha256(requested_url) AS url_hash, seq, outcome, status::VARCHAR AS status, seq % 2 AS odd FROM crawl_records)
          SELECT url_hash, seq, outcome, status FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY odd DESC, seq DESC) AS k FROM r) WHERE k = 1""",
        "url_status": "SELECT sha256(requested_url) AS url_hash, coalesce(arg_max(outcome, seq) FILTER (outcome <> 'fetch_failed'), 'queued') AS status FROM crawl_records GROUP BY requested_url",
        "page_status_merge": f"""WITH e AS (SELECT event_id AS seq, {_KIND} AS kind, 'u' || user_id AS url, props, event_type FROM events),
          made AS (SELECT url, min(seq) AS first_seq FROM e WHERE kind = 'page_queued' GROUP BY url),
          own AS (SELECT e.* FROM e JOIN made USING (url) WHERE kind <> 'page_queued' AND seq > first_seq),
          agg AS (SELECT url, arg_max(kind, seq) AS kind, max(CASE WHEN kind = 'page_fetched' THEN 200 END) AS http_status, arg_max(props, seq) FILTER (kind = 'page_fetched') AS title, arg_max(event_type, seq) AS last_type FROM own GROUP BY url)
          SELECT url, CASE kind WHEN 'page_fetched' THEN 'fetched' WHEN 'page_failed' THEN 'failed' ELSE 'queued' END AS status, http_status, title, CASE WHEN kind = 'page_failed' THEN last_type END AS error FROM made LEFT JOIN agg USING (url)""",
        "page_ids": "SELECT row_number() OVER (ORDER BY seq) AS id, url FROM (SELECT requested_url AS url, min(seq) AS seq FROM crawl_records GROUP BY requested_url)",
        "link_insert_ignore": "SELECT from_page_id, to_page_id, epoch_us(discovered_at) AS discovered_at, anchor_text FROM (SELECT from_page_id, to_page_id, discovered_at, max(anchor_text) AS anchor_text, row_number() OVER (PARTITION BY from_page_id, to_page_id ORDER BY discovered_at) AS k FROM links GROUP BY from_page_id, to_page_id, discovered_at) WHERE k = 1",
        "content_upsert": "SELECT page_id, epoch_us(stored_at) AS stored_at, content_hash FROM (SELECT page_id, stored_at, max(content_hash) AS content_hash, row_number() OVER (PARTITION BY page_id ORDER BY stored_at DESC) AS k FROM page_contents GROUP BY page_id, stored_at) WHERE k = 1",
        "pagerank_current": f"WITH {_RECORD_GRAPH}, {_iterations(True)} SELECT node AS url, {_SIG.format("r")} AS page_rank FROM r20",
        "pagerank_by_joins": f"WITH {_RECORD_GRAPH}, {_iterations(True)} SELECT node AS url, {_SIG.format("r")} AS page_rank FROM r20",
        "pagerank_legacy": f"WITH {_TABLE_GRAPH}, {_iterations(False)} SELECT node AS page_id, round(r, 6) AS page_rank FROM r20",
        "legacy_search": f"{_legacy_found(20)} SELECT page_id, url, title, score FROM found",
        "legacy_result_lines": f"{_legacy_found(10)} SELECT rank, rank || '. ' || coalesce(title, 'Untitled') || chr(10) || '   URL: ' || url || chr(10) || '   Score: ' || printf('%.6f', score) || chr(10) AS line FROM (SELECT *, row_number() OVER (ORDER BY score DESC, page_id) AS rank FROM found)",
        "crawl_counts": "SELECT count(*) AS written, count(*) FILTER (outcome = 'stored') AS stored, max(depth) AS deepest FROM crawl_records",
        "expire_records": "SELECT seq FROM crawl_records WHERE fetched_at_ms >= (SELECT max(fetched_at_ms) FROM crawl_records) - 7 * 86400000",
        "records_roundtrip": "SELECT requested_url, final_url, depth, outcome, skip_reason, coalesce(schema_version, 2)::INTEGER AS schema_version, fetched_at_ms, len(links)::BIGINT AS n_links, md5(extracted_text) AS text_md5 FROM crawl_records",
        "record_table_decode": "SELECT requested_url, outcome, len(links)::BIGINT AS n_links FROM crawl_records",
        "page_links": f"""WITH {_NEWEST_PAGES}, c AS (SELECT page_id, arg_max(html, stored_at) AS html FROM page_contents WHERE html IS NOT NULL GROUP BY page_id)
          SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]+') || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a href="(/[^"]*)"', 1)) AS href FROM c JOIN newest_pages ON id = page_id)""",
        "search_stored_index": f"""WITH one AS (SELECT id, arg_max(term_freqs, (term_freqs IS NOT NULL, coalesce(token_count, 0))) AS freqs, arg_max(coalesce(token_count, 0), (term_freqs IS NOT NULL, coalesce(token_count, 0))) AS dl, arg_max(coalesce(page_rank, 1e0), (term_freqs IS NOT NULL, coalesce(token_count, 0))) AS pr FROM indexed_documents WHERE id IS NOT NULL GROUP BY id),
          postings AS (SELECT id, e.key AS term, e.value AS tf FROM (SELECT id, unnest(map_entries(freqs)) AS e FROM one) WHERE e.value > 0),
          terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM one),
          q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_tokens("'" + QUERY + "'")}) AS term) GROUP BY term),
          parts AS (SELECT p.id, pr, CASE WHEN dl > 0 THEN qtf * {_BM25} ELSE 0 END AS b, CASE WHEN dl > 0 THEN qtf * {_TFIDF.replace('tf / dl::DOUBLE', 'tf / nullif(dl, 0)::DOUBLE')} ELSE 0 END AS t FROM q JOIN terms USING (term) JOIN postings p USING (term) JOIN one USING (id) CROSS JOIN stats),
          sums AS (SELECT id, any_value(pr) AS pr, sum(b) AS b, sum(t) AS t FROM parts GROUP BY id)
          SELECT id, round((b + t) * greatest(pr, 0.1e0), 6) AS score, round(b, 6) AS bm25_score, round(t, 6) AS tfidf_score, round(pr, 6) AS page_rank FROM sums WHERE round((b + t) * greatest(pr, 0.1e0), 6) > 0 ORDER BY score DESC, id LIMIT 20""",
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_suppression": "SELECT user_id, event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS suppressed FROM events",
        "stream_dead_letters": "SELECT 'broken ' || event_id AS value FROM events WHERE event_type = 'error'",
        "stream_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id",
        "url_dedup_seen": "SELECT sha256(requested_url) AS url_hash, requested_url AS url, arg_min(source_seed, seq) AS source_seed, min(seq) AS seq FROM crawl_records WHERE seq % 2 = 1 AND requested_url NOT IN (SELECT requested_url FROM crawl_records WHERE seq % 2 = 0) GROUP BY requested_url",
        "page_ids_known": "SELECT row_number() OVER (ORDER BY late, seq) AS id, url FROM (SELECT requested_url AS url, bool_and(seq % 2 = 1) AS late, coalesce(min(seq) FILTER (seq % 2 = 0), min(seq)) AS seq FROM crawl_records GROUP BY requested_url)",
        "page_insert_ignore": "SELECT id, min(url) AS url FROM pages GROUP BY id UNION ALL SELECT id, min(url) FROM pages_late WHERE id NOT IN (SELECT id FROM pages) GROUP BY id",
        "legacy_outcomes": "SELECT seq, CASE WHEN NOT coalesce(status BETWEEN 200 AND 299, false) THEN 'failed' WHEN coalesce(content_type, '') LIKE '%text/html%' THEN 'fetched' END AS outcome FROM crawl_records",
        "normalize_urls": "SELECT seq, CASE WHEN regexp_matches(requested_url, '^https?://[^/]+$') THEN requested_url || '/' ELSE requested_url END AS url FROM crawl_records",
        "fetch_fallback": f"""WITH {_NEWEST_PAGES}, c AS (SELECT page_id, arg_max(html, stored_at) AS html FROM page_contents WHERE html IS NOT NULL GROUP BY page_id)
          SELECT n.id AS page_id, CASE WHEN n.id % 2 = 0 THEN md5(html) WHEN n.id % 3 <> 0 THEN md5(html || '<!-- second -->') END AS html_md5, CASE WHEN html IS NOT NULL AND (n.id % 2 = 0 OR n.id % 3 <> 0) THEN url END AS final_url FROM newest_pages n LEFT JOIN c ON page_id = n.id""",
        "index_json": f"WITH {_DOCS} SELECT id AS doc_id, len(tokens)::BIGINT AS token_count, len(list_distinct(tokens))::BIGINT AS n_terms, len(tokens)::BIGINT AS occurrences FROM docs",
        "search_read_index": f"WITH {_RANKED}, {_scored(_one(QUERY), 'pr')} SELECT s.id, url, title, {_SIG.format("score")} AS score, bm25_score, tfidf_score, {_SIG.format("page_rank")} AS page_rank FROM scored s JOIN docs ON docs.id = s.id WHERE s.score > 0 ORDER BY s.score DESC, s.id LIMIT 20",
        "event_pages": f"""{_EVENTS} SELECT id, url, CASE last WHEN 1 THEN 'fetched' WHEN 2 THEN 'failed' ELSE 'queued' END AS status, http_status, title, CASE WHEN last = 2 THEN error END AS error
          FROM ids LEFT JOIN (SELECT url, arg_max(kind, seq) AS last, max(CASE WHEN kind = 1 THEN 200 END) AS http_status, arg_max(props, seq) FILTER (kind = 1) AS title, arg_max(event_type, seq) AS error FROM own GROUP BY url) USING (url)""",
        "event_links": f"{_EVENTS} SELECT a.id AS from_page_id, b.id AS to_page_id, anchor_text FROM (SELECT url, to_url, arg_min(event_type, seq) AS anchor_text FROM e WHERE kind = 3 GROUP BY url, to_url) l JOIN ids a ON a.url = l.url JOIN ids b ON b.url = l.to_url",
        "event_contents": f"{_EVENTS} SELECT id AS page_id, html, extracted_text, md5(html) AS content_hash FROM (SELECT url, arg_max(props, seq) AS html, arg_max(event_type, seq) AS extracted_text FROM e WHERE kind = 4 GROUP BY url) JOIN ids USING (url)",
        "event_assets": f"{_EVENTS} SELECT id AS page_id, asset_url, 'image' AS asset_type, alt_text FROM (SELECT url, asset_url, arg_max(event_type, seq) AS alt_text FROM e WHERE kind = 5 GROUP BY url, asset_url) JOIN ids USING (url)",
        "p5_found": f"{_P5} SELECT * FROM found",
        "p5_composite": """WITH refs AS (SELECT seq, final_url AS url, content_hash FROM crawl_records),
parents AS MATERIALIZED (SELECT DISTINCT p.url, c.content_hash FROM (SELECT DISTINCT id, url FROM pages) p JOIN page_contents c ON c.page_id = p.id),
checked AS (SELECT *, url IS NOT NULL AND content_hash IS NOT NULL AS whole, url IS NOT NULL OR content_hash IS NOT NULL AS given,
 EXISTS (FROM parents p WHERE (p.url = r.url OR r.url IS NULL) AND (p.content_hash = r.content_hash OR r.content_hash IS NULL)) AS matched FROM refs r)
SELECT 'simple' AS declared_match, seq, url, content_hash FROM checked WHERE whole AND NOT matched
UNION ALL SELECT 'partial', seq, url, content_hash FROM checked WHERE given AND NOT matched
UNION ALL SELECT 'full', seq, url, content_hash FROM checked WHERE given AND NOT (whole AND matched)""",
        "p5_report": f"{_P5} SELECT ref_field, ref_month, ref_state, count(*) AS orphan_refs, count(DISTINCT missing_key) AS orphan_keys FROM found GROUP BY ALL",
    }


_EVENTS = """WITH e AS MATERIALIZED (SELECT event_id AS seq, event_id % 6 AS kind, 'u' || user_id AS url, 'u' || ((user_id * 7 + event_id) % 400) AS to_url, 'a' || (event_id % 20) AS asset_url, event_type, props FROM events),
made AS MATERIALIZED (SELECT url, min(place) AS first FROM (SELECT url, seq * 2 AS place FROM e WHERE kind NOT IN (1, 2) UNION ALL SELECT to_url, seq * 2 + 1 FROM e WHERE kind = 3) GROUP BY url),
ids AS MATERIALIZED (SELECT url, first, row_number() OVER (ORDER BY first) AS id FROM made),
own AS (SELECT e.* FROM e JOIN made USING (url) WHERE kind IN (1, 2) AND seq * 2 > first)"""


def oracle_sql() -> dict[str, str]:
    return _base()
