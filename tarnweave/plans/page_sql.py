"""SQL for the queries that read markup and replay a crawl.

Patterns stand in for the parser. They are written for well-formed tags and the character
entities below, which is what the stored pages have.
"""

from __future__ import annotations

#: Character entities of the stored pages (fixed values).
_ENTITIES = {"&eacute;": "é", "&uuml;": "ü", "&#39;": "''"}


def _plain(column: str) -> str:
    for entity, sign in _ENTITIES.items():
        column = f"replace({column}, '{entity}', '{sign}')"
    return column


def _squash(column: str) -> str:
    return rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"


def _text(html: str) -> str:
    """Tags and comments are white space; what scripts and styles hold is text."""
    kept = rf"regexp_replace(regexp_replace({html}, '(?is)<!--.*?-->', ' ', 'g'), '(?is)</?[a-z][^<>]*>|<![a-z][^>]*>', ' ', 'g')"
    return _squash(_plain(kept))


_BODY = r"regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)"
_FIRST_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_AT = "epoch_us(stored_at) AS stored_at"
_SITE = "regexp_extract(url, '^https?://[^/?#]+')"


def _snapshots(newest_pages: str) -> str:
    return f"""{newest_pages}, snaps AS MATERIALIZED (SELECT page_id, html, url, content_type FROM (SELECT page_id, arg_max(html, stored_at) AS html FROM page_contents WHERE html IS NOT NULL GROUP BY page_id) JOIN newest_pages ON id = page_id),
hrefs AS MATERIALIZED (SELECT page_id, {_SITE} || h AS url, a, k FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a href="(/[^"]*)"[^>]*>(.*?)</a>', 1)) AS h, unnest(regexp_extract_all(html, '(?is)<a href="(/[^"]*)"[^>]*>(.*?)</a>', 2)) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a href="(/[^"]*)"[^>]*>(.*?)</a>'), 1) AS k FROM snaps))"""


#: What a skipped page is skipped for, from columns content_type, html and text.
_REASON = r"""CASE WHEN NOT (CASE WHEN content_type IS NOT NULL THEN lower(content_type) LIKE '%text/html%' ELSE starts_with(ltrim(html), '<!doctype html') OR html LIKE '%<html%' END) THEN 'non_html'
  WHEN length(trim(text)) < 80 AND (len(regexp_extract_all(lower(html), '<script')) >= 3 OR lower(text) LIKE '%enable javascript%' OR lower(text) LIKE '%requires javascript%' OR lower(text) LIKE '%please enable js%' OR lower(html) LIKE '%id="__next"%' OR lower(html) LIKE '%id="root"%') THEN 'likely_javascript_required'
  WHEN length(trim(text)) < 80 THEN 'empty_text' END"""

_PENALISED = "('non_html', 'empty_text', 'likely_javascript_required', 'fetch_error')"


def _snippet(found: str, terms: list[str]) -> str:
    """From 80 bytes before the first hit of a term, at the start of a character, 239 characters of it."""
    hits = ", ".join(f"CASE WHEN strpos(low, '{t}') > 0 THEN strlen(left(low, strpos(low, '{t}') - 1)) END" for t in terms)
    return f"""{found}, hit AS (SELECT id, text, greatest(coalesce(least({hits}), 0) - 80, 0) AS off FROM (SELECT f.id, c.text, lower(c.text) AS low FROM found f JOIN chosen c USING (id))),
cuts AS (SELECT id, text, list_filter(range(0, length(text) + 1), lambda k: strlen(left(text, k)) >= off)[1] AS skip FROM hit)
SELECT id, {_squash("substr(text, CASE WHEN skip >= length(text) THEN 1 ELSE skip + 1 END, 239)")} AS snippet FROM cuts"""


def _crawl(suppress: bool, budget: int, levels: int = 3, threshold: int = 3) -> str:
    """A breadth-first crawl, one group of CTEs for each level; places are counted from 0 over all levels."""
    ctes = [
        "last AS MATERIALIZED (SELECT * FROM (SELECT requested_url AS url, final_url, status, content_type, extracted_text, links, row_number() OVER (PARTITION BY requested_url ORDER BY seq DESC) AS k FROM crawl_records WHERE final_url IS NOT NULL) WHERE k = 1)",
        # The page of a snapshot: the text, then a link for each of its links, with a dot as its text.
        rf"""shown AS MATERIALIZED (SELECT url, final_url, content_type, links, '<html><body>' || coalesce(extracted_text, '') || list_aggregate(list_transform(links, lambda u: '<a href="' || u || '">.</a>'), 'string_agg', '') AS html,
          {_squash("coalesce(extracted_text, '') || ' ' || coalesce(list_aggregate(list_transform(links, lambda u: '.'), 'string_agg', ' '), '')")} AS text FROM last)""",
        f"pages_of AS MATERIALIZED (SELECT *, {_REASON.replace('html)', 'coalesce(html, {0}))'.replace('{0}', chr(39) * 2))} AS reason FROM shown)",
        r"f0 AS MATERIALIZED (SELECT url, row_number() OVER (ORDER BY first) - 1 AS seq FROM (SELECT source_seed AS url, min(seq) AS first FROM crawl_records GROUP BY source_seed) WHERE regexp_matches(url, '^[a-z]+://[^/:?#]+'))",
    ]
    for k in range(levels):
        before = " UNION ALL ".join(f"SELECT host, bad FROM l{j}" for j in range(k)) or "SELECT '' AS host, false AS bad WHERE false"
        late = "coalesce(done, 0) + coalesce(sum(bad::INT) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if suppress else "0"
        ctes += [
            rf"g{k} AS MATERIALIZED (SELECT f.seq, f.url, p.final_url, p.links, lower(regexp_extract(f.url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CASE WHEN p.url IS NULL THEN 'fetch_error' ELSE p.reason END AS reason, p.url IS NULL AS lost FROM f{k} f LEFT JOIN pages_of p USING (url) WHERE f.seq < {budget})",
            f"m{k} AS MATERIALIZED (SELECT g.*, coalesce(reason IN {_PENALISED}, false) AS bad, done FROM g{k} g LEFT JOIN (SELECT host, sum(bad::INT) AS done FROM ({before}) GROUP BY host) USING (host))",
            f"""l{k} AS MATERIALIZED (SELECT seq, url, final_url, links, host, {k} AS depth, CASE WHEN late >= {threshold} THEN 'host_suppressed' WHEN lost THEN 'fetch_failed' WHEN reason IS NULL THEN 'stored' ELSE 'skipped' END AS outcome,
              CASE WHEN late >= {threshold} THEN 'bad_host_threshold' ELSE reason END AS reason, late < {threshold} AND bad AS bad FROM (SELECT *, {late} AS late FROM m{k}))""",
        ]
        if k + 1 < levels:
            seen = " UNION ALL ".join(f"SELECT url FROM f{j}" for j in range(k + 1))
            ctes.append(rf"""f{k + 1} AS MATERIALIZED (SELECT url, (SELECT count(*) FROM ({seen})) + row_number() OVER (ORDER BY place) - 1 AS seq FROM
              (SELECT url, min((seq, pos)) AS place FROM (SELECT seq, unnest(links) AS url, generate_subscripts(links, 1) AS pos FROM l{k} WHERE outcome = 'stored') WHERE url NOT IN (SELECT url FROM ({seen})) AND regexp_matches(url, '^https?://[^/:?#]+') GROUP BY url))""")
    return f"WITH {', '.join(ctes)}, every AS ({' UNION ALL '.join(f'FROM l{k}' for k in range(levels))})"


def page_sql(newest_pages: str, ranked: str, scored: str, terms: list[str]) -> dict[str, str]:
    snaps = f"WITH {_snapshots(newest_pages)}"
    found = f"WITH {ranked}, {scored}, found AS (SELECT id FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 20)"
    return {
        "page_title": f"SELECT page_id, {_AT}, nullif(trim({_plain(_FIRST_TITLE)}), '') AS title FROM page_contents WHERE html IS NOT NULL",
        "page_text": f"SELECT page_id, {_AT}, {_text(_BODY)} AS text FROM page_contents",
        "page_text_legacy": f"SELECT page_id, {_AT}, nullif({_text('html')}, '') AS text FROM page_contents",
        "page_anchors": rf"{snaps} SELECT page_id, url, nullif(trim({_plain("regexp_replace(arg_min(a, k), '(?s)<[^>]*>', '', 'g')")}), '') AS anchor_text FROM hrefs GROUP BY page_id, url",
        "page_assets": f"""{snaps} SELECT page_id, {_SITE} || path AS asset_url, asset_type, alt_text FROM snaps, LATERAL (VALUES ('/i/' || page_id || '.png', 'image', 'Seen from the road'), ('/i/plain.png', 'image', NULL), ('/s/' || page_id || '.js', 'script', NULL), ('/c/site.css', 'stylesheet', NULL)) AS v(path, asset_type, alt_text)""",
        "classify_pages": f"""{snaps}, texts AS (SELECT *, {_text(_BODY)} AS text FROM snaps), judged AS (SELECT *, {_REASON} AS skip_reason FROM texts)
          SELECT page_id, CASE WHEN skip_reason IS NULL THEN 'stored' ELSE 'skipped' END AS outcome, skip_reason, strlen(html)::BIGINT AS content_length, CASE WHEN skip_reason IS NULL THEN sha256(html) END AS content_hash,
            (SELECT count(DISTINCT h.url) FROM hrefs h WHERE h.page_id = judged.page_id)::BIGINT AS links FROM judged""",
        "search_snippets": _snippet(found, terms),
        "frontier_bfs": f"{_crawl(False, 10**9)} SELECT seq, url AS requested_url, depth::BIGINT AS depth, outcome FROM every",
        "frontier_budget": f"{_crawl(True, 100)} SELECT seq, url AS requested_url, depth::BIGINT AS depth, outcome, reason AS skip_reason FROM every",
    }
