"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_TERMS = r"""WITH one AS (SELECT id, unnest(map_entries(term_freqs)) AS e, row_number() OVER () AS r FROM indexed_documents WHERE id IS NOT NULL AND term_freqs IS NOT NULL),
per_row AS (SELECT id, r, lower(regexp_replace(e.key, '[^\p{L}\p{N}]', '', 'g')) AS term, sum(e.value) AS n FROM one WHERE e.value >= 1 GROUP BY ALL),
per_id AS (SELECT id, term, max(n) AS n FROM per_row WHERE term <> '' GROUP BY id, term),
ids AS (SELECT count(DISTINCT id) AS ids FROM indexed_documents),
marked AS (SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS documents, CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) > 0.15e0 * (SELECT ids FROM ids) THEN 'common' END AS term_mark FROM per_id GROUP BY term)"""

_WORDS = r"list_filter(string_split_regex(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+'), lambda w: w <> '')"
_RUNS = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"

_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
dr AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 12), er AS (SELECT item_id, unnest({_RUNS}) AS run FROM e WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (run)"""

_PAIRS = f"""WITH r AS MATERIALIZED (SELECT seq, {_WORDS.format("extracted_text")} AS w FROM crawl_records WHERE outcome = 'stored' AND extracted_text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT seq, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM r WHERE len(w) >= 50),
n AS MATERIALIZED (SELECT seq, count(*) AS n FROM s GROUP BY seq),
shared AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.seq < b.seq GROUP BY ALL)
SELECT seq_a, seq_b FROM shared JOIN n x ON x.seq = seq_a JOIN n y ON y.seq = seq_b WHERE c >= 0.6e0 * (x.n + y.n - c) - 1e-9"""

_GROUPS = f"""{_PAIRS.replace("WITH r", "WITH RECURSIVE r", 1).rsplit("SELECT seq_a, seq_b", 1)[0]}, pairs AS MATERIALIZED (SELECT seq_a, seq_b {_PAIRS.rsplit("SELECT seq_a, seq_b", 1)[1]}),
both_ways AS MATERIALIZED (SELECT seq_a AS v, seq_b AS w FROM pairs UNION ALL SELECT seq_b, seq_a FROM pairs),
reached AS (SELECT v, v AS w FROM both_ways UNION SELECT reached.v, b.w FROM reached JOIN both_ways b ON b.v = reached.w),
same AS MATERIALIZED (SELECT seq, md5(array_to_string(w, ' ')) AS words FROM r),
linked AS (SELECT b.v AS seq, count(DISTINCT y.words) FILTER (WHERE x.words <> y.words) AS links FROM both_ways b JOIN same x ON x.seq = b.v JOIN same y ON y.seq = b.w GROUP BY b.v)
SELECT linked.seq, g.group_id, linked.links FROM linked JOIN (SELECT v AS seq, min(w) AS group_id FROM reached GROUP BY v) g USING (seq)"""

_NAME = r"regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]+', '_', 'g')"
_MIXTURE = f"""WITH w AS (SELECT {_NAME} AS src, sum(target_share) AS t, max(max_repeats) AS r FROM source_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY 1),
d AS (SELECT doc_id, {_NAME} AS src, length(text) AS size, ('0x' || substr(md5('7:' || doc_id), 1, 10))::BIGINT AS u FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0),
run AS (SELECT d.*, t, r, sum(size) OVER (PARTITION BY src) AS whole, sum(size) OVER (PARTITION BY src ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS place FROM d JOIN w USING (src)),
budget AS (SELECT min(f * r / t) * sum(t) AS b FROM (SELECT DISTINCT src, whole AS f, t, r FROM run)),
timed AS (SELECT doc_id, src, copy, size, ((copy - 1) * whole + place) / t AS finish FROM (SELECT *, unnest(range(1, r + 1)) AS copy FROM run)),
total AS (SELECT *, sum(size) OVER (ORDER BY finish, src, copy, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM timed)
SELECT doc_id, src AS source, copy::INT AS copy, size AS n_chars, round(finish, 3) AS finish FROM total WHERE total <= (SELECT b FROM budget)"""

_CHOSEN = "SELECT doc_id, src AS source, copy::INT AS copy, size AS n_chars, round(finish, 3) AS finish FROM total WHERE total <= (SELECT b FROM budget)"
_SHARES = f"""{_MIXTURE.replace(_CHOSEN, "").rstrip()}, chosen AS (SELECT * FROM total WHERE total <= (SELECT b FROM budget)),
per AS (SELECT src, sum(size) AS n, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM chosen GROUP BY src), have AS (SELECT DISTINCT src FROM run)
SELECT w.src AS source, round(t, 6) AS target_share, round(CASE WHEN h.src IS NULL THEN 0 ELSE t END / sum(CASE WHEN h.src IS NOT NULL THEN t END) OVER (), 6) AS goal_share,
 coalesce(n, 0)::BIGINT AS n_chars, round(coalesce(n, 0) / sum(n) OVER (), 6) AS share, coalesce(docs, 0) AS documents, coalesce(uses, 0) AS uses FROM w LEFT JOIN have h USING (src) LEFT JOIN per USING (src)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _PAIRS,
        "p4_groups": _GROUPS,
        "p7_terms": f"{_TERMS} SELECT term, occurrences, documents, term_mark FROM marked",
        "p7_found": f"{_TERMS} SELECT term, term_mark FROM marked WHERE term_mark IS NOT NULL",
        "p8_found": _LEAKS,
        "p9_by_characters": _MIXTURE,
        "p9_shares_by_characters": _SHARES,
    }
