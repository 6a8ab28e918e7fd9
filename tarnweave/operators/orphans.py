"""Orphan references: foreign keys that no parent row carries.

Method: references are grouped by their null mask (which key columns are null); each mask is
anti-joined on its non-null columns only, and the declared match semantics say what a partly
null reference means:

* ``simple``  – a reference with any null column refers to nothing and is never an orphan.
* ``partial`` – the non-null columns must agree with some parent row.
* ``full``    – all columns are null (no reference) or none is; a mixed row is an orphan.

References are read with all their columns and shuffled once, on their key. What comes of a key that
holds a third of all references is known beforehand: buckets of key hashes are counted, then the
keys of the fullest buckets, and keys above a share of all rows (at most 1/HOT_SHARE of them) meet their parents
by broadcast. The rest joins by shuffle.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all references is hot; at most 1/HOT_SHARE keys can be.
HOT_SHARE = 0.002
#: Buckets of key hashes that are counted to find hot keys.
BUCKETS = 4096
MATCHES = ("simple", "partial", "full")


def _masks(keys: list[str], match: str) -> list[tuple[list[str], Column, str]]:
    """(non-null columns, condition, treatment) of each null mask: 'join', or 'orphan' for what the semantics decide alone."""
    if match not in MATCHES:
        raise ValueError(f"unknown match: {match}")
    out = []
    for nulls in itertools.product([False, True], repeat=len(keys)):
        shown = [k for k, null in zip(keys, nulls, strict=True) if not null]
        if not shown or (match == "simple" and len(shown) < len(keys)):
            continue
        condition = functools.reduce(Column.__and__, [F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, nulls, strict=True)])
        out.append((shown, condition, "orphan" if match == "full" and len(shown) < len(keys) else "join"))
    return out


def hot_keys(rows: DataFrame, key: Column) -> DataFrame:
    """(hot_key): the values of ``key`` with more than HOT_SHARE of the rows, 1/HOT_SHARE at most."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    counts = {r.b: r.n for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # BUCKETS rows at most
    least = max(1.0, sum(counts.values()) * HOT_SHARE)
    full = [b for b, n in counts.items() if n > least]  # 1/HOT_SHARE at most
    if not full:
        return rows.select(key.alias("hot_key")).limit(0)
    return rows.where(bucket.isin(full)).groupBy(key.alias("hot_key")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("hot_key")


def with_parents(refs: DataFrame, parents: DataFrame, keys: list[str], match: str = "simple", label: Column | None = None) -> DataFrame:
    """The checked references, with a column ``parent``: the least label of the parents that match, null for orphans.

    References are grouped by their null mask; each mask is joined on its non-null columns only.
    What the semantics leave unchecked gives no row. Null labels count as 'known'. Rows of
    ``refs`` are kept as they are and as often as they are; repeated parents count once; an empty
    parents table makes every checked reference an orphan, an empty refs table gives no rows.
    Other columns of ``parents`` are dropped first, so they may clash freely.
    """
    have = parents.select(*keys, F.coalesce(label if label is not None else F.lit(None), F.lit("known")).alias("parent"))
    parts = []
    for shown, condition, treatment in _masks(keys, match):
        of_mask = refs.where(condition)
        if treatment == "orphan":
            parts.append(of_mask.withColumn("parent", F.lit(None).cast("string")))
            continue
        side = have.dropna(subset=shown).groupBy(*shown).agg(F.min("parent").alias("parent"))
        packed = F.to_json(F.struct(*shown)) if len(shown) > 1 else F.col(shown[0]).cast("string")
        hot = F.broadcast(hot_keys(of_mask, packed))
        for kind in ("left_semi", "left_anti"):
            mine = of_mask.withColumn("hot_key", packed).join(hot, "hot_key", kind).drop("hot_key")
            known = side.withColumn("hot_key", packed).join(hot, "hot_key", kind).drop("hot_key")
            parts.append(mine.join(F.broadcast(known) if kind == "left_semi" else known, shown, "left").select(*refs.columns, "parent"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else refs.withColumn("parent", F.lit(None).cast("string")).limit(0)


def orphan_references(refs: DataFrame, parents: DataFrame, keys: list[str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose key no row of ``parents`` carries, under the declared match (above)."""
    return with_parents(refs, parents, keys, match).where("parent is null").drop("parent")


def orphan_keys(refs: DataFrame, parents: DataFrame, keys: list[str], match: str = "simple") -> DataFrame:
    """Distinct key combinations of ``refs`` that ``parents`` lacks, as columns ``keys``."""
    return orphan_references(refs.select(*keys).distinct(), parents, keys, match)


def newest_rows(df: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """One row per key: the one with the newest ``at``, null counting as oldest.

    Ties go to the greatest values of ``keep`` in order, so that the result is defined.
    """
    best = F.max(F.struct(F.col(at).isNotNull().alias("_known"), F.col(at).alias("_at"), *keep)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in keep])


def reference_states(refs: DataFrame, pages: DataFrame, pages_late: DataFrame) -> DataFrame:
    """refs(ref_field, holder_id, page_id, page_url, ref_month) with the state of what is missing.

    The key of a page is (id, url); a reference gives one of the two and leaves the other null, so
    it is matched partially. 'deleted': the newest row of
    the page in ``pages`` says so; 'late': the page is in ``pages_late`` only; 'missing': in
    neither. missing_key is the id or the url as a string. Rows are distinct. A reference without any key refers to nothing;
    a null holder or month is kept. Several ids of one url are alive if any is.
    """
    newest = newest_rows(pages, "id", "fetched_at", ["status", "url"])
    # In the order of their names: a page that is known in one way isn't late.
    known = newest.select(F.col("id").alias("page_id"), F.col("url").alias("page_url"), F.when(F.col("status").eqNullSafe("deleted"), "2 deleted").otherwise("1 alive").alias("state"))
    late = pages_late.select(F.col("id").alias("page_id"), F.col("url").alias("page_url"), F.lit("3 late").alias("state"))
    found = with_parents(refs, known.unionByName(late), ["page_id", "page_url"], "partial", F.col("state"))
    orphans = found.where("parent is null or parent <> '1 alive'")
    state = F.coalesce(F.substring("parent", 3, 10), F.lit("missing"))
    return orphans.select("ref_field", "holder_id", F.coalesce(F.col("page_url"), F.col("page_id").cast("string")).alias("missing_key"), "ref_month", state.alias("ref_state")).distinct()


def utc_month(micros: Column) -> Column:
    """'yyyy-MM' in UTC of microseconds since 1970, whatever the session's time zone."""
    return F.date_format(F.date_from_unix_date(F.floor(micros / F.lit(86_400_000_000)).cast("int")), "yyyy-MM")


def page_references(links: DataFrame, crawl_records: DataFrame) -> DataFrame:
    """Every reference to a page: both ends of a link, and the URLs a crawl record lists."""
    month = utc_month(F.unix_micros("discovered_at"))
    no_id, no_url = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    ends = links.select(
        F.explode(
            F.array(
                F.struct(F.lit("links.from_page_id").alias("ref_field"), F.col("to_page_id").alias("holder_id"), F.col("from_page_id").alias("page_id")),
                F.struct(F.lit("links.to_page_id").alias("ref_field"), F.col("from_page_id").alias("holder_id"), F.col("to_page_id").alias("page_id")),
            )
        ).alias("r"),
        month.alias("ref_month"),
    ).select("r.ref_field", "r.holder_id", "r.page_id", no_url.alias("page_url"), "ref_month")
    fetched = utc_month(F.col("fetched_at_ms") * 1000)
    urls = crawl_records.select(F.lit("crawl_records.links").alias("ref_field"), F.col("seq").alias("holder_id"), no_id.alias("page_id"), F.explode("links").alias("page_url"), fetched.alias("ref_month"))
    return ends.unionByName(urls)


def orphan_report(states: DataFrame) -> DataFrame:
    """Orphans per table field, period and state."""
    return states.groupBy("ref_field", "ref_month", "ref_state").agg(F.count("*").alias("orphan_refs"), F.count_distinct("missing_key").alias("orphan_keys"))
