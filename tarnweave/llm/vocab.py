"""Frequency of every term, by last-seen counters.

Records are partitioned by their id and ordered, so that a term's occurrences in one record
come together. Each term has a counter (occurrences, records, last record id): when a token
arrives, the record count goes up only if the record differs from the last one seen. No set of
records is kept for any term, and nothing for a record. Partial counters of a partition are for disjoint records, so they
add up, and a term held by every record is one row per partition before the second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An id with more than this share of all rows is hot; there are at most 1/HOT_SHARE.
HOT_SHARE, HOT_ROWS = 0.002, 10_000
#: A partition writes its counters out and starts anew at so many terms.
COUNTERS_KEPT = 500_000


def reduce_term(key: str) -> str:
    """Letters and digits, lower-cased."""
    return (key if key.isalnum() else "".join(c for c in key if c.isalnum())).lower()


def term_counters(docs: DataFrame, *, id_col: str = "id", freqs_col: str = "term_freqs", partitions: int | None = None) -> DataFrame:
    """(term, occurrences, documents) over all records.

    An id counts once: where its rows repeat, the greatest count of a term holds. Keys that
    reduce to one term add up within a row. Null ids, maps and counts, counts below 1 and keys
    that reduce to nothing are no occurrence; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reduced: dict[str, str] = {}
        counters: dict[str, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(t, c[0], c[1]) for t, c in counters.items()], columns=["term", "occurrences", "documents"])
            counters.clear()
            return out

        current, row = None, 0
        for pdf in batches:
            for rid, freqs in zip(pdf["id"], pdf["freqs"], strict=True):
                if rid != current:
                    current = rid
                    if len(counters) > COUNTERS_KEPT:
                        yield flush()
                row += 1
                for key, count in freqs:
                    if count is None or not count >= 1:
                        continue
                    term = _reduced(key, reduced)
                    if term:
                        see(counters, term, rid, row, int(count))
        yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.map_entries(freqs_col).alias("freqs")).where("id is not null and freqs is not null")
    rows = rows.select("id", F.transform("freqs", lambda e: F.struct(e["key"].alias("k"), e["value"].cast("long").alias("v"))).alias("freqs"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > max(HOT_ROWS, int(docs.count() * HOT_SHARE))).select("id").persist()
    if not hot.isEmpty():
        repeated = rows.join(F.broadcast(hot), "id", "left_semi")
        rows = rows.join(F.broadcast(hot), "id", "left_anti")
    else:
        repeated = None
    spread = (rows.repartition(partitions, "id") if partitions else rows.repartition("id")).sortWithinPartitions("id")
    pairs = spread.mapInPandas(_as_pairs(run), "term string, occurrences long, documents long")
    if repeated is not None:
        # The rows of a hot id don't meet in one place: each gives its terms, the greatest count holds.
        kind = rows.schema["id"].dataType.simpleString()
        single = repeated.mapInPandas(_as_pairs(_each_row), f"id {kind}, term string, n long").groupBy("id", "term").agg(F.max("n").alias("occurrences"))
        pairs = pairs.unionByName(single.select("term", "occurrences", F.lit(1).cast("long").alias("documents")))
    return pairs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def see(counters: dict[str, list], term: str, record, row: int, count: int) -> None:
    """One token entry of a record: (occurrences, records, last record, last row, sum in that row, greatest sum of a row).

    Records come in order, so that a term is new to a record exactly if its last one differs. In
    another row of the same record only what exceeds the greatest sum so far is added.
    """
    c = counters.get(term)
    if c is None:
        counters[term] = [count, 1, record, row, count, count]
    elif c[2] != record:
        c[0] += count
        c[1] += 1
        c[2:] = record, row, count, count
    else:
        c[4] = c[4] + count if c[3] == row else count
        c[3] = row
        if c[4] > c[5]:
            c[0] += c[4] - c[5]
            c[5] = c[4]


def _reduced(key: str, reduced: dict[str, str]) -> str:
    """The reduced term; ``reduced`` remembers reductions."""
    term = reduced.get(key)
    if term is None:
        if len(reduced) > COUNTERS_KEPT:
            reduced.clear()
        term = reduced[key] = reduce_term(key)
    return term


def _each_row(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reduced: dict[str, str] = {}
    for pdf in batches:
        found = [(rid, row, _reduced(key, reduced), int(count)) for row, (rid, freqs) in enumerate(zip(pdf["id"], pdf["freqs"], strict=True)) for key, count in freqs if count is not None and count >= 1]
        sums = pd.DataFrame(found, columns=["id", "row", "term", "n"]).groupby(["id", "row", "term"], as_index=False)["n"].sum()
        yield sums[sums["term"] != ""].groupby(["id", "term"], as_index=False)["n"].max()


def _as_pairs(run):
    """Arrow hands lists of structs over as dicts; turn them into (key, count) tuples."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tuples() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "freqs": [[(e["k"], e["v"]) for e in row] for row in pdf["freqs"]]})

        return run(tuples())

    return inner


def marked_terms(docs: DataFrame, *, id_col: str = "id", freqs_col: str = "term_freqs", rare_below: int = 3, common_above: float = 0.15) -> DataFrame:
    """(term, occurrences, documents, term_mark): 'rare', 'common' or null.

    The share is of all distinct ids of the table, whether or not they have a map.
    """
    counts = term_counters(docs, id_col=id_col, freqs_col=freqs_col)
    ids = docs.where(F.col(id_col).isNotNull()).select(F.count_distinct(id_col).alias("ids"))
    mark = F.when(F.col("documents") < rare_below, "rare").when(F.col("documents") > F.col("ids") * F.lit(common_above), "common")
    return counts.crossJoin(F.broadcast(ids)).select("term", "occurrences", "documents", mark.alias("term_mark"))
