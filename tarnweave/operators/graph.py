"""PageRank over the link graph, in both profiles.

Ranks are kept scaled by the number of nodes, so their mean is 1 where no rank leaks. Parallel
edges are merged into one with a weight, and the out-degree is part of that weight, so an
iteration is one join on the source and one aggregation on the target (with partial sums before
its shuffle, so a popular target is no hot key; the edges of a source with a large share of all
edges are cut into parts, and its rank is sent to each).

An iteration is affine: x' = (1-d) + s + dAx, where the scalar s is the dangling mass of x. So
x is a sum of powers of dA applied to ones, and only the factors depend on the scalars. The
powers are computed in one chain of joins without a pause; the dangling mass of every power
then comes from one aggregation, and the ranks from another. Powers are persisted; every
CHECKPOINT_EVERY-th is written to the shared checkpoint folder, which bounds the plan and what
is recomputed if an executor is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.session import cut

CHECKPOINT_EVERY = 7
#: A source with more than this share of all edges is hot (there are at most 1/HOT_SHARE); its edges are cut into so many parts.
HOT_SHARE, PARTS = 0.01, 64
#: Nodes and edges up to which a graph is iterated in one task by default, where 20 joins would be overhead.
ONE_TASK_ROWS = 500_000


def record_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node, dangling) and edges(src, dst, weight) of crawl records(seq, outcome, final_url, links).

    Nodes are the final URLs of stored records. Where a URL has several records, all of them
    contribute links, but its out-degree, and whether it dangles, are those of the last one.
    Links are kept as often as they occur, also to the page itself, if they lead to a node.
    """
    stored = records.where((F.col("outcome") == "stored") & F.col("final_url").isNotNull()).select("seq", F.col("final_url").alias("src"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    nodes = stored.select(F.col("src").alias("dst")).distinct()
    # One row per record and target before any shuffle on the target.
    listed = stored.select("seq", "src", F.explode("links").alias("dst")).groupBy("seq", "src", "dst").agg(F.count("*").alias("n"))
    kept = listed.join(nodes, "dst", "left_semi")
    last = stored.groupBy("src").agg(F.max("seq").alias("seq"))
    degree = last.join(kept.groupBy("seq", "src").agg(F.sum("n").alias("degree")), ["seq", "src"], "left").select("src", F.coalesce("degree", F.lit(0)).alias("degree"))
    edges = kept.groupBy("src", "dst").agg(F.sum("n").alias("n")).join(degree, "src")
    return degree.select(F.col("src").alias("node"), (F.col("degree") == 0).alias("dangling")), edges.select("src", "dst", (F.col("n") / F.greatest("degree", F.lit(1))).alias("weight"))


def table_graph(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The legacy graph: every page id is a node, each (from, to) pair counts once.

    The loop of the legacy profile has no dangling term; edges to ids that are no page count
    in the out-degree but carry rank nowhere.
    """
    nodes = pages.where(F.col("id").isNotNull()).select(F.col("id").alias("node")).distinct()
    pairs = links.where(F.col("from_page_id").isNotNull() & F.col("to_page_id").isNotNull()).select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst")).distinct()
    degree = pairs.groupBy("src").agg(F.count("*").alias("degree"))
    edges = pairs.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("weight"))
    return nodes.withColumn("dangling", F.lit(False)), edges


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 20, dangling_mass: bool = True, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(node, page_rank): ``iterations`` steps from equal ranks, scaled by the number of nodes.

    With ``dangling_mass`` the rank of nodes without links is spread over all nodes; without, it
    leaks. ``one_task_rows`` of 0 iterates graphs of any size by joins. An empty graph gives no rows. Edges from unknown sources carry nothing.
    """
    nodes = nodes.persist()
    edges = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").persist()
    count, links = nodes.count(), edges.count()
    if not count:
        return nodes.select("node", F.lit(1.0).alias("page_rank"))
    if count + links <= one_task_rows:
        return _in_one_task(nodes, edges, damping, iterations, dangling_mass)
    # Powers of the damped transition matrix applied to the vector of ones.
    hot = [r.src for r in edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > links * HOT_SHARE).collect()]  # 1/HOT_SHARE at most
    is_hot = F.col("src").isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("dst"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    # Written, not persisted: a persisted plan would be part of every later plan.
    # It keeps its partitioning, so that edges are shuffled once for all iterations.
    wide = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(edges.select("src", part.alias("part"), "dst", "weight").repartition(wide, "src", "part"))
    nodes = cut(nodes)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    power = nodes.select("node", F.lit(1.0).alias("v"))
    powers = [power]
    for k in range(1, iterations + 1):
        senders = power.select(F.col("node").alias("src"), "v").select("src", F.explode(every).alias("part"), "v")
        power = placed.join(senders, ["src", "part"]).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("v") * F.col("weight")) * damping).alias("v"))
        power = cut(power) if k % CHECKPOINT_EVERY == 0 else power.persist()
        powers.append(power)
    stacked = functools.reduce(DataFrame.unionByName, [p.withColumn("k", F.lit(k)) for k, p in enumerate(powers)])
    lost = [0.0] * (iterations + 1)
    if dangling_mass:
        for r in stacked.join(nodes.where("dangling").select("node"), "node", "left_semi").groupBy("k").agg(F.sum("v").alias("lost")).collect():  # a row per step
            lost[r.k] = r.lost
    share = [1.0]
    for _ in range(iterations):
        spread = damping * sum(c * x for c, x in zip(share, lost, strict=False)) / count
        share = [1.0 - damping + spread, *share]
    factor = F.element_at(F.array(*[F.lit(float(c)) for c in share]), F.col("k") + 1)
    return stacked.groupBy("node").agg(F.sum(factor * F.col("v")).alias("page_rank"))


def _in_one_task(nodes: DataFrame, edges: DataFrame, damping: float, iterations: int, dangling_mass: bool) -> DataFrame:
    """The same iteration on vectors; only for graphs of at most ONE_TASK_ROWS rows."""
    kind = nodes.schema["node"].dataType.simpleString()
    as_rows = nodes.select("node", F.lit(None).cast(kind).alias("dst"), F.col("dangling").cast("double").alias("weight"))
    rows = as_rows.unionByName(edges.select(F.col("src").alias("node"), "dst", "weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["dst"].isna()
        names = pd.Index(pdf.loc[own, "node"])
        lost = pdf.loc[own, "weight"].to_numpy() > 0
        links = pdf.loc[~own]
        src, dst, weight = names.get_indexer(links["node"]), names.get_indexer(links["dst"]), links["weight"].to_numpy()
        known = (src >= 0) & (dst >= 0)
        src, dst, weight = src[known], dst[known], weight[known]
        n = len(names)
        rank = np.ones(n)
        for _ in range(iterations):
            spread = damping * rank[lost].sum() / n if dangling_mass else 0.0
            rank = 1.0 - damping + spread + damping * np.bincount(dst, weights=rank[src] * weight, minlength=n)
        return pd.DataFrame({"node": names, "page_rank": rank})

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"node {kind}, page_rank double")


def page_rank_current(records: DataFrame, damping: float = 0.85, iterations: int = 20, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    nodes, edges = record_graph(records)
    return pagerank(nodes, edges, damping=damping, iterations=iterations, one_task_rows=one_task_rows).withColumnRenamed("node", "url")


def page_rank_legacy(pages: DataFrame, links: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    nodes, edges = table_graph(pages, links)
    return pagerank(nodes, edges, damping=damping, iterations=iterations, dangling_mass=False).withColumnRenamed("node", "page_id")
