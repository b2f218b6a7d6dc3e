"""Host graph: harmonic centrality, exact or by HyperBall, and its percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize

EXACT_UP_TO = 20_000
LEAST_NODES = 500
MAX_STEPS = 200
HLL_BITS = 6


def graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of distinct edges (src, dst), without loops."""
    edges = links.filter("from_host <> to_host").select(F.col("from_host").alias("src"), F.col("to_host").alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes, edges


def harmonic_exact(links: DataFrame) -> DataFrame:
    """(node, score): the sum of 1/d over all nodes at distance d to the node. All sources advance a step at a time."""
    nodes, edges = graph(links)
    edges = materialize(edges, "graph")
    hop = edges.select(F.col("src").alias("via"), F.col("dst").alias("to"))
    front = seen = materialize(edges.select("src", "dst", F.lit(1).alias("d")), "hop")
    fronts, d = [front], 1
    while True:
        d += 1
        step = front.join(hop, front["dst"] == hop["via"]).select("src", F.col("to").alias("dst")).filter("src <> dst").distinct()
        front = materialize(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("d", F.lit(d)), "hop")
        if not front.take(1):
            break
        fronts.append(front)  # each front is written once; what was reached is the union of their files
        seen = front.sparkSession.read.schema(front.schema).parquet(*[p for f in fronts for p in f.inputFiles()])
    score = seen.groupBy(F.col("dst").alias("node")).agg(F.sum(F.lit(1.0) / F.col("d")).alias("score"))
    return nodes.join(score, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def hyperball(links: DataFrame) -> DataFrame:
    """(node, score) from one HyperLogLog sketch a node, which takes in its predecessors' each step."""
    nodes, edges = graph(links)
    edges = materialize(edges, "graph")
    ball = nodes.groupBy("node").agg(F.hll_sketch_agg("node", HLL_BITS).alias("ball"))
    state = materialize(ball.withColumns({"size": F.hll_sketch_estimate("ball").cast("double"), "score": F.lit(0.0)}), "ball")
    for t in range(1, MAX_STEPS + 1):
        came = edges.join(state.select(F.col("node").alias("src"), "ball"), "src").select(F.col("dst").alias("node"), "ball")
        grown = state.select("node", "ball").unionByName(came).groupBy("node").agg(F.hll_union_agg("ball").alias("ball"))
        j = grown.join(state.select("node", "size", "score"), "node").withColumn("now", F.hll_sketch_estimate("ball").cast("double"))
        gain = F.greatest(F.col("now") - F.col("size"), F.lit(0.0))
        state = materialize(j.select("node", "ball", F.greatest("now", "size").alias("size"), (F.col("score") + gain / t).alias("score"), (gain > 0).alias("moved")), "ball")
        if not state.filter("moved").take(1):
            break
        state = state.drop("moved")
    return state.select("node", "score")


def centrality(links: DataFrame, force: bool = False) -> DataFrame:
    """Exact up to EXACT_UP_TO nodes, HyperBall above; an empty graph, or one under LEAST_NODES unless forced, is refused."""
    n = graph(links)[0].count()
    if n == 0:
        raise ValueError("the graph is empty")
    if n < LEAST_NODES and not force:
        raise ValueError(f"{n} nodes are too few for percentiles to mean much")
    return harmonic_exact(links) if n <= EXACT_UP_TO else hyperball(links)


def percentile(scores: DataFrame, tie: str = "node") -> DataFrame:
    """(node, pct): place in ascending order over n - 1, ties by node, 1 for a single node.

    Ranks come from range partitions and their prefix counts, so no task sorts all nodes."""
    spark = scores.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = materialize(scores.select(tie, "score").repartitionByRange(parts, "score", tie).withColumn("part", F.spark_partition_id()), "ranked")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("score", tie))
    place = ordered.withColumn("k", local).join(offsets, "part").withColumn("place", F.col("before") + F.col("k") - 1)
    return place.select(tie, F.when(F.col("all") == 1, 1.0).otherwise(F.try_divide(F.col("place").cast("double"), F.col("all") - 1)).alias("pct"))


def write_back(hosts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Hosts with their new centrality; those outside the graph keep what they had."""
    return hosts.join(ranks.select(F.col("node").alias("id"), "pct"), "id", "left").withColumn("centrality", F.coalesce("pct", "centrality")).drop("pct")
