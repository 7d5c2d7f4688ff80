"""The dependency graph as edges (src, dst) and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: one for the node and one for each end of an edge that it is."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(ends, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + 1).alias("degree"))


def call_edges(bundles: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) from bundles (component_id, imports) to classes (component_id, api_name) by the first
    segment of each import."""
    called = bundles.select(F.col("component_id").alias("src"), F.explode("imports").alias("i")).select("src", F.substring_index("i", ".", 1).alias("api_name")).distinct()
    return called.join(classes.select(F.col("component_id").alias("dst"), "api_name"), "api_name").select("src", "dst", F.lit("calls").alias("kind"))


def skipped_imports(bundles: DataFrame, classes: DataFrame) -> DataFrame:
    called = bundles.select(F.col("component_id").alias("src"), F.explode("imports").alias("i")).select("src", "i", F.substring_index("i", ".", 1).alias("api_name"))
    return called.join(classes.select("api_name"), "api_name", "left_anti").select("src", F.col("i").alias("import"))


def dispatch_graph(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Dispatch edges (dispatcher, handler, confidence) with a hub node ``cmt:<dispatcher>`` for each dispatcher."""
    return edges.join(classes.select(F.col("component_id").alias("dst"), F.col("api_name").alias("handler")), "handler").select(F.concat(F.lit("cmt:"), "dispatcher").alias("src"), "dst", "confidence")


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and what edges add to them, each once."""
    return nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut off the lineage in the folder that the cluster names for checkpoints."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnflow-graph-"))
    return df.checkpoint()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the smallest node that is reached. Labels spread along edges and then jump to their own
    label's label, so the rounds grow with the logarithm of the longest path. Raises if they do not suffice."""
    both = _checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    labels = _checkpointed(labels)
    for _ in range(rounds):
        near = both.join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        spread = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = _checkpointed(spread.join(jump, "component").select("node", F.least("component", "further").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components not settled after {rounds} rounds")


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """node, community by modularity: in each round half of the nodes, dealt by a hash, move to the neighbouring
    community where modularity gains most; ties go to the smaller label. Deterministic for given edges. Each round
    is one pass over the edges; totals of communities are joined, not collected."""
    links = edges.filter("src <> dst").select("src", "dst")
    both = _checkpointed(links.union(links.select("dst", "src")).toDF("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    degrees = _checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    m2 = degrees.agg(F.sum("k")).first()[0] or 1
    labels = degrees.select("node", F.col("node").alias("community"))
    for r in range(rounds):
        at = labels.join(degrees, "node")
        totals = at.groupBy("community").agg(F.sum("k").alias("total"))
        ties = both.join(labels.toDF("dst", "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("links"))
        stay = at.select("node", "community", F.lit(0).cast("long").alias("links"))
        options = ties.unionByName(stay).groupBy("node", "community").agg(F.sum("links").alias("links"))
        own = at.select("node", F.col("community").alias("own"), "k")
        scored = options.join(own, "node").join(totals, "community")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("links") - F.lit(resolution) * F.col("k") * rest / F.lit(float(m2)), 9)
        best = scored.groupBy("node").agg(F.max_by("community", F.struct(gain, F.col("community") == F.col("own"), -F.xxhash64("community"))).alias("best"), F.first("own").alias("own"))
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        new = _checkpointed(best.select("node", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("community"), "own"))
        labels = new.select("node", "community")
        if r % 2 and new.filter("community <> own").isEmpty():
            break
    return labels


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with number, from 1 in the given order: ranges are sorted apart, and each starts after those before."""
    from pyspark.sql import Window as W

    ranged = _checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.join(starts, "_range").select(*df.columns, (F.col("_start") + place).alias("number"))


def business_processes(members: DataFrame, category: DataFrame) -> DataFrame:
    """process_id (bp_001, ...), label, size of communities (node, community): the most frequent category, ties to
    the first in order, and the size; largest first. Hub nodes, which have no category, do not count."""
    counted = members.join(category, "node").groupBy("community", "category").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy("community").agg(F.max_by("category", F.struct(F.col("n"), -F.length("category"))).alias("c"), F.sum("n").alias("size"))
    groups = numbered(groups, F.col("size").desc(), F.col("community").asc())
    return groups.select("community", F.concat(F.lit("bp_"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), "0")).alias("process_id"), F.concat("c", F.lit(" ("), F.col("size").cast("string"), F.lit(")")).alias("label"), "size")
