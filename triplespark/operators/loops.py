"""Frontier loops: reachability by repeated joins."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; one of its own on a single machine where that is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of `df` with a table in the folder that all executors share.

    A checkpoint would keep the estimated size of its plan. Joins multiply estimates, so in a loop their
    digits double with each round, until these numbers alone fill the driver; a table has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges of one node that a task joins; the edges of nodes with more are spread.
HEAVY = 100_000
#: Nodes with many edges up to which their table is sent to all tasks.
SENT = 100_000


class Dealt(NamedTuple):
    """Edges dealt for joins by their source: (src, salt, dst), and (src, salts) of the sources that are spread."""

    edges: DataFrame
    heavy: DataFrame

    def spread(self, rows: DataFrame, node: str) -> DataFrame:
        """`rows` with salt: one row for each part of the node's edges."""
        heavy = self.heavy.withColumnRenamed("src", node)
        return rows.join(heavy, node, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def deal(edges: DataFrame, most: int | None = None) -> Dealt:
    """Edges (src, dst) dealt by source, those of a source with over `most` (HEAVY) of them over several tasks by target."""
    most = most or HEAVY
    edges = cut(edges.select("src", "dst"))
    heavy = cut(edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    if heavy.limit(SENT + 1).count() <= SENT:
        heavy = F.broadcast(heavy)
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
    return Dealt(cut(edges.join(heavy, "src", "left").select("src", salt.alias("salt"), "dst").repartition("src", "salt")), heavy)


def reach(start: DataFrame, edges: DataFrame | Dealt, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) for each node that is reached from a root over `edges` (src, dst), each once at its least depth.

    `start` has (root, node). Each level joins the frontier with the edges and drops what has
    been visited, so cycles end; the loop stops when the frontier is empty, at `max_depth`, or,
    with `stop` (node), for the roots that have reached one of its nodes. A hub's edges are spread
    over tasks, and the frontier's row for it goes to each of them.
    """
    dealt = edges if isinstance(edges, Dealt) else deal(edges)
    visited = cut(start.select("root", "node", F.lit(0).alias("depth")).distinct())
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if stop is not None:
            done = frontier.join(stop, "node", "left_semi").select("root").distinct()
            frontier = frontier.join(done, "root", "left_anti")
        steps = dealt.spread(frontier.select("root", F.col("node").alias("src")), "src")
        found = steps.join(dealt.edges, ["src", "salt"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(visited, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): each node (node) with itself and all that it reaches over `edges` (src, dst), in as many rounds as the logarithm of the longest way.

    A round adds what lies as many steps farther as have been taken, by the pairs that are so far apart.
    """
    found = cut(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    steps, known = cut(edges.select("src", "dst").where("src <> dst").distinct()), found.count()
    while not steps.isEmpty():
        more = found.join(steps.toDF("dst", "far"), "dst").select("src", F.col("far").alias("dst"))
        found = cut(found.unionByName(more).distinct())
        now = found.count()
        if now == known:
            break
        known = now
        steps = cut(steps.join(steps.toDF("dst", "far"), "dst").select("src", F.col("far").alias("dst")).distinct())
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): each of `nodes` (node) with the smallest node that `edges` (src, dst) join it to, in either direction.

    Each round takes the smallest label around a node and then its label's label, so long chains take
    few rounds.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().toDF("node", "near"))
    labels = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        around = both.join(labels.toDF("near", "label"), "near").groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.toDF("component", "far")
        new = labels.join(around, "node", "left").join(jump, "component", "left").select("node", F.least("component", "label", "far").alias("component"), (F.least("component", "label", "far") < F.col("component")).alias("moved"))
        new = cut(new)
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
