"""Large taxonomies: which classes lie below one, without a table of all pairs.

Each class keeps one step upwards, which makes trees, and gets two numbers, its place on the way
around its tree when it is entered and when it is left. A class lies below another of the same tree if
it is entered in between, which is a comparison of numbers. The other steps are few in taxonomies that
are almost trees; they are followed one after another from a class downwards, each bringing the
stretch of one more subtree.

All numbers come from pointer doubling, so a chain of 100,000 classes takes 17 rounds and not as
many as it has levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .loops import cut

#: Subtrees up to which they are sent to all tasks; more are joined.
SENT = 100_000


def _roots(up: DataFrame) -> DataFrame:
    """(node, root): the end of the steps (node, up; null at a root) from each node; null within and below rings."""
    at = cut(up.select("node", F.coalesce("up", "node").alias("root")))
    ends = up.where("up is null").select(F.col("node").alias("root"), F.lit(True).alias("end"))
    n, size = up.count(), 1
    while size < 2 * n:
        far = at.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(at.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        at, size = new.select("node", "root"), 2 * size
        if new.where("moved").isEmpty():
            break
    return at.join(ends, "root", "left").select("node", F.when(F.col("end"), F.col("root")).alias("root"))


def _ring_ends(up: DataFrame) -> DataFrame:
    """(node): the first by name of each ring of steps (node, up)."""
    at = cut(up.where("up is not null").select("node", F.col("up").alias("far"), F.col("up").alias("least")))
    n, size = at.count(), 1
    while size < 2 * n:
        next_ = at.select(F.col("node").alias("far"), F.col("far").alias("f"), F.col("least").alias("l"))
        at, size = cut(at.join(next_, "far").select("node", F.col("f").alias("far"), F.least("least", "l").alias("least"))), 2 * size
    return at.where("least = node").select("node")


class Subsumption:
    """The numbers of a taxonomy of `nodes` (node) with steps `edges` (src, dst) upwards."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
        first = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("up"))
        everything = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
        up = cut(everything.join(first, "node", "left"))
        roots = cut(_roots(up))
        ringed = roots.where("root is null").select("node")
        if not ringed.isEmpty():  # a ring is opened at one of its nodes, whose step is then one of the others
            ends = _ring_ends(up.join(ringed, "node", "left_semi")).withColumn("cut", F.lit(True))
            up = cut(up.join(ends, "node", "left").select("node", F.when(F.col("cut").isNull(), F.col("up")).alias("up")))
            roots = cut(_roots(up))
        #: (node, root, entered, left): distances to the end of the way around the tree.
        self.labels = cut(self._numbered(up).join(roots, "node"))
        others = edges.join(up.select(F.col("node").alias("src"), F.col("up").alias("dst")), ["src", "dst"], "left_anti")
        own = self.labels.select(F.col("node").alias("src"), F.col("root").alias("src_root"), F.col("entered").alias("high"), F.col("left").alias("low"))
        target = self.labels.select(F.col("node").alias("dst"), "root", "entered")
        #: Steps outside the trees: where they lead to, and the stretch of the subtree that they bring.
        self.others = cut(others.join(own, "src").join(target, "dst").select("src", "root", "entered", "src_root", "high", "low"))

    @staticmethod
    def _numbered(up: DataFrame) -> DataFrame:
        """(node, entered, left) from the way around each tree as a linked list, ranked by doubling."""
        order = Window.partitionBy("up").orderBy("node")
        children = up.where("up is not null").select("node", "up", F.row_number().over(order).alias("n"), F.lead("node").over(order).alias("sibling"))
        child = children.where("n = 1").select(F.col("up").alias("node"), F.col("node").alias("child"))
        rows = up.join(child, "node", "left").join(children.select("node", "sibling"), "node", "left")
        event = lambda node, enters: F.struct(node.alias("node"), F.lit(enters).alias("enters"))
        node, sibling, parent, down = (F.col(c) for c in ("node", "sibling", "up", "child"))
        enter = F.struct(event(node, True).alias("at"), F.when(down.isNotNull(), event(down, True)).otherwise(event(node, False)).alias("to"))
        leave = F.struct(event(node, False).alias("at"), F.when(sibling.isNotNull(), event(sibling, True)).when(parent.isNotNull(), event(parent, False)).alias("to"))
        way = rows.select(F.explode(F.array(enter, leave)).alias("e")).select("e.at", "e.to", F.when(F.col("e.to").isNull(), 0).otherwise(1).cast("long").alias("d"))
        way = cut(way)
        while not way.where("to is not null").isEmpty():
            far = way.select(F.col("at").alias("to"), F.col("to").alias("far"), F.col("d").alias("more"))
            way = cut(way.join(far, "to", "left").select("at", F.col("far").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0).cast("long"))).alias("d")))
        return way.groupBy(F.col("at.node").alias("node")).agg(F.max(F.when(F.col("at.enters"), F.col("d"))).alias("entered"), F.max(F.when(~F.col("at.enters"), F.col("d"))).alias("left"))

    def stretches(self, *names: str) -> DataFrame:
        """(root, high, low): the subtrees that make up what lies below the named nodes; a node is in one if it is entered between them."""
        new = cut(self.labels.where(F.col("node").isin(*names)).select("root", F.col("entered").alias("high"), F.col("left").alias("low")))
        found = new
        while True:
            inside = (F.col("o.root") == F.col("x.root")) & (F.col("o.entered") <= F.col("x.high")) & (F.col("o.entered") >= F.col("x.low"))
            hit = self.others.alias("o").join(self._small(new).alias("x"), inside, "left_semi").select(F.col("src_root").alias("root"), "high", "low").distinct()
            new = cut(hit.join(found, ["root", "high", "low"], "left_anti"))
            if new.isEmpty():
                return found
            found = cut(found.unionByName(new))

    @staticmethod
    def _small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows

    def below(self, *names: str) -> DataFrame:
        """(p): the named nodes and all below them."""
        inside = (F.col("n.root") == F.col("x.root")) & (F.col("n.entered") <= F.col("x.high")) & (F.col("n.entered") >= F.col("x.low"))
        return self.labels.alias("n").join(self._small(self.stretches(*names)).alias("x"), inside, "left_semi").select(F.col("n.node").alias("p"))
