"""Graphs compared up to the names of their blank nodes.

Blank nodes are coloured by refinement: a node's colour is hashed with those of its triples and
neighbours until no class of equal colours splits any more. Links between blank nodes make
components, which are compared one by one. In a component where a class still has several nodes, one
of them after another is given a colour of its own, all at once as branches, and the refinement goes
on, until every node of every branch has its own colour; the least hash of the branches' triples is
the component's form. Nodes with the same neighbours can change places in any case and need no
branch. Two graphs are equal if their other triples are, and the numbers of each form.

Colours and forms are 128-bit hashes. Each round is a join and an aggregate that combines before the
shuffle, so a hub's triples are never gathered. The number of branches grows with the symmetry of
single components, and for very symmetric large ones it is large; other components don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from .loops import components, cut


def _sums(*parts: Column) -> list[Column]:
    """Two sums of hashes: the same for the same parts in any order, repeats counted."""
    return [F.sum(F.xxhash64(F.lit(n), *parts).cast("decimal(20,0)")).alias(f"h{n}") for n in (0, 1)]


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _incident(t: DataFrame) -> DataFrame:
    """(node, way, p, other, blank, rest): each triple seen from its blank nodes; a term that isn't blank is in `rest` whole."""
    term = lambda c: F.when(F.col(f"{c}_kind") != "bnode", F.concat_ws("\x00", c, f"{c}_kind", *(["o_dt", "o_lang"] if c == "o" else [])))
    out = F.when(F.col("s_kind") == "bnode", F.struct(F.col("s").alias("node"), F.lit("out").alias("way"), "p", F.col("o").alias("other"), (F.col("o_kind") == "bnode").alias("blank"), term("o").alias("rest")))
    into = F.when(F.col("o_kind") == "bnode", F.struct(F.col("o").alias("node"), F.lit("in").alias("way"), "p", F.col("s").alias("other"), (F.col("s_kind") == "bnode").alias("blank"), term("s").alias("rest")))
    return t.select(F.explode(F.array_compact(F.array(out, into))).alias("x")).select("x.*")


def _refined(nodes: DataFrame, incident: DataFrame) -> DataFrame:
    """`nodes` (c, branch, node, color) with colours that no further round splits."""
    classes = -1
    while True:
        others = nodes.select("branch", F.col("node").alias("other"), F.col("color").alias("oc"))
        near = nodes.select("branch", "node").join(incident, "node")
        inner = near.where("blank").join(others, ["branch", "other"]).select("branch", "node", "way", "p", F.col("oc").alias("x"))
        outer = near.where(~F.col("blank")).select("branch", "node", "way", "p", F.col("rest").alias("x"))
        sums = inner.unionByName(outer).groupBy("branch", "node").agg(*_sums(F.col("way"), F.col("p"), F.col("x")))
        nodes = cut(nodes.join(sums, ["branch", "node"], "left").select("c", "branch", "node", _hash(F.col("color"), F.col("h0"), F.col("h1")).alias("color")))
        now = nodes.select("branch", "color").distinct().count()
        if now == classes:
            return nodes
        classes = now


def blank_forms(t: DataFrame) -> DataFrame:
    """(form, n): the form of each component of blank nodes, and how many have it."""
    t = cut(t.where("s_kind = 'bnode' or o_kind = 'bnode'").select(*S.COLUMNS).distinct())
    incident = cut(_incident(t))
    names = incident.select("node").distinct()
    parts = components(names, incident.where("way = 'out' and blank").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    nodes = cut(parts.select(F.col("component").alias("c"), F.col("component").alias("branch"), "node", F.lit("").alias("color")))
    own = incident.groupBy("node").agg(*_sums(F.col("way"), F.col("p"), F.col("other"), F.col("rest"))).select("node", _hash(F.col("h0"), F.col("h1")).alias("twin"))
    # Nodes with the same triples, blank neighbours by name, are told apart at once: any order is as good.
    order = Window.partitionBy("c", "twin").orderBy("node")
    nodes = cut(nodes.join(own, "node").withColumn("k", F.row_number().over(order)).select("c", "branch", "node", F.col("k").cast("string").alias("color")))
    done = None
    while True:
        nodes = _refined(nodes, incident)
        sizes = nodes.groupBy("c", "branch", "color").agg(F.count("*").alias("size"))
        tied = sizes.where("size > 1").groupBy("branch").agg(F.min(F.struct("size", "color")).alias("first")).select("branch", F.col("first.color").alias("tied"))
        tied = cut(tied)
        settled = nodes.join(tied, "branch", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if tied.isEmpty():
            break
        open_ = nodes.join(tied, "branch")
        chosen = open_.where("color = tied").select("branch", F.col("node").alias("chosen"))
        nodes = cut(open_.join(chosen, "branch").select("c", _hash(F.col("branch"), F.col("chosen")).alias("branch"), "node", F.when(F.col("node") == F.col("chosen"), _hash(F.col("color"), F.lit("chosen"))).otherwise(F.col("color")).alias("color")))
    known = done.select("c", "branch", "node", "color")
    rows = known.join(incident, "node").where("way = 'out' or not blank")
    ends = known.select("branch", F.col("node").alias("other"), F.col("color").alias("oc"))
    rows = rows.join(ends, ["branch", "other"], "left")
    forms = rows.groupBy("c", "branch").agg(*_sums(F.col("color"), F.col("way"), F.col("p"), F.coalesce("oc", "rest"))).select("c", _hash(F.col("h0"), F.col("h1")).alias("form"))
    return forms.groupBy("c").agg(F.min("form").alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs have the same triples, whatever their blank nodes are called."""
    a, b = (x.select(*S.COLUMNS).distinct() for x in (a, b))
    named = "s_kind <> 'bnode' and o_kind <> 'bnode'"
    x, y = a.where(named), b.where(named)
    if not (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()):
        return False
    x, y = blank_forms(a), blank_forms(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
