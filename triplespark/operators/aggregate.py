"""Aggregations: attribute maps, counts, single values, changes and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from .navigate import container_counts, edges, neighbors_with_rel
from .search import find
from .select import attribute_values, individuals, preferred_label, superclasses_of, types_of
from .tbox import TBox, direct_super


def attribute_map(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, attributes): a map from each attribute in use to its sorted distinct values."""
    rows = t.where("o_kind = 'literal'").join(tb.names("attribute").toDF("p"), "p", "left_semi")
    sets = rows.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("values"))
    return sets.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "values")))).alias("attributes"))


def counts(t: DataFrame, tb: TBox, namespaces: list[tuple[str, str]] = ()) -> DataFrame:
    """(what, n): distinct individuals of the graph, entities of each namespace, members of each container."""
    out = individuals(t, tb).agg(F.lit("graph").alias("what"), F.count("*").alias("n"))
    for name, iri in namespaces:
        out = out.union(tb.kinds.where(F.col("s").startswith(iri)).agg(F.lit(f"namespace {name}"), F.count("*")))
    return out.union(container_counts(t, tb).select(F.concat(F.lit("container "), "container"), "num_members"))


def functional_value(t: DataFrame, tb: TBox, attribute: str) -> DataFrame:
    """(s, value, n) for each individual: its only value; null if it has none, and with n over 1 a violation."""
    values = attribute_values(t, tb, attribute).groupBy("s").agg(F.count("*").alias("n"), F.min("o").alias("value"))
    out = individuals(t, tb).join(values, "s", "left")
    return out.select("s", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def one(sets: DataFrame, key: str = "s", element: str = "element") -> DataFrame:
    """(key, one, status): the only element of each set, or null and `empty` or `multiple`."""
    found = sets.groupBy(key).agg(F.countDistinct(element).alias("n"), F.min(element).alias("x"))
    return found.select(key, F.when(F.col("n") == 1, F.col("x")).alias("one"), F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "empty").otherwise("multiple").alias("status"))


def any_of(sets: DataFrame, key: str = "s", element: str = "element") -> DataFrame:
    """(key, any): the first element of each set, or null."""
    return sets.groupBy(key).agg(F.min(element).alias("any"))


def entity_changes(base: DataFrame, log: DataFrame) -> DataFrame:
    """(s, change): subjects that a change log (seq, op, triple) adds, deletes or updates; the last operation on a triple counts.

    Added: no triple before. Deleted: as many removed as there were, even if others are added.
    Updated: any other touched subject that existed, even if the additions change nothing.
    """
    last = log.groupBy(*S.COLUMNS).agg(F.max_by("op", "seq").alias("op"))
    before = base.groupBy("s").agg(F.count("*").alias("before"))
    own = last.join(base.select(*S.COLUMNS, F.lit(1).alias("here")), list(S.COLUMNS), "left")
    touched = own.groupBy("s").agg(F.count_if(F.col("op") == "add").alias("added"), F.count_if((F.col("op") == "delete") & F.col("here").isNotNull()).alias("removed"), F.count("*").alias("n"))
    out = touched.join(before, "s", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    change = F.when((F.col("before") == 0) & (F.col("added") > 0), "added").when((F.col("before") > 0) & (F.col("removed") >= F.col("before")), "deleted").when(F.col("before") > 0, "updated")
    return out.select("s", change.alias("change")).where("change is not null")


def report_rows(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP) -> DataFrame:
    """(s, n, relationship, neighbor, class_label, relationship_label, label): the lines of a printed entity about its neighbours, a row each, n from 1 in their order.

    Relationships come in the order of their names (label, else IRI); within one the neighbours by the
    first of their classes' names, then by their own. Names that are labels come before those that
    are IRIs. Rows are numbered as they stream out of a sort; no array of a hub's neighbours is made.
    """
    named = preferred_label(t).select("s", "label")
    terms = preferred_label(tb.triples).select("s", "label")
    first = lambda c, i: F.when(F.col(c).isNotNull(), F.concat(F.lit("\x00"), c)).otherwise(F.col(i))
    near = neighbors_with_rel(t, tb, relationship)
    near = near.join(individuals(t, tb).toDF("neighbor"), "neighbor", "left_semi").join(individuals(t, tb), "s", "left_semi")
    classes = types_of(t, tb).join(terms.toDF("class", "class_label"), "class", "left").groupBy(F.col("s").alias("neighbor")).agg(F.min(F.coalesce("class_label", "class")).alias("class_label"))
    rows = near.join(terms.toDF("relationship", "relationship_label"), "relationship", "left").join(named.toDF("neighbor", "label"), "neighbor", "left").join(classes, "neighbor", "left")
    order = Window.partitionBy("s").orderBy(F.coalesce("relationship_label", "relationship"), "relationship", "class_label", first("label", "neighbor"), "neighbor")
    return rows.withColumn("n", F.row_number().over(order).cast("long")).select("s", "n", "relationship", "neighbor", "class_label", "relationship_label", "label")


def entity_report(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP) -> DataFrame:
    """(s, label, types, superclasses, attributes, neighbors) of each individual, all sorted; the table form of a printed entity.

    Attributes are `name=value`; neighbours are grouped by relationship as structs (relationship, label, neighbor).
    """
    listed = lambda df, c, name: df.groupBy("s").agg(F.sort_array(F.collect_set(c)).alias(name))
    values = t.where("o_kind = 'literal'").join(tb.names("attribute").toDF("p"), "p", "left_semi").select("s", F.concat("p", F.lit("="), "o").alias("v"))
    label = preferred_label(t).select("s", "label")
    near = neighbors_with_rel(t, tb, relationship).join(label.toDF("neighbor", "label"), "neighbor", "left")
    near = near.select("s", F.struct("relationship", F.coalesce("label", F.lit("")).alias("label"), "neighbor").alias("n"))
    out = individuals(t, tb).join(label, "s", "left")
    for part in (listed(types_of(t, tb), "class", "types"), listed(superclasses_of(t, tb), "class", "superclasses"), listed(values, "v", "attributes"), listed(near, "n", "neighbors")):
        out = out.join(part, "s", "left")
    return out


def drawn(t: DataFrame, tb: TBox, nodes: DataFrame, relationships: Iterable[str] | None = None) -> DataFrame:
    """(s): the individuals `nodes` (s), and with `relationships` all that are reached from them by these."""
    if relationships is None:
        return nodes.select("s").distinct()
    return find(t, tb, nodes, relationships=relationships, annotations=False).select(F.col("node").alias("s")).distinct()


def plot_nodes(t: DataFrame, tb: TBox, nodes: DataFrame) -> DataFrame:
    """(s, kind, label, classes, attributes) of the drawn individuals `nodes` (s); only what belongs to them is worked out."""
    chosen = nodes.select("s").distinct()
    own = t.join(chosen, "s", "left_semi").select(*S.COLUMNS)
    listed = lambda df, c, name: df.groupBy("s").agg(F.sort_array(F.collect_set(c)).alias(name))
    values = own.where("o_kind = 'literal'").join(tb.names("attribute").toDF("p"), "p", "left_semi").select("s", F.concat("p", F.lit("="), "o").alias("v"))
    out = individuals(own, tb).join(preferred_label(own).select("s", "label"), "s", "left").join(listed(types_of(own, tb), "class", "classes"), "s", "left").join(listed(values, "v", "attributes"), "s", "left")
    return out.select("s", F.lit("individual").alias("kind"), "label", "classes", "attributes")


def plot_edges(t: DataFrame, tb: TBox, nodes: DataFrame, inverse_of: DataFrame) -> DataFrame:
    """(src, dst, label, directed): links between drawn individuals, one undirected edge for each inverse pair.

    `inverse_of` has (p, inverse).
    """
    drawn = nodes.select("s")
    rows = neighbors_with_rel(t, tb).join(drawn, "s", "left_semi").join(drawn.toDF("neighbor"), "neighbor", "left_semi")
    rows = rows.select(F.col("s").alias("src"), F.col("neighbor").alias("dst"), F.col("relationship").alias("label"))
    pairs = inverse_of.select(F.col("p").alias("label"), F.col("inverse"))
    back = rows.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("label").alias("inverse"), F.lit(True).alias("both"))
    found = rows.join(pairs, "label", "left").join(back, ["src", "dst", "inverse"], "left")
    # The other half of an inverse pair is drawn with its first half.
    second = found.where("both").select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("inverse").alias("label"))
    kept = found.join(second, ["src", "dst", "label"], "left_anti")
    return kept.select("src", "dst", "label", F.col("both").isNull().alias("directed"))


def plot_is_a(tb: TBox) -> DataFrame:
    """(src, dst): each class and property with its direct superclasses, or the top of its kind where it has none."""
    kinds = tb.kinds.where(F.col("kind").isin("class", "relationship", "attribute"))
    top = F.when(F.col("kind") == "class", S.THING).when(F.col("kind") == "relationship", S.TOP_RELATIONSHIP).otherwise(S.TOP_ATTRIBUTE)
    up = direct_super(tb).toDF("s", "up")
    rows = kinds.join(up, "s", "left").select(F.col("s").alias("src"), F.coalesce("up", top).alias("dst"))
    return rows.where("src <> dst").distinct()


def degree(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP) -> DataFrame:
    """(s, n): the number of neighbours of each individual that has one."""
    return edges(t, tb, relationship).groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
