"""Navigation: neighbours through relationships, links, patterns and containers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import patterns as patterns_
from .select import get_by_class, individuals
from .tbox import TBox, below, inverses


def _roles(tb: TBox, names: tuple[str, ...], inverse: bool) -> DataFrame:
    """(p, forward, backward): which way a link with predicate p leads for the named relationships and those below them."""
    own = below(tb.relationships, *names)
    other = own.join(inverses(tb), "p").select(F.col("inverse").alias("p"))
    forward, backward = (other, own) if inverse else (own, other)
    rows = forward.select("p", F.lit(1).alias("f"), F.lit(0).alias("b")).union(backward.select("p", F.lit(0), F.lit(1)))
    return rows.groupBy("p").agg(F.max("f").alias("forward"), F.max("b").alias("backward"))


def edges(t: DataFrame, tb: TBox, *relationships: str, inverse: bool = False) -> DataFrame:
    """(src, dst), distinct: links through the relationships and those below them, and links through their declared inverses the other way.

    One pass over the graph: the small table of roles says for each predicate which way it leads.
    """
    both = S.links(t).join(_roles(tb, relationships, inverse), "p")
    ways = F.array(F.when(F.col("forward") == 1, F.struct(F.col("s").alias("src"), F.col("o").alias("dst"))), F.when(F.col("backward") == 1, F.struct(F.col("o").alias("src"), F.col("s").alias("dst"))))
    return both.select(F.explode(F.array_compact(ways)).alias("e")).select("e.src", "e.dst").distinct()


def neighbors(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP, cls: str | None = None, ids: DataFrame | None = None, inverse: bool = False) -> DataFrame:
    """(s, neighbor) for each individual; with `ids` (pos, s, id) one row for each request, null where it isn't a neighbour.

    Neighbours are individuals of the graph, of the class `cls` if one is given.
    """
    found = edges(t, tb, relationship, inverse=inverse)
    known = individuals(t, tb) if cls is None else get_by_class(t, tb, cls)
    found = found.join(known.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("s"), F.col("dst").alias("neighbor"))
    if ids is None:
        return found
    return ids.join(found.withColumn("id", F.col("neighbor")), ["s", "id"], "left").select("pos", "s", "id", "neighbor").orderBy("pos")


def neighbors_with_rel(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP) -> DataFrame:
    """(s, neighbor, relationship): direct links alone, with the predicate that makes them."""
    return S.links(t).join(below(tb.relationships, relationship), "p", "left_semi").select("s", F.col("o").alias("neighbor"), F.col("p").alias("relationship")).distinct()


def links(t: DataFrame, tb: TBox, relationship: str | None = None) -> DataFrame:
    """(s, p, o): links by relationships as they are stored, to individuals of the graph."""
    found = S.links(t).join(tb.names("relationship").toDF("p"), "p", "left_semi")
    if relationship is not None:
        found = found.where(F.col("p") == relationship)
    return found.join(individuals(t, tb).toDF("o"), "o", "left_semi").select("s", "p", "o").distinct()


def relationships_between(t: DataFrame, tb: TBox, pairs: DataFrame) -> DataFrame:
    """(s, o, relationships): sorted relationships that link each (s, o) of `pairs`; empty if there are none."""
    found = S.links(t).join(tb.names("relationship").toDF("p"), "p", "left_semi").select("s", "o", "p")
    return pairs.select("s", "o").distinct().join(found, ["s", "o"], "left").groupBy("s", "o").agg(F.sort_array(F.collect_set("p")).alias("relationships"))


def bgp(t: DataFrame, patterns: list[patterns_.Pattern], filters: list[Column] = (), distinct: bool = True, how: tuple[patterns_.Join, ...] = (), statistics: DataFrame | None = None) -> DataFrame:
    """Rows for which all patterns hold, with the columns x, x_kind, x_dt and x_lang of each variable ?x.

    Terms are compared as wholes; `how` joins optional, alternative and excluded patterns, and
    `statistics` of the predicates order the joins (see `patterns.select`).
    """
    return patterns_.select(t, patterns, tuple(how), tuple(filters), distinct, statistics)


def path_star(t: DataFrame, closure: DataFrame, p: str) -> DataFrame:
    """(s, o): one step p, then any number of steps of `closure` (sub, super)."""
    return S.links(match_p(t, p)).select("s", F.col("o").alias("sub")).join(closure, "sub").select("s", F.col("super").alias("o")).distinct()


def match_p(t: DataFrame, p: str) -> DataFrame:
    """The triples of one predicate."""
    return t.where(F.col("p") == p)


def ask(t: DataFrame, patterns: list[patterns_.Pattern], **options) -> bool:
    """Whether the patterns hold anywhere."""
    return patterns_.ask(t, patterns, **options)


def construct(t: DataFrame, patterns: list[patterns_.Pattern], template: list[patterns_.Pattern], **options) -> DataFrame:
    """The triples that the template makes of each row of the patterns; variables keep their whole terms."""
    return patterns_.construct(t, patterns, template, **options)


def describe(t: DataFrame, entities: DataFrame) -> DataFrame:
    """All triples whose subject is one of `entities` (s)."""
    return t.join(entities.select("s"), "s", "left_semi").select(*S.COLUMNS)


def container_references(t: DataFrame) -> DataFrame:
    """(container, reference): what containers link to, present or not."""
    return match_p(t, S.CONTAINS).select(F.col("s").alias("container"), F.col("o").alias("reference")).distinct()


def container_members(t: DataFrame, tb: TBox) -> DataFrame:
    """(container, member): references that are individuals of the graph."""
    return container_references(t).withColumnRenamed("reference", "member").join(individuals(t, tb).toDF("member"), "member", "left_semi").select("container", "member")


def container_counts(t: DataFrame, tb: TBox) -> DataFrame:
    """(container, num_references, num_members)."""
    member = individuals(t, tb).select(F.col("s").alias("reference"), F.lit(1).alias("here"))
    return container_references(t).join(member, "reference", "left").groupBy("container").agg(F.count("*").alias("num_references"), F.count("here").alias("num_members"))


def container_contains(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """(container, reference, contains) for each (container, reference) asked for."""
    here = container_references(t).withColumn("here", F.lit(True))
    return pairs.select("container", "reference").distinct().join(here, ["container", "reference"], "left").select("container", "reference", F.coalesce("here", F.lit(False)).alias("contains"))


def apply_by_class(t: DataFrame, tb: TBox, operations: list[tuple[str, str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(operation, *what the functions return): each (class, name, function) applied to the individuals (s) of its class and those below it.

    Two functions of the same class and name are an error.
    """
    names = [(c, n) for c, n, _ in operations]
    if len(set(names)) < len(names):
        raise ValueError("two operations of one class have the same name")
    parts = [f(get_by_class(t, tb, c)).withColumn("operation", F.lit(n)) for c, n, f in operations]
    return reduce(lambda a, b: a.unionByName(b), parts)
