"""Search from roots: what can be reached, and which of it satisfies a criterion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .loops import deal, reach
from .navigate import edges
from .select import annotation_edges, get_by_class, has_attribute_value, individuals
from .tbox import TBox, below


def search_edges(t: DataFrame, tb: TBox, relationships: Iterable[str] = (S.TOP_RELATIONSHIP,), annotations: bool | Iterable[str] = True) -> DataFrame:
    """(src, dst) through relationships with those below them and their inverses, and annotation links (all, none or some)."""
    out = edges(t, tb, *relationships)
    if annotations is not False:
        names = () if annotations is True else tuple(annotations)
        out = out.union(annotation_edges(t, tb, *names).select(F.col("s").alias("src"), F.col("o").alias("dst"))).distinct()
    return out.join(individuals(t, tb).toDF("dst"), "dst", "left_semi").select("src", "dst")


def find(t: DataFrame, tb: TBox, roots: DataFrame, criterion: DataFrame | None = None, relationships: Iterable[str] = (S.TOP_RELATIONSHIP,), annotations: bool | Iterable[str] = True, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): individuals reached from each root (s) that are in `criterion` (s); the root itself at depth 0.

    Each node comes once at its least depth. A criterion is any DataFrame with the column s.
    """
    walk = deal(search_edges(t, tb, relationships, annotations))
    found = reach(roots.select(F.col("s").alias("root"), F.col("s").alias("node")), walk, max_depth)
    return found if criterion is None else found.join(criterion.select(F.col("s").alias("node")), "node", "left_semi").select("root", "node", "depth")


def find_first(t: DataFrame, tb: TBox, roots: DataFrame, criterion: DataFrame, relationships: Iterable[str] = (S.TOP_RELATIONSHIP,), annotations: bool | Iterable[str] = True, max_depth: int | None = None) -> DataFrame:
    """(root, node): the nearest match of each root, the first by name of equals, or null. A root stops searching once it has a match."""
    walk = deal(search_edges(t, tb, relationships, annotations))
    wanted = criterion.select(F.col("s").alias("node")).distinct()
    found = reach(roots.select(F.col("s").alias("root"), F.col("s").alias("node")), walk, max_depth, wanted)
    best = found.join(wanted, "node", "left_semi").groupBy("root").agg(F.min(F.struct("depth", "node")).alias("m"))
    return roots.select(F.col("s").alias("root")).distinct().join(best, "root", "left").select("root", F.col("m.node").alias("node"))


def find_by_identifier(t: DataFrame, tb: TBox, roots: DataFrame, identifier: str, **options) -> DataFrame:
    """(root, node): `identifier` where it can be reached, else null."""
    return find_first(t, tb, roots, individuals(t, tb).where(F.col("s") == identifier), **options)


def find_by_class(t: DataFrame, tb: TBox, roots: DataFrame, cls: str, **options) -> DataFrame:
    """(root, node, depth): reached individuals of a class or one below it."""
    return find(t, tb, roots, get_by_class(t, tb, cls), **options)


def find_by_attribute(t: DataFrame, tb: TBox, roots: DataFrame, attribute: str, value: str, datatype: str = "", **options) -> DataFrame:
    """(root, node, depth): reached individuals with that value of the attribute or one below it."""
    return find(t, tb, roots, has_attribute_value(t, tb, attribute, value, datatype), **options)


def find_relationships(t: DataFrame, tb: TBox, roots: DataFrame, relationship: str, find_sub: bool = False, **options) -> DataFrame:
    """(root, node, depth): reached individuals with an outgoing link of that relationship, or with `find_sub` of one below it."""
    wanted = below(tb.relationships, relationship)
    if not find_sub:
        wanted = wanted.where(F.col("p") == relationship)
    return find(t, tb, roots, S.links(t).join(wanted, "p", "left_semi").select("s").distinct(), **options)
