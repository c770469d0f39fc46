"""Individuals from the rows of ordinary tables, and checks of imported and exported graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.select import individuals, labels
from ..operators.tbox import TBox, attribute_datatypes, class_attributes, class_optional_attributes


def attribute_columns(tb: TBox, cls: str, columns: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(column to attribute, mandatory attributes without a column, unexpected columns); columns are matched by label or suffix."""
    mandatory = {r["attribute"] for r in class_attributes(tb).where(F.col("class") == cls).collect()}
    allowed = mandatory | {r["attribute"] for r in class_optional_attributes(tb).where(F.col("class") == cls).collect()}
    called: dict[str, str] = {}
    for r in labels(tb.triples).where(F.col("s").isin(*allowed)).collect() if allowed else ():
        called[r["label"]] = r["s"]
    found = {c: called.get(c) or next((a for a in sorted(allowed) if a.replace("/", "#").rsplit("#", 1)[-1] == c), None) for c in columns}
    known = {c: a for c, a in found.items() if a}
    return known, sorted(mandatory - set(known.values())), [c for c in columns if not found[c]]


def individuals_from_table(df: DataFrame, cls: str | Column, subject: Column, attributes: dict[str, tuple[Column, str]], links: dict[str, Column] | None = None) -> DataFrame:
    """The triples of one typed individual for each row: its type, a literal for each attribute (value, datatype), a link for each relationship.

    A null value is an attribute that isn't given; a row without a subject is left out.
    """
    made = [S.link(subject, S.TYPE, F.lit(cls) if isinstance(cls, str) else cls)]
    made += [S.literal(subject, a, value, datatype) for a, (value, datatype) in attributes.items()]
    made += [S.link(subject, p, o) for p, o in (links or {}).items()]
    return S.from_structs(df, *made)


def create_individuals(df: DataFrame, tb: TBox, cls: str, subject: Column, columns: list[str], force: bool = False) -> DataFrame:
    """Like `individuals_from_table`, with columns matched to the class's attributes.

    Missing mandatory attributes and unexpected columns are errors; with `force` defaults fill in and such columns are left out.
    """
    known, missing, unexpected = attribute_columns(tb, cls, columns)
    if (missing or unexpected) and not force:
        raise ValueError(f"missing: {missing}, unexpected: {unexpected}")
    kinds = {r["attribute"]: r["datatype"] or S.XSD + "string" for r in attribute_datatypes(tb).collect()}
    values = {a: (F.col(c).cast("string"), kinds.get(a, S.XSD + "string")) for c, a in known.items()}
    if force:
        for r in class_attributes(tb).where((F.col("class") == cls) & F.col("default").isNotNull()).collect():
            old = values.get(r["attribute"], (F.lit(None).cast("string"), kinds[r["attribute"]]))
            values[r["attribute"]] = (F.coalesce(old[0], F.lit(r["default"])), old[1])
    return individuals_from_table(df, cls, subject, values)


def missing_mandatory(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, attribute): individuals without a value of an attribute that a class of theirs demands."""
    types = t.where(F.col("p") == S.TYPE).select("s", F.col("o").alias("class"))
    wanted = types.join(class_attributes(tb).select("class", "attribute"), "class").select("s", "attribute").distinct()
    return wanted.join(t.select("s", F.col("p").alias("attribute")).distinct(), ["s", "attribute"], "left_anti")


#: Types that make terms of an ontology, which graphs of individuals can't hold.
TERMS = tuple(S.OWL + x for x in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Restriction")) + (S.RDFS + "Class", S.RDF + "Property")


def check_import(t: DataFrame, tb: TBox, all_triples: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(s, p, o, violation, severity): statements that can't be taken in.

    Terms of an ontology are errors; a type that the ontology doesn't know, and a relationship
    whose target isn't an individual (of `targets`, or of the graph), are warnings with
    `all_triples` and else errors.
    """
    types = t.where((F.col("p") == S.TYPE) & (F.col("s_kind") != "literal"))
    terms = types.where(F.col("o").isin(*TERMS)).select("s", "p", "o", F.lit("ontology term").alias("violation"), F.lit("error").alias("severity"))
    severity = F.lit("warning" if all_triples else "error")
    unknown = types.where(~F.col("o").isin(*TERMS)).join(tb.individual_types, "o", "left_anti").select("s", "p", "o", F.lit("unknown type"), severity)
    known = (individuals(t, tb) if targets is None else targets).select(F.col("s").alias("o"))
    dangling = S.links(t).join(tb.names("relationship").toDF("p"), "p", "left_semi").join(known, "o", "left_anti").select("s", "p", "o", F.lit("missing target"), severity)
    out = terms.union(unknown)
    return out if all_triples else out.union(dangling)


def import_triples(t: DataFrame, tb: TBox, scope: str = "individuals") -> DataFrame:
    """What an import keeps: the individuals' relevant triples, `all_triples` of individuals, or `all_statements`."""
    from ..operators.update import relevant

    if scope == "all_statements":
        return t.select(*S.COLUMNS)
    if scope == "all_triples":
        return t.join(individuals(t, tb), "s", "left_semi").select(*S.COLUMNS)
    return relevant(t, tb).distinct()


def export_triples(t: DataFrame, tb: TBox, scope: str = "individuals", chosen: DataFrame | None = None, main: str | None = None) -> DataFrame:
    """What an export writes: `import_triples` of the graph, or of the individuals `chosen` (s), without links that leave them; `main` is flagged."""
    if chosen is not None:
        inside = chosen.select("s").distinct()
        rel = tb.names("relationship").select(F.col("s").alias("p"), F.lit(True).alias("rel"))
        here = inside.select(F.col("s").alias("o"), F.lit(True).alias("here"))
        own = t.join(inside, "s", "left_semi").join(rel, "p", "left").join(here, "o", "left")
        t = own.where(F.col("rel").isNull() | (F.col("o_kind") == "literal") | F.col("here").isNotNull()).select(*S.COLUMNS)
    out = import_triples(t, tb, scope)
    flag = [(main, S.MAIN, "true", S.XSD + "boolean")] if main else []
    return S.union(out, S.triples(t.sparkSession, flag)) if flag else out
