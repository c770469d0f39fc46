"""Selecting entities, labels and values: filters and lookups on whole graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .tbox import TBox, below, class_attributes, class_optional_attributes, class_sub_closure, entity_kinds, settled_kinds


def match(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples that fit a pattern; None fits anything."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            t = t.where(F.col(column) == value)
    return t


def types_of(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, class): declared types that the ontology knows. The types are looked up in its small table; nothing is dealt by class."""
    return t.where((F.col("p") == S.TYPE) & (F.col("s_kind") != "literal")).join(tb.individual_types, "o", "left_semi").select("s", F.col("o").alias("class"))


def individuals(t: DataFrame, tb: TBox) -> DataFrame:
    """(s): subjects with a type that the ontology declares, each once; literals aren't individuals."""
    return types_of(t, tb).select("s").distinct()


def classify_entities(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, kind): class, composition, restriction, relationship, attribute, annotation or individual; `ambiguous` if several.

    A type makes an individual if it is none of the terms of the language itself but known to the ontology.
    """
    terms = entity_kinds(t).select("s", "kind")
    language = F.col("o").startswith(S.OWL) | F.col("o").startswith(S.RDF) | F.col("o").startswith(S.RDFS)
    known = t.where((F.col("p") == S.TYPE) & (F.col("s_kind") != "literal") & (~language | F.col("o").isin(S.THING, S.OWL + "NamedIndividual")))
    own = known.join(tb.individual_types, "o", "left_semi").select("s", F.lit("individual").alias("kind"))
    return settled_kinds(terms.union(own))


def get_by_ids(t: DataFrame, tb: TBox, ids: DataFrame, cls: str | None = None) -> DataFrame:
    """(pos, id, found): for each requested (pos, id) the individual, or null if it is absent or not of the class; in order."""
    known = individuals(t, tb) if cls is None else get_by_class(t, tb, cls)
    known = known.select(F.col("s").alias("id"), F.col("s").alias("found"))
    return ids.join(known, "id", "left").select("pos", "id", "found").orderBy("pos")


def get_by_class(t: DataFrame, tb: TBox, cls: str) -> DataFrame:
    """(s): individuals of a class or a class below it, each once."""
    wanted = tb.subclasses(cls).withColumnRenamed("p", "o")
    return t.where((F.col("p") == S.TYPE) & (F.col("s_kind") != "literal")).join(wanted, "o", "left_semi").select("s").distinct()


def is_a(t: DataFrame, tb: TBox, cls: str) -> DataFrame:
    """(s, is_a) for each individual; every owl:Class lies below owl:Thing."""
    found = class_sub_closure(tb).where(F.col("super") == cls).select("sub") if cls == S.THING else tb.subclasses(cls)
    wanted = found.toDF("class").withColumn("hit", F.lit(True))
    return types_of(t, tb).join(wanted, "class", "left").groupBy("s").agg(F.max(F.coalesce("hit", F.lit(False))).alias("is_a"))


def superclasses_of(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, class): the classes of each individual and all above them."""
    return types_of(t, tb).join(tb.classes.withColumnRenamed("sub", "class"), "class").select("s", F.col("super").alias("class")).distinct()


def subclasses_of(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, class): the classes of each individual and all below them."""
    return types_of(t, tb).join(tb.classes.withColumnRenamed("super", "class"), "class").select("s", F.col("sub").alias("class")).distinct()


def in_namespace(df: DataFrame, iri: str, column: str = "s") -> DataFrame:
    """The rows whose IRI lies in a namespace, with its suffix; blank nodes never do."""
    return df.where(F.col(column).startswith(iri) & ~F.col(column).startswith("_:")).withColumn("suffix", F.substring(F.col(column), len(iri) + 1, 1 << 30))


def namespace_of(df: DataFrame, namespaces: list[tuple[str, str]], column: str = "s") -> DataFrame:
    """`df` with the name of the first bound namespace that each IRI lies in, or null."""
    name = F.lit(None).cast("string")
    for bound, iri in reversed(namespaces):
        name = F.when(F.col(column).startswith(iri) & ~F.col(column).startswith("_:"), F.lit(bound)).otherwise(name)
    return df.withColumn("namespace", name)


def labels(t: DataFrame, lang: str | None = None, predicates: tuple[str, ...] = S.LABELS) -> DataFrame:
    """(s, label, property, lang): None is any language, '' untagged labels alone."""
    found = t.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "literal"))
    if lang is not None:
        found = found.where(F.col("o_lang") == lang)
    return found.select("s", F.col("o").alias("label"), F.col("p").alias("property"), F.col("o_lang").alias("lang"))


def from_label(t: DataFrame, label: str, lang: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """(s): what has that label."""
    same = F.col("label") == label if case_sensitive else F.lower("label") == label.lower()
    return labels(t, lang).where(same).select("s").distinct()


def resolve_name(tb: TBox, iri: str, name: str) -> DataFrame:
    """(name, s, n): the entity of a namespace with that label or suffix, case counting; n other than 1 is a violation and s is null."""
    entities = in_namespace(tb.kinds.select("s"), iri)
    found = entities.where(F.col("suffix") == name).select("s").union(labels(tb.triples).where(F.col("label") == name).join(entities, "s", "left_semi").select("s"))
    found = found.agg(F.countDistinct("s").alias("n"), F.min("s").alias("s"))
    return found.select(F.lit(name).alias("name"), F.when(F.col("n") == 1, F.col("s")).alias("s"), "n")


def class_attribute_names(tb: TBox) -> DataFrame:
    """(class, p): attributes that a class demands or allows."""
    own = class_attributes(tb).select("class", "attribute").union(class_optional_attributes(tb))
    return own.select("class", F.col("attribute").alias("p")).distinct()


def resolve_predicate(t: DataFrame, tb: TBox, name: str) -> DataFrame:
    """(s, p, n) for each individual: its predicate with that label or ending; n other than 1 is a violation and p is null.

    Predicates are those it uses, and attributes of its classes.
    """
    used = t.select("s", "p").join(tb.kinds.where(F.col("kind").isin("relationship", "attribute", "annotation")).select(F.col("s").alias("p")), "p", "left_semi").select("s", "p")
    mine = types_of(t, tb).join(class_attribute_names(tb), "class").select("s", "p")
    called = labels(tb.triples).where(F.col("label") == name).select(F.col("s").alias("p"), F.lit(True).alias("called")).distinct()
    every = used.union(mine).join(called, "p", "left").where(F.col("called") | F.col("p").endswith(name))
    found = individuals(t, tb).join(every.select("s", "p").distinct(), "s", "left").groupBy("s").agg(F.count("p").alias("n"), F.min("p").alias("p"))
    return found.select("s", F.when(F.col("n") == 1, F.col("p")).alias("p"), "n")


def attribute_values(t: DataFrame, tb: TBox, attribute: str) -> DataFrame:
    """(s, o, o_dt, o_lang): distinct values of an attribute and those below it."""
    wanted = below(tb.attributes, attribute)
    return t.where(F.col("o_kind") == "literal").join(wanted, "p", "left_semi").select("s", "o", "o_dt", "o_lang").distinct()


def has_attribute_value(t: DataFrame, tb: TBox, attribute: str, value: str, datatype: str = "") -> DataFrame:
    """(s): individuals with that value; without a datatype, or for tagged text, strings are compared, else form and datatype."""
    plain = datatype in ("", S.RDF + "langString")
    same = F.col("o") == value if plain else (F.col("o") == value) & (F.col("o_dt") == datatype)
    return attribute_values(t, tb, attribute).where(same).select("s").distinct()


def attributes_in_use(t: DataFrame, tb: TBox) -> DataFrame:
    """(s, p): attributes that each subject has values of."""
    return t.join(tb.names("attribute").toDF("p"), "p", "left_semi").select("s", "p").distinct()


def annotation_values(t: DataFrame, tb: TBox, annotation: str) -> DataFrame:
    """(s, value, source): values of exactly that annotation: literals, entities of the graph or the ontology, or other IRIs; blank nodes are left out."""
    found = t.where((F.col("p") == annotation) & (F.col("o_kind") != "bnode"))
    here = individuals(t, tb).select(F.col("s").alias("o"), F.lit("graph").alias("here"))
    there = tb.kinds.select(F.col("s").alias("o"), F.lit("ontology").alias("there"))
    entities = found.where("o_kind = 'iri'").join(here, "o", "left").join(there, "o", "left").select("s", F.col("o").alias("value"), F.coalesce("here", "there", F.lit("iri")).alias("source"))
    return entities.union(found.where("o_kind = 'literal'").select("s", "o", F.lit("literal"))).distinct()


def annotation_edges(t: DataFrame, tb: TBox, *annotations: str) -> DataFrame:
    """(s, p, o): annotation links between entities, of the named annotations and those below them, or of all; unknown targets are left out."""
    wanted = below(tb.annotations, *annotations) if annotations else tb.names("annotation").toDF("p")
    known = individuals(t, tb).union(tb.kinds.select("s")).select(F.col("s").alias("o")).distinct()
    return S.links(t).join(wanted, "p", "left_semi").join(known, "o", "left_semi").select("s", "p", "o").distinct()


def preferred_label(t: DataFrame, predicates: tuple[str, ...] = S.LABELS, languages: tuple[str, ...] = ()) -> DataFrame:
    """(s, label, lang): one label for each entity: by property, then chosen language, en, untagged, any other; the shortest, then the first."""
    rank = lambda column, values, last: F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(last))
    order = (*languages, *[x for x in ("en", "") if x not in languages])
    w = F.struct(rank("property", predicates, len(predicates)).alias("a"), rank("lang", order, len(order)).alias("b"), F.length("label").alias("c"), F.col("label"), F.col("lang"))
    best = labels(t, None, predicates).groupBy("s").agg(F.min(w).alias("w"))
    return best.select("s", "w.label", "w.lang")

