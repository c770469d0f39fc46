"""The table of triples and the names it uses.

A graph is a DataFrame with the columns below, one row for each triple, no row twice. Absent
datatypes and languages are empty strings rather than nulls, so that joins, distinct and
anti-joins agree on what is equal.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in COLUMNS])

# Fixed names of public vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
# Names of this library.
GRAPH = "http://triplespark.example/graph#"
ENTITY = "http://triplespark.example/entity#"
VECTOR = "http://triplespark.example/types#Vector"

TYPE, LABEL, PREF_LABEL = RDF + "type", RDFS + "label", SKOS + "prefLabel"
SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
THING, TOP_RELATIONSHIP, TOP_ATTRIBUTE = OWL + "Thing", OWL + "topObjectProperty", OWL + "topDataProperty"
CONTAINS, MAIN, FILE = GRAPH + "contains", GRAPH + "main", GRAPH + "File"
LABELS = (PREF_LABEL, LABEL)


def kind_of(term: Column) -> Column:
    """iri or bnode, by the prefix of blank nodes."""
    return F.when(term.startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri"))


def link(s: Column, p: Column | str, o: Column) -> Column:
    """A triple between two entities, as a struct."""
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), kind_of(s).alias("s_kind"), p.alias("p"), o.alias("o"), kind_of(o).alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


def literal(s: Column, p: Column | str, value: Column, datatype: Column | str = XSD + "string", lang: Column | str = "") -> Column:
    """A triple with a literal, as a struct; `value` is its lexical form."""
    p, datatype, lang = (F.lit(x) if isinstance(x, str) else x for x in (p, datatype, lang))
    return F.struct(s.alias("s"), kind_of(s).alias("s_kind"), p.alias("p"), value.cast("string").alias("o"), F.lit("literal").alias("o_kind"), datatype.alias("o_dt"), lang.alias("o_lang"))


def from_structs(df: DataFrame, *structs: Column) -> DataFrame:
    """The triples that `structs` make of each row; those with a null subject or object are left out."""
    rows = df.select(F.explode(F.array(*structs)).alias("t")).select("t.*")
    return rows.where(F.col("s").isNotNull() & F.col("o").isNotNull()).select(*[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])


def triples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small graph from tuples (s, p, o) of entities or (s, p, value, datatype[, language]) with literals."""
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    full = [(r[0], kind(r[0]), r[1], str(r[2]), kind(r[2]) if len(r) == 3 else "literal", r[3] if len(r) > 3 else "", r[4] if len(r) > 4 else "") for r in rows]
    return local(spark, full, COLUMNS)


def local(spark: SparkSession, rows: list[tuple], names: tuple[str, ...], kinds: dict[str, pa.DataType] | None = None) -> DataFrame:
    """A small table (of strings, but for `kinds`) that is part of the plan itself, so that its size is known and joins with it are broadcast."""
    kinds = kinds or {}
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)}))


def links(t: DataFrame) -> DataFrame:
    """Triples whose object is an entity."""
    return t.where(F.col("o_kind") != "literal")


def union(*graphs: DataFrame) -> DataFrame:
    """One graph of several, each triple once."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return out.distinct()
