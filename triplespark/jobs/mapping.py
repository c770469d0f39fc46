"""The relational tables as a graph, with its ontology."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.loops import shared_folder
from ..operators.patterns import predicate_statistics
from ..operators.tbox import TBox, load_tbox
from ..sources.tables import individuals_from_table

EX = "http://example.org/kg#"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: Classes with the class above, relationships with the one above, attributes with datatype and the one above.
CLASSES = {"Place": None, "Region": "Place", "Nation": "Place", "Party": None, "Customer": "Party", "Supplier": "Party", "Product": None, "Part": "Product", "Transaction": None, "Order": "Transaction", "Document": None, "User": None} | {s.title(): "Customer" for s in SEGMENTS}
RELATIONSHIPS = {"encloses": None, "hasNation": "encloses", "hasParty": "encloses", "hasCustomer": "hasParty", "hasSupplier": "hasParty", "isEnclosedBy": None, "inNation": "isEnclosedBy", "places": None, "placedBy": None, "orders": None, "follows": None}
INVERSES = {"encloses": "isEnclosedBy", "hasParty": "inNation", "places": "placedBy"}
ATTRIBUTES = {"number": ("integer", None), "size": ("integer", "number"), "name": ("string", None), "status": ("string", None), "balance": ("decimal", None), "date": ("dateTime", None)}
MANDATORY = {"Place": ["name"], "Party": ["name", "balance"], "Transaction": ["status"]}
OPTIONAL = {"number": "Party", "size": "Product"}


def name(x: str) -> str:
    return EX + x


def iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


_ONTOLOGIES: dict[str, TBox] = {}


def ontology(spark: SparkSession) -> TBox:
    """The ontology of the tables, loaded once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _ONTOLOGIES:
        _ONTOLOGIES[app] = load_tbox(S.triples(spark, _rows()))[0]
    return _ONTOLOGIES[app]


def _rows() -> list[tuple]:
    rows: list[tuple] = []
    for c, up in CLASSES.items():
        rows += [(name(c), S.TYPE, S.OWL + "Class"), (name(c), S.LABEL, c, S.RDF + "langString", "en")]
        rows += [(name(c), S.SUB_CLASS, name(up))] if up else []
    for r, up in RELATIONSHIPS.items():
        rows += [(name(r), S.TYPE, S.OWL + "ObjectProperty"), (name(r), S.LABEL, r, S.RDF + "langString", "en")]
        rows += [(name(r), S.SUB_PROPERTY, name(up))] if up else []
    rows += [(name(a), S.OWL + "inverseOf", name(b)) for a, b in INVERSES.items()]
    for a, (kind, up) in ATTRIBUTES.items():
        rows += [(name(a), S.TYPE, S.OWL + "DatatypeProperty"), (name(a), S.LABEL, a, S.RDF + "langString", "en")]
        rows += [(name(a), S.SUB_PROPERTY, name(up))] if up else [(name(a), S.RDFS + "range", S.XSD + kind)]
    rows += [(name("remark"), S.TYPE, S.OWL + "AnnotationProperty")]
    for c, attributes in MANDATORY.items():
        for a in attributes:
            b = f"_:{c}_{a}"
            rows += [(name(c), S.SUB_CLASS, b), (b, S.TYPE, S.OWL + "Restriction"), (b, S.OWL + "onProperty", name(a)), (b, S.OWL + "qualifiedCardinality", "1", S.XSD + "integer")]
    rows += [(name(a), S.RDFS + "domain", name(c)) for a, c in OPTIONAL.items()]
    # An order is a transaction that is placed by a customer.
    rows += [(name("Order"), S.OWL + "equivalentClass", "_:both"), ("_:both", S.TYPE, S.OWL + "Class"), ("_:both", S.OWL + "intersectionOf", "_:l1"), ("_:l1", S.RDF + "first", name("Transaction")), ("_:l1", S.RDF + "rest", "_:l2"), ("_:l2", S.RDF + "first", "_:some"), ("_:l2", S.RDF + "rest", S.RDF + "nil")]
    rows += [("_:some", S.TYPE, S.OWL + "Restriction"), ("_:some", S.OWL + "onProperty", name("placedBy")), ("_:some", S.OWL + "someValuesFrom", name("Customer"))]
    return rows


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


#: Rows of a table that one task makes into triples. All of a task's triples are sorted by predicate before they are written, so this bounds what it holds.
ROWS = 200_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` over as many tasks as their number asks for, however few files they come from."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), *keys)


_GRAPHS: dict[tuple[str, str, str], DataFrame] = {}


def graph(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The triples of the named tables; each table's are written once for each application as a store, in a folder for each predicate, so that queries read those they name."""
    parts = []
    for t in tables:
        key = (spark.sparkContext.applicationId, sf_dir, t)
        if key not in _GRAPHS:
            made = _of(spark, sf_dir, t)
            path = f"{shared_folder(spark)}/graph-{t}-{uuid.uuid4().hex}"
            made.write.partitionBy("p").parquet(path)
            _GRAPHS[key] = spark.read.schema(made.schema).parquet(path).select(*S.COLUMNS)
        parts.append(_GRAPHS[key])
    return reduce(DataFrame.unionByName, parts)


_STATISTICS: dict[tuple, DataFrame] = {}


def statistics(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The statistics of the predicates of these tables' graph, worked out once for each application and kept beside the store."""
    key = (spark.sparkContext.applicationId, sf_dir, tables)
    if key not in _STATISTICS:
        path = f"{shared_folder(spark)}/statistics-{uuid.uuid4().hex}"
        made = predicate_statistics(graph(spark, sf_dir, *tables))
        made.coalesce(1).write.parquet(path)
        _STATISTICS[key] = spark.read.schema(made.schema).parquet(path)
    return _STATISTICS[key]


def _of(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The triples of the named tables; each subject's come from one row."""
    whole_table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    read = lambda t: spread(whole_table(t), keys[t]) if t in keys else whole_table(t)
    text, whole, decimal = S.XSD + "string", S.XSD + "integer", S.XSD + "decimal"
    parts = []
    for t in tables:
        if t == "region":
            parts.append(individuals_from_table(read(t), name("Region"), iri(t, "r_regionkey"), {name("name"): (F.col("r_name"), text)}))
        elif t == "nation":
            own = individuals_from_table(read(t), name("Nation"), iri(t, "n_nationkey"), {name("name"): (F.col("n_name"), text)})
            parts += [own, S.from_structs(read(t), S.link(iri("region", "n_regionkey"), name("hasNation"), iri(t, "n_nationkey")))]
        elif t == "customer":
            cls = F.concat(F.lit(EX), F.initcap(F.lower("c_mktsegment")))
            parts.append(individuals_from_table(read(t), cls, iri(t, "c_custkey"), {name("name"): (F.col("c_name"), text), name("balance"): (money("c_acctbal"), decimal)}, {name("inNation"): iri("nation", "c_nationkey")}))
        elif t == "supplier":
            own = individuals_from_table(read(t), name("Supplier"), iri(t, "s_suppkey"), {name("name"): (F.col("s_name"), text), name("balance"): (money("s_acctbal"), decimal), name("number"): (F.col("s_suppkey"), whole)})
            parts += [own, S.from_structs(read(t), S.link(iri("nation", "s_nationkey"), name("hasSupplier"), iri(t, "s_suppkey")))]
        elif t == "part":
            parts.append(individuals_from_table(read(t), name("Part"), iri(t, "p_partkey"), {name("name"): (F.col("p_name"), text), name("number"): (F.col("p_partkey"), whole), name("size"): (F.col("p_size"), whole)}))
        elif t == "orders":
            own = individuals_from_table(read(t), name("Order"), iri("order", "o_orderkey"), {name("status"): (F.col("o_orderstatus"), text), name("date"): (F.col("o_orderdate"), S.XSD + "dateTime")})
            parts += [own, S.from_structs(read(t), S.link(iri("customer", "o_custkey"), name("places"), iri("order", "o_orderkey")))]
        elif t == "lineitem":  # which parts an order has; several lines can name one part
            parts.append(S.from_structs(spread(read(t).select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").distinct(), S.link(iri("order", "l_orderkey"), name("orders"), iri("part", "l_partkey"))))
        elif t == "documents":
            doc = iri("document", "doc_id")
            tagged = S.RDF + "langString"
            title = S.literal(doc, F.when(F.col("doc_id") % 3 == 0, S.LABEL).otherwise(S.PREF_LABEL), F.col("text"), tagged, F.coalesce("lang", F.lit("")))
            parts += [individuals_from_table(read(t), name("Document"), doc, {}), S.from_structs(read(t), title, S.literal(doc, S.LABEL, F.col("source")))]
        elif t == "events":
            user = iri("user", "user_id")
            parts.append(S.from_structs(read(t), S.link(user, S.TYPE, F.lit(name("User"))), S.literal(user, name("status"), F.col("event_type"))).distinct())
        else:
            raise ValueError(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, triple): purchases and clicks add a status to a user, errors delete the status `click`, by event_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("purchase", "click", "error"))
    triple = S.literal(iri("user", "user_id"), name("status"), F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")))
    return events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"), triple.alias("t")).select("seq", "op", "t.*")
