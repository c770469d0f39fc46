"""Queries over the tables, and the SQL that gives the same rows on the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as X
from ..operators import aggregate as A
from ..operators import isomorphism as I
from ..operators import navigate as N
from ..operators import patterns as G
from ..operators import search as R
from ..operators import select as P
from ..operators import tbox as T
from ..operators import update as U
from ..operators.loops import shared_folder
from ..operators.subsumption import Subsumption
from ..sources import rdf, store, tables, turtle
from .mapping import EX, SEGMENTS, changelog, graph, iri, name, ontology, statistics

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(label: str, sql: str):
    """Registers a query with its SQL; `{E}` in it is the namespace."""

    def keep(f):
        QUERIES[label] = (f, sql.replace("{E}", EX).replace("{TYPE}", S.TYPE).replace("{XSD}", S.XSD))
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


SEGMENT = "'{E}' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"
PARTIES = "select '{E}customer/' || c_custkey as s from customer union all select '{E}supplier/' || s_suppkey from supplier"
PLACES = "select '{E}region/' || r_regionkey as s from region union all select '{E}nation/' || n_nationkey from nation"


@query("s9_individuals_from_table", """select '{E}nation/' || n_nationkey as s, '{TYPE}' as p, '{E}Nation' as o, '' as o_dt from nation
union all select '{E}nation/' || n_nationkey, '{E}name', n_name, '{XSD}string' from nation
union all select '{E}region/' || n_regionkey, '{E}hasNation', '{E}nation/' || n_nationkey, '' from nation
union all select '{E}customer/' || c_custkey, '{TYPE}', """ + SEGMENT + """, '' from customer
union all select '{E}customer/' || c_custkey, '{E}name', c_name, '{XSD}string' from customer
union all select '{E}customer/' || c_custkey, '{E}balance', cast(cast(c_acctbal as decimal(18,2)) as varchar), '{XSD}decimal' from customer
union all select '{E}customer/' || c_custkey, '{E}inNation', '{E}nation/' || c_nationkey, '' from customer""")
def s9(spark, d):
    return graph(spark, d, "nation", "customer").select("s", "p", "o", "o_dt")


def dirty(spark, d):
    """Orders of which every seventh is placed by a customer that doesn't exist and every eleventh has a type of its own."""
    orders = table(spark, d, "orders")
    bad = orders.where("o_orderkey % 7 = 0")
    odd = orders.where("o_orderkey % 11 = 0")
    return graph(spark, d, "orders", "customer").unionByName(S.from_structs(bad, S.link(iri("order", "o_orderkey"), name("placedBy"), iri("nobody", "o_orderkey")))).unionByName(S.from_structs(odd, S.link(iri("odd", "o_orderkey"), S.TYPE, F.lit(name("Odd")))))


@query("s3_check_import", """select '{E}order/' || o_orderkey as s, '{E}placedBy' as p, '{E}nobody/' || o_orderkey as o, 'missing target' as violation, 'error' as severity from orders where o_orderkey % 7 = 0
union all select '{E}odd/' || o_orderkey, '{TYPE}', '{E}Odd', 'unknown type', 'error' from orders where o_orderkey % 11 = 0
union all select '{E}customer/' || c_custkey, '{E}inNation', '{E}nation/' || c_nationkey, 'missing target', 'error' from customer""")
def s3(spark, d):
    return tables.check_import(dirty(spark, d), ontology(spark))


@query("s4_import_triples", """with n as (select count(*) as o from orders), c as (select count(*) as c from customer)
select '{TYPE}' as p, o + c as n from n, c union all select '{E}status', o from n union all select '{E}date', o from n union all select '{E}places', o from n union all select '{E}name', c from c union all select '{E}balance', c from c""")
def s4(spark, d):
    return tables.import_triples(dirty(spark, d), ontology(spark)).groupBy("p").agg(F.count("*").alias("n"))


@query("s5_main_individual", "select min('{E}customer/' || c_custkey) as s from customer where c_acctbal < 0")
def s5(spark, d):
    """All customers in debt are flagged, of whom the first by name, as text, is taken."""
    t, tb = graph(spark, d, "nation", "customer"), ontology(spark)
    debtors = table(spark, d, "customer").where("c_acctbal < 0")
    flags = S.from_structs(debtors, S.literal(iri("customer", "c_custkey"), S.MAIN, F.lit("true"), S.XSD + "boolean"))
    return rdf.main_individual(t.unionByName(flags), P.individuals(t, tb))


@query("s6_export_triples", "select '{TYPE}' as p, (select count(*) from region) + (select count(*) from nation) as n union all select '{E}name', (select count(*) from region) + (select count(*) from nation) union all select '{E}hasNation', count(*) from nation union all select '" + S.MAIN + "', 1")
def s6(spark, d):
    t, tb = graph(spark, d, "region", "nation", "supplier"), ontology(spark)
    out = tables.export_triples(t, tb, chosen=P.get_by_class(t, tb, name("Place")), main=EX + "region/0")
    return out.groupBy("p").agg(F.count("*").alias("n"))


@query("s6_export_rows", "select '{E}customer/' || c_custkey as s, '{TYPE}' as p, " + SEGMENT + " as o from customer union all select '{E}customer/' || c_custkey, '{E}name', c_name from customer union all select '{E}customer/1', '" + S.MAIN + "', 'true'")
def s6_rows(spark, d):
    """All triples of an export of the customers, but for their balances: links to nations, which aren't chosen, stay behind."""
    t, tb = graph(spark, d, "nation", "customer", "supplier"), ontology(spark)
    out = tables.export_triples(t, tb, chosen=P.get_by_class(t, tb, name("Customer")), main=EX + "customer/1")
    return out.where(F.col("p") != name("balance")).select("s", "p", "o")


@query("s1_s7_ntriples", "select '{E}part/' || p_partkey as s, p_name as o, '{XSD}string' as o_dt from part union all select '{E}part/' || p_partkey, cast(p_size as varchar), '{XSD}integer' from part")
def s1(spark, d):
    back = rdf.parse_ntriples(rdf.ntriples_lines(graph(spark, d, "part")))
    return back.where(F.col("p").isin(name("name"), name("size"))).select("s", "o", "o_dt")


@query("s1_s7_escapes", "select distinct '{E}document/' || doc_id as s, text as o, coalesce(lang, '') as o_lang from documents where text is not null")
def s1_escapes(spark, d):
    back = rdf.parse_ntriples(rdf.ntriples_lines(graph(spark, d, "documents")))
    return back.where(F.col("o_dt") == S.RDF + "langString").select("s", "o", "o_lang")


@query("s2_s7_jsonld", "select '{E}supplier/' || s_suppkey as s, '{E}name' as p, s_name as o, '{XSD}string' as o_dt from supplier union all select '{E}nation/' || s_nationkey, '{E}hasSupplier', '{E}supplier/' || s_suppkey, '' from supplier")
def s2(spark, d):
    back = rdf.parse_jsonld_lines(rdf.jsonld_nodes(graph(spark, d, "supplier")))
    return back.where(F.col("p").isin(name("name"), name("hasSupplier"))).select("s", "p", "o", "o_dt")


def files(spark, what):
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("s1_s7_turtle", "select '{E}customer/' || c_custkey as s, '{TYPE}' as p, " + SEGMENT + """ as o, '' as o_dt from customer
union all select '{E}customer/' || c_custkey, '{E}name', c_name, '{XSD}string' from customer
union all select '{E}customer/' || c_custkey, '{E}balance', cast(cast(c_acctbal as decimal(18,2)) as varchar), '{XSD}decimal' from customer
union all select '{E}customer/' || c_custkey, '{E}inNation', '{E}nation/' || c_nationkey, '' from customer""")
def s1_turtle(spark, d):
    path = files(spark, "turtle")
    turtle.write_turtle(graph(spark, d, "customer"), path, {"ex": EX, "xsd": S.XSD})
    return turtle.read_turtle(spark, path).select("s", "p", "o", "o_dt")


@query("s1_s7_turtle_texts", "select distinct '{E}document/' || doc_id as s, text as o, coalesce(lang, '') as o_lang from documents where text is not null")
def s1_turtle_texts(spark, d):
    path = files(spark, "turtle")
    turtle.write_turtle(graph(spark, d, "documents"), path, {"ex": EX})
    return turtle.read_turtle(spark, path).where(F.col("o_dt") == S.RDF + "langString").select("s", "o", "o_lang")


@query("s1_turtle_nodes", """select '{E}part/' || p_partkey as s, '{E}list' as p, cast(p_size as varchar) as first, p_name as second, '{XSD}integer' as first_dt from part""")
def s1_turtle_nodes(spark, d):
    # Statements over several lines, with lists, nodes without a name and long strings, made of a table.
    path = files(spark, "turtle")
    text = F.concat(F.lit("@prefix ex: <" + EX + "> . # names\n<" + EX + "part/"), F.col("p_partkey"), F.lit("> ex:list ( "), F.col("p_size"), F.lit(' [ ex:says \"\"\"'), F.col("p_name"), F.lit('\"\"\" ] ) ;\n  a ex:Part .'))
    table(spark, d, "part").select(text).write.text(path)
    t = turtle.read_turtle(spark, path)
    first, rest = S.RDF + "first", S.RDF + "rest"
    rows = N.bgp(t, [("?s", name("list"), "?l"), ("?l", first, "?first"), ("?l", rest, "?m"), ("?m", first, "?n"), ("?m", rest, S.RDF + "nil"), ("?n", name("says"), "?second")])
    return rows.select("s", F.lit(name("list")).alias("p"), "first", "second", "first_dt")


def strange(spark, d):
    """Identifiers with characters that IRIs can't hold as they are."""
    odd = F.concat(F.lit(EX + "odd>/"), F.col("p_name"), F.lit("\\|<{}^`"), F.col("p_partkey"))
    return S.from_structs(table(spark, d, "part"), S.link(odd, name("of"), iri("part", "p_partkey")), S.literal(odd, name("name"), F.col("p_name")))


STRANGE = "select '{E}odd>/' || p_name || '\\|<{}^`' || p_partkey as s, '{E}of' as p, '{E}part/' || p_partkey as o from part union all select '{E}odd>/' || p_name || '\\|<{}^`' || p_partkey, '{E}name', p_name from part"


@query("s7_ntriples_strange", STRANGE)
def s7_strange(spark, d):
    path = files(spark, "ntriples")
    rdf.write_ntriples(strange(spark, d), path)
    return rdf.read_ntriples(spark, path).select("s", "p", "o")


@query("s7_turtle_strange", STRANGE)
def s7_turtle_strange(spark, d):
    path = files(spark, "turtle")
    turtle.write_turtle(strange(spark, d), path, {"ex": EX})
    return turtle.read_turtle(spark, path).select("s", "p", "o")


@query("s10_mint_iri", "select distinct user_id, '" + S.ENTITY + "' || left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as iri from (select user_id, format('{:032x}', user_id) as h from events)")
def s10(spark, d):
    return table(spark, d, "events").select("user_id", X.mint_iri(F.col("user_id"), "int").alias("iri")).distinct()


@query("p1_match", "select '{E}supplier/' || s_suppkey as s, s_name as o from supplier")
def p1(spark, d):
    return P.match(graph(spark, d, "supplier"), p=name("name")).select("s", "o")


@query("p2_classify_entities", "select s, 'individual' as kind from (" + PLACES + " union all " + PARTIES + ")")
def p2(spark, d):
    return P.classify_entities(graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark))


@query("p3_individuals", PLACES + " union all " + PARTIES)
def p3(spark, d):
    return P.individuals(graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark))


@query("p4_get_by_ids", "select event_id as pos, '{E}customer/' || (user_id * 3) as id, '{E}customer/' || c_custkey as found from events left join customer on c_custkey = user_id * 3 and c_mktsegment = 'BUILDING'")
def p4(spark, d):
    ids = table(spark, d, "events").select(F.col("event_id").alias("pos"), iri("customer", F.col("user_id") * 3).alias("id"))
    return P.get_by_ids(graph(spark, d, "customer"), ontology(spark), ids, name("Building"))


@query("p5_get_by_class", PARTIES)
def p5(spark, d):
    return P.get_by_class(graph(spark, d, "customer", "supplier", "nation"), ontology(spark), name("Party"))


@query("p6_is_a", "select s, s like '%customer/%' as is_a from (" + PARTIES + ")")
def p6(spark, d):
    return P.is_a(graph(spark, d, "customer", "supplier"), ontology(spark), name("Customer"))


UP = "with recursive up(sub, super) as (values ('{E}Customer', '{E}Party'), ('{E}Supplier', '{E}Party')" + "".join(f", ('{{E}}{s.title()}', '{{E}}Customer')" for s in SEGMENTS) + "), closure(sub, super) as (select sub, sub from up union select sub, super from up union select c.sub, u.super from closure c join up u on c.super = u.sub), thing as (select * from closure union select sub, '" + S.THING + "' from closure)"


@query("p7_superclasses_of", UP + ", own as (select '{E}customer/' || c_custkey as s, " + SEGMENT + " as c from customer union all select '{E}supplier/' || s_suppkey, '{E}Supplier' from supplier) select s, super as class from own join thing on sub = c")
def p7(spark, d):
    return P.superclasses_of(graph(spark, d, "customer", "supplier"), ontology(spark))


@query("p7_subclasses_of", "select '{E}customer/' || c_custkey as s, " + SEGMENT + " as class from customer union all select '{E}supplier/' || s_suppkey, '{E}Supplier' from supplier")
def p7_sub(spark, d):
    return P.subclasses_of(graph(spark, d, "customer", "supplier"), ontology(spark))


@query("p8_namespaces", "select '{E}customer/' || c_custkey as s, 'customer/' || c_custkey as suffix, 'customers' as namespace from customer union all select '{E}nation/' || n_nationkey, 'nation/' || n_nationkey, 'kg' from nation")
def p8(spark, d):
    t = P.individuals(graph(spark, d, "customer", "nation"), ontology(spark))
    return P.namespace_of(P.in_namespace(t, EX), [("customers", EX + "customer/"), ("kg", EX)])


@query("p9_labels", "select '{E}document/' || doc_id as s, text as label, coalesce(lang, '') as lang from documents where lang = 'de' and text is not null")
def p9(spark, d):
    return P.labels(graph(spark, d, "documents"), "de").select("s", "label", "lang")


@query("p10_from_label", "select '{E}document/' || doc_id as s from documents where lower(source) = 'src3' or lower(text) = 'src3'")
def p10(spark, d):
    return P.from_label(graph(spark, d, "documents"), "SRC3")


@query("p12_resolve_predicate", "select s, '{E}name' as p, 1 as n from (" + PARTIES + ")")
def p12(spark, d):
    return P.resolve_predicate(graph(spark, d, "customer", "supplier"), ontology(spark), "name")


@query("p13_attribute_values", "select distinct '{E}part/' || p_partkey as s, v as o from (select p_partkey, cast(p_partkey as varchar) as v from part union select p_partkey, cast(p_size as varchar) from part)")
def p13(spark, d):
    return P.attribute_values(graph(spark, d, "part"), ontology(spark), name("number")).select("s", "o")


@query("p14_has_attribute_value", "select '{E}part/' || p_partkey as s from part where p_size = 11 or p_partkey = 11")
def p14(spark, d):
    return P.has_attribute_value(graph(spark, d, "part"), ontology(spark), name("number"), "11", S.XSD + "integer")


@query("p15_attributes_in_use", "select '{E}name' as p, (select count(*) from customer) + (select count(*) from supplier) as n union all select '{E}balance', (select count(*) from customer) + (select count(*) from supplier) union all select '{E}number', count(*) from supplier")
def p15(spark, d):
    return P.attributes_in_use(graph(spark, d, "customer", "supplier"), ontology(spark)).groupBy("p").agg(F.count("*").alias("n"))


def remarked(spark, d):
    """Suppliers remark on their nation, on a name, on their class, and on a page of no graph."""
    own = lambda o: S.link(iri("supplier", "s_suppkey"), name("remark"), o)
    made = S.from_structs(table(spark, d, "supplier"), own(iri("nation", "s_nationkey")), own(F.lit(name("Supplier"))), own(iri("page", "s_suppkey")), S.literal(iri("supplier", "s_suppkey"), name("remark"), F.col("s_name")))
    return graph(spark, d, "nation", "supplier").unionByName(made)


@query("p16_annotation_values", "select '{E}supplier/' || s_suppkey as s, '{E}nation/' || s_nationkey as value, 'graph' as source from supplier union all select '{E}supplier/' || s_suppkey, '{E}Supplier', 'ontology' from supplier union all select '{E}supplier/' || s_suppkey, '{E}page/' || s_suppkey, 'iri' from supplier union all select '{E}supplier/' || s_suppkey, s_name, 'literal' from supplier")
def p16(spark, d):
    return P.annotation_values(remarked(spark, d), ontology(spark), name("remark"))


@query("p17_annotation_edges", "select '{E}supplier/' || s_suppkey as s, '{E}nation/' || s_nationkey as o from supplier union all select '{E}supplier/' || s_suppkey, '{E}Supplier' from supplier")
def p17(spark, d):
    return P.annotation_edges(remarked(spark, d), ontology(spark), name("remark")).select("s", "o")


@query("t7_missing_mandatory", "select '{E}order/' || o_orderkey as s, '{E}status' as attribute from orders where o_orderkey % 5 = 0")
def t7(spark, d):
    t = graph(spark, d, "orders", "customer")
    fifth = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(iri("order", "o_orderkey").alias("s"), F.lit(name("status")).alias("p"))
    return tables.missing_mandatory(t.join(fifth, ["s", "p"], "left_anti").select(*S.COLUMNS), ontology(spark))


@query("t8_optional_attributes", "select s, '{E}number' as attribute from (" + PARTIES + ")")
def t8(spark, d):
    types = P.types_of(graph(spark, d, "customer", "supplier"), tb := ontology(spark))
    return types.join(T.class_optional_attributes(tb), "class").select("s", "attribute")


@query("t9_axioms", "select s, case when s like '%supplier/%' then 2 else 2 end as n from (" + PARTIES + ") union all select '{E}order/' || o_orderkey, 2 from orders")
def t9(spark, d):
    types = P.types_of(graph(spark, d, "customer", "supplier", "orders"), tb := ontology(spark))
    return types.join(T.class_axioms(tb), "class").groupBy("s").agg(F.count("*").cast("int").alias("n"))


@query("t10_restrictions", "select '{E}balance' as property, 'EXACTLY' as quantifier, '1' as target, (select count(*) from customer) + (select count(*) from supplier) as n union all select '{E}name', 'EXACTLY', '1', (select count(*) from customer) + (select count(*) from supplier) union all select '{E}status', 'EXACTLY', '1', count(*) from orders")
def t10(spark, d):
    types = P.types_of(graph(spark, d, "customer", "supplier", "orders"), tb := ontology(spark))
    bound = types.join(T.class_axioms(tb), "class").join(T.restrictions(tb).withColumnRenamed("id", "axiom"), "axiom")
    return bound.groupBy("property", "quantifier", "target").agg(F.count("*").alias("n"))


@query("t11_compositions", "select 'AND' as operator, '{E}Transaction' as first_operand, count(*) as n from orders")
def t11(spark, d):
    types = P.types_of(graph(spark, d, "orders"), tb := ontology(spark))
    used = types.join(T.class_axioms(tb), "class").join(T.compositions(tb).withColumnRenamed("id", "axiom"), "axiom")
    return used.groupBy("operator", F.col("operands")[0].alias("first_operand")).agg(F.count("*").alias("n"))


@query("t12_datatypes", "select '{E}number' as attribute, '{XSD}integer' as datatype, count(*) as n from part union all select '{E}size', '{XSD}integer', count(*) from part union all select '{E}name', '{XSD}string', count(*) from part")
def t12(spark, d):
    rows = graph(spark, d, "part").where("o_kind = 'literal'").select(F.col("p").alias("attribute"), "o_dt")
    return rows.join(T.attribute_datatypes(ontology(spark)), "attribute").where("o_dt = datatype").groupBy("attribute", "datatype").agg(F.count("*").alias("n"))


@query("j1_neighbors", "select '{E}nation/' || c_nationkey as s, count(*) as n from customer group by 1")
def j1(spark, d):
    t = graph(spark, d, "region", "nation", "customer", "supplier")
    return N.neighbors(t, ontology(spark), name("encloses"), name("Customer")).groupBy("s").agg(F.count("*").alias("n"))


@query("j1_neighbors_by_id", "select o_orderkey as pos, '{E}customer/' || o_custkey as s, '{E}order/' || (o_orderkey // 2 * 2) as id, case when p.k is not null then '{E}order/' || (o_orderkey // 2 * 2) end as neighbor from orders left join (select o_orderkey as k, o_custkey as c from orders) p on p.k = o_orderkey // 2 * 2 and p.c = o_custkey")
def j1i(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), iri("customer", "o_custkey").alias("s"), iri("order", F.expr("o_orderkey div 2 * 2")).alias("id"))
    return N.neighbors(graph(spark, d, "orders", "customer"), ontology(spark), name("places"), ids=asked)


@query("j2_neighbors_inverse", "select '{E}customer/' || c_custkey as s, '{E}nation/' || c_nationkey as neighbor from customer union all select '{E}supplier/' || s_suppkey, '{E}nation/' || s_nationkey from supplier")
def j2(spark, d):
    return N.neighbors(graph(spark, d, "nation", "customer", "supplier"), ontology(spark), name("hasParty"), inverse=True)


@query("j3_neighbors_with_rel", "select '{E}region/' || n_regionkey as s, '{E}nation/' || n_nationkey as neighbor, '{E}hasNation' as relationship from nation union all select '{E}nation/' || s_nationkey, '{E}supplier/' || s_suppkey, '{E}hasSupplier' from supplier")
def j3(spark, d):
    return N.neighbors_with_rel(graph(spark, d, "region", "nation", "supplier", "customer"), ontology(spark), name("encloses"))


@query("j4_links", "select '{E}customer/' || o_custkey as s, '{E}places' as p, '{E}order/' || o_orderkey as o from orders")
def j4(spark, d):
    return N.links(graph(spark, d, "orders", "customer"), ontology(spark))


@query("j5_relationships_between", "select '{E}customer/' || o_custkey as s, '{E}order/' || o_orderkey as o, 1 as n from orders union select '{E}customer/' || (o_custkey + 1), '{E}order/' || o_orderkey, 0 from orders")
def j5(spark, d):
    orders = table(spark, d, "orders")
    pairs = orders.select(iri("customer", "o_custkey").alias("s"), iri("order", "o_orderkey").alias("o")).union(orders.select(iri("customer", F.col("o_custkey") + 1), iri("order", "o_orderkey")))
    return N.relationships_between(graph(spark, d, "orders"), ontology(spark), pairs).select("s", "o", F.size("relationships").alias("n"))


@query("j6_bgp", "select c_name as customer_name, n_name as nation_name, '{E}order/' || o_orderkey as o, cast(c_acctbal as decimal(18,2)) as balance from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey where o_orderstatus = 'F'")
def j6(spark, d):
    t = graph(spark, d, "nation", "customer", "orders")
    patterns = [("?c", name("inNation"), "?n"), ("?c", name("name"), "?customer_name"), ("?n", name("name"), "?nation_name"), ("?c", name("places"), "?o"), ("?o", name("status"), "F"), ("?c", name("balance"), "?balance")]
    rows = X.result_types(N.bgp(t, patterns), balance="decimal(18,2)")
    return rows.select("customer_name", "nation_name", "o", "balance")


def placed(spark, d):
    """The graph of nations, customers, suppliers and orders, with the statistics of its predicates."""
    tables_ = ("nation", "customer", "supplier", "orders")
    return graph(spark, d, *tables_), statistics(spark, d, *tables_)


@query("j6_bgp_star", "select c_name as customer, n_name as nation, cast(cast(c_acctbal as decimal(18,2)) as varchar) as balance, '{E}order/' || o_orderkey as o, o_orderstatus as status from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey")
def j6_star(spark, d):
    t, stats = placed(spark, d)
    patterns = [("?c", name("inNation"), "?n"), ("?c", name("name"), "?customer"), ("?n", name("name"), "?nation"), ("?c", name("places"), "?o"), ("?o", name("status"), "?status"), ("?c", name("balance"), "?balance")]
    return N.bgp(t, patterns, statistics=stats).select("customer", "nation", "balance", "o", "status")


@query("j6_bgp_optional", "select c_name as customer, n_name as nation, '{E}order/' || o_orderkey as o from customer join nation on n_nationkey = c_nationkey left join orders on o_custkey = c_custkey and o_orderstatus = 'P'")
def j6_optional(spark, d):
    t, stats = placed(spark, d)
    own = [("?c", name("inNation"), "?n"), ("?c", name("name"), "?customer"), ("?n", name("name"), "?nation")]
    pending = G.Join("optional", [("?c", name("places"), "?o"), ("?o", name("status"), G.Literal("P"))])
    return N.bgp(t, own, how=(pending,), statistics=stats).select("customer", "nation", "o")


@query("j6_bgp_minus", "select c_name as customer from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def j6_minus(spark, d):
    t, stats = placed(spark, d)
    open_ = G.Join("minus", [("?c", name("places"), "?o"), ("?o", name("status"), G.Literal("O"))])
    return N.bgp(t, [("?c", name("inNation"), "?n"), ("?c", name("name"), "?customer")], how=(open_,), statistics=stats).select("customer")


@query("j6_bgp_union", "select n_name as nation, c_name as party, cast(cast(c_acctbal as decimal(18,2)) as varchar) as balance from customer join nation on n_nationkey = c_nationkey union all select n_name, s_name, cast(cast(s_acctbal as decimal(18,2)) as varchar) from supplier join nation on n_nationkey = s_nationkey")
def j6_union(spark, d):
    t, stats = placed(spark, d)
    own = [("?x", name("name"), "?party"), ("?x", name("balance"), "?balance")]
    either = G.Join("union", [("?x", name("inNation"), "?n")], ([("?n", name("hasSupplier"), "?x")],))
    nation = G.Join("optional", [("?n", name("name"), "?nation")])
    return N.bgp(t, own, how=(either, nation), statistics=stats).select("nation", "party", "balance")


def alike(spark, d):
    """Of each supplier, its name as a string, with a language and as an entity's identifier, said and listed."""
    own = lambda kind, p, o: S.link(iri(kind, "s_suppkey"), name(p), o)
    text = lambda kind, p, dt, lang: S.literal(iri(kind, "s_suppkey"), name(p), F.col("s_name"), dt, lang)
    made = [(kind, p) for p in ("says", "lists") for kind in (f"{p}/plain", f"{p}/tagged", f"{p}/entity")]
    rows = [own(k, p, F.col("s_name")) if "entity" in k else text(k, p, *((S.RDF + "langString", "en") if "tagged" in k else (S.XSD + "string", ""))) for k, p in made]
    return S.from_structs(table(spark, d, "supplier"), *rows, S.literal(F.col("s_name"), name("number"), F.col("s_suppkey"), S.XSD + "integer"))


@query("j6_bgp_terms", "".join(f" union all select '{{E}}says/{k}/' || s_suppkey as a, '{{E}}lists/{k}/' || s_suppkey as b, s_name as v, '{kind}' as v_kind, '{dt}' as v_dt, '{lang}' as v_lang from supplier" for k, kind, dt, lang in (("plain", "literal", "{XSD}string", ""), ("tagged", "literal", S.RDF + "langString", "en"), ("entity", "iri", "", ""))).removeprefix(" union all "))
def j6_terms(spark, d):
    return N.bgp(alike(spark, d), [("?a", name("says"), "?v"), ("?b", name("lists"), "?v")]).select("a", "b", "v", "v_kind", "v_dt", "v_lang")


@query("j6_bgp_terms_entity", "select '{E}says/entity/' || s_suppkey as a, s_name as v, cast(s_suppkey as varchar) as n from supplier")
def j6_terms_entity(spark, d):
    return N.bgp(alike(spark, d), [("?a", name("says"), "?v"), ("?v", name("number"), "?n")]).select("a", "v", "n")


@query("j6_predicate_statistics", "select '{E}name' as p, (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) as n union all select '{E}places', count(*) from orders union all select '{E}status', count(*) from orders")
def j6_statistics(spark, d):
    return placed(spark, d)[1].where(F.col("p").isin(name("name"), name("places"), name("status"))).select("p", "n")


@query("j7_path_star", UP + " select '{E}supplier/' || s_suppkey as s, super as o from supplier join thing on sub = '{E}Supplier'")
def j7(spark, d):
    return N.path_star(graph(spark, d, "supplier"), ontology(spark).classes, S.TYPE)


@query("j8_construct", "select '{E}order/' || o_orderkey as s, '{E}placedBy' as p, '{E}customer/' || o_custkey as o from orders")
def j8(spark, d):
    return N.construct(graph(spark, d, "orders"), [("?c", name("places"), "?o")], [("?o", name("placedBy"), "?c")]).select("s", "p", "o")


@query("j8_construct_terms", "select '{E}customer/' || c_custkey as s, '{E}title' as p, c_name as o, 'literal' as o_kind, '{XSD}string' as o_dt from customer union all select '{E}customer/' || c_custkey, '{E}worth', cast(cast(c_acctbal as decimal(18,2)) as varchar), 'literal', '{XSD}decimal' from customer union all select '{E}nation/' || c_nationkey, '{E}home', '{E}customer/' || c_custkey, 'iri', '' from customer")
def j8_terms(spark, d):
    t, stats = placed(spark, d)
    patterns = [("?c", name("name"), "?n"), ("?c", name("balance"), "?b"), ("?c", name("inNation"), "?h")]
    made = N.construct(t, patterns, [("?c", name("title"), "?n"), ("?c", name("worth"), "?b"), ("?h", name("home"), "?c"), ("?n", name("of"), "?c")], statistics=stats)
    return made.select("s", "p", "o", "o_kind", "o_dt")


@query("j8_describe", "select '{E}customer/' || c_custkey as s, c_name as o from customer where c_mktsegment = 'MACHINERY'")
def j8_describe(spark, d):
    t, tb = graph(spark, d, "customer"), ontology(spark)
    return N.describe(t, P.get_by_class(t, tb, name("Machinery"))).where(F.col("p") == name("name")).select("s", "o")


def roots(t, tb):
    return P.get_by_class(t, tb, name("Region"))


INSIDE = "select '{E}region/' || r_regionkey as root, '{E}region/' || r_regionkey as node, 0 as depth from region union all select '{E}region/' || n_regionkey, '{E}nation/' || n_nationkey, 1 from nation union all select '{E}region/' || n_regionkey, '{E}customer/' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey union all select '{E}region/' || n_regionkey, '{E}supplier/' || s_suppkey, 2 from supplier join nation on s_nationkey = n_nationkey"
ORDERS = " union all select '{E}region/' || n_regionkey, '{E}order/' || o_orderkey, 3 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


@query("j9_find", INSIDE + ORDERS)
def j9(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "supplier", "orders"), ontology(spark)
    return R.find(t, tb, roots(t, tb), relationships=[name("encloses"), name("places")])


@query("j9_find_depth", "select * from (" + INSIDE + ") where depth <= 1")
def j9_depth(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark)
    return R.find(t, tb, roots(t, tb), relationships=[name("encloses")], max_depth=1)


@query("j10_find_first", "with s as (" + INSIDE + ") select r.root, min(m.node) as node from (select distinct root from s) r left join s m on m.root = r.root and m.node like '%supplier/%' group by 1")
def j10(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark)
    return R.find_first(t, tb, roots(t, tb), P.get_by_class(t, tb, name("Supplier")), relationships=[name("encloses")])


@query("j11_find_by_identifier", "with s as (" + INSIDE + ") select r.root, min(m.node) as node from (select distinct root from s) r left join s m on m.root = r.root and m.node = '{E}customer/7' group by 1")
def j11(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark)
    return R.find_by_identifier(t, tb, roots(t, tb), EX + "customer/7", relationships=[name("encloses")])


@query("j12_find_by_class", "select * from (" + INSIDE + ") where node like '%customer/%' or node like '%supplier/%'")
def j12(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "supplier"), ontology(spark)
    return R.find_by_class(t, tb, roots(t, tb), name("Party"), relationships=[name("encloses")])


@query("j13_find_by_attribute", "select '{E}region/' || n_regionkey as root, '{E}order/' || o_orderkey as node, 3 as depth from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'")
def j13(spark, d):
    t, tb = graph(spark, d, "region", "nation", "customer", "orders"), ontology(spark)
    return R.find_by_attribute(t, tb, roots(t, tb), name("status"), "P", relationships=[name("encloses"), name("places")])


@query("j14_find_relationships", "select distinct '{E}region/' || n_regionkey as root, '{E}nation/' || n_nationkey as node, 1 as depth from nation join supplier on s_nationkey = n_nationkey")
def j14(spark, d):
    t, tb = graph(spark, d, "region", "nation", "supplier"), ontology(spark)
    return R.find_relationships(t, tb, roots(t, tb), name("hasParty"), find_sub=True, relationships=[name("encloses")])


def contained(spark, d):
    """A container for each nation with its customers, and one reference that isn't in the graph."""
    box = lambda c: S.link(iri("box", c), S.TYPE, F.lit(S.GRAPH + "Container"))
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    made = S.from_structs(nations, box("n_nationkey"), S.link(iri("box", "n_nationkey"), S.CONTAINS, iri("lost", "n_nationkey")))
    return graph(spark, d, "customer").unionByName(made).unionByName(S.from_structs(customers, S.link(iri("box", "c_nationkey"), S.CONTAINS, iri("customer", "c_custkey"))))


@query("j15_container_counts", "select '{E}box/' || n_nationkey as container, count(c_custkey) + 1 as num_references, count(c_custkey) as num_members from nation left join customer on c_nationkey = n_nationkey group by 1")
def j15(spark, d):
    return N.container_counts(contained(spark, d), ontology(spark))


@query("j15_container_members", "select '{E}box/' || c_nationkey as container, '{E}customer/' || c_custkey as member from customer")
def j15_members(spark, d):
    return N.container_members(contained(spark, d), ontology(spark))


@query("j15_container_contains", "select '{E}box/' || (c_custkey % 25) as container, '{E}customer/' || c_custkey as reference, c_custkey % 25 = c_nationkey as contains from customer")
def j15_contains(spark, d):
    pairs = table(spark, d, "customer").select(iri("box", F.col("c_custkey") % 25).alias("container"), iri("customer", "c_custkey").alias("reference"))
    return N.container_contains(contained(spark, d), pairs)


@query("j16_plot_edges", "select '{E}customer/' || c_custkey as src, '{E}nation/' || c_nationkey as dst, '{E}inNation' as label, true as directed from customer where c_custkey % 2 = 1 union all select '{E}nation/' || c_nationkey, '{E}customer/' || c_custkey, '{E}hasParty', false from customer where c_custkey % 2 = 0")
def j16(spark, d):
    t, tb = graph(spark, d, "nation", "customer"), ontology(spark)
    back = table(spark, d, "customer").where("c_custkey % 2 = 0")
    t = t.unionByName(S.from_structs(back, S.link(iri("nation", "c_nationkey"), name("hasParty"), iri("customer", "c_custkey"))))
    drawn = P.individuals(t, tb).where(~F.col("s").contains("region"))
    return A.plot_edges(t, tb, drawn, T.inverses(tb))


@query("a1_attribute_map", "select '{E}part/' || p_partkey as s, p_name as part_name, cast(p_size as varchar) as part_size, 3 as n from part")
def a1(spark, d):
    m = F.col("attributes")
    return A.attribute_map(graph(spark, d, "part"), ontology(spark)).select("s", m[name("name")][0].alias("part_name"), m[name("size")][0].alias("part_size"), F.size("attributes").alias("n"))


@query("a2_counts", "select 'graph' as what, (select count(*) from customer) + (select count(*) from nation) as n union all select 'container {E}box/' || n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) from nation")
def a2(spark, d):
    return A.counts(contained(spark, d), ontology(spark))


@query("a3_functional_value", "select '{E}user/' || user_id as s, case when count(distinct event_type) = 1 then min(event_type) end as value, count(distinct event_type) as n from events group by 1")
def a3(spark, d):
    return A.functional_value(graph(spark, d, "events"), ontology(spark), name("status"))


@query("a4_one", "select '{E}customer/' || c_custkey as s, case when count(o_orderkey) = 1 then '{E}order/' || min(o_orderkey) end as one, case count(o_orderkey) when 1 then 'ok' when 0 then 'empty' else 'multiple' end as status from customer left join orders on o_custkey = c_custkey group by c_custkey")
def a4(spark, d):
    t, tb = graph(spark, d, "customer", "orders"), ontology(spark)
    sets = P.get_by_class(t, tb, name("Customer")).join(N.neighbors(t, tb, name("places")), "s", "left")
    return A.one(sets, element="neighbor")


CHANGES = "with log as (select event_id as seq, case when event_type = 'error' then 'delete' else 'add' end as op, '{E}user/' || user_id as s, case when event_type = 'error' then 'click' else event_type end as o from events where event_type in ('purchase', 'click', 'error')), last as (select s, o, arg_max(op, seq) as op from log group by all), base as (select distinct case when user_id % 2 = 0 then '{E}user/' else '{E}guest/' end || user_id as s, event_type as o from events)"


def users(spark, d):
    """The statuses of all users, of whom those with odd numbers are guests, which the change log knows by other names."""
    who = F.when(F.col("user_id") % 2 == 0, iri("user", "user_id")).otherwise(iri("guest", "user_id"))
    return S.from_structs(table(spark, d, "events"), S.literal(who, name("status"), F.col("event_type"))).distinct()


@query("a5_entity_changes", CHANGES + ", b as (select s, count(*) as n from base group by 1), t as (select l.s, count(*) filter (op = 'add') as added, count(*) filter (op = 'delete' and base.s is not null) as removed from last l left join base on base.s = l.s and base.o = l.o group by 1) select * from (select t.s, case when b.n is null and added > 0 then 'added' when b.n > 0 and removed >= b.n then 'deleted' when b.n > 0 then 'updated' end as change from t left join b on b.s = t.s) where change is not null")
def a5(spark, d):
    return A.entity_changes(users(spark, d), changelog(spark, d))


@query("a6_entity_report", "select '{E}nation/' || n_nationkey as s, 1 as n_types, 3 as n_super, count(s_suppkey) as n_neighbors from nation left join supplier on s_nationkey = n_nationkey group by 1")
def a6(spark, d):
    t, tb = graph(spark, d, "nation", "supplier"), ontology(spark)
    r = A.entity_report(t, tb).where(F.col("s").contains("nation/"))
    return r.select("s", F.size("types").alias("n_types"), F.size("superclasses").alias("n_super"), F.coalesce(F.size("neighbors"), F.lit(0)).cast("long").alias("n_neighbors"))


@query("a6_report_rows", "select s, row_number() over (partition by s order by relationship_label, class_label, neighbor) as n, relationship, neighbor, class_label, relationship_label from (select '{E}nation/' || s_nationkey as s, '{E}hasSupplier' as relationship, '{E}supplier/' || s_suppkey as neighbor, 'Supplier' as class_label, 'hasSupplier' as relationship_label from supplier union all select '{E}nation/' || s_nationkey, '{E}hasParty', '{E}supplier/' || s_suppkey, 'Supplier', 'hasParty' from supplier union all select '{E}nation/' || c_nationkey, '{E}hasParty', '{E}customer/' || c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)), 'hasParty' from customer union all select '{E}customer/' || c_custkey, '{E}inNation', '{E}nation/' || c_nationkey, 'Nation', 'inNation' from customer)")
def a6_rows(spark, d):
    party = lambda t, own, nation: S.from_structs(table(spark, d, t), S.link(iri("nation", nation), name("hasParty"), iri(t, own)))
    t = graph(spark, d, "nation", "customer", "supplier").unionByName(party("customer", "c_custkey", "c_nationkey")).unionByName(party("supplier", "s_suppkey", "s_nationkey"))
    rows = A.report_rows(t, ontology(spark))
    return rows.where(~F.col("s").contains("region/")).select("s", "n", "relationship", "neighbor", "class_label", "relationship_label")


@query("w1_preferred_label", "select '{E}document/' || doc_id as s, case when doc_id % 3 <> 0 then text when coalesce(lang, '') = 'de' then text when coalesce(lang, '') = 'en' then text when length(source) < length(text) or lang is not null then source else source end as label from documents where text is not null")
def w1(spark, d):
    return P.preferred_label(graph(spark, d, "documents"), languages=("de",)).select("s", "label")


@query("g1_add", "select '{E}supplier/' || s_suppkey as s, case when s_suppkey % 2 = 0 then 'new ' || s_name else s_name end as o from supplier")
def g1(spark, d):
    new = tables.individuals_from_table(table(spark, d, "supplier").where("s_suppkey % 2 = 0"), name("Supplier"), iri("supplier", "s_suppkey"), {name("name"): (F.concat(F.lit("new "), "s_name"), S.XSD + "string")})
    return U.add(graph(spark, d, "nation", "supplier"), new, ontology(spark)).where((F.col("p") == name("name")) & F.col("s").contains("supplier/")).select("s", "o")


@query("g2_delete", "with kept as (select * from supplier where s_suppkey % 5 <> 0) select '{E}supplier/' || s_suppkey as s, '{E}' || a as p from kept, (values ('name'), ('balance'), ('number')) v(a) union all select '{E}supplier/' || s_suppkey, '{TYPE}' from kept union all select '{E}nation/' || s_nationkey, '{E}hasSupplier' from kept")
def g2(spark, d):
    return U.delete(graph(spark, d, "supplier"), table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(iri("supplier", "s_suppkey").alias("s"))).select("s", "p")


def halves(spark, d):
    """Two graphs that share some suppliers and have all of them together: those not divisible by three, and those divisible by two or three with other names."""
    make = lambda which, text: tables.individuals_from_table(table(spark, d, "supplier").where(which), name("Supplier"), iri("supplier", "s_suppkey"), {name("name"): (text, S.XSD + "string")})
    return make(FIRST, F.col("s_name")), make(SECOND, F.concat(F.lit("other "), "s_name"))


def names_only(t):
    return t.where(F.col("p") == name("name")).select("s", "o")


FIRST, SECOND = "(s_suppkey % 3 <> 0)", "(s_suppkey % 2 = 0 or s_suppkey % 3 = 0)"
ONE, OTHER = f"select '{{E}}supplier/' || s_suppkey as s, s_name as o from supplier where {FIRST}", f"select '{{E}}supplier/' || s_suppkey as s, 'other ' || s_name as o from supplier where {SECOND}"


@query("g4_union", ONE + " union all " + OTHER)
def g4_union(spark, d):
    a, b = halves(spark, d)
    return names_only(U.session_union(a, b, ontology(spark)))


@query("g4_intersection", f"{ONE} and {SECOND} union all {OTHER} and {FIRST}")
def g4_intersection(spark, d):
    a, b = halves(spark, d)
    return names_only(U.session_intersection(a, b, ontology(spark)))


@query("g4_difference", f"{ONE} and not {SECOND}")
def g4_difference(spark, d):
    a, b = halves(spark, d)
    return names_only(U.session_difference(a, b, ontology(spark)))


@query("g4_symmetric_difference", f"{ONE} and not {SECOND} union all {OTHER} and not {FIRST}")
def g4_symmetric_difference(spark, d):
    a, b = halves(spark, d)
    return names_only(U.session_symmetric_difference(a, b, ontology(spark)))


@query("g5_value_sets", "select '{E}supplier/' || s_suppkey as s from supplier where " + FIRST + " <> " + SECOND)
def g5(spark, d):
    a, b = halves(spark, d)
    return U.value_sets(a.select("s"), b.select("s"), "xor")


@query("g6_attributes_assign", "select '{E}supplier/' || s_suppkey as s, cast(case when s_suppkey % 2 = 0 then s_suppkey + 1 else s_suppkey end as varchar) as o from supplier")
def g6(spark, d):
    t, tb = graph(spark, d, "supplier"), ontology(spark)
    new = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(iri("supplier", "s_suppkey").alias("s"), (F.col("s_suppkey") + 1).cast("string").alias("value"))
    return U.attributes_assign(t, tb, name("number"), new).where(F.col("p") == name("number")).select("s", "o")


@query("g7_connect", "select '{E}nation/' || s_nationkey as s, '{E}hasSupplier' as p, '{E}supplier/' || s_suppkey as o from supplier union all select '{E}nation/' || (s_suppkey % 25), '{E}hasParty', '{E}supplier/' || s_suppkey from supplier where s_suppkey % 25 <> s_nationkey")
def g7(spark, d):
    pairs = table(spark, d, "supplier").select(iri("nation", F.col("s_suppkey") % 25).alias("s"), iri("supplier", "s_suppkey").alias("o"))
    out = U.connect(graph(spark, d, "nation", "supplier"), ontology(spark), pairs, name("hasParty"))
    return out.where(F.col("o").contains("supplier/")).select("s", "p", "o")


@query("g8_disconnect", "select '{E}nation/' || s_nationkey as s, '{E}supplier/' || s_suppkey as o from supplier where s_suppkey % 4 <> 0")
def g8(spark, d):
    pairs = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(iri("nation", "s_nationkey").alias("s"), iri("supplier", "s_suppkey").alias("o"))
    out = U.disconnect(graph(spark, d, "nation", "supplier"), ontology(spark), name("encloses"), pairs)
    return out.where(F.col("p") == name("hasSupplier")).select("s", "o")


@query("g9_assign_links", "select '{E}nation/' || (s_suppkey % 25) as s, '{E}supplier/' || s_suppkey as o from supplier union select '{E}nation/' || s_nationkey, '{E}supplier/' || s_suppkey from supplier where s_nationkey not in (select s_suppkey % 25 from supplier)")
def g9(spark, d):
    wanted = table(spark, d, "supplier").select(iri("nation", F.col("s_suppkey") % 25).alias("s"), iri("supplier", "s_suppkey").alias("o"))
    out = U.assign_links(graph(spark, d, "nation", "supplier"), ontology(spark), name("hasSupplier"), wanted)
    return out.where(F.col("p") == name("hasSupplier")).select("s", "o")


@query("g10_annotations_assign", "select '{E}supplier/' || s_suppkey as s, case when s_suppkey % 2 = 0 then 'even' else s_name end as o from supplier")
def g10(spark, d):
    new = S.from_structs(table(spark, d, "supplier").where("s_suppkey % 2 = 0"), S.literal(iri("supplier", "s_suppkey"), name("remark"), F.lit("even")))
    return U.annotations_assign(remarked(spark, d), name("remark"), new).where((F.col("p") == name("remark")) & (F.col("o_kind") == "literal")).select("s", "o")


@query("g11_set_classes", "select '{E}supplier/' || s_suppkey as s, case when s_suppkey % 2 = 0 then '{E}Customer' else '{E}Supplier' end as o from supplier")
def g11(spark, d):
    new = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(iri("supplier", "s_suppkey").alias("s"), F.lit(name("Customer")).alias("class"))
    return U.set_classes(graph(spark, d, "supplier"), new).where(F.col("p") == S.TYPE).select("s", "o")


@query("g12_container_assign", "select '{E}box/' || c_nationkey as container, '{E}customer/' || c_custkey as reference from customer where c_custkey % 2 = 0 union select '{E}box/' || n_nationkey, '{E}lost/' || n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_custkey % 2 = 0) union select '{E}box/' || c_nationkey, '{E}customer/' || c_custkey from customer where c_nationkey not in (select c_nationkey from customer where c_custkey % 2 = 0)")
def g12(spark, d):
    pairs = table(spark, d, "customer").where("c_custkey % 2 = 0").select(iri("box", "c_nationkey").alias("container"), iri("customer", "c_custkey").alias("reference"))
    return N.container_references(U.container_assign(contained(spark, d), pairs))


@query("g13_apply_changelog", CHANGES + " select s, o from base where not exists (select 1 from last l where l.s = base.s and l.o = base.o) union all select s, o from last where op = 'add'")
def g13(spark, d):
    return U.apply_changelog(users(spark, d), changelog(spark, d)).select("s", "o")


@query("g13_delete_patterns", CHANGES + ", cut as (select '{E}user/' || user_id as s, max(event_id) as last_seq from events where event_type = 'signup' group by 1), state as (select s, o, -1 as seq from base where not exists (select 1 from last l where l.s = base.s and l.o = base.o) union all select s, o, max(seq) as seq from log join last using (s, o) where last.op = 'add' group by s, o) select state.s, o from state left join cut on cut.s = state.s where last_seq is null or last_seq < seq")
def g13_patterns(spark, d):
    null = F.lit(None).cast("string")
    patterns = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("seq"), iri("user", "user_id").alias("s"), null.alias("p"), null.alias("o"))
    return U.apply_changelog(users(spark, d), changelog(spark, d), patterns).select("s", "o")


@query("f1_typed_value", "select '{E}part/' || p_partkey as s, cast(p_size as decimal(38,0)) as number, true as valid from part")
def f1(spark, d):
    t = graph(spark, d, "part").where(F.col("p") == name("size"))
    return X.typed_value(t).select("s", F.col("v.number").alias("number"), "valid")


@query("f2_vectors", "select vec_id, len(embedding) as n, cast(embedding[1] as double) as first, true as same from embeddings")
def f2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    back = e.withColumn("d", X.decode_vector(X.encode_vector("v", F.array(F.size("v")))))
    return back.select("vec_id", F.col("d.shape")[0].cast("long").alias("n"), F.col("d.values")[0].alias("first"), (F.col("d.values") == F.col("v")).alias("same"))


@query("f4_curie", "select 'kg:customer/' || c_custkey as curie, '{E}customer/' || c_custkey as iri from customer")
def f4(spark, d):
    t = P.individuals(graph(spark, d, "customer"), ontology(spark))
    ns = {"kg": EX, "owl": S.OWL}
    return t.select(X.curie(F.col("s"), ns).alias("curie")).withColumn("iri", X.expand(F.col("curie"), ns))


@query("f5_display_name", "select distinct '" + S.ENTITY + "' || h as iri, left(h, 8) || '...' || right(h, 3) as display from (select left(x, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) as h from (select format('{:032x}', user_id) as x from events))")
def f5(spark, d):
    own = X.mint_iri(F.col("user_id"), "int")
    rows = table(spark, d, "events").select(own.alias("iri")).distinct()
    null = F.lit(None).cast("string")
    return rows.withColumn("display", X.display_name(null, null, F.col("iri")))


@query("u3_apply_by_class", "select 'hubs' as operation, '{E}nation/' || n_nationkey as s from nation union all select 'parties', s from (" + PARTIES + ")")
def u3(spark, d):
    t, tb = graph(spark, d, "nation", "customer", "supplier"), ontology(spark)
    return N.apply_by_class(t, tb, [(name("Nation"), "hubs", lambda x: x), (name("Party"), "parties", lambda x: x)]).select("operation", "s")


def listed(spark, d):
    """Customers as JSON-LD documents with lists, mixed values, and strings that look like numbers, objects and lists."""
    c = lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    value = lambda x: F.regexp_extract(c(x), r'^\{"x":(.*)\}$', 1)
    key = F.col("c_custkey")
    parts = [
        F.lit('{"@context":{"kg":"' + EX + '","phone":"kg:phone","since":{"@id":"kg:since","@type":"' + S.XSD + 'long"},"near":{"@id":"kg:near","@type":"@id"}},"@graph":[{"@id":"kg:customer/'), key.cast("string"), F.lit('","@type":["kg:Customer","kg:Party"],"kg:tags":['), value(F.col("c_mktsegment")), F.lit(',"b"],"kg:mixed":["'), key.cast("string"), F.lit('",'), key.cast("string"),
        F.lit(',2.5,true,null],"kg:draft":"[draft] '), key.cast("string"), F.lit('","kg:braces":"{'), key.cast("string"), F.lit('}","phone":'), value(F.col("c_name")), F.lit(',"since":'), key.cast("string"), F.lit(',"near":"kg:nation/'), F.col("c_nationkey").cast("string"), F.lit('","kg:said":{"@value":"'), key.cast("string"), F.lit('"},"kg:called":{"@value":'), value(F.col("c_name")), F.lit(',"@language":"EN"}}]}'),
    ]
    return table(spark, d, "customer").select(F.concat(*parts).alias("value"))


@query("s2_jsonld_document", "with c as (select '{E}customer/' || c_custkey as s, * from customer) select s, '{TYPE}' as p, t.o, '' as o_dt, '' as o_lang from c, (values ('{E}Customer'), ('{E}Party')) t(o) union all " + " union all ".join(
    f"select s, '{{E}}{p}', {o}, '{dt}', '{lang}' from c" for p, o, dt, lang in (
        ("tags", "c_mktsegment", "{XSD}string", ""), ("tags", "'b'", "{XSD}string", ""), ("mixed", "cast(c_custkey as varchar)", "{XSD}string", ""), ("mixed", "cast(c_custkey as varchar)", "{XSD}integer", ""), ("mixed", "'2.5'", "{XSD}double", ""), ("mixed", "'true'", "{XSD}boolean", ""),
        ("draft", "'[draft] ' || c_custkey", "{XSD}string", ""), ("braces", "'{{' || c_custkey || '}}'".replace("{{", "{").replace("}}", "}"), "{XSD}string", ""), ("phone", "c_name", "{XSD}string", ""), ("since", "cast(c_custkey as varchar)", "{XSD}long", ""), ("near", "'{E}nation/' || c_nationkey", "", ""),
        ("said", "cast(c_custkey as varchar)", "{XSD}string", ""), ("called", "c_name", S.RDF + "langString", "en"))))
def s2_document(spark, d):
    return rdf.parse_jsonld(listed(spark, d)).select("s", "p", "o", "o_dt", "o_lang")


@query("s1_s7_backslashes", "select '{E}part/' || p_partkey as s, 'C:' || chr(92) || 'u00e9' || chr(92) || chr(92) || 'n' || chr(10) || p_name || chr(9) || '\"' as o from part")
def s1_backslashes(spark, d):
    """Text with backslashes before letters, line feeds, tabs and quotes, through lines and back."""
    text = F.concat(F.lit("C:\\u00e9\\\\n\n"), F.col("p_name"), F.lit('\t"'))
    t = S.from_structs(table(spark, d, "part"), S.literal(iri("part", "p_partkey"), name("name"), text))
    return rdf.parse_ntriples(rdf.ntriples_lines(t)).select("s", "o")


BOTH = '{"@context": {"ex": "' + EX + '", "name": "ex:name", "seq": {"@id": "ex:seq", "@container": "@list"}, "by": {"@id": "ex:by", "@container": "@language"}, "@language": "en"}, "@id": "'


def nested(spark, d):
    """A JSON-LD document for each customer: nested nodes, one without an id, a list, a set, reverse links, a container by language, a context within."""
    c = lambda x: F.col(x).cast("string")
    text = F.concat(
        F.lit(BOTH), iri("customer", "c_custkey"), F.lit('", "name": "'), c("c_name"), F.lit('", "ex:home": {"@id": "'), iri("nation", "c_nationkey"), F.lit('", "@context": {"name": "ex:title", "@language": null}, "name": "N'), c("c_nationkey"),
        F.lit('", "ex:in": {"name": "deep"}}, "@reverse": {"ex:hasCustomer": [{"@id": "'), iri("nation", "c_nationkey"), F.lit('"}]}, "seq": ['), c("c_custkey"), F.lit(', "'), c("c_mktsegment"),
        F.lit('"], "by": {"DE": "'), c("c_mktsegment"), F.lit('"}, "ex:big": 123456789012345678901234567890'), c("c_custkey"), F.lit(', "ex:all": {"@set": [true, null, [{"@value": "7", "@type": "ex:t"}]]}}'),
    )
    return table(spark, d, "customer").select(text.alias("value"))


@query("s2_jsonld_forms", "with c as (select '{E}customer/' || c_custkey as s, '{E}nation/' || c_nationkey as nat, * from customer) select s, '{E}name' as p, c_name as o, '" + S.RDF + "langString' as o_dt, 'en' as o_lang from c union all select s, '{E}home', nat, '', '' from c union all select distinct nat, '{E}title', 'N' || c_nationkey, '{XSD}string', '' from c union all select nat, '{E}hasCustomer', s, '', '' from c union all select s, '{E}by', c_mktsegment, '" + S.RDF + "langString', 'de' from c union all select s, '{E}big', '123456789012345678901234567890' || c_custkey, '{XSD}integer', '' from c union all select s, '{E}all', 'true', '{XSD}boolean', '' from c union all select s, '{E}all', '7', '{E}t', '' from c")
def s2_forms(spark, d):
    return rdf.parse_jsonld(nested(spark, d)).where("s_kind = 'iri' and o_kind <> 'bnode'").select("s", "p", "o", "o_dt", "o_lang")


@query("s2_jsonld_lists", "select '{E}customer/' || c_custkey as s, cast(c_custkey as varchar) as first, '{XSD}integer' as first_dt, c_mktsegment as second, 'en' as second_lang, '{E}nation/' || c_nationkey as home, 'deep' as inner from customer")
def s2_lists(spark, d):
    t = rdf.parse_jsonld(nested(spark, d))
    first, rest = S.RDF + "first", S.RDF + "rest"
    rows = N.bgp(t, [("?s", name("seq"), "?l"), ("?l", first, "?first"), ("?l", rest, "?m"), ("?m", first, "?second"), ("?m", rest, S.RDF + "nil"), ("?s", name("home"), "?home")])
    # A home has a node within from each of its customers; what they say is taken once before it meets the customers.
    inner = N.bgp(t, [("?home", name("in"), "?b"), ("?b", name("title"), "?inner")]).select("home", "inner").distinct()
    return rows.join(inner, "home").select("s", "first", "first_dt", "second", "second_lang", "home", "inner").distinct()


STATES = "with log as (select event_id as seq, case when event_type = 'error' then 'delete' else 'add' end as op, '{E}user/' || user_id as s, case when event_type = 'error' then 'click' else event_type end as o from events where event_type in ('purchase', 'click', 'error')), last as (select s, o, arg_max(op, seq) as op from log group by all), base as (select distinct '{E}user/' || user_id as s, event_type as o from events where event_type <> 'purchase') select s, o from base where not exists (select 1 from last l where l.s = base.s and l.o = base.o) union all select s, o from last where op = 'add'"


def committed(spark, d):
    """A store of all users' statuses but purchases, with the change log in three commits."""
    rows = S.from_structs(table(spark, d, "events").where("event_type <> 'purchase'"), S.literal(iri("user", "user_id"), name("status"), F.col("event_type"))).distinct()
    made = store.Store.create(rows, files(spark, "store"), 16)
    log = changelog(spark, d)
    middle = log.agg(F.max("seq")).first()[0] or 0
    for low, high in ((None, middle // 3), (middle // 3, middle // 2), (middle // 2, None)):
        made.commit(log.where((F.lit(low is None) | (F.col("seq") > F.lit(low))) & (F.lit(high is None) | (F.col("seq") <= F.lit(high)))))
    return made


@query("s8_store_commits", STATES)
def s8_commits(spark, d):
    return committed(spark, d).read().select("s", "o")


@query("s8_store_compacted", STATES)
def s8_compacted(spark, d):
    made = committed(spark, d)
    made.compact()
    return made.read().select("s", "o")


def saved(spark, d):
    """A folder with a file for each supplier, named by its IRI, and the file individuals of these and of as many without a file."""
    path = files(spark, "files")
    rows = table(spark, d, "supplier").select(F.regexp_replace(F.base64(iri("file", "s_suppkey").cast("binary")), r"\s", "").alias("key"), F.col("s_name").alias("text"))
    rdf.write_files(rows, path)
    return path, S.from_structs(table(spark, d, "supplier"), S.link(iri("file", "s_suppkey"), S.TYPE, F.lit(S.FILE)), S.link(iri("lost", "s_suppkey"), S.TYPE, F.lit(S.FILE)))


@query("s12_file_manifest", "select '{E}file/' || s_suppkey as s, base64(encode('{E}file/' || s_suppkey)) as storage_key, strlen(s_name) as size, sha256(s_name) as sha256 from supplier union all select '{E}lost/' || s_suppkey, base64(encode('{E}lost/' || s_suppkey)), null, null from supplier")
def s12(spark, d):
    path, t = saved(spark, d)
    return rdf.file_manifest(spark, path, t)


@query("s8_store", "select s, p, o, o_dt from (select '{E}part/' || p_partkey as s, '{E}name' as p, p_name as o, '{XSD}string' as o_dt from part union all select '{E}part/' || p_partkey, '{E}number', cast(p_partkey as varchar), '{XSD}integer' from part union all select '{E}part/' || p_partkey, '{E}size', cast(p_size as varchar), '{XSD}integer' from part union all select '{E}order/' || o_orderkey, '{E}status', o_orderstatus, '{XSD}string' from orders) where p <> '{E}status' or s is not null")
def s8(spark, d):
    """The attributes of parts and orders but dates, read from their own partition of a store."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rdf.write_store(graph(spark, d, "part", "orders"), ontology(spark), path)
    return rdf.read_store(spark, path, "attribute").where(F.col("p") != name("date")).select("s", "p", "o", "o_dt")


@query("s11_load_tbox", UP + " select '{E}supplier/' || s_suppkey as s, super as class from supplier join thing on sub = '{E}Supplier'")
def s11(spark, d):
    """Classes of suppliers by an ontology that is loaded from two graphs."""
    triples, here = ontology(spark).triples, F.pmod(F.xxhash64("s", "o"), F.lit(2)) == 0
    tb, _ = T.load_tbox(triples.where(here), triples.where(~here), namespaces={"KG": EX[:-1]})
    return P.superclasses_of(graph(spark, d, "supplier"), tb)


@query("p11_resolve_name", "select s, '{E}Supplier' as found, cast(1 as bigint) as n from (select '{E}supplier/' || s_suppkey as s from supplier)")
def p11(spark, d):
    tb = ontology(spark)
    types = P.types_of(graph(spark, d, "supplier"), tb)
    return types.join(P.resolve_name(tb, EX, "Supplier").withColumnRenamed("s", "found"), F.col("class") == F.col("found")).select("s", "found", "n")


@query("t1_direct_super", "select '{E}customer/' || c_custkey as s, '{E}Customer' as super from customer union all select '{E}supplier/' || s_suppkey, '{E}Party' from supplier")
def t1(spark, d):
    tb = ontology(spark)
    return P.types_of(graph(spark, d, "customer", "supplier"), tb).join(T.direct_super(tb).withColumnRenamed("sub", "class"), "class").select("s", "super")


@query("t1_direct_sub", "select s, '{E}' || t.sub as sub from (select '{E}region/' || r_regionkey as s from region), (values ('Region'), ('Nation')) t(sub) union all select '{E}nation/' || n_nationkey, '{E}' || t.sub from nation, (values ('Region'), ('Nation')) t(sub)")
def t1_sub(spark, d):
    """Of each region and nation the classes beside its own: what lies directly below what lies directly above it."""
    tb = ontology(spark)
    up = P.types_of(graph(spark, d, "region", "nation"), tb).join(T.direct_super(tb).withColumnRenamed("sub", "class"), "class")
    return up.join(T.direct_sub(tb), "super").select("s", "sub")


@query("t2_class_closure", UP + ", own as (select '{E}customer/' || c_custkey as s, " + SEGMENT + " as c from customer) select s, super from own join thing on sub = c")
def t2(spark, d):
    tb = ontology(spark)
    return P.types_of(graph(spark, d, "customer"), tb).join(T.class_closure(tb).withColumnRenamed("sub", "class"), "class").select("s", "super")


@query("t3_class_sub_closure", "select '{E}order/' || o_orderkey as s, super from orders, (values ('{E}Order'), ('{E}Transaction'), ('" + S.THING + "')) t(super)")
def t3(spark, d):
    tb = ontology(spark)
    return P.types_of(graph(spark, d, "orders"), tb).join(T.class_sub_closure(tb).withColumnRenamed("sub", "class"), "class").select("s", "super")


@query("t3_subsumption", "with recursive steps(src, dst) as (select p_partkey, p_partkey // 2 from part where p_partkey > 1 union select p_partkey, p_partkey - 7 from part where p_partkey % 50 = 0), below(k) as (select 5::bigint union select src from steps join below on dst = k) select '{E}part/' || k as p from below")
def t3_subsumption(spark, d):
    """What lies below one of as many classes as there are parts, some with two above them, by numbers of their trees."""
    rows = table(spark, d, "part")
    near = rows.where("p_partkey > 1").select(iri("part", "p_partkey").alias("src"), iri("part", F.expr("p_partkey div 2")).alias("dst"))
    far = rows.where("p_partkey % 50 = 0").select(iri("part", "p_partkey").alias("src"), iri("part", F.col("p_partkey") - 7).alias("dst"))
    return Subsumption(rows.select(iri("part", "p_partkey").alias("node")), near.union(far)).below(EX + "part/5")


@query("t4_property_closure", "select '{E}part/' || p_partkey as s, p, super from part, (values ('{E}name', '{E}name'), ('{E}name', '" + S.TOP_ATTRIBUTE + "'), ('{E}number', '{E}number'), ('{E}number', '" + S.TOP_ATTRIBUTE + "'), ('{E}size', '{E}size'), ('{E}size', '{E}number'), ('{E}size', '" + S.TOP_ATTRIBUTE + "')) t(p, super)")
def t4(spark, d):
    closure = T.property_closure(ontology(spark), "attribute").withColumnRenamed("sub", "p")
    return graph(spark, d, "part").where("o_kind = 'literal'").join(closure, "p").select("s", "p", "super")


@query("t5_is_sub", "select s, true as is_party, false as is_place, true as above from (" + PARTIES + ")")
def t5(spark, d):
    tb = ontology(spark)
    sub, other, above = T.is_sub(tb.classes, name("Customer"), name("Party")), T.is_sub(tb.classes, name("Customer"), name("Place")), T.is_super(tb.classes, name("Party"), name("Supplier"))
    return P.individuals(graph(spark, d, "customer", "supplier"), tb).select("s", F.lit(sub).alias("is_party"), F.lit(other).alias("is_place"), F.lit(above).alias("above"))


@query("t6_inverses", "select '{E}order/' || o_orderkey as s, '{E}placedBy' as p, '{E}customer/' || o_custkey as o from orders")
def t6(spark, d):
    t = S.links(graph(spark, d, "orders"))
    return t.join(T.inverses(ontology(spark)), "p").select(F.col("o").alias("s"), F.col("inverse").alias("p"), F.col("s").alias("o"))


def renamed(spark, d):
    """Suppliers of even numbers with other names and no balance."""
    rows = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    return tables.individuals_from_table(rows, name("Supplier"), iri("supplier", "s_suppkey"), {name("name"): (F.concat(F.lit("new "), "s_name"), S.XSD + "string")})


OLD = "select '{E}supplier/' || s_suppkey as s, '{E}name' as p, s_name as o from supplier union all select '{E}supplier/' || s_suppkey, '{E}number', cast(s_suppkey as varchar) from supplier union all select '{E}supplier/' || s_suppkey, '{TYPE}', '{E}Supplier' from supplier union all select '{E}nation/' || s_nationkey, '{E}hasSupplier', '{E}supplier/' || s_suppkey from supplier"
NEW = "select '{E}supplier/' || s_suppkey as s, '{E}name' as p, 'new ' || s_name as o from supplier where s_suppkey % 2 = 0 union all select '{E}supplier/' || s_suppkey, '{TYPE}', '{E}Supplier' from supplier where s_suppkey % 2 = 0"


def suppliers(spark, d):
    return graph(spark, d, "supplier").where(F.col("p") != name("balance"))


@query("g3_upsert_replace", "select s, p, o from (" + OLD + ") where s not in (select s from (" + NEW + ")) union all " + NEW)
def g3_replace(spark, d):
    return U.upsert(suppliers(spark, d), renamed(spark, d)).select("s", "p", "o")


@query("g3_upsert_merge", "select s, p, o from (" + OLD + ") union select * from (" + NEW + ")")
def g3_merge(spark, d):
    return U.upsert(suppliers(spark, d), renamed(spark, d), "merge").select("s", "p", "o")


@query("g14_clear", "select s, p, o from (" + OLD + ") where false")
def g14(spark, d):
    return U.clear(suppliers(spark, d)).select("s", "p", "o")


@query("g15_graph_equal", "select '{E}supplier/' || s_suppkey as s, true as same, false as other from supplier")
def g15(spark, d):
    t = suppliers(spark, d)
    same, other = U.graph_equal(t, t.repartition(3, "o")), U.graph_equal(t, t.where(F.col("o") != EX + "supplier/1"))
    return P.individuals(t, ontology(spark)).where(F.col("s").contains("supplier/")).select("s", F.lit(same).alias("same"), F.lit(other).alias("other"))


def addresses(spark, d, prefix):
    """Customers with an address each, a blank node that leads to another one with the nation and the segment."""
    outer, inner = F.concat(F.lit(f"_:{prefix}o"), "c_custkey"), F.concat(F.lit(f"_:{prefix}i"), "c_custkey")
    rows = table(spark, d, "customer")
    return S.from_structs(rows, S.link(iri("customer", F.col("c_nationkey")), name("address"), outer), S.link(outer, name("in"), inner), S.link(inner, name("inNation"), iri("nation", "c_nationkey")), S.literal(inner, name("name"), F.col("c_mktsegment")))


@query("g15_blank_forms", "select a.n, a.n = b.n as same from (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) a join (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) b using (c_nationkey, c_mktsegment)")
def g15_forms(spark, d):
    a, b = I.blank_forms(addresses(spark, d, "a")), I.blank_forms(addresses(spark, d, "b"))
    return a.join(b.toDF("form", "m"), "form", "full").select("n", (F.col("n") == F.col("m")).alias("same"))


def changed(spark, d, f):
    """What `f` makes of the numbers of suppliers, with every third's own number and every fifth's next one."""
    rows = table(spark, d, "supplier")
    key, number = iri("supplier", "s_suppkey").alias("s"), lambda c: c.cast("string").alias("value")
    changes = rows.where("s_suppkey % 3 = 0").select(key, number(F.col("s_suppkey"))).union(rows.where("s_suppkey % 5 = 0").select(key, number(F.col("s_suppkey") + 1)))
    return f(suppliers(spark, d), ontology(spark), name("number"), changes).select("s", "p", "o")


REST = "select s, p, o from (" + OLD + ") where p <> '{E}number' union all select '{E}supplier/' || k, '{E}number', cast(v as varchar) from "
HAVE, WANT = "(select s_suppkey as k, s_suppkey as v from supplier)", "(select s_suppkey as k, s_suppkey as v from supplier where s_suppkey % 3 = 0 union select s_suppkey, s_suppkey + 1 from supplier where s_suppkey % 5 = 0)"


@query("g6_attributes_add", REST + "(" + HAVE + " union " + WANT + ")")
def g6_add(spark, d):
    return changed(spark, d, U.attributes_add)


@query("g6_attributes_remove", REST + "(" + HAVE + " except " + WANT + ")")
def g6_remove(spark, d):
    return changed(spark, d, U.attributes_remove)


@query("g6_attributes_intersect", REST + "(select * from " + HAVE + " h where k not in (select k from " + WANT + ") or (k, v) in (select k, v from " + WANT + "))")
def g6_intersect(spark, d):
    return changed(spark, d, U.attributes_intersect)


@query("g6_attributes_xor", REST + "((" + HAVE + " except " + WANT + ") union all (" + WANT + " except " + HAVE + "))")
def g6_xor(spark, d):
    return changed(spark, d, U.attributes_xor)


def relinked(spark, d, f):
    """What `f` makes of the suppliers of nations, with every third supplier's nation and every fifth's next one."""
    rows = table(spark, d, "supplier")
    pair = lambda n: [iri("nation", n).alias("s"), iri("supplier", "s_suppkey").alias("o")]
    wanted = rows.where("s_suppkey % 3 = 0").select(*pair("s_nationkey")).union(rows.where("s_suppkey % 5 = 0").select(*pair((F.col("s_nationkey") + 1) % 25)))
    out = f(graph(spark, d, "nation", "supplier"), ontology(spark), name("hasSupplier"), wanted)
    return out.where(F.col("p") == name("hasSupplier")).select("s", "p", "o")


LINKED, WISHED = "(select s_nationkey as n, s_suppkey as k from supplier)", "(select s_nationkey as n, s_suppkey as k from supplier where s_suppkey % 3 = 0 union select (s_nationkey + 1) % 25, s_suppkey from supplier where s_suppkey % 5 = 0)"
PAIR = "select '{E}nation/' || n as s, '{E}hasSupplier' as p, '{E}supplier/' || k as o from "


@query("g9_intersect_links", PAIR + "(select * from " + LINKED + " l where n not in (select n from " + WISHED + ") or (n, k) in (select n, k from " + WISHED + "))")
def g9_intersect(spark, d):
    return relinked(spark, d, U.intersect_links)


@query("g9_xor_links", PAIR + "((" + LINKED + " except " + WISHED + ") union all (" + WISHED + " except " + LINKED + "))")
def g9_xor(spark, d):
    return relinked(spark, d, U.xor_links)


@query("g11_set_label", "select '{E}document/' || doc_id as s, case when doc_id % 2 = 0 then 'new ' || doc_id else source end as o, case when doc_id % 2 = 0 then 'en' else '' end as o_lang from documents")
def g11_label(spark, d):
    """Documents with their source as label, of which those of even numbers get a new one in its place."""
    t = graph(spark, d, "documents").where((F.col("p") == S.TYPE) | (F.col("o_dt") == S.XSD + "string"))
    new = table(spark, d, "documents").where("doc_id % 2 = 0").select(iri("document", "doc_id").alias("s"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("label"), F.lit("en").alias("lang"))
    return U.set_label(t, new).where(F.col("p") == S.LABEL).select("s", "o", "o_lang")


@query("g12_container_disconnect", "select '{E}box/' || c_nationkey as container, '{E}customer/' || c_custkey as reference from customer where c_custkey % 2 <> 0 union all select '{E}box/' || n_nationkey, '{E}lost/' || n_nationkey from nation")
def g12_disconnect(spark, d):
    pairs = table(spark, d, "customer").where("c_custkey % 2 = 0").select(iri("box", "c_nationkey").alias("container"), iri("customer", "c_custkey").alias("reference"))
    return N.container_references(U.container_disconnect(contained(spark, d), pairs))


@query("f3_result_types", "select '{E}nation/' || c_nationkey as nation, upper(c_name) as customer_name, cast(c_acctbal as decimal(18,2)) as balance, cast(null as varchar) as page from customer")
def f3(spark, d):
    """Results read as a type, through a function, and as individuals, of which the pages are none."""
    pages = S.from_structs(table(spark, d, "customer"), S.link(iri("customer", "c_custkey"), name("remark"), iri("page", "c_custkey")))
    t, tb = graph(spark, d, "nation", "customer").unionByName(pages), ontology(spark)
    rows = N.bgp(t, [("?c", name("inNation"), "?nation"), ("?c", name("name"), "?customer_name"), ("?c", name("balance"), "?balance"), ("?c", name("remark"), "?page")])
    known = P.individuals(t, tb)
    return X.result_types(rows, known, nation="individual", page="individual", balance="decimal(18,2)", customer_name=F.upper).select("nation", "customer_name", "balance", "page")


@query("j16_plot_nodes", "select '{E}supplier/' || s_suppkey as s, 'individual' as kind, '{E}Supplier' as class, '{E}name=' || s_name as first_name from supplier union all select '{E}nation/' || n_nationkey, 'individual', '{E}Nation', '{E}name=' || n_name from nation")
def j16_nodes(spark, d):
    """What is drawn for nations, grown by their parties."""
    t, tb = graph(spark, d, "nation", "supplier"), ontology(spark)
    drawn = A.drawn(t, tb, P.get_by_class(t, tb, name("Nation")), [name("hasParty")])
    rows = A.plot_nodes(t, tb, drawn)
    return rows.select("s", "kind", F.col("classes")[0].alias("class"), F.filter("attributes", lambda x: x.contains("#name="))[0].alias("first_name"))


@query("j16_plot_is_a", "select '{E}customer/' || c_custkey as s, " + SEGMENT + " as src, '{E}Customer' as dst from customer union all select '{E}supplier/' || s_suppkey, '{E}Supplier', '{E}Party' from supplier")
def j16_is_a(spark, d):
    tb = ontology(spark)
    return P.types_of(graph(spark, d, "customer", "supplier"), tb).join(A.plot_is_a(tb).withColumnRenamed("src", "class"), "class").select("s", F.col("class").alias("src"), "dst")


@query("a4_any_of", "select '{E}customer/' || c_custkey as s, min('{E}order/' || o_orderkey) as any from customer left join orders on o_custkey = c_custkey group by 1")
def a4_any(spark, d):
    t, tb = graph(spark, d, "customer", "orders"), ontology(spark)
    return A.any_of(P.get_by_class(t, tb, name("Customer")).join(N.neighbors(t, tb, name("places")), "s", "left"), element="neighbor")


@query("hub_degrees", "select '{E}part/' || l_partkey as part, count(distinct l_orderkey) as n from lineitem group by 1")
def hub_degrees(spark, d):
    """Orders of each part: hubs are summed before they are dealt."""
    t = graph(spark, d, "lineitem")
    return S.links(N.match_p(t, name("orders"))).groupBy(F.col("o").alias("part")).agg(F.count("*").alias("n"))


@query("flagship", "select '{E}region/' || n_regionkey as region, count(*) as customers from customer join nation on n_nationkey = c_nationkey group by 1")
def flagship(spark, d):
    """Customers within each region, through nations, by sub-relationships and inverses."""
    t, tb = graph(spark, d, "region", "nation", "customer"), ontology(spark)
    inside = R.find_by_class(t, tb, roots(t, tb), name("Customer"), relationships=[name("encloses")], annotations=False)
    return inside.groupBy(F.col("root").alias("region")).agg(F.count("*").alias("customers"))
