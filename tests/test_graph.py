"""Operators on graphs against small worlds whose answers are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplespark import schema as S
from triplespark.functions import scalar as X
from triplespark.operators import aggregate as A
from triplespark.operators import navigate as N
from triplespark.operators import search as R
from triplespark.operators import select as P
from triplespark.operators import tbox as T
from triplespark.operators import update as U
from triplespark.sources import rdf, tables

from .conftest import CITY, names

c = lambda x: CITY + x


@pytest.fixture(scope="module")
def world(make):
    things = {"fr": ("City", {"name": "Freiburg"}), "pr": ("City", {"name": "Paris"}), "marc": ("Citizen", {"name": "Marc", "age": "25"}), "sveta": ("Citizen", {"age": "25"}), "lukas": ("Citizen", {"age": "3"}), "ahmed": ("Citizen", {"age": "30"})}
    links = [("fr", "hasInhabitant", "marc"), ("fr", "hasInhabitant", "sveta"), ("fr", "hasInhabitant", "lukas"), ("sveta", "hasChild", "lukas"), ("marc", "hasChild", "lukas"), ("fr", "hasWorker", "ahmed"), ("pr", "hasInhabitant", "ahmed"), ("pr", "hasWorker", "ahmed")]
    return make(things, links)


def root(spark, key="fr"):
    return spark.createDataFrame([(c(key),)], "s string")


def found(df):
    return names(df, "node")


@pytest.mark.parametrize(
    ("rels", "expected"),
    [
        ([S.TOP_RELATIONSHIP], ["ahmed", "fr", "lukas", "marc", "sveta"]),
        ([c("hasInhabitant")], ["fr", "lukas", "marc", "sveta"]),
        ([c("hasPart")], ["ahmed", "fr"]),
        ([c("hasWorker")], ["ahmed", "fr"]),
        ([c("hasWorker"), c("hasInhabitant")], ["ahmed", "fr", "lukas", "marc", "sveta"]),
        ([c("hasMajor")], ["fr"]),
    ],
)
def test_find(spark, city, world, rels, expected):
    assert found(R.find(world, city, root(spark), relationships=rels)) == expected


def test_find_variants(spark, city, world):
    nothing = spark.createDataFrame([], "s string")
    assert found(R.find(world, city, root(spark), nothing)) == []
    assert R.find_first(world, city, root(spark), nothing).collect()[0]["node"] is None
    assert found(R.find_by_class(world, city, root(spark), c("Citizen"))) == ["ahmed", "lukas", "marc", "sveta"]
    assert found(R.find_by_attribute(world, city, root(spark), c("age"), "25")) == ["marc", "sveta"]
    assert found(R.find_relationships(world, city, root(spark), c("hasChild"))) == ["marc", "sveta"]
    assert R.find_by_identifier(world, city, root(spark), c("lukas")).collect()[0]["node"] == c("lukas")
    pair = spark.createDataFrame([(c("fr"), c("lukas"))], "s string, o string")
    cut = U.disconnect(world, city, c("hasInhabitant"), pair)
    assert found(R.find(cut, city, root(spark))) == ["ahmed", "fr", "lukas", "marc", "sveta"]
    assert found(R.find(cut, city, root(spark), max_depth=1)) == ["ahmed", "fr", "marc", "sveta"]


def test_patterns(spark, city, make, world):
    assert names(N.bgp(world, [("?person", S.TYPE, c("Citizen"))]), "person") == ["ahmed", "lukas", "marc", "sveta"]
    assert N.bgp(U.clear(world), [("?person", S.TYPE, c("Citizen"))]).count() == 0
    t = make({"fr": ("City", {"name": "Freiburg"}), "karl": ("Citizen", {"name": "Karl", "age": "47"})}, [("fr", "hasInhabitant", "karl")])
    rows = N.bgp(t, [("?city", S.TYPE, c("City")), ("?city", c("name"), "?city_name"), ("?city", c("hasInhabitant"), "?citizen"), ("?citizen", c("age"), "?age"), ("?citizen", c("name"), "?citizen_name")])
    assert [(r["city_name"], r["age"], r["citizen_name"]) for r in X.result_types(rows, age="int").collect()] == [("Freiburg", 47, "Karl")]
    assert N.ask(t, [("?x", c("age"), "47")]) and not N.ask(t, [("?x", c("age"), "48")])
    with pytest.raises(ValueError):
        N.bgp(t, [("?a", S.TYPE, "?b"), ("?c", c("age"), "?d")])


def test_navigation(spark, city, make):
    t = make({"freiburg": ("City", {}), "altstadt": ("Neighborhood", {}), "marc": ("Citizen", {"name": "Marc", "age": "25"}), "sveta": ("Citizen", {}), "paris": ("City", {})}, [("freiburg", "hasPart", "altstadt"), ("freiburg", "hasInhabitant", "marc"), ("freiburg", "hasInhabitant", "sveta"), ("freiburg", S.TOP_RELATIONSHIP, "paris")])
    near = lambda *a, **k: names(N.neighbors(t, city, *a, **k).where(F.col("s") == c("freiburg")), "neighbor")
    assert near() == ["altstadt", "marc", "paris", "sveta"]
    assert near(c("encloses")) == ["altstadt", "marc", "sveta"]
    assert near(cls=c("Citizen")) == near(cls=c("Person")) == ["marc", "sveta"]
    assert near(cls=c("Building")) == []
    asked = spark.createDataFrame([(0, c("freiburg"), c("sveta")), (1, c("freiburg"), c("marc")), (2, c("freiburg"), c("nobody"))], "pos int, s string, id string")
    assert [r["neighbor"] for r in N.neighbors(t, city, ids=asked).collect()] == [c("sveta"), c("marc"), None]
    assert [r["neighbor"] for r in N.neighbors(t, city, c("hasPart"), ids=asked.where("pos = 1")).collect()] == [None]
    assert sorted((r["neighbor"].removeprefix(CITY), r["relationship"].removeprefix(CITY)) for r in N.neighbors_with_rel(t, city, c("encloses")).collect()) == [("altstadt", "hasPart"), ("marc", "hasInhabitant"), ("sveta", "hasInhabitant")]
    assert names(N.neighbors(t, city, c("encloses"), inverse=True).where(F.col("s") == c("marc")), "neighbor") == ["freiburg"]
    assert {r["s"].removeprefix(CITY): r["attributes"] for r in A.attribute_map(t, city).collect()} == {"marc": {c("name"): ["Marc"], c("age"): ["25"]}}


def test_ontology(city):
    below = lambda closure, x: names(closure.where(F.col("super") == x), "sub")
    assert names(city.kinds.where(F.col("s").startswith(CITY))).__len__() == 28
    assert names(city.attributes.where(F.col("sub") == c("name")), "super") == [S.TOP_ATTRIBUTE, "name"]
    assert below(city.attributes, c("name")) == ["name"]
    assert T.is_sub(city.attributes, c("age"), c("number")) and not T.is_super(city.attributes, c("age"), c("number"))
    assert {r["attribute"]: r["datatype"] for r in T.attribute_datatypes(city).collect()}[c("age")] == S.XSD + "integer"
    assert names(T.class_attributes(city).where(F.col("class") == c("Person")), "attribute") == ["age", "name"]
    assert T.class_axioms(city).where(F.col("class") == c("Person")).count() == 2
    inverse = {r["p"]: r["inverse"] for r in T.inverses(city).collect()}
    assert inverse[c("hasWorker")] == c("worksIn") and c("hasInhabitant") not in inverse and c("isPartOf") not in inverse
    assert {(r["quantifier"], r["rtype"], r["target"]) for r in T.restrictions(city).collect()} == {("EXACTLY", "ATTRIBUTE", "1")}
    assert c("Citizen") in [r["sub"] for r in T.class_sub_closure(city).where(F.col("super") == S.THING).collect()]
    assert [r["s"] for r in P.from_label(city.triples, "Name").collect()] == [c("name")]
    assert P.from_label(city.triples, "Name", case_sensitive=True).count() == P.from_label(city.triples, "name", "jp").count() == 0
    assert P.resolve_name(city, CITY, "City").collect()[0]["s"] == c("City") and P.resolve_name(city, CITY, "Nothing").collect()[0]["n"] == 0


def test_compositions(spark):
    rows = [("_:a", S.TYPE, S.OWL + "Class"), ("_:a", S.OWL + "unionOf", "_:1"), ("_:1", S.RDF + "first", "x:A"), ("_:1", S.RDF + "rest", "_:2"), ("_:2", S.RDF + "first", "x:B"), ("_:2", S.RDF + "rest", S.RDF + "nil"), ("_:b", S.TYPE, S.OWL + "Class"), ("_:b", S.OWL + "complementOf", "x:C")]
    got = {r["id"]: (r["operator"], r["operands"]) for r in T.compositions(T.load_tbox(S.triples(spark, rows))[0]).collect()}
    assert got == {"_:a": ("OR", ["x:A", "x:B"]), "_:b": ("NOT", ["x:C"])}


def test_sub_relationship_updates(spark, city, make):
    t = make({x: ("Citizen", {}) for x in ("aimee", "marc", "clement")} | {"paris": ("City", {})}, [("paris", "hasMajor", "aimee"), ("paris", "hasWorker", "marc"), ("paris", "hasInhabitant", "clement")])
    pairs = lambda *x: spark.createDataFrame([(c("paris"), c(k)) for k in x], "s string, o string")
    of = lambda g, rel: names(N.neighbors(g, city, c(rel)).where(F.col("s") == c("paris")), "neighbor")
    same = U.assign_links(t, city, c("hasWorker"), pairs("aimee", "marc"))
    assert of(same, "hasMajor") == ["aimee"] and of(same, "encloses") == ["aimee", "clement", "marc"]
    assert U.graph_equal(U.connect(t, city, pairs("aimee"), c("hasWorker")), t)
    more = U.disconnect(U.connect(t, city, pairs("clement"), c("hasWorker")), city, c("hasMajor"), pairs("aimee"))
    assert of(more, "hasWorker") == ["clement", "marc"]
    assert of(U.xor_links(t, city, c("hasWorker"), pairs("marc", "clement")), "hasWorker") == ["aimee", "clement"]
    assert of(U.intersect_links(t, city, c("hasWorker"), pairs("marc")), "hasWorker") == ["marc"]


def test_add_and_delete(spark, city, make):
    t = make({"fr": ("City", {}), "klaus": ("Citizen", {"age": "59", "name": "Klaus"})}, [("fr", "hasInhabitant", "klaus")])
    empty = t.limit(0)
    fr = t.where(F.col("s") == c("fr"))
    assert U.add(empty, fr, city).count() == 1 and U.add(empty, t, city).count() == 5
    outer = make({"klaus": ("Citizen", {"age": "20", "name": "Klaus outer"})})
    assert names(U.existing(t, outer, city)) == ["klaus"]
    ages = lambda g: sorted(r["o"] for r in P.attribute_values(g, city, c("age")).collect())
    assert ages(U.add(t, outer, city)) == ["20"] and ages(U.add(t, outer, city, merge=True)) == ["20", "59"]
    left = U.delete(t, root(spark, "klaus"))
    assert names(P.individuals(left, city)) == ["fr"] and left.count() == 1
    assert names(U.not_contained(t, root(spark, "nobody"), city)) == ["nobody"]
    assert U.upsert(t, outer).where(F.col("s") == c("klaus")).count() == 3


def test_set_algebra(spark, city, make):
    t = make({"fr": ("City", {}), "lena": ("Citizen", {"age": "90"}), "bob": ("Citizen", {"age": "2"}), "st": ("Neighborhood", {})})
    other = make({"fr": ("City", {}), "lena": ("Citizen", {"age": "23"}), "st": ("Neighborhood", {})})
    both = U.session_intersection(t, other, city)
    assert names(P.individuals(both, city)) == ["fr", "lena", "st"]
    assert sorted(r["o"] for r in P.attribute_values(both, city, c("age")).collect()) == ["23", "90"]
    assert names(P.individuals(U.session_difference(t, other, city), city)) == ["bob"]
    new = make({"x": ("City", {}), "bob": ("Citizen", {})})
    assert names(P.individuals(U.session_symmetric_difference(t, new, city), city)) == ["fr", "lena", "st", "x"]
    assert names(U.filter_violations(t, city, c("Citizen"))) == ["fr", "st"]
    elements = spark.createDataFrame([("two", "a"), ("two", "b"), ("one", "a"), ("none", None)], "s string, element string")
    assert {r["s"]: (r["one"], r["status"]) for r in A.one(elements).collect()} == {"two": (None, "multiple"), "one": ("a", "ok"), "none": (None, "empty")}
    assert {r["s"]: r["any"] for r in A.any_of(elements).collect()} == {"two": "a", "one": "a", "none": None}


def test_attributes(spark, city, make):
    t = make({"a": ("Citizen", {"age": ("1", "2"), "postalCode": "7"})})
    change = lambda *v: spark.createDataFrame([(c("a"), x) for x in v], "s string, value string")
    values = lambda g, a="age": sorted(r["o"] for r in P.attribute_values(g, city, c(a)).collect())
    assert values(t, "number") == ["1", "2", "7"]
    assert values(U.attributes_add(t, city, c("age"), change("3", "003", None))) == ["1", "2", "3"]
    assert values(U.attributes_remove(t, city, c("number"), change("7", "1")), "number") == ["2"]
    assert values(U.attributes_assign(t, city, c("age"), change("2", "9"))) == ["2", "9"]
    assert values(U.attributes_assign(t, city, c("age"), change(None))) == []
    assert values(U.attributes_intersect(t, city, c("age"), change("2", "9"))) == ["2"]
    assert values(U.attributes_xor(t, city, c("age"), change("2", "9"))) == ["1", "9"]
    assert A.functional_value(t, city, c("age")).collect()[0]["n"] == 2
    assert names(P.has_attribute_value(t, city, c("number"), "7", S.XSD + "integer")) == ["a"]


def test_unsupported_triples(spark, city):
    rows = [("x:1", S.TYPE, S.THING), ("x:1", "no:1", "no:2"), ("x:1", "no:3", "58", "no:4")]
    t = S.triples(spark, rows).union(spark.createDataFrame([("18", "literal", "x:some", S.THING, "iri", "", "")], S.SCHEMA))
    assert U.unsupported(t, city).count() == 3
    assert [tables.import_triples(t, city, k).count() for k in ("individuals", "all_triples", "all_statements")] == [1, 3, 4]
    assert P.individuals(t, city).count() == 1
    bad = S.triples(spark, [("x:1", S.TYPE, "no:5"), ("x:2", S.TYPE, S.OWL + "Class")])
    assert sorted((r["violation"], r["severity"]) for r in tables.check_import(bad, city, all_triples=True).collect()) == [("ontology term", "error"), ("unknown type", "warning")]


def test_labels(spark):
    tag = S.RDF + "langString"
    rows = [("x:1", S.PREF_LABEL, "Freiburg prefLabel", S.XSD + "string"), ("x:1", S.LABEL, "Freiburg label", S.XSD + "string")]
    rows += [("x:2", S.PREF_LABEL, x, tag if lang else S.XSD + "string", lang) for x, lang in (("u", ""), ("d", "de"), ("i", "it"), ("e", "en"))]
    t = S.triples(spark, rows)
    label = lambda **k: {r["s"]: r["label"] for r in P.preferred_label(t, **k).collect()}
    assert label() == {"x:1": "Freiburg prefLabel", "x:2": "e"}
    assert label(predicates=(S.LABEL, S.PREF_LABEL))["x:1"] == "Freiburg label"
    assert label(languages=("it", "en", "de"))["x:2"] == "i"
    new = spark.createDataFrame([("x:1", "New", ""), ("x:2", None, "")], "s string, label string, lang string")
    assert {r["s"]: r["label"] for r in P.preferred_label(U.set_label(t, new)).collect()} == {"x:1": "New"}


def test_relationships_between(spark, city, make):
    t = make({"fr": ("City", {}), "marc": ("Citizen", {})}, [("fr", "hasMajor", "marc"), ("fr", "hasInhabitant", "marc"), ("marc", "hasChild", "fr")])
    pair = lambda a, b: spark.createDataFrame([(c(a), c(b))], "s string, o string")
    assert U.graph_equal(U.connect(t, city, pair("fr", "marc"), S.TOP_RELATIONSHIP), t)
    of = lambda a, b: N.relationships_between(t, city, pair(a, b)).collect()[0]["relationships"]
    assert of("fr", "marc") == [c("hasInhabitant"), c("hasMajor")] and of("marc", "fr") == [c("hasChild")]


def test_containers(spark, city, make):
    t = S.union(make({"a": ("City", {})}), S.triples(spark, [("x:box", S.TYPE, S.GRAPH + "Container"), ("x:box", S.CONTAINS, c("a")), ("x:box", S.CONTAINS, "x:lost")]))
    assert [tuple(r) for r in N.container_counts(t, city).collect()] == [("x:box", 2, 1)]
    pairs = spark.createDataFrame([("x:box", c("a")), ("x:box", "x:other")], "container string, reference string")
    assert sorted(r["contains"] for r in N.container_contains(t, pairs).collect()) == [False, True]
    assert N.container_references(U.container_disconnect(t, pairs)).count() == 1
    assert sorted(r["reference"] for r in N.container_references(U.container_assign(t, pairs)).collect()) == [c("a"), "x:other"]


def test_changelog(spark):
    base = S.triples(spark, [("x:1", "p", "a"), ("x:1", "p", "b"), ("x:2", "p", "a")])
    log = [(1, "add", ("x:3", "p", "c")), (2, "delete", ("x:1", "p", "a")), (3, "add", ("x:1", "p", "a")), (4, "delete", ("x:2", "p", "a")), (5, "add", ("x:4", "p", "d"))]
    rows = S.triples(spark, [t for _, _, t in log]).collect()
    changes = spark.createDataFrame([(n, op, *r) for (n, op, _), r in zip(log, rows)], "seq long, op string, " + ", ".join(f"{k} string" for k in S.COLUMNS))
    out = lambda g: sorted((r["s"], r["o"]) for r in g.collect())
    assert out(U.apply_changelog(base, changes)) == [("x:1", "a"), ("x:1", "b"), ("x:3", "c"), ("x:4", "d")]
    patterns = spark.createDataFrame([(2, "x:1", None, None)], "seq long, s string, p string, o string")
    assert out(U.apply_changelog(base, changes, patterns)) == [("x:1", "a"), ("x:3", "c"), ("x:4", "d")]
    everything = spark.createDataFrame([(4, None, None, None)], "seq long, s string, p string, o string")
    assert out(U.apply_changelog(base, changes, everything)) == [("x:4", "d")]
    assert {r["s"]: r["change"] for r in A.entity_changes(base, changes).collect()} == {"x:1": "updated", "x:2": "deleted", "x:3": "added", "x:4": "added"}


def test_annotations(spark, city):
    note = "x:note"
    tb = T.load_tbox(city.triples, S.triples(spark, [(note, S.TYPE, S.OWL + "AnnotationProperty")]))[0]
    t = S.triples(spark, [("x:g", S.TYPE, c("City")), ("x:g", note, c("City")), ("x:g", note, "18", S.XSD + "integer"), ("x:g", note, "a string", S.XSD + "string"), ("x:g", note, "x:g")])
    assert sorted((r["value"], r["source"]) for r in P.annotation_values(t, tb, note).collect()) == sorted([(c("City"), "ontology"), ("18", "literal"), ("a string", "literal"), ("x:g", "graph")])
    assert sorted(r["o"] for r in P.annotation_edges(t, tb).collect()) == [c("City"), "x:g"]
    new = U.annotations_assign(t, note, S.triples(spark, [("x:g", note, "15", S.XSD + "decimal")]))
    assert [r["value"] for r in P.annotation_values(new, tb, note).collect()] == ["15"]


def test_files(spark, city, world, tmp_path):
    odd = S.union(world, S.triples(spark, [("x:q", c("name"), 'a "b"\\\n\té', S.RDF + "langString", "fr"), ("x:q", c("hasPart"), "_:b1")]))
    rdf.write_ntriples(odd, f"{tmp_path}/nt")
    assert U.graph_equal(rdf.read_ntriples(spark, f"{tmp_path}/nt"), odd) and rdf.bad_lines(spark, f"{tmp_path}/nt").count() == 0
    (tmp_path / "u.nt").write_text('<x:a> <x:p> "\\u00e9\\U0001F600"^^<x:t> .\n# note\n\nnonsense\n')
    assert [r["o"] for r in rdf.read_ntriples(spark, f"{tmp_path}/u.nt").collect()] == ["é\U0001f600"]
    assert rdf.bad_lines(spark, f"{tmp_path}/u.nt").count() == 1
    rdf.write_jsonld(odd, f"{tmp_path}/jl")
    assert U.graph_equal(rdf.read_jsonld_lines(spark, f"{tmp_path}/jl"), odd)
    rdf.write_store(world, city, f"{tmp_path}/store")
    assert U.graph_equal(rdf.read_store(spark, f"{tmp_path}/store"), world)
    assert rdf.read_store(spark, f"{tmp_path}/store", "type").count() == 6


def test_jsonld_document(spark, city, tmp_path):
    text = '{"@context": {"city": "%s"}, "@graph": [{"@id": "city:p", "@type": "city:Citizen", "city:name": "Peter", "city:age": 23, "city:hasChild": [{"@id": "city:a"}, {"@id": "city:b"}], "%s": true}, {"@id": "city:a", "@type": ["city:Person"], "city:name": {"@value": "Anna", "@language": "EN"}}]}' % (CITY, S.MAIN)
    (tmp_path / "x.json").write_text(text)
    t = rdf.read_jsonld(spark, f"{tmp_path}/x.json")
    assert U.graph_equal(t, S.triples(spark, [(c("p"), S.TYPE, c("Citizen")), (c("p"), c("name"), "Peter", S.XSD + "string"), (c("p"), c("age"), "23", S.XSD + "integer"), (c("p"), c("hasChild"), c("a")), (c("p"), c("hasChild"), c("b")), (c("p"), S.MAIN, "true", S.XSD + "boolean"), (c("a"), S.TYPE, c("Person")), (c("a"), c("name"), "Anna", S.RDF + "langString", "en")]))
    assert names(rdf.main_individual(t, P.individuals(t, city))) == ["p"]


def test_jsonld_kinds(spark):
    """Lists, mixed values, strings that look like something else, and what isn't understood."""
    text = '''{"@context": {"ex": "http://e/", "age": {"@id": "ex:age", "@type": "http://www.w3.org/2001/XMLSchema#long"}, "knows": {"@id": "http://e/knows", "@type": "@id"}, "@vocab": "http://v/"},
    "@graph": [{"@id": "ex:a", "@type": ["ex:T", "U"], "ex:p": ["a", "b", 1, 2.5, true, null, "42"], "ex:q": "[draft] x", "ex:r": "{y}", "ex:s": {"@value": "79111"}, "ex:t": {"@value": 7}, "ex:u": {"@value": "x", "@language": "EN"},
    "age": 5, "knows": ["ex:b", "http://z/c"], "free": "f", "ex:n": {"@id": "ex:z", "ex:name": "in"}, "ex:l": {"@list": [1]}, "ex:m": {"@id": "_:b0"}}, {"ex:p": "no id"}]}'''
    docs = spark.createDataFrame([(text,), ("{bad",), ('[{"@id": "http://e/x", "http://e/p": "y"}]',), ('{"@id": "http://e/y", "http://e/p": [3]}',), ("",), (None,)], "value string")
    x, rdf_type = S.XSD, S.TYPE
    want = {("a", rdf_type, "http://e/T", ""), ("a", rdf_type, "http://v/U", ""), ("a", "p", "a", x + "string"), ("a", "p", "b", x + "string"), ("a", "p", "1", x + "integer"), ("a", "p", "2.5", x + "double"), ("a", "p", "true", x + "boolean"), ("a", "p", "42", x + "string")}
    want |= {("a", "q", "[draft] x", x + "string"), ("a", "r", "{y}", x + "string"), ("a", "s", "79111", x + "string"), ("a", "t", "7", x + "integer"), ("a", "u", "x", S.RDF + "langString"), ("a", "age", "5", x + "long"), ("a", "knows", "http://e/b", ""), ("a", "knows", "http://z/c", "")}
    want |= {("a", "http://v/free", "f", x + "string"), ("a", "m", "_:b0", ""), ("x", "p", "y", x + "string"), ("y", "p", "3", x + "integer")}
    got = {(r["s"].removeprefix("http://e/"), r["p"].removeprefix("http://e/"), r["o"], r["o_dt"]) for r in rdf.parse_jsonld(docs).where("s_kind = 'iri' and p <> 'http://e/l'").collect()}
    assert got == want | {("a", "n", "http://e/z", ""), ("z", "name", "in", x + "string")}
    bad = {(r["id"], r["k"], r["x"]) for r in rdf.bad_jsonld(docs).collect()}
    assert bad == {(None, None, "{bad"), (None, None, "")}
    assert rdf.parse_jsonld(docs.limit(0)).collect() == []


def test_ntriples_escapes(spark):
    """One pass over escapes; numbers that are no characters make bad lines; long literals and many escapes."""
    b = "\\"
    lines = [
        f'<http://e/a> <http://e/p> "C:{b}{b}u00e9x" .', f'<http://e/a> <http://e/q> "{b}U0001F600 {b}u00e9 {b}{b}{b}{b} {b}t{b}"" .', f'<http://e/{b}u00e9> <http://e/p> <http://e/o> .', '<http://e/a> <http://e/n> "' + f"{b}n" * 20_000 + '" .', '<http://e/a> <http://e/l> "' + "ab" * 200_000 + '"@en-GB .',
    ]
    wrong = [f'<http://e/a> <http://e/p> "{b}UFFFFFFFF" .', f'<http://e/a> <http://e/p> "{b}uD800" .', f'<http://e/a> <http://e/p> "{b}x" .', "<http://e/a> <http://e/p> <open ."]
    made = spark.createDataFrame([(x,) for x in lines + wrong], "value string")
    got = {(r["s"], r["p"].removeprefix("http://e/")): r["o"] for r in rdf.parse_ntriples(made).collect()}
    assert got == {("http://e/a", "p"): f"C:{b}u00e9x", ("http://e/a", "q"): f'\U0001F600 é {b}{b} \t"', ("http://e/é", "p"): "http://e/o", ("http://e/a", "n"): "\n" * 20_000, ("http://e/a", "l"): "ab" * 200_000}
    texts = [f"C:{b}u00e9x", f"{b}{b}n\n\r\t\"'", "\x00\x0b\x85\u2028 \U0001F600", f"end{b}", ""]
    t = S.triples(spark, [(f"http://e/{i}", "http://e/p", x, S.XSD + "string") for i, x in enumerate(texts)])
    assert {r["s"]: r["o"] for r in rdf.parse_ntriples(rdf.ntriples_lines(t)).collect()} == {f"http://e/{i}": x for i, x in enumerate(texts)}


def test_entity_changes_of_replaced_subjects(spark):
    """A subject of which all is removed is deleted, even if something else is added to it."""
    base = S.triples(spark, [("http://e/a", "http://e/p", "1", S.XSD + "string"), ("http://e/b", "http://e/p", "1", S.XSD + "string"), ("http://e/b", "http://e/p", "2", S.XSD + "string")])
    log = [("delete", "a", "1"), ("add", "a", "9"), ("delete", "b", "1"), ("add", "b", "9"), ("add", "c", "9")]
    rows = [(n, op, f"http://e/{s}", "iri", "http://e/p", o, "literal", S.XSD + "string", "") for n, (op, s, o) in enumerate(log)]
    changes = spark.createDataFrame(rows, "seq long, op string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    assert {(r["s"][-1], r["change"]) for r in A.entity_changes(base, changes).collect()} == {("a", "deleted"), ("b", "updated"), ("c", "added")}


def test_closure_bounds(spark, monkeypatch):
    """The driver's closure and the frontier loop give the same rows."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    want = {tuple(r) for r in T._closure(edges, nodes).collect()}
    assert len(want) == 14
    for limit in ("SMALL", "CLOSED"):
        monkeypatch.setattr(T, limit, 3)
        assert {tuple(r) for r in T._closure(edges, nodes).collect()} == want
        monkeypatch.undo()


def test_manifest(spark, tmp_path):
    import base64

    t = S.triples(spark, [("x:file", S.TYPE, S.FILE), ("x:gone", S.TYPE, S.FILE)])
    (tmp_path / base64.b64encode(b"x:file").decode()).write_text("text")
    got = {r["s"]: r["size"] for r in rdf.file_manifest(spark, str(tmp_path), t).collect()}
    assert got == {"x:file": 4, "x:gone": None}


def test_individuals(spark, city):
    rows = spark.createDataFrame([("p1", "Ann", 5), ("p2", "Bob", None)], "id string, name string, age int")
    t = tables.create_individuals(rows, city, c("Person"), F.concat(F.lit(CITY), "id"), ["name", "age"])
    assert t.count() == 5 and [r["attribute"] for r in tables.missing_mandatory(t, city).collect()] == [c("age")]
    with pytest.raises(ValueError):
        tables.create_individuals(rows, city, c("Person"), F.col("id"), ["name"])
    with pytest.raises(ValueError):
        tables.create_individuals(rows.withColumn("colour", F.lit("x")), city, c("Person"), F.col("id"), ["name", "age", "colour"])


def test_scalars(spark):
    rows = spark.createDataFrame([("12", S.XSD + "int"), ("x", S.XSD + "int"), ("true", S.XSD + "boolean"), ("1.50", S.XSD + "decimal"), ("hi", S.XSD + "string"), ("6869", S.XSD + "hexBinary")], "o string, o_dt string")
    assert [r["valid"] for r in X.typed_value(rows).collect()] == [True, False, True, True, True, True]
    one = spark.range(1)
    mint = lambda v, k: one.select(X.mint_iri(F.lit(v), k)).first()[0]
    assert mint(123, "int") == S.ENTITY + "00000000-0000-0000-0000-00000000007b"
    assert mint("00000000-0000-0000-0000-000000000000", "uuid") is None and mint(S.ENTITY + "no", "string") is None and mint("x:y", "string") == "x:y"
    v = spark.createDataFrame([([0.0, 1.5], [2]), (None, None)], "v array<double>, s array<int>")
    back = v.select("v", X.decode_vector(X.encode_vector("v", "s")).alias("d")).collect()
    assert back[0]["d"]["values"] == [0.0, 1.5] and back[1]["d"]["values"] is None
    sets = spark.createDataFrame([([1, 2], [1, 2, 3])], "a array<int>, b array<int>").select(U.compare_sets(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert sets["le"] and sets["lt"] and not sets["eq"] and not sets["disjoint"]


def test_operations_by_class(spark, city, world):
    out = N.apply_by_class(world, city, [(c("City"), "size", lambda x: x), (c("Person"), "greet", lambda x: x)])
    assert out.count() == 6
    with pytest.raises(ValueError):
        N.apply_by_class(world, city, [(c("City"), "a", lambda x: x), (c("City"), "a", lambda x: x)])


def test_report_and_plot(spark, city, world):
    r = {x["s"].removeprefix(CITY): x for x in A.entity_report(world, city).collect()}
    assert len(r["fr"]["neighbors"]) == 4 and r["marc"]["attributes"] == [c("age") + "=25", c("name") + "=Marc"]
    drawn = P.individuals(world, city)
    assert A.plot_nodes(world, city, drawn).count() == 6 and A.plot_edges(world, city, drawn, T.inverses(city)).count() == 8
    assert (c("Citizen"), c("Person")) in [tuple(x) for x in A.plot_is_a(city).collect()]
