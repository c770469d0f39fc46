"""Graph patterns with whole terms, and Turtle files cut anywhere."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from triplespark import schema as S
from triplespark.operators import navigate as N
from triplespark.operators import patterns as P
from triplespark.sources import rdf, turtle

E = "http://example.org/x#"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


@pytest.fixture(scope="module")
def terms(spark):
    e = lambda x: E + x
    return S.triples(spark, [
        (e("a"), e("says"), "Ann", S.XSD + "string"), (e("b"), e("says"), "Ann", S.RDF + "langString", "en"), (e("c"), e("says"), e("Ann")), (e("d"), e("says"), "1", S.XSD + "integer"),
        (e("t"), e("topic"), "Ann", S.XSD + "string"), (e("u"), e("topic"), "Ann", S.RDF + "langString", "en"), (e("v"), e("topic"), e("Ann")), (e("w"), e("topic"), "1", S.XSD + "string"),
        (e("Ann"), e("age"), "7", S.XSD + "integer"), (e("a"), e("knows"), e("b")), (e("b"), e("knows"), e("b")), (e("a"), e("nick"), "A", S.XSD + "string"), (e("a"), e("nick"), "B", S.XSD + "string"),
    ])


@pytest.mark.parametrize("counted", [False, True])
def test_terms_are_wholes(terms, counted):
    e = lambda x: E + x
    stats = P.predicate_statistics(terms) if counted else None
    both = N.bgp(terms, [("?a", e("says"), "?v"), ("?b", e("topic"), "?v")], statistics=stats)
    assert rows(both, "a", "b") == [(e("a"), e("t")), (e("b"), e("u")), (e("c"), e("v"))]
    # As a subject elsewhere, ?v is an entity.
    assert rows(N.bgp(terms, [("?a", e("says"), "?v"), ("?v", e("age"), "?n")], statistics=stats), "a", "n", "n_dt") == [(e("c"), "7", S.XSD + "integer")]
    one = lambda o: [r["a"][len(E) :] for r in N.bgp(terms, [("?a", e("says"), o)], statistics=stats).collect()]
    assert one(P.Literal("Ann")) == ["a"] and one(P.tagged("Ann", "EN")) == ["b"] and one(e("Ann")) == ["c"] and one("1") == ["d"] and one(P.Literal("1")) == []
    assert rows(N.bgp(terms, [("?x", e("knows"), "?x")], statistics=stats), "x") == [(e("b"),)]
    assert rows(N.bgp(terms, [("?x", "?p", P.Literal("1"))], statistics=stats), "x", "p") == [(e("w"), e("topic"))]
    star = N.bgp(terms, [("?x", e("nick"), "?n"), ("?x", e("nick"), "?m"), ("?x", e("says"), "?v"), ("?x", e("knows"), e("b"))], statistics=stats)
    assert rows(star, "n", "m", "v") == [(n, m, "Ann") for n in "AB" for m in "AB"]
    assert N.bgp(terms, [("?x", e("nick"), "?n"), ("?x", e("says"), "?n")], statistics=stats).count() == 0
    assert N.bgp(terms, [(e("a"), e("knows"), e("b")), ("?x", e("age"), "?n")], statistics=stats).count() == 1
    assert N.bgp(terms, [(e("a"), e("knows"), e("c")), ("?x", e("age"), "?n")], statistics=stats).count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_optional_union_minus(terms, counted):
    e = lambda x: E + x
    stats = P.predicate_statistics(terms) if counted else None
    base = [("?x", e("says"), "?v")]
    found = N.bgp(terms, base, how=(P.Join("optional", [("?x", e("knows"), "?y"), ("?y", e("says"), "?w")]),), statistics=stats)
    assert sorted((r["x"][len(E) :], r["y"] and r["y"][len(E) :], r["w"], r["w_lang"]) for r in found.collect()) == [("a", "b", "Ann", "en"), ("b", "b", "Ann", "en"), ("c", None, None, None), ("d", None, None, None)]
    found = N.bgp(terms, base, how=(P.Join("minus", [("?y", e("topic"), "?v")]),), statistics=stats)
    assert rows(found, "x") == [(e("d"),)]
    assert N.bgp(terms, base, how=(P.Join("minus", [("?q", e("age"), "?r")]),), statistics=stats).count() == 4
    found = N.bgp(terms, base, how=(P.Join("union", [("?x", e("knows"), "?y")], ([("?x", e("nick"), "?y")],)),), statistics=stats)
    assert sorted((r["x"][len(E) :], r["y"], r["y_kind"]) for r in found.collect()) == [("a", "A", "literal"), ("a", "B", "literal"), ("a", e("b"), "iri"), ("b", e("b"), "iri")]
    for bad in (P.Join("optional", [("?q", e("age"), "?r")]), P.Join("union", [("?x", e("knows"), "?y")], ([("?y", e("nick"), "?v")],)), P.Join("other", base)):
        with pytest.raises(ValueError):
            N.bgp(terms, base, how=(bad,), statistics=stats)


def test_construct_keeps_terms(terms):
    e = lambda x: E + x
    made = N.construct(terms, [("?x", e("says"), "?v")], [("?x", e("said"), "?v"), ("?v", e("by"), "?x"), ("?x", e("note"), P.tagged("n", "en"))])
    expected = [(e("a"), "iri", e("said"), "Ann", "literal", S.XSD + "string", ""), (e("b"), "iri", e("said"), "Ann", "literal", S.RDF + "langString", "en"), (e("c"), "iri", e("said"), e("Ann"), "iri", "", ""), (e("d"), "iri", e("said"), "1", "literal", S.XSD + "integer", "")]
    expected += [(e("Ann"), "iri", e("by"), e("c"), "iri", "", "")] + [(e(x), "iri", e("note"), "n", "literal", S.RDF + "langString", "en") for x in "abcd"]
    assert rows(made) == sorted(expected)
    fresh = N.construct(terms, [("?x", e("says"), "?v")], [("_:n", e("of"), "?x"), ("_:n", e("is"), "?v")])
    assert fresh.count() == 8 and fresh.select("s").distinct().count() == 4 and fresh.where("s_kind = 'bnode'").count() == 8


def test_order_follows_statistics(spark):
    stats = spark.createDataFrame([(E + "big", 10**9, 10**8, 10**8), (E + "small", 5, 5, 5), (E + "mid", 10**6, 10**5, 10**6)], "p string, n long, subjects long, objects long")
    patterns = [("?a", E + "big", "?b"), ("?b", E + "mid", "?c"), ("?c", E + "small", "?d")]
    known = P.Statistics(stats, patterns)
    assert [g[0][1][len(E) :] for g in P._ordered([[p] for p in patterns], known, set())] == ["small", "mid", "big"]


TEXT = '''# Comments have dots. And "quotes
@prefix ex: <http://example.org/x#> .
@prefix : <http://example.org/d#>.
PREFIX s: <http://example.org/s#>
BASE <http://example.org/base/>
ex:a a ex:C ; ex:p "x", 'y'@EN, """long
. with "" dots ''' + "'''" + ''' and \\""" quotes .
@prefix ex: <http://wrong/> .
""" , 1, 1.5, .5, -2e3, 1.E2, true ;
  ex:q <rel>, <http://h/a.b#c>, _:b.c, ex:a.b.c , : ;; .
ex:b ex:p \'\'\'other """ long. \'\'\'^^ex:t.ex:c
 ex:p "a.b\\t\\u0041\\"."^^<http://t.t/x> .
[] ex:p [ ex:q ( 1 "two" [ ex:r ex:z ] () ) ; ex:w ex:v ] .
[ ex:only ex:this ] .
( ex:l1 ) ex:p 'it\\'s' .
@prefix ex: <http://example.org/y#> .
ex:a ex:p s:\\~x%20y , ex:\u00e9 . # last. 
ex:bad ex:p "unknown\\q" .
nope:x ex:p ex:y .
ex:end ex:p ex:f.'''


def expected_text():
    x, y, d, s, b = "http://example.org/x#", "http://example.org/y#", "http://example.org/d#", "http://example.org/s#", "http://example.org/base/"
    string, number = S.XSD + "string", lambda k: S.XSD + k
    long = "long\n. with \"\" dots ''' and \"\"\" quotes .\n@prefix ex: <http://wrong/> .\n"
    lit = lambda s_, v, dt, lang="": (s_, x + "p", v, "literal", dt, lang)
    out = [(x + "a", S.TYPE, x + "C", "iri", "", ""), lit(x + "a", "x", string), lit(x + "a", "y", S.RDF + "langString", "en"), lit(x + "a", long, string)]
    out += [lit(x + "a", v, number(k)) for v, k in (("1", "integer"), ("1.5", "decimal"), (".5", "decimal"), ("-2e3", "double"), ("1.E2", "double"), ("true", "boolean"))]
    out += [(x + "a", x + "q", o, "bnode" if o[:2] == "_:" else "iri", "", "") for o in (b + "rel", "http://h/a.b#c", "_:b.c", x + "a.b.c", d)]
    out += [lit(x + "b", 'other """ long. ', x + "t.ex:c")[:0] or None]
    return [o for o in out if o]


def test_turtle_terms(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TEXT.replace("^^ex:t.ex:c\n", "^^ex:t .\nex:c\n"), newline="")
    t = turtle.read_turtle(spark, str(tmp_path))
    found = {tuple(r) for r in t.where("s_kind = 'iri'").select("s", "p", "o", "o_kind", "o_dt", "o_lang").collect()}
    for row in expected_text():
        assert row in found, row
    x, y = "http://example.org/x#", "http://example.org/y#"
    assert (x + "b", x + "p", 'other """ long. ', "literal", x + "t", "") in found
    assert (x + "c", x + "p", 'a.b\tA".', "literal", "http://t.t/x", "") in found
    assert (y + "a", y + "p", "http://example.org/s#~x%20y", "iri", "", "") in found and (y + "a", y + "p", y + "\u00e9", "iri", "", "") in found and (y + "end", y + "p", y + "f", "iri", "", "") in found
    assert not any("wrong" in r[1] for r in found)
    bad = sorted(r["text"].strip() for r in turtle.bad_turtle(spark, str(tmp_path)).collect())
    assert len(bad) == 2 and bad[0].endswith('ex:bad ex:p "unknown\\q" .') and bad[1] == "nope:x ex:p ex:y ."
    nodes = t.where("s_kind = 'bnode'")
    assert nodes.count() == 1 + 8 + 2 + 1 + 1 + 1 + 2
    assert nodes.where(f"p = '{S.RDF}first'").count() == 5 and nodes.where(f"o = '{S.RDF}nil'").count() == 2 + 1


def test_turtle_cut_anywhere(spark, tmp_path):
    """The same triples however files are split, also within long strings."""
    r = random.Random(5)
    text = TEXT.replace("^^ex:t.ex:c\n", "^^ex:t .\nex:c\n") + "\n" + "\n".join(f"ex:n{n} ex:p {r.choice(['1', chr(34) * 3 + 'a.' + chr(10) + 'b . ' + chr(10) + chr(34) * 3, 'ex:o ;' + chr(10) + ' ex:q <http://q/> , 2.0', chr(39) * 3 + ' ' + chr(34) * 3 + chr(10) + '. ' + chr(39) * 3])} ." for n in range(60))
    (tmp_path / "a.ttl").write_text(text, newline="")
    (tmp_path / "b.ttl").write_text("@prefix ex: <http://other/> .\nex:a ex:p 1", newline="")
    named = lambda df: sorted(tuple(r) for r in df.where("s_kind = 'iri' and o_kind <> 'bnode'").collect())
    whole = turtle.read_turtle(spark, str(tmp_path))
    expected, n = named(whole), whole.count()
    assert len(expected) > 100
    for size in (40, 97, 1000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            t = turtle.read_turtle(spark, str(tmp_path))
            lines = turtle._lines(spark, str(tmp_path))
            assert lines.select("file", "block").distinct().count() > len(text) / size / 2.5 and lines.rdd.getNumPartitions() > 1
            assert named(t) == expected and t.count() == n
            assert turtle.bad_turtle(spark, str(tmp_path)).count() == 3  # the second file's last statement has no dot
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_turtle_many_directives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turtle, "SENT", 1)
    (tmp_path / "a.ttl").write_text("".join(f"@prefix p{n}: <http://h/{n}#> .\np{n}:s p{n}:p p{n // 2}:o .\n" for n in range(20)), newline="")
    assert rows(turtle.read_turtle(spark, str(tmp_path)), "s", "o") == sorted((f"http://h/{n}#s", f"http://h/{n // 2}#o") for n in range(20))


HARD = ["http://e/a>b", "http://e/back\\slash", 'http://e/q"uote', "http://e/sp ace", "http://e/{}|^`", "http://e/ok#x", "http://e/é"]


@pytest.mark.parametrize("form", ["turtle", "ntriples"])
def test_round_trips(spark, tmp_path, form):
    made = [(s, p, o) for s in HARD for p, o in zip(HARD, HARD[1:])] + [("_:b1", HARD[0], "_:b2")]
    made += [(HARD[5], HARD[5], v, dt, lang) for v, dt, lang in (("a\n\t\r\"\\b . '''", S.XSD + "string", ""), ("", S.XSD + "string", ""), ("x", S.RDF + "langString", "en-gb"), ("5", HARD[0], ""), ("\x00\x0b\x85\u2028", S.XSD + "string", ""))]
    t = S.triples(spark, made)
    path = str(tmp_path / "out")
    if form == "turtle":
        turtle.write_turtle(t.repartition(3), path, {"e": "http://e/", "x": "http://www.w3.org/2001/XMLSchema#"})
        back, bad = turtle.read_turtle(spark, path), turtle.bad_turtle(spark, path)
    else:
        rdf.write_ntriples(t, path)
        back, bad = rdf.read_ntriples(spark, path), rdf.bad_lines(spark, path)
    assert rows(back) == rows(t)
    assert bad.count() == 0
    empty = turtle.turtle_lines(t.where("false"), {"e": "http://e/"})
    assert all(r["value"].startswith("@prefix") for r in empty.collect())


def test_turtle_repeated_directives(spark, tmp_path):
    """Directives that say again what holds are no rows; those that change a prefix, and relative ones behind another base, are."""
    (tmp_path / "many.ttl").write_text(
        "".join(f"@prefix a: <http://x/> .\na:s{n} a:p {n} .\n" for n in range(40)) + "@prefix a: <http://y/> .\na:s a:p 40 .\n@prefix a: <http://x/> .\na:s a:p 41 .\n"
        + "".join(f"@base <http://b{n}/> .\n@prefix r: <r/> .\nr:s a:p {50 + n} .\n" for n in range(2))
    )
    rows = turtle.statements(spark, str(tmp_path))
    assert turtle._directives(rows).count() == 3 + 4
    found = {(r["s"], r["o"]) for r in turtle.read_turtle(spark, str(tmp_path)).collect()}
    assert found == {(f"http://x/s{n}", str(n)) for n in range(40)} | {("http://y/s", "40"), ("http://x/s", "41"), ("http://b0/r/s", "50"), ("http://b1/r/s", "51")}


def test_turtle_holds_little():
    # A batch has up to 10,000 rows, however long: a few are turned into Python's strings at a time.
    texts = ["x" * 200_000 if n % 3 else None for n in range(60)] + ["", "y" * 5_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(63), pa.int64()), pa.array(texts, pa.string())], ["n", "text"])
    parts = list(turtle._parts(iter([batch, batch.slice(0, 0)]), "n", "text"))
    assert [(n, x) for part in parts for n, x in zip(*part)] == list(enumerate(texts))
    assert all(sum(len(x or "") for x in part[1][:-1]) < turtle.HELD for part in parts) and len(parts) > 5
