"""JSON-LD documents: every form of node and value, and documents of any size."""

from __future__ import annotations

import json
import random

import pytest

from triplespark import schema as S
from triplespark.operators import update as U
from triplespark.sources import jsonld

E, X = "http://e/", S.XSD


def graph(spark, *documents):
    return jsonld.parse_jsonld(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string"))


def same(spark, document, rows):
    found = graph(spark, document)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.triples(spark, rows).collect()))


def test_numbers_keep_all_digits(spark):
    big = "123456789012345678901234567890123456789012"
    same(spark, f'{{"@id": "http://e/a", "http://e/p": [{big}, -0, 12345678901234567890, 1.50, 2e400]}}', [(E + "a", E + "p", v, X + k) for v, k in ((big, "integer"), ("-0", "integer"), ("12345678901234567890", "integer"), ("1.50", "double"), ("2e400", "double"))])


def test_nested_nodes_and_contexts(spark):
    doc = {"@context": {"ex": E, "name": "ex:name", "knows": {"@id": "ex:knows", "@context": {"name": "ex:nick"}}, "id": "@id", "type": "@type", "made": {"@reverse": "ex:by"}, "when": {"@id": "ex:when", "@type": "ex:day"}, "kind": {"@id": "ex:kind", "@type": "@vocab"}, "ex2": "ex:two/", "gone": None, "@language": "DE"},
           "id": "ex:a", "type": ["ex:T", "name"], "name": "A", "gone": 1, "when": "today", "kind": "name",
           "knows": {"id": "ex:b", "name": {"@value": "B", "@type": "ex:t"}, "ex:deep": {"@context": {"name": "ex2:inner", "@language": None}, "name": "C", "ex:deeper": {"id": "ex:d", "name": "D"}}},
           "made": [{"id": "ex:m", "name": "M"}, {"id": "ex:n"}], "@reverse": {"ex:likes": {"id": "ex:l"}}}
    t = graph(spark, doc)
    inner = [r["o"] for r in t.where(f"p = '{E}deep'").collect()][0]
    tag = S.RDF + "langString"
    rows = [(E + "a", S.TYPE, E + "T"), (E + "a", S.TYPE, E + "name"), (E + "a", E + "name", "A", tag, "de"), (E + "a", E + "when", "today", E + "day"), (E + "a", E + "kind", E + "name"), (E + "a", E + "knows", E + "b"), (E + "b", E + "nick", "B", E + "t"), (E + "b", E + "deep", inner)]
    rows += [(inner, E + "two/inner", "C", X + "string"), (inner, E + "deeper", E + "d"), (E + "d", E + "two/inner", "D", X + "string"), (E + "m", E + "by", E + "a"), (E + "m", E + "name", "M", tag, "de"), (E + "n", E + "by", E + "a"), (E + "l", E + "likes", E + "a")]
    assert inner.startswith("_:")
    same(spark, doc, rows)


def test_lists_sets_and_containers(spark):
    doc = {"@context": {"ex": E, "seq": {"@id": "ex:seq", "@container": "@list"}, "by": {"@id": "ex:by", "@container": "@language"}, "at": {"@id": "ex:at", "@container": "@index"}, "all": {"@id": "ex:all", "@container": "@set", "@type": "@id"}},
           "@id": "ex:a", "ex:l": {"@list": [1, "x", {"@id": "ex:n", "ex:q": True}, ["in"]]}, "ex:empty": {"@list": []}, "seq": ["p", "q"], "by": {"EN": "e", "fr": ["f", "g"]}, "at": {"one": 1, "two": {"@id": "ex:z"}}, "all": ["ex:u", "ex:v"], "ex:s": {"@set": [1, [2, None]]}}
    t = graph(spark, doc)
    first, rest, nil = S.RDF + "first", S.RDF + "rest", S.RDF + "nil"
    of = {(r["s"], r["p"]): r["o"] for r in t.where("s_kind = 'bnode'").collect()}

    def walk(head):
        out = []
        while head != nil:
            out.append(of[head, first])
            head = of[head, rest]
        return out

    a = {r["p"].removeprefix(E): r["o"] for r in t.where(f"s = '{E}a'").collect()}
    cells = walk(a["l"])
    assert cells[:3] == ["1", "x", E + "n"] and walk(cells[3]) == ["in"] and a["empty"] == nil and walk(a["seq"]) == ["p", "q"]
    plain = sorted((r["s"], r["p"], r["o"], r["o_dt"], r["o_lang"]) for r in t.where(f"s_kind = 'iri' and o_kind <> 'bnode' and o <> '{nil}'").collect())
    tag = S.RDF + "langString"
    assert plain == sorted([(E + "n", E + "q", "true", X + "boolean", ""), (E + "a", E + "by", "e", tag, "en"), (E + "a", E + "by", "f", tag, "fr"), (E + "a", E + "by", "g", tag, "fr"), (E + "a", E + "at", "1", X + "integer", ""), (E + "a", E + "at", E + "z", "", ""), (E + "a", E + "all", E + "u", "", ""), (E + "a", E + "all", E + "v", "", ""), (E + "a", E + "s", "1", X + "integer", ""), (E + "a", E + "s", "2", X + "integer", "")])


def test_what_is_not_understood(spark):
    docs = ['{"@context": "http://elsewhere/", "@id": "http://e/a"}', '{"@id": "http://e/a", "bare": 1, "http://e/p": [2, {"@value": [1]}], "http://e/g": {"@graph": []}}', "[1]", "3", "{]", '{"a": 1,}', '{"a" 1}', "[1 2]", "nul", '"\\x"', "{} {}", None]
    frame = spark.createDataFrame([(d,) for d in docs], "value string")
    bad = sorted((r["k"] or "", r["x"]) for r in jsonld.bad_jsonld(frame).collect())
    assert bad == sorted([("@context", '"http://elsewhere/"'), ("bare", "1"), ("http://e/p", '{"@value": [1]}'), ("http://e/g", '{"@graph": []}'), ("", "1"), ("", "3")] + [("", d) for d in docs[4:-1]])
    assert [r["o"] for r in jsonld.parse_jsonld(frame).collect()] == ["2"]


def test_validity_agrees_with_the_json_module():
    r = random.Random(2)
    good = json.dumps({"a": [1, -2.5e3, True, None, "x\\\"é", {}, []], "b": {"c": {"d": [[]]}}})
    for _ in range(3000):
        text = list(good)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(text))
            text[k] = r.choice(["", ",", "}", "]", "{", "[", '"', ":", "1", " ", text[k]])
        text = "".join(text)
        try:
            json.loads(text)
            expected = True
        except ValueError:
            expected = False
        assert jsonld.valid(text) == expected, text


@pytest.mark.parametrize("nodes", [40_000])
def test_large_documents_give_all_triples(spark, nodes):
    doc = '{"@graph": [' + ",".join('{"@id": "http://e/%d", "http://e/p": {"http://e/q": [%s]}}' % (n, '"%s"' % ("x" * 700)) for n in range(nodes)) + '], "@context": {"unused": "http://u/"}}'
    hub = '{"@id": "http://e/hub", "http://e/h": [' + ",".join(f'{{"@id": "http://e/{n}"}}' for n in range(nodes)) + "]}"
    t = graph(spark, doc, hub)
    assert t.groupBy("p").count().orderBy("p").collect() == [(E + "h", nodes), (E + "p", nodes), (E + "q", nodes)]
    assert U.graph_equal(t.where(f"p = '{E}h'"), graph(spark, hub))


def test_documents_of_one_file_are_spread(spark, monkeypatch):
    """The first level, too, is dealt over tasks, however few partitions the documents come in."""
    seen, real = [], jsonld._level
    monkeypatch.setattr(jsonld, "_level", lambda rows: (seen.append(rows), real(rows))[1])
    docs = spark.createDataFrame([(f'{{"@id": "http://x/{n}", "http://x/p": {n}}}',) for n in range(50)], "value string").coalesce(1)
    assert jsonld.parse_jsonld(docs).count() == 50
    assert "hashpartitioning(xxhash64(text" in seen[0]._jdf.queryExecution().toString()
