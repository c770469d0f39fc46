"""Graphs with blank nodes compared, lists of any length, and components."""

from __future__ import annotations

import random

import pytest

from triplespark import schema as S
from triplespark.operators import loops
from triplespark.operators import tbox as T
from triplespark.operators import update as U

E = "http://e/"


def renamed(rows, seed=0):
    names = sorted({x for r in rows for x in (r[0], *(r[2:] if len(r) == 3 else ())) if x.startswith("_:")})
    shuffled = [f"_:n{k}" for k in range(len(names))]
    random.Random(seed).shuffle(shuffled)
    to = dict(zip(names, shuffled))
    return [(to.get(r[0], r[0]), r[1], to.get(r[2], r[2]) if len(r) == 3 else r[2], *r[3:]) for r in rows]


def ring(prefix, n, p=E + "p"):
    return [(f"_:{prefix}{k}", p, f"_:{prefix}{(k + 1) % n}") for k in range(n)]


WORLD = [(E + "a", E + "p", "1", S.XSD + "integer"), (E + "a", E + "has", "_:x"), ("_:x", E + "name", "X", S.XSD + "string"), ("_:x", E + "next", "_:y"), ("_:y", E + "name", "X", S.XSD + "string"), ("_:y", E + "next", E + "b")]
CASES = {
    "renamed": (WORLD, renamed(WORLD, 3), True),
    "another value": (WORLD, renamed([*WORLD[:4], ("_:y", E + "name", "Y", S.XSD + "string"), WORLD[5]]), False),
    "two rings of three and one of six": (ring("a", 3) + ring("b", 3), ring("c", 6), False),
    "rings of six": (ring("a", 6), renamed(ring("b", 6), 5), True),
    "three rings": (ring("a", 4) + ring("b", 4) + ring("c", 5), renamed(ring("d", 5) + ring("e", 4) + ring("f", 4), 2), True),
    "many twins": ([("_:hub", E + "p", f"_:t{k}") for k in range(40)], renamed([("_:hub", E + "p", f"_:t{k}") for k in range(40)], 1), True),
    "one twin less": ([("_:hub", E + "p", f"_:t{k}") for k in range(40)], [("_:hub", E + "p", f"_:t{k}") for k in range(39)], False),
    "a loop": ([("_:a", E + "p", "_:a")], [("_:b", E + "p", "_:c")], False),
    "a triangle and its mirror": (ring("a", 3) + [("_:a0", E + "q", "_:a1")], renamed(ring("b", 3) + [("_:b1", E + "q", "_:b0")], 4), False),
    # Two regular graphs that refinement alone can't tell apart.
    "prism and bipartite": (
        [(f"_:{u}", E + "p", f"_:{v}") for a, b in ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)) for u, v in ((a, b), (b, a))],
        [(f"_:{u}", E + "p", f"_:{v}") for a in (0, 1, 2) for b in (3, 4, 5) for u, v in ((a, b), (b, a))], False),
}


@pytest.mark.parametrize("name", CASES)
def test_blank_nodes(spark, name):
    a, b, same = CASES[name]
    assert U.graph_equal(S.triples(spark, a), S.triples(spark, b)) == same


@pytest.mark.parametrize("n", [1, 3000])
def test_long_lists(spark, n):
    rows = [(E + "u", S.TYPE, S.OWL + "Class"), ("_:u", S.TYPE, S.OWL + "Class"), ("_:u", S.OWL + "unionOf", "_:c0")]
    rows += [(f"_:c{k}", S.RDF + "first", f"{E}m{k}") for k in range(n)] + [(f"_:c{k}", S.RDF + "rest", f"_:c{k + 1}" if k + 1 < n else S.RDF + "nil") for k in range(n)]
    found = T.compositions(T.load_tbox(S.triples(spark, rows))[0]).collect()
    assert [(r["operator"], r["operands"]) for r in found] == [("OR", [f"{E}m{k}" for k in range(n)])]


def test_rings_of_lists(spark):
    rows = [("_:u", S.TYPE, S.OWL + "Class"), ("_:u", S.OWL + "unionOf", "_:c0")] + [(f"_:c{k}", S.RDF + "first", f"{E}m{k}") for k in range(3)] + [(f"_:c{k}", S.RDF + "rest", f"_:c{(k + 1) % 3}") for k in range(3)]
    with pytest.raises(ValueError):
        T.compositions(T.load_tbox(S.triples(spark, rows))[0])


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(100)]
    owner = {x: x for x in [f"n{k}" for k in range(60)] + [f"c{k:03}" for k in range(101)]}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        owner[y] = x
    found = loops.components(spark.createDataFrame([(x,) for x in owner], "node string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {x["node"]: x["component"] for x in found.collect()} == {x: root(x) for x in owner}
