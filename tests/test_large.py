"""Large taxonomies and hubs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from triplespark import schema as S
from triplespark.jobs import mapping
from triplespark.operators import loops
from triplespark.operators import select as P
from triplespark.operators import tbox as T
from triplespark.operators.subsumption import Subsumption

E = "http://e/"


def reached(edges, nodes):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = {}
    for n in nodes:
        seen, open_ = {n}, [n]
        while open_:
            for x in up.get(open_.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    open_.append(x)
        out[n] = seen
    return out


def taxonomy(kind):
    r = random.Random(6)
    nodes = [f"n{k:03}" for k in range(70)]
    edges = [(nodes[k], nodes[r.randrange(k)]) for k in range(1, 60) if k % 13]
    if kind != "trees":
        edges += [(nodes[r.randrange(30, 60)], nodes[r.randrange(30)]) for _ in range(12)]
    if kind == "rings":
        edges += [(nodes[60], nodes[61]), (nodes[61], nodes[62]), (nodes[62], nodes[60]), (nodes[63], nodes[61]), (nodes[5], nodes[62]), (nodes[64], nodes[64]), (nodes[65], nodes[66]), (nodes[66], nodes[65])]
    return nodes, sorted(set(edges))


@pytest.mark.parametrize("kind", ["trees", "several parents", "rings"])
def test_numbers_tell_what_lies_below(spark, kind):
    nodes, edges = taxonomy(kind)
    above = reached(edges, nodes)
    n, e = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")
    labels = Subsumption(n, e)
    for name in nodes[:3] + nodes[60:63]:
        assert sorted(r["p"] for r in labels.below(name).collect()) == sorted(x for x in nodes if name in above[x]), name
    if kind != "trees":
        assert sorted(tuple(r) for r in loops.closed(n, e).collect()) == sorted((x, y) for x in nodes for y in above[x])


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    size, rounds = 20_000, []
    chain = spark.range(size).select(F.format_string("n%06d", "id").alias("src"), F.format_string("n%06d", F.col("id") + 1).alias("dst"))
    real = loops.cut
    monkeypatch.setattr("triplespark.operators.subsumption.cut", lambda df: rounds.append(1) or real(df))
    labels = Subsumption(chain.select(F.col("src").alias("node")), chain)
    assert len(rounds) < 45
    assert labels.below("n000700").count() == 701
    assert labels.below(f"n{size:06}").count() == size + 1


def test_classes_of_a_large_ontology(spark, monkeypatch):
    nodes, edges = taxonomy("several parents")
    rows = [(E + x, S.TYPE, S.OWL + "Class") for x in nodes] + [(E + a, S.SUB_CLASS, E + b) for a, b in edges]
    world = S.triples(spark, [(E + "i" + x, S.TYPE, E + x) for x in nodes])
    small = T.load_tbox(S.triples(spark, rows))[0]
    monkeypatch.setattr(T, "CLOSED", 10)
    large = T.load_tbox(S.triples(spark, rows))[0]
    for cls in (E + nodes[1], S.THING):
        monkeypatch.setattr(T, "CLOSED", 500_000)
        want = [sorted(map(tuple, f(world, small, cls).collect())) for f in (P.get_by_class, P.is_a)]
        monkeypatch.setattr(T, "CLOSED", 10)
        assert [sorted(map(tuple, f(world, large, cls).collect())) for f in (P.get_by_class, P.is_a)] == want
    assert isinstance(large._kept["intervals"], Subsumption) and small._kept["intervals"] is None


def test_hubs_are_spread(spark):
    r = random.Random(1)
    edges = [("hub", f"n{k}") for k in range(30_000)] + [(f"n{k}", f"n{r.randrange(30_000)}") for k in range(20_000)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = loops.deal(frame, 500)
        sizes = sorted(x["count"] for x in dealt.edges.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] <= 10 * sizes[len(sizes) // 2] and len(sizes) == 24
        start = spark.createDataFrame([("hub", "hub"), ("n5", "n5")], "root string, node string")
        found = {(x["root"], x["node"]): x["depth"] for x in loops.reach(start, dealt, 2).collect()}
        plain = {(x["root"], x["node"]): x["depth"] for x in loops.reach(start, loops.deal(frame), 2).collect()}
        assert found == plain and sum(1 for k, d in found.items() if k[0] == "hub" and d == 1) == 30_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_estimates_stay_small_over_rounds(spark):
    """Joins multiply estimated sizes; what is cut starts from the size of its rows again."""
    pairs = loops.cut(spark.range(1000).selectExpr("id", "id + 1 as far"))
    for _ in range(6):
        pairs = loops.cut(pairs.join(pairs.toDF("far", "f"), "far").selectExpr("id", "f as far"))
    assert pairs.count() == 937
    assert int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 30


def test_tables_are_spread_by_rows(spark, monkeypatch):
    """A task's share of a table doesn't grow with the table, whatever its files are."""
    monkeypatch.setattr(mapping, "ROWS", 100)
    rows = mapping.spread(spark.range(1000).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000


def test_the_graph_is_not_sent(spark, tmp_path):
    # A graph's predicates and datatypes take few bytes of its files, so Spark would send all of its rows to each task instead of the ontology's.
    rows = spark.range(100_000).select(F.lit(mapping.name("size")).alias("attribute"), F.lit(S.XSD + "integer").alias("o_dt"))
    rows.coalesce(1).write.parquet(str(tmp_path / "g"))
    kinds = T.attribute_datatypes(mapping.ontology(spark))
    found = spark.read.parquet(str(tmp_path / "g")).join(kinds, "attribute").where("o_dt = datatype").groupBy("attribute", "n_ranges").count()
    assert [tuple(r) for r in found.collect()] == [(mapping.name("size"), 1, 100_000)] and dict(kinds.dtypes)["n_ranges"] == "bigint"
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastExchange" in plan and "LocalTableScan" in plan.split("BroadcastExchange")[1] and "FileScan" not in plan.split("BroadcastExchange")[1].split("FileScan")[0]
    assert "Parquet" not in plan.split("BroadcastExchange")[1].split("LocalTableScan")[0]
