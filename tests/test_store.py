"""The store with commits, databases, files and reports."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from triplespark import schema as S
from triplespark.operators import aggregate as A
from triplespark.operators import update as U
from triplespark.sources import rdf
from triplespark.sources.store import Store

from .conftest import CITY

E = "http://e/"


def graph(spark, numbers):
    return S.triples(spark, [(f"{E}s{n}", E + "p", str(n), S.XSD + "integer") for n in numbers])


def log(spark, changes):
    rows = [(seq, op, f"{E}s{n}", "iri", E + "p", str(n), "literal", S.XSD + "integer", "") for seq, (op, n) in enumerate(changes)]
    return spark.createDataFrame(rows, "seq long, op string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def numbers(t):
    return sorted(int(r["o"]) for r in t.collect())


def test_commits(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store.create(graph(spark, range(400)), path, 32)
    before = files(path + "/base")
    assert store.commit(log(spark, [("delete", 3), ("add", 500), ("add", 3), ("delete", 500), ("delete", 4)])) == 1
    assert files(path + "/base") == before
    assert numbers(store.read()) == [n for n in range(400) if n != 4]
    assert store.commit(log(spark, [("add", 4), ("add", 501), ("delete", 3), ("delete", 999)])) == 2
    want = sorted({*range(400), 501} - {3})
    assert numbers(store.read()) == want and numbers(Store(spark, path).read()) == want
    met = store.compact()
    after = files(path + "/base")
    kept = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("/")[0].removeprefix("bucket=")) for f in before.keys() - kept} <= set(met) and 0 < len(met) <= 6 and len(kept) > 20
    assert store.versions() == [] and numbers(store.read()) == want and store.compact() == []
    assert store.statistics().collect()[0]["n"] == len(want)
    # A bucket that loses everything is empty afterwards.
    store.commit(log(spark, [("delete", n) for n in want]))
    assert store.read().count() == 0
    store.compact()
    assert store.read().count() == 0
    store.commit(log(spark, []))
    store.commit(log(spark, [("add", 7)]))
    assert numbers(store.read()) == [7] and store.compact() and numbers(store.read()) == [7]


def test_unfinished_commits_are_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store.create(graph(spark, range(10)), path, 4)
    store.commit(log(spark, [("delete", 1)]))
    os.remove(f"{path}/log/version=1/_SUCCESS")
    assert numbers(store.read()) == list(range(10))


def test_database(spark, tmp_path):
    t = graph(spark, range(50)).unionByName(S.triples(spark, [(E + "x", E + "q", E + "y"), (E + "x", E + "q", "é\n'", S.RDF + "langString", "de")]))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rdf.write_jdbc(t, url, "triples", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes=", ".join(f"{c} varchar(500)" for c in S.COLUMNS))
    for parts, part in ((1, None), (4, 'mod(length("s") + length("o"), {parts})')):
        back = rdf.read_jdbc(spark, url, "triples", parts, part, driver="org.apache.derby.jdbc.EmbeddedDriver")
        assert back.rdd.getNumPartitions() == parts and U.graph_equal(back, t)


def test_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:  # over the two gigabytes of one value, most of them a hole
        f.write(b"start")
        f.seek((2 << 30) + 100)
        f.write(b"end")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "small").write_bytes(b"x")
    digest = hashlib.sha256()
    with open(tmp_path / "large", "rb") as f:
        while data := f.read(1 << 22):
            digest.update(data)
    found = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in rdf.hashed_files(spark, str(tmp_path)).collect()}
    assert found == {"large": ((2 << 30) + 103, digest.hexdigest()), "small": (1, hashlib.sha256(b"x").hexdigest())}


def test_manifest_of_keys_with_slashes(spark, tmp_path):
    subject = "x:???>>>???"
    import base64

    key = base64.b64encode(subject.encode()).decode()
    assert "/" in key
    rdf.write_files(spark.createDataFrame([(key, "text")], "key string, text string"), str(tmp_path / "f"))
    row = rdf.file_manifest(spark, str(tmp_path / "f"), S.triples(spark, [(subject, S.TYPE, S.FILE)])).first()
    assert (row["storage_key"], row["size"]) == (key, 4)


def test_report_rows_in_order(spark, city, make):
    c = lambda x: CITY + x
    t = make({"fr": ("City", {}), "b": ("Citizen", {}), "a": ("Citizen", {}), "z": ("Neighborhood", {}), "m": ("Citizen", {})}, [("fr", "hasInhabitant", "b"), ("fr", "hasInhabitant", "a"), ("fr", "hasPart", "z"), ("fr", "encloses", "z"), ("fr", "encloses", "m"), ("fr", "hasInhabitant", "nobody")])
    t = t.unionByName(S.triples(spark, [(c("b"), S.LABEL, "Zoe", S.XSD + "string")]))
    rows = [(r["n"], r["relationship"].removeprefix(CITY), r["neighbor"].removeprefix(CITY), r["label"]) for r in A.report_rows(t, city).where(F.col("s") == c("fr")).orderBy("n").collect()]
    assert rows == [(1, "encloses", "m", None), (2, "encloses", "z", None), (3, "hasInhabitant", "b", "Zoe"), (4, "hasInhabitant", "a", None), (5, "hasPart", "z", None)]
