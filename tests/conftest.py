"""One session for all tests, and the ontology of a city with its people."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from triplespark import schema as S  # noqa: E402
from triplespark.operators.tbox import load_tbox  # noqa: E402

CITY = "http://example.org/city#"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def city(spark):
    """10 relationships, 5 attributes and 13 classes."""
    c = lambda x: CITY + x
    rows: list[tuple] = []
    for name, up, inverse in (
        ("encloses", None, "isEnclosedBy"), ("hasChild", "hasPart", "isChildOf"), ("hasInhabitant", "encloses", None), ("hasMajor", "hasWorker", None), ("hasPart", "encloses", "isPartOf"),
        ("hasWorker", "hasPart", "worksIn"), ("isChildOf", "isPartOf", None), ("isEnclosedBy", None, None), ("isPartOf", "isEnclosedBy", None), ("worksIn", "isPartOf", None),
    ):
        rows.append((c(name), S.TYPE, S.OWL + "ObjectProperty"))
        rows += [(c(name), S.SUB_PROPERTY, c(up))] if up else []
        rows += [(c(name), S.OWL + "inverseOf", c(inverse))] if inverse else []
    for name, up, kind in (("age", "number", None), ("postalCode", "number", None), ("number", None, S.XSD + "integer"), ("name", None, S.XSD + "string"), ("coordinates", None, S.VECTOR)):
        rows.append((c(name), S.TYPE, S.OWL + "DatatypeProperty"))
        rows += [(c(name), S.SUB_PROPERTY, c(up))] if up else []
        rows += [(c(name), S.RDFS + "range", kind)] if kind else []
    for name, up in (
        ("LivingBeing", None), ("Person", "LivingBeing"), ("Citizen", "Person"), ("GeographicalPlace", None), ("PopulatedPlace", "GeographicalPlace"), ("City", "PopulatedPlace"), ("Neighborhood", "PopulatedPlace"),
        ("Street", "PopulatedPlace"), ("ArchitecturalStructure", "GeographicalPlace"), ("Building", "ArchitecturalStructure"), ("ArchitecturalComponent", None), ("Floor", "ArchitecturalComponent"), ("Address", None),
    ):
        rows.append((c(name), S.TYPE, S.OWL + "Class"))
        rows += [(c(name), S.SUB_CLASS, c(up))] if up else []
    for n, attribute in enumerate(("age", "name")):
        rows += [(c("LivingBeing"), S.SUB_CLASS, f"_:r{n}"), (f"_:r{n}", S.TYPE, S.OWL + "Restriction"), (f"_:r{n}", S.OWL + "onProperty", c(attribute)), (f"_:r{n}", S.OWL + "cardinality", "1", S.XSD + "integer")]
    rows += [(c(n), S.LABEL, n, S.RDF + "langString", "en") for n in ("name", "age", "encloses", "City")]
    return load_tbox(S.triples(spark, rows))[0]


@pytest.fixture(scope="session")
def make(spark):
    """A graph from people and places: {id: (class, {attribute: value})} and links (s, relationship, o)."""

    def build(things: dict, links: list[tuple[str, str, str]] = ()):
        rows: list[tuple] = []
        for key, (cls, values) in things.items():
            rows.append((CITY + key, S.TYPE, CITY + cls))
            for a, value in values.items():
                rows += [(CITY + key, CITY + a, v, S.XSD + ("integer" if a in ("age", "postalCode") else "string")) for v in (value if isinstance(value, tuple) else (value,))]
        rows += [(CITY + s, p if p.startswith("http") else CITY + p, CITY + o) for s, p, o in links]
        return S.triples(spark, rows)

    return build


def names(df, column="s"):
    """The local names in a column."""
    return sorted(r[column].removeprefix(CITY) for r in df.collect())
