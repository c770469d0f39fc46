"""The ontology (TBox): kinds of entities, closures of classes and properties, restrictions.

An ontology is a small graph. What has at most `SMALL` rows, which is checked, becomes part of
the plans that use it, and closures of that size are walked on the driver; larger ones stay
DataFrames and take the frontier loop. Results are kept with the TBox.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .loops import closed, cut
from .subsumption import Subsumption

SMALL = 50_000
#: Rows of a closure that are made on the driver.
CLOSED = 500_000
CLASS_TYPES = (S.OWL + "Class", S.RDFS + "Class")
ANNOTATION_TYPES = (S.OWL + "AnnotationProperty", S.RDF + "Property")

#: What every ontology holds (fixed values).
BUILT_IN = [
    (S.THING, S.TYPE, S.OWL + "Class"),
    (S.OWL + "NamedIndividual", S.TYPE, S.OWL + "Class"),
    (S.OWL + "NamedIndividual", S.SUB_CLASS, S.THING),
    (S.TOP_RELATIONSHIP, S.TYPE, S.OWL + "ObjectProperty"),
    (S.OWL + "bottomObjectProperty", S.TYPE, S.OWL + "ObjectProperty"),
    (S.TOP_ATTRIBUTE, S.TYPE, S.OWL + "DatatypeProperty"),
    (S.OWL + "bottomDataProperty", S.TYPE, S.OWL + "DatatypeProperty"),
    (S.RDFS + "Class", S.TYPE, S.RDFS + "Class"),
    (S.RDF + "Property", S.TYPE, S.RDFS + "Class"),
    (S.LABEL, S.TYPE, S.RDF + "Property"),
    (S.RDFS + "comment", S.TYPE, S.RDF + "Property"),
    (S.GRAPH + "Entity", S.TYPE, S.OWL + "Class"),
    (S.GRAPH + "Container", S.TYPE, S.OWL + "Class"),
    (S.GRAPH + "Container", S.SUB_CLASS, S.GRAPH + "Entity"),
    (S.FILE, S.TYPE, S.OWL + "Class"),
    (S.FILE, S.SUB_CLASS, S.GRAPH + "Entity"),
    (S.CONTAINS, S.TYPE, S.OWL + "ObjectProperty"),
    (S.MAIN, S.TYPE, S.OWL + "AnnotationProperty"),
]


def entity_kinds(t: DataFrame) -> DataFrame:
    """(s, s_kind, kind) for each kind that a graph declares an entity to be."""
    of = lambda *types: (F.col("p") == S.TYPE) & F.col("o").isin(*types)
    iri, bnode = F.col("s_kind") == "iri", F.col("s_kind") == "bnode"
    kind = (
        F.when(of(*CLASS_TYPES) & iri, "class")
        .when(of(S.OWL + "Class") & bnode, "composition")
        .when(of(S.OWL + "Restriction") & bnode, "restriction")
        .when(of(S.OWL + "ObjectProperty") | (F.col("p") == S.OWL + "inverseOf"), "relationship")
        .when(of(S.OWL + "DatatypeProperty"), "attribute")
        .when(of(*ANNOTATION_TYPES), "annotation")
    )
    return t.select("s", "s_kind", kind.alias("kind")).where("kind is not null")


def settled_kinds(kinds: DataFrame) -> DataFrame:
    """(s, kind): one kind for each entity; annotations that are also relationships or attributes are those; `ambiguous` if several are left."""
    found = kinds.groupBy("s").agg(F.collect_set("kind").alias("k"))
    other = F.arrays_overlap("k", F.array(F.lit("relationship"), F.lit("attribute")))
    found = found.withColumn("k", F.when(other, F.array_except("k", F.array(F.lit("annotation")))).otherwise(F.col("k")))
    return found.select("s", F.when(F.size("k") > 1, "ambiguous").otherwise(F.col("k")[0]).alias("kind"))


def settle(df: DataFrame) -> DataFrame:
    """`df` as a small table within plans if it has at most `SMALL` rows of strings and whole numbers, else kept in memory and on disk."""
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL or any(kind not in ("string", "bigint") for _, kind in df.dtypes):
        return df.persist()
    return S.local(df.sparkSession, [tuple(r) for r in rows], tuple(df.columns), {c: pa.int64() for c, kind in df.dtypes if kind == "bigint"})


def _closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sub, super): reflexive and transitive, over edges (src, dst) and nodes (node).

    Small ontologies are closed on the driver; with over `SMALL` edges or nodes, or `CLOSED` rows of
    the result, joins do it, in as many rounds as the logarithm of the depth.
    """
    rows, all_nodes = edges.limit(SMALL + 1).collect(), nodes.distinct().limit(SMALL + 1).collect()
    out = _closed(rows, all_nodes) if max(len(rows), len(all_nodes)) <= SMALL else None
    if out is None:
        return closed(nodes, edges).toDF("sub", "super")
    return S.local(edges.sparkSession, out, ("sub", "super"))


def _closed(edges: list, nodes: list) -> list[tuple[str, str]] | None:
    """The closure's rows, or None if they are too many."""
    up: dict[str, set[str]] = {}
    for r in edges:
        up.setdefault(r["src"], set()).add(r["dst"])
    out: list[tuple[str, str]] = []
    for (node,) in nodes:
        seen, open_ = {node}, [node]
        while open_:
            for x in up.get(open_.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    open_.append(x)
            if len(out) + len(seen) > CLOSED:
                return None
        out.extend((node, x) for x in sorted(seen))
    return out


class TBox:
    """An ontology's triples with what follows from them; each part is worked out once, when it is first asked for."""

    def __init__(self, triples: DataFrame):
        self.spark = triples.sparkSession
        self.triples = settle(S.union(triples, S.triples(self.spark, BUILT_IN)))
        self._kept: dict[str, DataFrame | Subsumption | None] = {}

    def keep(self, what: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The part called `what`, made on the first call."""
        if what not in self._kept:
            self._kept[what] = settle(make())
        return self._kept[what]

    @property
    def kinds(self) -> DataFrame:
        """(s, kind) of everything that the ontology declares."""
        return self.keep("kinds", lambda: settled_kinds(entity_kinds(self.triples)))

    def names(self, kind: str) -> DataFrame:
        """(s) of one kind."""
        return self.kinds.where(F.col("kind") == kind).select("s")

    @property
    def individual_types(self) -> DataFrame:
        """(o): what a subject's type can be for it to be an individual."""
        return self.kinds.where(F.col("kind") != "ambiguous").select(F.col("s").alias("o"))

    @property
    def classes(self) -> DataFrame:
        return self.keep("classes", lambda: class_closure(self))

    def subclasses(self, cls: str) -> DataFrame:
        """(p): a class and those below it. Where the pairs of all classes are too many, a comparison of numbers tells them (see `Subsumption`)."""
        if "intervals" not in self._kept:
            names, edges = self.names("class"), _steps(self, "class")
            rows, nodes = edges.limit(SMALL + 1).collect(), names.limit(SMALL + 1).collect()
            small = max(len(rows), len(nodes)) <= SMALL and _closed(rows, nodes) is not None
            self._kept["intervals"] = None if small else Subsumption(names.select(F.col("s").alias("node")), edges)
        intervals = self._kept["intervals"]
        if intervals is None:
            return below(self.classes, cls)
        return self.names("class").toDF("p") if cls == S.THING else intervals.below(cls)

    @property
    def relationships(self) -> DataFrame:
        return self.keep("relationships", lambda: property_closure(self, "relationship"))

    @property
    def attributes(self) -> DataFrame:
        return self.keep("attributes", lambda: property_closure(self, "attribute"))

    @property
    def annotations(self) -> DataFrame:
        return self.keep("annotations", lambda: property_closure(self, "annotation"))


def _part(f: Callable[[TBox], DataFrame]) -> Callable[[TBox], DataFrame]:
    """Keeps a function's result with the ontology."""

    @wraps(f)
    def kept(tb: TBox) -> DataFrame:
        return tb.keep(f.__name__, lambda: f(tb))

    return kept


def load_tbox(*graphs: DataFrame, namespaces: dict[str, str] | None = None) -> tuple[TBox, dict[str, str]]:
    """One ontology of several graphs, and its namespaces: names in lower case, IRIs that end with # or /.

    A class that dcterms:Agent names as a type is taken as a subclass.
    """
    merged = S.union(*graphs)
    agent = (F.col("p") == S.TYPE) & (F.col("o") == S.DCTERMS + "AgentClass")
    merged = merged.withColumn("p", F.when(agent, S.SUB_CLASS).otherwise(F.col("p")))
    ended = {name.lower(): iri if iri[-1:] in ("#", "/") else iri + "#" for name, iri in (namespaces or {}).items()}
    return TBox(merged.select(*S.COLUMNS)), ended


def direct_super(tb: TBox) -> DataFrame:
    """(sub, super): one step of subClassOf or subPropertyOf between entities of the same kind."""
    steps = tb.triples.where(F.col("p").isin(S.SUB_CLASS, S.SUB_PROPERTY)).select(F.col("s").alias("sub"), F.col("o").alias("super"))
    kinds = tb.kinds.where(F.col("kind").isin("class", "relationship", "attribute", "annotation"))
    return steps.join(kinds.toDF("sub", "kind"), "sub").join(kinds.toDF("super", "kind"), ["super", "kind"]).select("sub", "super").distinct()


def direct_sub(tb: TBox) -> DataFrame:
    """(super, sub): the same steps downwards."""
    return direct_super(tb).select("super", "sub")


def _steps(tb: TBox, kind: str) -> DataFrame:
    """(src, dst): one step upwards from entities of a kind."""
    return direct_super(tb).join(tb.names(kind).toDF("sub"), "sub", "left_semi").select(F.col("sub").alias("src"), F.col("super").alias("dst"))


def _up(tb: TBox, kind: str, top: str | None) -> DataFrame:
    names = tb.names(kind)
    out = _closure(_steps(tb, kind), names.select(F.col("s").alias("node")))
    if top:
        out = out.union(names.select("s", F.lit(top))).distinct()
    return out.toDF("sub", "super")


def class_closure(tb: TBox) -> DataFrame:
    """(sub, super) of classes: reflexive, transitive, and below owl:Thing."""
    return _up(tb, "class", S.THING)


@_part
def class_sub_closure(tb: TBox) -> DataFrame:
    """(super, sub) of classes; below owl:Thing is every owl:Class with an IRI."""
    owl = tb.triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.OWL + "Class") & (F.col("s_kind") == "iri")).select(F.lit(S.THING).alias("super"), F.col("s").alias("sub"))
    return tb.classes.where(F.col("super") != S.THING).select("super", "sub").union(owl).distinct()


TOPS = {"relationship": S.TOP_RELATIONSHIP, "attribute": S.TOP_ATTRIBUTE, "annotation": None}


def property_closure(tb: TBox, kind: str) -> DataFrame:
    """(sub, super) of relationships, attributes or annotations; the first two lie below their top property."""
    return _up(tb, kind, TOPS[kind])


def is_sub(closure: DataFrame, a: str, b: str) -> bool:
    """Whether `a` is `b` or below it."""
    return not closure.where((F.col("sub") == a) & (F.col("super") == b)).isEmpty()


def is_super(closure: DataFrame, a: str, b: str) -> bool:
    """Whether `a` is `b` or above it."""
    return is_sub(closure, b, a)


def below(closure: DataFrame, *names: str) -> DataFrame:
    """(p): the named properties or classes and what lies below them."""
    return closure.where(F.col("super").isin(*names)).select(F.col("sub").alias("p")).distinct()


@_part
def inverses(tb: TBox) -> DataFrame:
    """(p, inverse): the declared inverse of each relationship, in the declared direction; the first by name of several."""
    return tb.triples.where(F.col("p") == S.OWL + "inverseOf").groupBy(F.col("s").alias("p")).agg(F.min("o").alias("inverse"))


def _of(tb: TBox, p: str, name: str) -> DataFrame:
    return tb.triples.where(F.col("p") == p).select(F.col("s").alias("id"), F.col("o").alias(name))


@_part
def class_attributes(tb: TBox) -> DataFrame:
    """(class, attribute, default): attributes that restrictions on the class or its superclasses demand.

    Any restriction on a datatype property counts. A class's own default wins over inherited
    ones, the nearest with a value over those farther up.
    """
    bound = _of(tb, S.OWL + "onProperty", "attribute").join(_of(tb, S.TYPE, "kind").where(F.col("kind") == S.OWL + "Restriction").select("id"), "id")
    bound = bound.join(tb.names("attribute").toDF("attribute"), "attribute", "left_semi")
    owned = tb.triples.where(F.col("p") == S.SUB_CLASS).select(F.col("s").alias("owner"), F.col("o").alias("id")).join(bound, "id").select("id", "owner", "attribute")
    defaults = _of(tb, S.OWL + "hasValue", "default")
    own = owned.join(defaults, "id", "left").select("owner", "attribute", "default")
    depth = tb.classes.groupBy("sub").agg(F.count("*").alias("depth")).toDF("owner", "depth")
    rows = tb.classes.where(F.col("super") != S.THING).toDF("class", "owner").join(own, "owner").join(depth, "owner")
    nearest = Window.partitionBy("class", "attribute").orderBy(F.col("default").isNull(), F.desc("depth"), "owner", "default")
    return rows.withColumn("n", F.row_number().over(nearest)).where("n = 1").select("class", "attribute", "default")


@_part
def class_optional_attributes(tb: TBox) -> DataFrame:
    """(class, attribute): datatype properties whose domain is the class or a superclass."""
    domain = tb.triples.where(F.col("p") == S.RDFS + "domain").select(F.col("s").alias("attribute"), F.col("o").alias("super"))
    domain = domain.join(tb.names("attribute").toDF("attribute"), "attribute", "left_semi")
    return tb.classes.join(domain, "super").select(F.col("sub").alias("class"), "attribute").distinct()


@_part
def class_axioms(tb: TBox) -> DataFrame:
    """(class, axiom): restrictions and compositions on the class or any superclass."""
    own = tb.triples.where(F.col("p").isin(S.SUB_CLASS, S.OWL + "equivalentClass") & (F.col("o_kind") == "bnode")).select(F.col("s").alias("super"), F.col("o").alias("axiom"))
    return tb.classes.join(own, "super").select(F.col("sub").alias("class"), "axiom").distinct()


#: Predicates of restrictions with their quantifiers; the first that is present counts.
QUANTIFIERS = (("someValuesFrom", "SOME"), ("allValuesFrom", "ONLY"), ("cardinality", "EXACTLY"), ("qualifiedCardinality", "EXACTLY"), ("minCardinality", "MIN"), ("minQualifiedCardinality", "MIN"), ("maxCardinality", "MAX"), ("maxQualifiedCardinality", "MAX"), ("hasValue", "VALUE"))


@_part
def restrictions(tb: TBox) -> DataFrame:
    """(id, property, rtype, quantifier, target) of each restriction."""
    ids = tb.names("restriction").toDF("id")
    rank = F.create_map(*[F.lit(x) for n, (name, _) in enumerate(QUANTIFIERS) for x in (S.OWL + name, n)])
    word = F.array(*[F.lit(q) for _, q in QUANTIFIERS])
    found = tb.triples.select(F.col("s").alias("id"), rank[F.col("p")].alias("n"), F.col("o").alias("target")).where("n is not null")
    first = found.groupBy("id").agg(F.min(F.struct("n", "target")).alias("q"))
    kinds = tb.kinds.where(F.col("kind").isin("relationship", "attribute")).select(F.col("s").alias("property"), F.upper("kind").alias("rtype"))
    out = ids.join(_of(tb, S.OWL + "onProperty", "property"), "id", "left").join(kinds, "property", "left").join(first, "id", "left")
    return out.select("id", "property", "rtype", F.get(word, F.col("q.n")).alias("quantifier"), F.col("q.target").alias("target"))


def list_members(heads: DataFrame, first: DataFrame, rest: DataFrame) -> DataFrame:
    """(head, at, member) of lists: `heads` (head), `first` (cell, member), `rest` (cell, next).

    The steps double in each round, so a list takes as many rounds as the logarithm of its length.
    A list that is a ring raises.
    """
    steps = cut(rest.where(F.col("next") != S.RDF + "nil").select("cell", "next"))
    longest = first.select("cell").distinct().count()
    cells, size = cut(heads.select("head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("at"))), 1
    while not steps.isEmpty():
        if size > max(1, longest):
            raise ValueError("a list is a ring")
        cells = cut(cells.unionByName(cells.join(steps, "cell").select("head", F.col("next").alias("cell"), (F.col("at") + size).alias("at"))))
        steps = cut(steps.join(steps.toDF("next", "far"), "next").select("cell", F.col("far").alias("next")))
        size *= 2
    return cells.join(first, "cell").select("head", "at", "member")


def compositions(tb: TBox) -> DataFrame:
    """(id, operator, operands in order) of unions, intersections and complements; a list that is a ring raises."""
    heads = None
    for name, operator in (("unionOf", "OR"), ("intersectionOf", "AND"), ("complementOf", "NOT")):
        own = _of(tb, S.OWL + name, "head").withColumn("operator", F.lit(operator))
        heads = own if heads is None else heads.unionByName(own)
    first, rest = _of(tb, S.RDF + "first", "member").withColumnRenamed("id", "cell"), _of(tb, S.RDF + "rest", "next").withColumnRenamed("id", "cell")
    members = list_members(heads.where("operator <> 'NOT'").select("head").distinct(), first, rest)
    out = heads.where("operator = 'NOT'").select("id", "operator", F.lit(0).cast("long").alias("at"), F.col("head").alias("member"))
    out = out.unionByName(heads.where("operator <> 'NOT'").join(members, "head").select("id", "operator", "at", "member"))
    return out.groupBy("id", "operator").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "member"))), lambda x: x["member"]).alias("operands"))


@_part
def attribute_datatypes(tb: TBox) -> DataFrame:
    """(attribute, datatype, n_ranges): the range of the attribute or a super-attribute; null if it has none, and several are a violation."""
    ranges = tb.triples.where(F.col("p") == S.RDFS + "range").select(F.col("s").alias("super"), F.col("o").alias("datatype"))
    found = tb.attributes.join(ranges, "super", "left").groupBy(F.col("sub").alias("attribute"))
    return found.agg(F.min("datatype").alias("datatype"), F.count("datatype").alias("n_ranges"))

