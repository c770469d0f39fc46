"""Set operations and updates: each returns a new graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import canonical
from .isomorphism import isomorphic
from .navigate import edges
from .select import attributes_in_use, get_by_class, individuals, preferred_label
from .tbox import TBox, attribute_datatypes, below

KEY = list(S.COLUMNS)


def _minus(t: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return t.join(other.select(*on).distinct(), on, "left_anti").select(*KEY)


def existing(t: DataFrame, new: DataFrame, tb: TBox) -> DataFrame:
    """(s): individuals of `new` that the graph has already; without exists_ok they are violations."""
    return individuals(new, tb).join(individuals(t, tb), "s", "left_semi")


def unsupported(new: DataFrame, tb: TBox) -> DataFrame:
    """Triples of `new` that `add` can't take without all_triples: unknown predicates, and attributes with an entity as value."""
    kinds = tb.kinds.where(F.col("kind").isin("relationship", "attribute", "annotation")).select(F.col("s").alias("p"), "kind")
    found = new.where(F.col("p") != S.TYPE).join(kinds, "p", "left")
    return found.where(F.col("kind").isNull() | ((F.col("kind") == "attribute") & (F.col("o_kind") != "literal"))).select(*KEY)


def relevant(new: DataFrame, tb: TBox) -> DataFrame:
    """What of `new` is copied: types, attributes with literals, annotations, and relationships to individuals that are copied too."""
    kinds = tb.kinds.where(F.col("kind").isin("relationship", "attribute", "annotation")).select(F.col("s").alias("p"), "kind")
    kinds = kinds.union(S.local(new.sparkSession, [(S.TYPE, "type")], ("p", "kind")))
    copied = individuals(new, tb)
    here = copied.select(F.col("s").alias("o"), F.lit(True).alias("here"))
    known = new.join(copied, "s", "left_semi").join(kinds, "p").join(here, "o", "left")
    plain = F.col("kind").isin("type", "annotation") | ((F.col("kind") == "attribute") & (F.col("o_kind") == "literal"))
    linked = (F.col("kind") == "relationship") & (F.col("o_kind") != "literal") & F.col("here").isNotNull()
    return known.where(plain | linked).select(*KEY)


def add(t: DataFrame, new: DataFrame, tb: TBox, merge: bool = False, all_triples: bool = False) -> DataFrame:
    """The graph with the individuals of `new`; without `merge` their old triples go first. Check `existing` and `unsupported` before."""
    copied = new.select(*KEY) if all_triples else relevant(new, tb)
    base = t if merge else _minus(t, individuals(new, tb), ["s"])
    return S.union(base, copied)


def delete(t: DataFrame, ids: DataFrame) -> DataFrame:
    """The graph without all triples that have one of `ids` (s) as subject or object."""
    return _minus(_minus(t, ids, ["s"]), ids.select(F.col("s").alias("o")), ["o"])


def not_contained(t: DataFrame, ids: DataFrame, tb: TBox) -> DataFrame:
    """(s): ids that the graph doesn't have; deleting them is a violation."""
    return ids.select("s").distinct().join(individuals(t, tb), "s", "left_anti")


def upsert(t: DataFrame, new: DataFrame, mode: str = "replace") -> DataFrame:
    """`new` in place of what its subjects had (replace), or beside it (merge)."""
    return S.union(t if mode == "merge" else _minus(t, new, ["s"]), new)


def filter_violations(other: DataFrame, tb: TBox, cls: str) -> DataFrame:
    """(s): individuals of `other` that aren't of the class a set is filtered by."""
    return individuals(other, tb).join(get_by_class(other, tb, cls), "s", "left_anti")


def session_union(t: DataFrame, other: DataFrame, tb: TBox) -> DataFrame:
    """All individuals of both; triples of those in both are merged."""
    return add(t, other, tb, merge=True)


def session_intersection(t: DataFrame, other: DataFrame, tb: TBox, cls: str = S.THING) -> DataFrame:
    """Members of the class that aren't in `other` go; triples of the common ones are merged."""
    mine = individuals(t, tb) if cls == S.THING else get_by_class(t, tb, cls)
    common = mine.join(individuals(other, tb), "s", "left_semi")
    kept = delete(t, mine.join(individuals(other, tb), "s", "left_anti"))
    return S.union(kept, relevant(other.join(common, "s", "left_semi"), tb))


def session_difference(t: DataFrame, other: DataFrame, tb: TBox) -> DataFrame:
    """Without the individuals of `other`."""
    return delete(t, individuals(other, tb))


def session_symmetric_difference(t: DataFrame, other: DataFrame, tb: TBox) -> DataFrame:
    """The individuals of one of both alone."""
    mine, theirs = individuals(t, tb), individuals(other, tb)
    common = mine.join(theirs, "s", "left_semi")
    return S.union(delete(t, common), delete(relevant(other, tb), common))


def value_sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set algebra on whole rows: and, or, minus, xor."""
    if how == "and":
        return a.intersect(b)
    if how == "or":
        return a.union(b).distinct()
    if how == "minus":
        return a.subtract(b)
    if how == "xor":
        return a.subtract(b).union(b.subtract(a))
    raise ValueError(how)


def compare_sets(a: Column, b: Column) -> Column:
    """Comparisons of two array columns as sets: le, lt, eq, ge, gt, disjoint."""
    le, ge = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.struct(le.alias("le"), (le & ~ge).alias("lt"), (le & ge).alias("eq"), ge.alias("ge"), (ge & ~le).alias("gt"), (~F.arrays_overlap(a, b)).alias("disjoint"))


def _values(changes: DataFrame, tb: TBox, attribute: str) -> DataFrame:
    """(s, value) as triples of the attribute with its datatype; null values are left out."""
    found = attribute_datatypes(tb).where(F.col("attribute") == attribute).first()
    datatype = (found and found["datatype"]) or S.XSD + "string"
    return S.from_structs(changes.where("value is not null"), S.literal(F.col("s"), attribute, canonical(F.col("value"), datatype), datatype)).distinct()


def attributes_add(t: DataFrame, tb: TBox, attribute: str, changes: DataFrame) -> DataFrame:
    """With the values of `changes` (s, value), cast to the attribute's datatype."""
    return S.union(t, _values(changes, tb, attribute))


def attributes_remove(t: DataFrame, tb: TBox, attribute: str, changes: DataFrame) -> DataFrame:
    """Without those values, of the attribute and those below it."""
    gone = _own(t, tb, attribute, changes).join(_values(changes, tb, attribute).select("s", "o", "o_dt"), ["s", "o", "o_dt"], "left_semi")
    return _minus(t, gone, KEY)


def _own(t: DataFrame, tb: TBox, attribute: str, subjects: DataFrame) -> DataFrame:
    return t.where("o_kind = 'literal'").join(below(tb.attributes, attribute), "p", "left_semi").join(subjects.select("s").distinct(), "s", "left_semi").select(*KEY)


def attributes_assign(t: DataFrame, tb: TBox, attribute: str, changes: DataFrame) -> DataFrame:
    """The subjects of `changes` have these values and no others; a null value alone leaves none."""
    wanted = _values(changes, tb, attribute)
    value = ["s", "o", "o_dt"]
    extra = _own(t, tb, attribute, changes).join(wanted.select(*value), value, "left_anti")
    missing = wanted.join(_own(t, tb, attribute, changes).select(*value).distinct(), value, "left_anti")
    return S.union(_minus(t, extra, KEY), missing)


def attributes_intersect(t: DataFrame, tb: TBox, attribute: str, changes: DataFrame) -> DataFrame:
    """The subjects of `changes` keep of their values only these."""
    value = ["s", "o", "o_dt"]
    return _minus(t, _own(t, tb, attribute, changes).join(_values(changes, tb, attribute).select(*value), value, "left_anti"), KEY)


def attributes_xor(t: DataFrame, tb: TBox, attribute: str, changes: DataFrame) -> DataFrame:
    """Values that a subject has go, those it hasn't are added."""
    wanted, value = _values(changes, tb, attribute), ["s", "o", "o_dt"]
    have = _own(t, tb, attribute, changes)
    return S.union(_minus(t, have.join(wanted.select(*value), value, "left_semi"), KEY), wanted.join(have.select(*value).distinct(), value, "left_anti"))


def connect(t: DataFrame, tb: TBox, pairs: DataFrame, relationship: str) -> DataFrame:
    """With a link for each (s, o) of `pairs` that isn't linked already, by the relationship, one below it or a declared inverse; both must be individuals of the graph."""
    known = individuals(t, tb)
    new = pairs.select("s", "o").distinct().join(known, "s", "left_semi").join(known.toDF("o"), "o", "left_semi")
    new = new.join(edges(t, tb, relationship).toDF("s", "o"), ["s", "o"], "left_anti")
    return S.union(t, S.from_structs(new, S.link(F.col("s"), relationship, F.col("o"))))


def disconnect(t: DataFrame, tb: TBox, relationship: str = S.TOP_RELATIONSHIP, pairs: DataFrame | None = None, subjects: DataFrame | None = None, cls: str | None = None) -> DataFrame:
    """Without links by the relationship and those below it: of `pairs` (s, o), or of `subjects` (s), or all; only to individuals of `cls` if one is given."""
    gone = S.links(t).join(below(tb.relationships, relationship), "p", "left_semi")
    if pairs is not None:
        gone = gone.join(pairs.select("s", "o"), ["s", "o"], "left_semi")
    if subjects is not None:
        gone = gone.join(subjects.select("s"), "s", "left_semi")
    if cls is not None:
        gone = gone.join(get_by_class(t, tb, cls).toDF("o"), "o", "left_semi")
    return _minus(t, gone, KEY)


def _linked(t: DataFrame, tb: TBox, relationship: str, wanted: DataFrame) -> DataFrame:
    return edges(t, tb, relationship).toDF("s", "o").join(wanted.select("s").distinct(), "s", "left_semi")


def assign_links(t: DataFrame, tb: TBox, relationship: str, wanted: DataFrame) -> DataFrame:
    """The subjects of `wanted` (s, o) are linked to these and no others."""
    extra = _linked(t, tb, relationship, wanted).join(wanted.select("s", "o"), ["s", "o"], "left_anti")
    return connect(disconnect(t, tb, relationship, extra), tb, wanted, relationship)


def intersect_links(t: DataFrame, tb: TBox, relationship: str, wanted: DataFrame) -> DataFrame:
    """The subjects of `wanted` keep of their links only these."""
    return disconnect(t, tb, relationship, _linked(t, tb, relationship, wanted).join(wanted.select("s", "o"), ["s", "o"], "left_anti"))


def xor_links(t: DataFrame, tb: TBox, relationship: str, wanted: DataFrame) -> DataFrame:
    """Links that are there go, those that aren't are made."""
    have = _linked(t, tb, relationship, wanted)
    return connect(disconnect(t, tb, relationship, have.join(wanted.select("s", "o"), ["s", "o"], "left_semi")), tb, wanted.select("s", "o").join(have, ["s", "o"], "left_anti"), relationship)


def annotations_add(t: DataFrame, annotations: DataFrame) -> DataFrame:
    """With these annotation triples."""
    return S.union(t, annotations)


def annotations_remove(t: DataFrame, annotations: DataFrame) -> DataFrame:
    """Without these annotation triples, literals and entities alike."""
    return _minus(t, annotations, KEY)


def annotations_assign(t: DataFrame, annotation: str, annotations: DataFrame) -> DataFrame:
    """The subjects of `annotations` have these values of that annotation and no others."""
    old = t.where(F.col("p") == annotation).join(annotations.select("s").distinct(), "s", "left_semi")
    return S.union(_minus(t, old, KEY), annotations)


def set_classes(t: DataFrame, classes: DataFrame) -> DataFrame:
    """The subjects of `classes` (s, class) have these types and no others."""
    old = t.where(F.col("p") == S.TYPE).join(classes.select("s").distinct(), "s", "left_semi")
    return S.union(_minus(t, old, KEY), S.from_structs(classes, S.link(F.col("s"), S.TYPE, F.col("class"))))


def set_label(t: DataFrame, new: DataFrame, predicates: tuple[str, ...] = S.LABELS) -> DataFrame:
    """`new` has (s, label, lang): it replaces the preferred label, or is the first property's where there is none; a null label deletes all."""
    labelled = t.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "literal"))
    best = preferred_label(t, predicates).select("s", F.col("label").alias("o"), F.col("lang").alias("o_lang"))
    replaced = labelled.join(best, ["s", "o", "o_lang"], "left_semi").join(new.where("label is not null").select("s"), "s", "left_semi")
    cleared = labelled.join(new.where("label is null").select("s"), "s", "left_semi")
    place = replaced.groupBy("s").agg(F.min("p").alias("p"))
    rows = new.where("label is not null").join(place, "s", "left")
    made = S.from_structs(rows, S.literal(F.col("s"), F.coalesce("p", F.lit(predicates[0])), F.col("label"), F.when(F.col("lang") == "", S.XSD + "string").otherwise(S.RDF + "langString"), F.col("lang")))
    return S.union(_minus(_minus(t, replaced, KEY), cleared, KEY), made)


def container_connect(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """With a reference for each (container, reference)."""
    return S.union(t, S.from_structs(pairs, S.link(F.col("container"), S.CONTAINS, F.col("reference"))))


def container_disconnect(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the reference of each (container, reference); removing one that isn't there is a violation that `container_contains` shows."""
    gone = S.from_structs(pairs, S.link(F.col("container"), S.CONTAINS, F.col("reference")))
    return _minus(t, gone, KEY)


def container_assign(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """The containers of `pairs` have these references and no others."""
    old = t.where(F.col("p") == S.CONTAINS).join(pairs.select(F.col("container").alias("s")).distinct(), "s", "left_semi")
    return container_connect(_minus(t, old, KEY), pairs)


def apply_changelog(base: DataFrame, log: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """The graph after a change log (seq, op: add or delete, triple): the last operation on a triple counts.

    `patterns` (seq, s, p, o; null fits anything) delete what fits of the base and of what was
    added before them. They are few: each kind of pattern is one join on its constants.
    """
    last = log.groupBy(*KEY).agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))
    rows = base.select(*KEY).join(last.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(-1).cast("long").alias("seq"))
    rows = rows.unionByName(last.where("op = 'add'").select(*KEY, F.col("seq").cast("long")))
    if patterns is not None:
        for mask in range(8):
            fixed = [c for n, c in enumerate("spo") if mask >> n & 1]
            of = patterns
            for c in "spo":
                of = of.where(F.col(c).isNotNull() if c in fixed else F.col(c).isNull())
            if not fixed:  # everything before the last such pattern goes
                at = of.agg(F.max("seq")).first()[0]
                rows = rows if at is None else rows.where(F.col("seq") > at)
                continue
            latest = of.groupBy(*fixed).agg(F.max("seq").alias("at"))
            rows = rows.join(latest, fixed, "left").where(F.coalesce(F.col("at") < F.col("seq"), F.lit(True))).drop("at")
    return rows.select(*KEY).distinct()


def clear(t: DataFrame) -> DataFrame:
    """An empty graph."""
    return t.limit(0)


def graph_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs have the same triples; blank nodes are the same if the triples around them are, whatever they are called."""
    a, b = a.select(*KEY), b.select(*KEY)
    if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty():
        return True
    blank = "s_kind = 'bnode' or o_kind = 'bnode'"
    return not a.where(blank).isEmpty() and isomorphic(a, b)


def unused_attributes(t: DataFrame, tb: TBox) -> DataFrame:
    """(p): attributes of the ontology that no subject has a value of."""
    return tb.names("attribute").toDF("p").join(attributes_in_use(t, tb).select("p").distinct(), "p", "left_anti")
