"""Graph patterns: conjunctions with optional, alternative and excluded parts.

A term is a whole: a literal's datatype and language belong to it, so "x", "x"@en and the entity x
are three terms, in constants, in joins and in templates. A variable that stands as a subject or a
predicate anywhere is an entity, whose text alone says what it is; others carry their kind, datatype
and language through every join.

The order of joins comes from statistics of the predicates. Patterns around one subject variable are
a star, which is answered in one grouped scan of the graph instead of one scan for each pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


class Literal(NamedTuple):
    """A literal in a pattern or template."""

    value: str
    datatype: str = S.XSD + "string"
    lang: str = ""


def tagged(value: str, lang: str) -> Literal:
    """A literal with a language."""
    return Literal(value, S.RDF + "langString", lang.lower())


Term = str | Literal
Pattern = tuple[str, str, Term]


@dataclass(frozen=True)
class Join:
    """A part that is joined to the patterns before it: `how` is optional, minus or union.

    * optional keeps rows without a match, with nulls; `where` holds within the match.
    * minus drops rows with a match on the shared variables; a part that shares none drops nothing.
    * union adds up the rows of `patterns` and of each list in `others`; a variable that an
      alternative lacks is null there. The variables that all alternatives share with the patterns
      before must be bound in all of them.
    """

    how: str
    patterns: list[Pattern]
    others: tuple[list[Pattern], ...] = ()
    where: tuple[Column, ...] = ()


def predicate_statistics(t: DataFrame) -> DataFrame:
    """(p, n, subjects, objects): triples and approximate numbers of distinct subjects and objects of each predicate, in one pass."""
    o = F.struct("o", "o_kind", "o_dt", "o_lang")
    return t.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct(F.xxhash64(o)).alias("objects"))


class Statistics:
    """Statistics of the predicates that patterns name; rows for those alone come to the driver."""

    def __init__(self, rows: DataFrame | None, patterns: list[Pattern]):
        named = sorted({p for _, p, _ in patterns if not is_variable(p)})
        found = rows.where(F.col("p").isin(named)).collect() if rows is not None and named else []
        self.of = {r["p"]: (max(1, r["n"]), max(1, r["subjects"]), max(1, r["objects"])) for r in found}
        self.known = rows is not None

    def rows(self, pattern: Pattern, bound: set[str]) -> float:
        """Rows that a pattern is expected to have for each row that binds `bound`."""
        s, p, o = pattern
        n, subjects, objects = self.of.get(p, (1, 1, 1) if self.known and not is_variable(p) else (1e6, 1e5, 1e5))
        out = float(n)
        out /= subjects if not is_variable(s) or s in bound else 1
        out /= objects if not is_variable(o) or o in bound else 1
        return out


def is_variable(x: Term) -> bool:
    return isinstance(x, str) and x.startswith("?")


def entity_variables(patterns: list[Pattern]) -> set[str]:
    """Variables that stand as a subject or predicate."""
    return {x for s, p, _ in patterns for x in (s, p) if is_variable(x)}


#: The columns of a variable ?x: its text, and x_kind, x_dt and x_lang.
PARTS = ("", "_kind", "_dt", "_lang")


def columns(variable: str) -> list[str]:
    return [variable[1:] + end for end in PARTS]


_ENTITY = re.compile(r"_:\S+|[A-Za-z][A-Za-z0-9+.\-]*:\S*")


def _is(constant: Term) -> Column:
    """Whether the object is this term."""
    same = F.col("o") == (constant.value if isinstance(constant, Literal) else constant)
    if isinstance(constant, Literal):
        return same & (F.col("o_kind") == "literal") & (F.col("o_dt") == constant.datatype) & (F.col("o_lang") == constant.lang)
    if _ENTITY.fullmatch(constant):
        return same & (F.col("o_kind") != "literal")
    return same & (F.col("o_kind") == "literal") & (F.col("o_lang") == "")


def _entity(variable: str, c: str) -> list[Column]:
    name = variable[1:]
    return [F.col(c).alias(name), S.kind_of(F.col(c)).alias(f"{name}_kind"), F.lit("").alias(f"{name}_dt"), F.lit("").alias(f"{name}_lang")]


def _one(t: DataFrame, pattern: Pattern, entities: set[str]) -> DataFrame:
    """The rows of one pattern."""
    s, p, o = pattern
    rows, out, seen = t, [], set()
    for c, term in (("p", p), ("s", s)):
        if not is_variable(term):
            rows = rows.where(F.col(c) == term)
        elif term in seen:
            rows = rows.where(F.col("s") == F.col("p"))
        else:
            seen.add(term)
            out += _entity(term, c)
    if not is_variable(o):
        rows = rows.where(_is(o))
    elif o in seen:
        rows = rows.where((F.col("o") == F.col("s" if o == s else "p")) & (F.col("o_kind") != "literal"))
    elif o in entities:
        rows = rows.where(F.col("o_kind") != "literal")
        out += _entity(o, "o")
    else:
        out += [F.col(c).alias(x) for c, x in zip(("o", "o_kind", "o_dt", "o_lang"), columns(o))]
    return rows.select(*out) if out else rows.select(F.lit(1).alias("_held")).limit(1)


def _star(t: DataFrame, patterns: list[Pattern], entities: set[str]) -> DataFrame:
    """The rows of patterns with one subject variable and known predicates: one scan, one group for each subject.

    Each triple is marked with the patterns that it fits; a subject in which one of them has no triple
    goes. A subject's values are exploded pattern by pattern, as the joins of its patterns would.
    """
    s = patterns[0][0]
    fits = []
    for _, p, o in patterns:
        fit = F.col("p") == p
        if not is_variable(o):
            fit &= _is(o)
        elif o == s:
            fit &= (F.col("o") == F.col("s")) & (F.col("o_kind") != "literal")
        elif o in entities:
            fit &= F.col("o_kind") != "literal"
        fits.append(fit)
    rows = t.where(F.col("p").isin(sorted({p for _, p, _ in patterns}))).where(reduce(lambda a, b: a | b, fits))
    own = F.struct("o", "o_kind", "o_dt", "o_lang")
    # A constant needs no values, only to be there.
    free = [is_variable(o) and o != s for _, _, o in patterns]
    found = [(F.collect_set(F.when(fit, own)) if f else F.max(F.when(fit, F.lit(True)))).alias(f"__{n}") for n, (fit, f) in enumerate(zip(fits, free))]
    out = rows.groupBy("s").agg(*found)
    for n, f in enumerate(free):
        out = out.where(F.size(f"__{n}") > 0 if f else F.col(f"__{n}"))
    out = out.select(*_entity(s, "s"), *[f"__{n}" for n, f in enumerate(free) if f])
    bound = {s}
    for n, (_, _, o) in enumerate(patterns):
        if not free[n]:
            continue
        rest = [c for c in out.columns if c != f"__{n}"]
        if o in bound:  # two patterns with one object
            same = reduce(lambda a, b: a & b, [F.col(f"__x.{c}") == F.col(x) for c, x in zip(("o", "o_kind", "o_dt", "o_lang"), columns(o))])
            out = out.select(*rest, F.explode(f"__{n}").alias("__x")).where(same).drop("__x")
        else:
            out = out.select(*rest, F.explode(f"__{n}").alias("__x")).select(*rest, *[F.col(f"__x.{c}").alias(x) for c, x in zip(("o", "o_kind", "o_dt", "o_lang"), columns(o))])
            bound.add(o)
    return out


def stars(patterns: list[Pattern], statistics: Statistics) -> list[list[Pattern]]:
    """Patterns in groups of one subject variable with known predicates, of two or more predicates; others alone.

    With statistics, a pattern that has over `SPREAD` objects for each subject stays alone, so that the
    values of a hub are never gathered.
    """
    groups: dict[str, list[Pattern]] = {}
    alone = []
    for x in dict.fromkeys(patterns):
        s, p, o = x
        n, subjects, _ = statistics.of.get(p, (1, 1, 1))
        if is_variable(s) and not is_variable(p) and statistics.known and n <= SPREAD * subjects:
            groups.setdefault(s, []).append(x)
        else:
            alone.append([x])
    return [g for g in groups.values()] + alone


#: Objects for each subject, on average, up to which a pattern is part of a star.
SPREAD = 4


def _ordered(groups: list[list[Pattern]], statistics: Statistics, bound: set[str]) -> list[list[Pattern]]:
    """Groups in the order of joins: the fewest expected rows first, then always one that shares a variable and adds the fewest."""
    waiting, out, bound = list(groups), [], set(bound)

    def variables(g: list[Pattern]) -> set[str]:
        return {x for pattern in g for x in pattern if is_variable(x)}

    def cost(g: list[Pattern]) -> tuple:
        least = min(statistics.rows(p, bound) for p in g)
        return (bool(bound) and bool(variables(g)) and not variables(g) & bound, least, sum(is_variable(x) for p in g for x in p))

    while waiting:
        g = min(waiting, key=cost)
        if bound and variables(g) and not variables(g) & bound:
            raise ValueError(f"{g[0]} shares no variable with the other patterns")
        waiting.remove(g)
        out.append(g)
        bound |= variables(g)
    return out


def _keys(shared: list[str], entities: set[str]) -> list[str]:
    return [c for v in shared for c in (columns(v)[:1] if v in entities else columns(v))]


def _joined(left: DataFrame, right: DataFrame, shared: list[str], entities: set[str], how: str) -> DataFrame:
    """A join on whole terms; for entities their text alone, because the rest follows from it."""
    keys = _keys(shared, entities)
    extra = [c for v in shared for c in columns(v) if c not in keys]
    return left.join(right.drop(*extra), keys, how)


def _conjunction(t: DataFrame, patterns: list[Pattern], entities: set[str], statistics: Statistics) -> DataFrame:
    out, bound = None, set()
    for g in _ordered(stars(patterns, statistics), statistics, bound):
        rows = _star(t, g, entities) if len(g) > 1 else _one(t, g[0], entities)
        here = {x for p in g for x in p if is_variable(x)}
        if out is None:
            out = rows
        elif not here:  # a pattern of constants holds or doesn't
            out = out.join(rows, how="left_semi", on=F.lit(True))
        elif not bound:
            out = rows.join(out, how="left_semi", on=F.lit(True))
        else:
            out = _joined(out, rows, sorted(here & bound), entities, "inner")
        bound |= here
    return out


def _variables(patterns: list[Pattern]) -> set[str]:
    return {x for p in patterns for x in p if is_variable(x)}


def _sided(t: DataFrame, part: list[Pattern], entities: set[str], statistics: Statistics, where: tuple[Column, ...] = ()) -> DataFrame:
    return reduce(lambda df, f: df.where(f), where, _conjunction(t, part, entities | entity_variables(part), statistics))


def select(t: DataFrame, patterns: list[Pattern], joins: tuple[Join, ...] = (), filters: tuple[Column, ...] = (), distinct: bool = True, statistics: DataFrame | None = None) -> DataFrame:
    """Rows for which the patterns hold, with the columns x, x_kind, x_dt and x_lang of each variable ?x.

    A constant is an entity's identifier (an IRI or a blank node), or a `Literal`; an object's text that
    is no IRI is short for a literal of that text without a language, of any datatype. `joins` follow the patterns one after
    another. `statistics` (see `predicate_statistics`) order the joins and allow stars; without them
    patterns with more constants come first. Nulls stand only where an optional or alternative part
    has no match, and such a variable matches no later part's value.
    """
    entities = entity_variables([*patterns, *[p for j in joins for part in (j.patterns, *j.others) for p in part]])
    known = Statistics(statistics, [*patterns, *[p for j in joins for part in (j.patterns, *j.others) for p in part]])
    out, bound = _conjunction(t, patterns, entities, known), _variables(patterns)
    for join in joins:
        here = _variables(join.patterns)
        if join.how == "union":
            parts = [join.patterns, *join.others]
            shared = sorted(reduce(lambda a, b: a & b, [_variables(p) for p in parts]) & bound)
            if any(_variables(p) & bound != set(shared) for p in parts):
                raise ValueError("alternatives share different variables with the patterns before them")
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_sided(t, p, entities, known, join.where) for p in parts])
            here = set().union(*[_variables(p) for p in parts])
            if not shared:
                _unshared(join)
            out = _joined(out, rows, shared, entities, "inner")
        elif join.how == "optional":
            shared = sorted(here & bound)
            if not shared:
                _unshared(join)
            out = _joined(out, _sided(t, join.patterns, entities, known, join.where).distinct(), shared, entities, "left")
        elif join.how == "minus":
            shared = sorted(here & bound)
            if shared:
                keys = _keys(shared, entities)
                rows = _sided(t, join.patterns, entities, known, join.where).select(*keys).distinct()
                out = out.join(rows, keys, "left_anti")
            here = set()
        else:
            raise ValueError(f"{join.how} is none of optional, minus, union")
        bound |= here
    order = [c for v in sorted(bound) for c in columns(v)]
    out = reduce(lambda df, f: df.where(f), filters, out).select(*order) if order else out
    return out.distinct() if distinct else out


def _unshared(join: Join):
    raise ValueError(f"{join.patterns[0]} shares no variable with the patterns before it")


def _struct(s: Term, p: Term, o: Term) -> Column:
    """The triple that a template makes of a row, with the whole term of each variable; null where it can't be a triple."""
    text = lambda x: F.col(x[1:]) if is_variable(x) else F.lit(x)
    kind = lambda x: F.col(f"{x[1:]}_kind") if is_variable(x) else S.kind_of(F.lit(x))
    if isinstance(o, Literal):
        whole = [F.lit(o.value), F.lit("literal"), F.lit(o.datatype), F.lit(o.lang)]
    elif is_variable(o):
        whole = [F.col(c) for c in columns(o)]
    else:
        whole = [F.lit(o), S.kind_of(F.lit(o)), F.lit(""), F.lit("")]
    fields = [text(s), kind(s), text(p), *whole]
    made = F.struct(*[f.alias(c) for f, c in zip(fields, S.COLUMNS)])
    # Literals are no subjects, and predicates are IRIs.
    return F.when((kind(s) != "literal") & (kind(p) == "iri") & fields[0].isNotNull() & fields[2].isNotNull() & fields[3].isNotNull(), made)


def construct(t: DataFrame, patterns: list[Pattern], template: list[Pattern], **options) -> DataFrame:
    """The triples that the template makes of each row; a variable keeps its whole term, and what would be no triple is left out.

    A blank node `_:x` of the template is a new one for each row; its name is a hash of the row's terms.
    """
    rows = select(t, patterns, **options)
    own = F.sha2(F.to_json(F.struct(*rows.columns)), 256) if rows.columns else F.lit("")
    fresh = {x for triple in template for x in triple if isinstance(x, str) and x.startswith("_:")}
    for x in sorted(fresh):
        rows = rows.withColumns({f"_new_{x[2:]}": F.concat(F.lit("_:"), F.substring(own, 1, 32), F.lit("_" + x[2:])), f"_new_{x[2:]}_kind": F.lit("bnode"), f"_new_{x[2:]}_dt": F.lit(""), f"_new_{x[2:]}_lang": F.lit("")})
    named = [tuple(f"?_new_{x[2:]}" if x in fresh else x for x in triple) for triple in template]
    made = rows.select(F.explode(F.array_compact(F.array(*[_struct(*x) for x in named]))).alias("t"))
    return made.select("t.*").select(*S.COLUMNS).distinct()


def ask(t: DataFrame, patterns: list[Pattern], **options) -> bool:
    """Whether the patterns hold anywhere."""
    return not select(t, patterns, distinct=False, **options).isEmpty()
