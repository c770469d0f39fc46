"""JSON-LD documents, expanded level by level.

Each level reads the objects that the one before has found: documents give their nodes, nodes give
their triples and the nodes within them, and so on until none is left. So the nodes of a large
document are spread over tasks, and a document is never held as more than its text: members and
elements are walked as stretches of it, and only single values are decoded. A node without a name
gets one from its document and its path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.loops import cut

_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'
_TOKEN = re.compile(rf"[ \t\n\r]*+(?:(?P<string>{_STRING})|(?P<other>-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null)|(?P<mark>[\[\]{{}},:]))", re.A)
_NEST = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]', re.S)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(rf"{_STRING}|[^\s,\]}}]+")
_WHOLE = re.compile(r"-?\d+")


class _Bad(ValueError):
    pass


def valid(text: str) -> bool:
    """Whether a text is JSON, with a stack of open brackets alone."""
    stack: list[str] = []
    at, wanted = 0, "value"  # value, value or end, key or end, key, colon, comma or end
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            return not stack and wanted == "comma or end" and _SPACE.fullmatch(text, at) is not None
        at, mark = m.end(), m["mark"]
        if wanted in ("key", "key or end"):
            if m["string"]:
                wanted = "colon"
                continue
            if mark != "}" or wanted == "key":
                return False
        elif wanted == "colon":
            if mark != ":":
                return False
            wanted = "value"
            continue
        elif wanted in ("value", "value or end") and mark != "]":
            if mark == "{":
                stack.append("}")
                wanted = "key or end"
                continue
            if mark == "[":
                stack.append("]")
                wanted = "value or end"
                continue
            if mark:
                return False
            wanted = "comma or end"
            if not stack:
                return _SPACE.fullmatch(text, at) is not None
            continue
        elif wanted == "value" or (wanted == "comma or end" and mark not in (",", "}", "]")):
            return False
        elif mark == ",":
            if not stack:
                return False
            wanted = "key" if stack[-1] == "}" else "value"
            continue
        if not stack or stack.pop() != mark:
            return False
        wanted = "comma or end"
        if not stack:
            return _SPACE.fullmatch(text, at) is not None


def _first(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _end(text: str, at: int) -> int:
    """The end of the value that starts at `at`, in valid JSON."""
    if text[at] not in "[{":
        return _SCALAR.match(text, at).end()
    depth = 0
    for m in _NEST.finditer(text, at):
        c = m[0]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return m.end()
    raise _Bad(text[at : at + 20])


def elements(text: str, at: int) -> Iterator[tuple[int, int]]:
    """The stretches of an array's elements."""
    at = _first(text, at + 1)
    while text[at] != "]":
        end = _end(text, at)
        yield at, end
        at = _first(text, end)
        at = _first(text, at + 1) if text[at] == "," else at


def members(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """The keys of an object with the stretches of their values."""
    at = _first(text, at + 1)
    while text[at] != "}":
        end = _end(text, at)
        key = json.loads(text[at:end])
        at = _first(text, _first(text, end) + 1)
        end = _end(text, at)
        yield key, at, end
        at = _first(text, end)
        at = _first(text, at + 1) if text[at] == "," else at


_EMPTY = {"terms": {}, "vocab": None, "base": None, "lang": None}


def extended(context: dict, given) -> dict:
    """A context with what a document adds to it; contexts elsewhere can't be read."""
    if given is None:
        return _EMPTY
    if isinstance(given, list):
        for x in given:
            context = extended(context, x)
        return context
    if not isinstance(given, dict):
        raise _Bad("context")
    out = {**context, "terms": dict(context["terms"])}
    for key, name in (("@vocab", "vocab"), ("@base", "base"), ("@language", "lang")):
        if key in given:
            out[name] = given[key]
    for key, x in given.items():
        if key.startswith("@"):
            continue
        if x is None or isinstance(x, str):
            out["terms"][key] = {"id": x}
        elif isinstance(x, dict):
            reverse = "@reverse" in x
            own = {"id": x.get("@reverse") if reverse else x.get("@id", None if "@id" in x else key), "type": x.get("@type"), "in": x.get("@container"), "reverse": reverse}
            own |= {"lang": x["@language"]} if "@language" in x else {}
            own |= {"context": x["@context"]} if "@context" in x else {}
            out["terms"][key] = own
        else:
            raise _Bad("context")
    return out


def full(context: dict, x: str, vocab: bool = True, seen: tuple = ()) -> str | None:
    """The IRI or keyword that a name stands for; null where the context takes its meaning away."""
    if x.startswith("@") or x.startswith("_:"):
        return x
    terms = context["terms"]
    if vocab and x in terms and x not in seen:
        own = terms[x]["id"]
        return None if own is None else own if own == x and ":" not in x and context["vocab"] is None else full(context, own, True, (*seen, x)) if own != x else full(context, x, True, (*seen, x))
    if ":" in x:
        prefix, _, rest = x.partition(":")
        if not rest.startswith("//") and prefix in terms and prefix not in seen and terms[prefix]["id"]:
            return full(context, terms[prefix]["id"], True, (*seen, prefix)) + rest
        return x
    if vocab:
        return x if context["vocab"] is None else full({**context, "vocab": None}, context["vocab"], True, seen) + x
    return urljoin(context["base"], x) if context["base"] else x


def _entity(x: str) -> tuple:
    return x, "bnode" if x.startswith("_:") else "iri", "", ""


_ROW = ("kind", *S.COLUMNS, "id", "k", "x", "doc", "ctx", "subject", "path", "text")
#: What a triple's row has no value for.
_NO_NODE = (None,) * (len(_ROW) - 1 - len(S.COLUMNS))


class _Level:
    """Reads one object: the triples, the nodes within it, and what isn't understood."""

    def __init__(self, doc: str, text: str, path: str):
        self.doc, self.text, self.path, self.out, self.made = doc, text, path, [], 0

    def emit(self, kind: str, **values) -> None:
        self.out.append(tuple({"kind": kind, **values}.get(c) for c in _ROW))

    def bad(self, raw_id: str | None, key: str | None, at: int, end: int) -> None:
        self.emit("bad", id=raw_id, k=key, x=self.text[at:end])

    def pend(self, context: dict, subject: str | None, path: str, at: int, end: int) -> None:
        self.emit("node", doc=self.doc, ctx=json.dumps(context), subject=subject, path=path, text=self.text[at:end])

    def triple(self, s: str, p: str, o: tuple) -> None:
        self.out.append(("triple", s, "bnode" if s.startswith("_:") else "iri", p, *o, *_NO_NODE))

    def blank(self, path: str) -> str:
        return "_:j" + blake2b(f"{self.doc} {path}".encode(), digest_size=12).hexdigest()

    def top(self) -> None:
        """A whole document."""
        at = _first(self.text, 0)
        if self.text[at] == "[":
            for n, (i, j) in enumerate(elements(self.text, at)):
                self.pend(_EMPTY, None, f"{n}", i, j)
        elif self.text[at] == "{":
            parts = {k: (i, j) for k, i, j in members(self.text, at)}
            try:
                context = extended(_EMPTY, json.loads(self.text[slice(*parts["@context"])])) if "@context" in parts else _EMPTY
            except _Bad:
                return self.bad(None, "@context", *parts["@context"])
            graph = next((k for k in parts if full(context, k) == "@graph"), None)
            if graph:
                i, j = parts[graph]
                for n, (x, y) in enumerate(elements(self.text, i) if self.text[i] == "[" else [(i, j)]):
                    self.pend(context, None, f"{n}", x, y)
            if graph is None or any(not (full(context, k) or "@").startswith("@") or full(context, k) in ("@type", "@reverse") for k in parts):
                self.node(_EMPTY, None, at, graph)
        else:
            self.bad(None, None, at, len(self.text))

    def node(self, context: dict, subject: str | None, at: int, without: str | None = None) -> None:
        """A node object; `without` is a member that has been read."""
        if self.text[at] != "{":
            return self.bad(None, None, at, _end(self.text, at))
        parts = [(k, i, j) for k, i, j in members(self.text, at) if k != without]
        raw = None
        for k, i, j in parts:
            if k == "@context":
                try:
                    context = extended(context, json.loads(self.text[i:j]))
                except _Bad:
                    return self.bad(None, k, i, j)
        for k, i, j in parts:
            if full(context, k) == "@id" and self.text[i] == '"':
                raw = json.loads(self.text[i:j])
                subject = subject or full(context, raw, False)
        s = subject or self.blank(self.path)
        for k, i, j in parts:
            p, term = full(context, k), context["terms"].get(k, {})
            if p in ("@id", "@context", "@index") or p is None:
                continue
            try:
                if p == "@type":
                    for x in self.strings(i, j):
                        self.triple(s, S.TYPE, _entity(full(context, x)))
                elif p == "@reverse":
                    for q, x, y in members(self.text, i):
                        self.back(s, q, full(context, q), context, context["terms"].get(q, {}), x, y, f"{self.path}.{k}.{q}")
                elif p.startswith("@") or ":" not in p:
                    raise _Bad(k)
                elif term.get("reverse"):
                    self.back(s, k, p, context, term, i, j, f"{self.path}.{k}")
                else:
                    self.values(s, p, k, raw, context, term, i, j, f"{self.path}.{k}")
            except (_Bad, ValueError, RecursionError):
                self.bad(raw, k, i, j)

    def strings(self, at: int, end: int) -> list[str]:
        x = json.loads(self.text[at:end])
        x = x if isinstance(x, list) else [x]
        if not all(isinstance(y, str) for y in x):
            raise _Bad("type")
        return x

    def back(self, s: str, key: str, p: str | None, context: dict, term: dict, at: int, end: int, path: str) -> None:
        if p is None or ":" not in p:
            raise _Bad(key)
        for o in self.objects(self.within(context, term), term, at, end, path):
            if o[1] == "literal":
                raise _Bad(key)
            self.triple(o[0], p, _entity(s))

    @staticmethod
    def within(context: dict, term: dict) -> dict:
        return extended(context, term["context"]) if "context" in term else context

    def values(self, s: str, p: str, key: str, raw: str | None, context: dict, term: dict, at: int, end: int, path: str) -> None:
        """The triples of one member; a value that isn't understood is a row of its own."""
        context, held = self.within(context, term), term.get("in")
        held = held if isinstance(held, list) else [held]
        if "@list" in held and not self.is_list(context, at):
            return self.triple(s, p, self.listed(context, term, at, end, path))
        if self.text[at] == "{" and ("@language" in held or "@index" in held):
            for n, (name, i, j) in enumerate(members(self.text, at)):
                if "@language" in held:
                    for x in self.strings(i, j):
                        self.triple(s, p, (x, "literal", S.RDF + "langString", name.lower()) if name != "@none" else (x, "literal", S.XSD + "string", ""))
                else:
                    for o in self.objects(context, term, i, j, f"{path}.{n}"):
                        self.triple(s, p, o)
            return
        if any(x in held for x in ("@graph", "@id", "@type")):
            raise _Bad(key)
        for n, (i, j) in enumerate(elements(self.text, at) if self.text[at] == "[" else [(at, end)]):
            before = len(self.out)
            try:
                for o in self.objects(context, term, i, j, f"{path}.{n}"):
                    self.triple(s, p, o)
            except (_Bad, ValueError):
                del self.out[before:]
                self.bad(raw, key, i, j)

    def is_list(self, context: dict, at: int) -> bool:
        return self.text[at] == "{" and any(full(context, k) == "@list" for k, _, _ in members(self.text, at))

    def listed(self, context: dict, term: dict, at: int, end: int, path: str) -> tuple:
        """The head of a list, whose cells are triples."""
        last = None
        head = _entity(S.RDF + "nil")
        n = 0
        for i, j in elements(self.text, at) if self.text[at] == "[" else [(at, end)]:
            found = [self.listed(context, term, i, j, f"{path}.{n}")] if self.text[i] == "[" else list(self.objects(context, term, i, j, f"{path}.{n}"))
            for o in found:
                cell = self.blank(f"{path} list {n}")
                n += 1
                if last is None:
                    head = _entity(cell)
                else:
                    self.triple(last, S.RDF + "rest", _entity(cell))
                self.triple(cell, S.RDF + "first", o)
                last = cell
        if last is not None:
            self.triple(last, S.RDF + "rest", _entity(S.RDF + "nil"))
        return head

    def objects(self, context: dict, term: dict, at: int, end: int, path: str) -> Iterator[tuple]:
        """The terms of a value; nodes within it wait for the next level."""
        text, kind = self.text, term.get("type")
        if text[at] == "[":
            for n, (i, j) in enumerate(elements(text, at)):
                yield from self.objects(context, term, i, j, f"{path}.{n}")
        elif text[at] == "{":
            parts = {(full(context, k) or k): (i, j) for k, i, j in members(text, at)}
            if "@context" in parts:
                context = extended(context, json.loads(text[slice(*parts["@context"])]))
                parts = {(full(context, k) or k): (i, j) for k, i, j in members(text, at)}
            if "@value" in parts:
                yield from self.literal(context, {k: text[slice(*v)] for k, v in parts.items()})
            elif "@list" in parts:
                yield self.listed(context, term, *parts["@list"], path)
            elif "@set" in parts:
                yield from self.objects(context, term, *parts["@set"], path)
            elif "@graph" in parts or "@included" in parts:
                raise _Bad("graph")
            else:
                own = json.loads(text[slice(*parts["@id"])]) if "@id" in parts else None
                if own is not None and not isinstance(own, str):
                    raise _Bad("id")
                s = self.blank(path) if own is None else full(context, own, False)
                if parts.keys() - {"@id", "@context", "@index"}:
                    self.pend(context, s, path, at, end)
                yield _entity(s)
        else:
            yield from self.scalar(context, term, kind, text[at:end])

    def scalar(self, context: dict, term: dict, kind: str | None, token: str) -> Iterator[tuple]:
        if token == "null":
            return
        text = token[0] == '"'
        if text and kind in ("@id", "@vocab"):
            yield _entity(full(context, json.loads(token), kind == "@vocab"))
        elif kind and kind not in ("@id", "@vocab", "@none"):
            if kind.startswith("@"):
                raise _Bad(kind)
            yield json.loads(token) if text else token, "literal", full(context, kind), ""
        elif text:
            lang = term["lang"] if "lang" in term else context["lang"]
            yield json.loads(token), "literal", S.RDF + "langString" if lang else S.XSD + "string", (lang or "").lower()
        else:
            yield token, "literal", S.XSD + ("boolean" if token in ("true", "false") else "integer" if _WHOLE.fullmatch(token) else "double"), ""

    def literal(self, context: dict, parts: dict[str, str]) -> Iterator[tuple]:
        token = parts["@value"]
        if token[0] in "[{":
            raise _Bad("value")
        lang = json.loads(parts.get("@language", "null"))
        kind = json.loads(parts.get("@type", "null"))
        if lang and token[0] == '"':
            yield json.loads(token), "literal", S.RDF + "langString", lang.lower()
        else:
            yield from self.scalar({**context, "lang": None}, {}, kind, token)


_SCHEMA = ", ".join(f"{c} string" for c in _ROW)


def _level(rows: DataFrame) -> DataFrame:
    """What the objects of one level give (doc, ctx, subject, path, text); documents have no ctx."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], _ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            out: list[tuple] = []
            for n in range(batch.num_rows):
                doc, ctx, subject, path, text = (batch.column(c)[n].as_py() for c in ("doc", "ctx", "subject", "path", "text"))
                level = _Level(doc, text, path)
                if ctx is None:
                    level.doc = blake2b(text.encode(), digest_size=16).hexdigest()
                    if valid(text):
                        level.top()
                    else:
                        level.emit("bad", x=text)
                else:
                    if ctx not in known:
                        known = {ctx: json.loads(ctx)}
                    level.node(known[ctx], subject, _first(text, 0))
                out += level.out
                if len(out) > 5000:
                    for i in range(0, len(out), 5000):
                        yield batch_of(out[i : i + 5000])
                    out = []
            if out:
                yield batch_of(out)

    return rows.mapInArrow(run, _SCHEMA)


def expanded(documents: DataFrame) -> DataFrame:
    """All rows that documents (value) give, level by level: triples, and with kind `bad` what isn't understood."""
    none = F.lit(None).cast("string")
    waiting = documents.where(F.col("value").isNotNull()).select(F.lit("").alias("doc"), none.alias("ctx"), none.alias("subject"), F.lit("").alias("path"), F.col("value").alias("text"))
    # So are the documents, which may come from few files.
    waiting = waiting.repartition(F.xxhash64("text"))
    out = None
    while True:
        found = cut(_level(waiting))
        own = found.where("kind <> 'node'").select("kind", *S.COLUMNS, "id", "k", "x")
        out = own if out is None else out.unionByName(own)
        nodes = found.where("kind = 'node'").select("doc", "ctx", "subject", "path", "text")
        if nodes.isEmpty():
            return out
        # The nodes of a large document are spread over all tasks.
        waiting = nodes.repartition(F.xxhash64("doc", "path"))


def parse_jsonld(documents: DataFrame) -> DataFrame:
    """The triples of JSON-LD documents (value), each a whole document of any size up to Spark's strings.

    Strings are strings whatever they look like; whole numbers are integers with all their digits,
    other numbers doubles as they are written, true and false booleans; nulls are nothing. Nodes
    within nodes, lists, sets, reverse properties, containers by language and index, types and
    languages of terms, keywords under other names, bases, and contexts within nodes and terms are
    understood. A node without an id is named by its document's text and its path, labels of blank
    nodes hold over all documents, and the nodes of a named graph count with all others. Contexts
    elsewhere, other containers, and members that have no IRI are not understood (see
    `bad_jsonld`).
    """
    return expanded(documents).where("kind = 'triple'").select(*S.COLUMNS).distinct()


def bad_jsonld(documents: DataFrame) -> DataFrame:
    """(id, k, x): subject, key and text of what isn't understood; a document that is no JSON has a null key and its text."""
    return expanded(documents).where("kind = 'bad'").select("id", "k", "x")
