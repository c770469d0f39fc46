"""Turtle files, split like text files, and Turtle output.

Spark's text reader cuts files into splits of whole lines. A statement can go over lines and so over
splits, and where one ends can only be told from outside strings, IRIs and comments. Of these only
long strings go over line ends. So:

1. Each split says, for each state in which it could start (outside, or in either kind of long
   string), in which one it ends; splits without three quotes in a row keep the state. The states
   are composed along each file, which tells how each split really starts. Files without such quotes
   skip this step.
2. Each split is cut at the dots that end statements. What stands before its first and after its last
   end are pieces of statements that neighbours share; they are put together by file and place.
3. Prefixes and bases are statements too; they are gathered first and are handed to all tasks with
   their places, so that each statement is read with those before it in its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

#: Prefixes and bases that are sent to all tasks; more of them are joined by file.
SENT = 100_000

#: Bytes that a task turns into Python's strings, or back into a batch, at a time: batches are bounded by rows, and rows can be long.
HELD = 1 << 20

_CODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_FIRST = r"A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
_CHAR = _FIRST + r"_0-9\-·̀-ͯ‿-⁀"
_LOCAL = rf"(?:[{_FIRST}_0-9:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[{_CHAR}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])|\.(?=[.]*(?:[{_CHAR}:%\\])))*+"
_NAME = rf"(?:[{_FIRST}](?:[{_CHAR}]|\.(?=[.]*[{_CHAR}]))*+)?:(?:{_LOCAL})?"
_NUMBER = r"[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+)"
_SHORT = r""""(?:[^"\\\n\r]++|\\.)*+"|'(?:[^'\\\n\r]++|\\.)*+'"""
_IRI = rf"""<(?:[^\x00-\x20<>"{{}}|^`\\]++|{_CODE})*+>"""
_BNODE = rf"_:[{_FIRST}_0-9](?:[{_CHAR}]|\.(?=[.]*[{_CHAR}]))*+"

#: What matters for the ends of statements; a long string's start stands before short strings.
_MARKS = re.compile(rf"""(?P<long>\"\"\"|''')|{_SHORT}|{_IRI}|#[^\n]*|{_BNODE}|{_NAME}|{_NUMBER}|(?P<end>\.)|\\?.""", re.S)
_CLOSED = {'"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.S)}
_STATES = ("", '"""', "'''")
_TOKEN = re.compile(
    rf"""(?P<skip>(?:\s++|#[^\n]*)++)|(?P<iri>{_IRI})|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+''')|(?P<short>{_SHORT})"""
    rf"""|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<bnode>{_BNODE})|(?P<name>{_NAME})|(?P<number>{_NUMBER})|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
#: Escapes and what they stand for (fixed values).
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_NUMBERS = ((re.compile(r"[+-]?\d+"), "integer"), (re.compile(r"[+-]?\d*\.\d+"), "decimal"))


def _ends(line: str, state: str) -> tuple[list[int], str]:
    """Where statements end in a line that starts in `state`, and the state after it."""
    ends, at = [], 0
    while True:
        if state:
            closed = _CLOSED[state].match(line, at)
            if closed is None:
                return ends, state
            at, state = closed.end(), ""
        for m in _MARKS.finditer(line, at):
            if m["long"]:
                at, state = m.end(), m["long"]
                break
            if m["end"]:
                ends.append(m.end())
        else:
            return ends, ""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines with the file and the place of their split in it."""
    m = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), "value")


def _parts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """The columns' values, of about `HELD` bytes of rows at a time."""
    for batch in batches:
        start = size = 0
        texts = [c for c in columns if pa.types.is_string(batch.schema.field(c).type) or pa.types.is_large_string(batch.schema.field(c).type)]
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in texts).tolist()
        for n, length in enumerate(lengths, 1):
            size += length + 8
            if size >= HELD or n == batch.num_rows:
                part = batch.slice(start, n - start)
                yield tuple(part.column(c).to_pylist() for c in columns)
                start, size = n, 0


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """Key, lines and whether the split is new, for each stretch of lines of one split."""
    last = None
    for files, blocks, values in _parts(batches, "file", "block", "value"):
        start = 0
        for n in range(1, len(files) + 1):
            if n == len(files) or files[n] != files[start] or blocks[n] != blocks[start]:
                key = (files[start], blocks[start])
                yield key, values[start:n], key != last
                last, start = key, n


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, ends): the state in which each split ends, for each state in which it could start."""
    key, states = None, [0, 1, 2]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([states], pa.list_(pa.int32()))], ["file", "block", "ends"])

    for new, lines, fresh in _per_block(batches):
        if fresh:
            if key is not None:
                yield row()
            key, states = new, [0, 1, 2]
        for line in lines:
            if '"""' in line or "'''" in line:
                to = {s: _STATES.index(_ends(line, _STATES[s])[1]) for s in set(states)}
                states = [to[s] for s in states]
    if key is not None:
        yield row()


def _starts(lines: DataFrame) -> dict[tuple[str, int], int]:
    """The splits that start within a long string, with its kind. One small row for each split comes to the driver, where they are composed."""
    if lines.where(F.col("value").contains('"""') | F.col("value").contains("'''")).isEmpty():
        return {}
    rows = lines.mapInArrow(_transitions, "file string, block long, ends array<int>").collect()
    out, state, file = {}, 0, None
    for r in sorted(rows):
        state = 0 if r["file"] != file else state
        file = r["file"]
        if state:
            out[file, r["block"]] = state
        state = r["ends"][state]
    return out


_CUT = "file string, block long, n long, text string, ended boolean"


def _cut(lines: DataFrame) -> DataFrame:
    """(file, block, n, text, ended): whole statements, n from 1, and each split's pieces at its start (n = 0) and end (n = -1); `ended` says whether a statement ends in the split."""
    starts = _starts(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state, n, held, size = None, "", 0, [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "n", "text", "ended"])

        def last() -> list[tuple]:
            if key is None:
                return []
            return [(*key, -1 if n else 0, "\n".join(held), n > 0)]

        for new, lines, fresh in _per_block(batches):
            if fresh:
                rows += last()
                key, state, n, held = new, _STATES[starts.get(new, 0)], 0, []
            for line in lines:
                ends, state = _ends(line, state)
                at = 0
                for end in ends:
                    rows.append((*key, n, "\n".join([*held, line[at:end]]), True))
                    held, at, n = [], end, n + 1
                held.append(line[at:])
                size += len(line)
                if len(rows) >= 5000 or (rows and size >= HELD):
                    yield batch()
                    rows, size = [], 0
        rows += last()
        if rows:
            yield batch()

    return lines.mapInArrow(run, _CUT)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text): each statement of the Turtle files with its place; what stands after a file's last dot is one, too, if it isn't blank."""
    cut = _cut(_lines(spark, path))
    whole = cut.where("n > 0").select("file", "block", "n", "text")
    pieces = cut.where("n <= 0")
    # A piece at a split's start goes on what the last split with an end, before it, has left.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.where("n = 0").withColumn("owner", F.last(F.when(F.col("ended"), F.col("block")), ignorenulls=True).over(before))
    tails = pieces.where("n = -1").withColumn("owner", F.col("block"))
    owned = heads.unionByName(tails).withColumn("owner", F.coalesce("owner", F.lit(-1).cast("long")))
    joined = owned.groupBy("file", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    # Behind all statements of its own split.
    joined = joined.select("file", F.col("owner").alias("block"), F.lit(1 << 62).alias("n"), "text")
    return whole.unionByName(joined).where(F.col("text").rlike(r"\S"))


_WHOLE_IRI = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


class _Bad(ValueError):
    pass


class _Reader:
    """Reads one statement with the prefixes and base before it."""

    def __init__(self, prefixes: dict[str, str], base: str, place: str):
        self.prefixes, self.base, self.place, self.made = prefixes, base, place, 0

    def tokens(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise _Bad(text[at : at + 20])
            at = m.end()
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0]))
        return out

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return self.whole(_ESCAPE.sub(_unescape, text[1:-1]))
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise _Bad(text)
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def whole(self, iri: str) -> str:
        return iri if re.match(_WHOLE_IRI, iri) else urljoin(self.base, iri)

    def node(self) -> str:
        self.made += 1
        return f"_:t{blake2b(self.place.encode(), digest_size=10).hexdigest()}_{self.made}"

    def directives(self, text: str) -> list[tuple[str, str]]:
        """The prefixes (`name:`) and bases (`@`) at the start of a statement, which then hold; what is left is kept for `triples`."""
        self.left, found = self.tokens(text), []
        while self.left and self.left[0][1].lower() in ("@prefix", "@base", "prefix", "base"):
            dotted, what = self.left[0][0] == "at", self.left[0][1].lower().lstrip("@")
            size = 2 + (what == "prefix") + dotted
            own = self.left[1:size]
            if len(own) < size - 1 or own[-1 - dotted][0] != "iri" or (dotted and own[-1][1] != ".") or (what == "prefix" and not (own[0][0] == "name" and own[0][1].endswith(":"))):
                raise _Bad(text)
            iri = self.iri(*own[-1 - dotted])
            found.append((own[0][1] if what == "prefix" else "@", iri))
            if what == "prefix":
                self.prefixes = self.prefixes | {own[0][1][:-1]: iri}
            else:
                self.base = iri
            self.left = self.left[size:]
        return found

    def triples(self, text: str) -> list[tuple]:
        self.directives(text)
        self.at, self.out = 0, []
        if not self.left:
            return []
        if self.peek()[1] == "[":
            subject = self.object()
            if self.peek()[1] != ".":
                self.pairs(subject)
        else:
            subject = self.object()
            if subject[1] == "literal":
                raise _Bad(text)
            self.pairs(subject)
        if self.peek()[1] != "." or self.at + 1 != len(self.left):
            raise _Bad(text)
        return self.out

    def peek(self) -> tuple[str, str]:
        return self.left[self.at] if self.at < len(self.left) else ("", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.left[self.at - 1] if self.at <= len(self.left) else ("", "")

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s[0], s[1], p, *o))

    def pairs(self, subject: tuple) -> None:
        """Predicates with their objects."""
        while True:
            kind, text = self.next()
            if (kind, text) == ("word", "a"):
                p = S.TYPE
            elif kind in ("iri", "name"):
                p = self.iri(kind, text)
            else:
                raise _Bad(text)
            self.add(subject, p, self.object())
            while self.peek()[1] == "," and self.next():
                self.add(subject, p, self.object())
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]"):
                return

    def object(self) -> tuple:
        """One term; what stands in brackets is read with it. Lists are walked in a loop, nodes within nodes go one call deeper."""
        kind, text = self.next()
        entity = lambda x: (x, "bnode" if x.startswith("_:") else "iri", "", "")
        if kind in ("iri", "name"):
            return entity(self.iri(kind, text))
        if kind == "bnode":
            return entity(text)
        if text == "[":
            own = entity(self.node())
            if self.peek()[1] != "]":
                self.pairs(own)
            if self.next()[1] != "]":
                raise _Bad(text)
            return own
        if text == "(":
            head = last = None
            while self.peek()[1] != ")":
                if not self.peek()[0]:
                    raise _Bad(text)
                own = entity(self.node())
                if last is None:
                    head = own
                else:
                    self.add(last, S.RDF + "rest", own)
                self.add(own, S.RDF + "first", self.object())
                last = own
            self.next()
            if last is None:
                return entity(S.RDF + "nil")
            self.add(last, S.RDF + "rest", entity(S.RDF + "nil"))
            return head
        if kind == "number":
            return text, "literal", S.XSD + next((k for form, k in _NUMBERS if form.fullmatch(text)), "double"), ""
        if kind == "word" and text in ("true", "false"):
            return text, "literal", S.XSD + "boolean", ""
        if kind in ("short", "long"):
            n = 3 if kind == "long" else 1
            value = _ESCAPE.sub(_unescape, text[n:-n])
            if self.peek()[0] == "at":
                return value, "literal", S.RDF + "langString", self.next()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.next()
                kind, text = self.next()
                if kind not in ("iri", "name"):
                    raise _Bad(text)
                return value, "literal", self.iri(kind, text), ""
            return value, "literal", S.XSD + "string", ""
        raise _Bad(text)


def _unescape(m: re.Match) -> str:
    if m[3]:
        if m[3] not in _ESCAPES:
            raise _Bad(m[0])
        return _ESCAPES[m[3]]
    code = int(m[1] or m[2], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        raise _Bad(m[0])
    return chr(code)


_PARSED = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, bad string, file string"


def _directives(rows: DataFrame) -> DataFrame:
    """(file, block, n, name, iri): prefixes and bases, relative ones as they stand; a statement that is no directive gives none."""
    starts = rows.where(F.lower("text").rlike(r"^(?:\s|#[^\n]*\n)*(?:@?prefix|@?base)\b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "file", "block", "n", "text"):
            out = []
            for file, block, n, text in zip(*part):
                reader = _Reader({}, "", "")
                reader.whole = lambda iri: iri
                try:
                    out += [(file, block, n, k, name, iri) for k, (name, iri) in enumerate(reader.directives(text))]
                except _Bad:
                    continue
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "block", "n", "k", "name", "iri"])

    return _changes(starts.mapInArrow(run, "file string, block long, n long, k long, name string, iri string"))


def _changes(found: DataFrame) -> DataFrame:
    """Directives without those that say again what holds: the same name with the same whole IRI as the one before. First within each split, so that few are left for a whole file."""
    for keys in (["file", "block", "name"], ["file", "name"]):
        before = F.lag("iri").over(Window.partitionBy(*keys).orderBy("block", "n", "k"))
        again = F.col("iri").rlike(_WHOLE_IRI) & (F.col("iri") == F.col("before"))
        found = found.withColumn("before", before).where(~F.coalesce(again, F.lit(False))).drop("before")
    return found


def _environment(directives: list[tuple], base: str) -> list[tuple[tuple[int, int], dict[str, str], str]]:
    """Prefixes and base from each place on, for one file's directives in order."""
    prefixes: dict[str, str] = {}
    out = [((-2, 0), prefixes, base)]
    reader = _Reader({}, base, "")
    for block, n, _, name, iri in sorted(directives):
        iri = reader.whole(iri)
        if name == "@":
            reader.base = iri
        else:
            prefixes = prefixes | {name[:-1]: iri}
        out.append(((block, n), prefixes, reader.base))
    return out


def _parsed(rows: DataFrame, base: str | None) -> DataFrame:
    """Triples, and with `bad` the statements that aren't understood."""
    found = _directives(rows)
    many = found.limit(SENT + 1).collect()
    if len(many) > SENT:  # each statement brings its file's
        rows = rows.join(found.groupBy("file").agg(F.collect_list(F.struct("block", "n", "k", "name", "iri")).alias("own")), "file", "left")
        sent = None
    else:
        by_file: dict[str, list[tuple]] = {}
        for r in many:
            by_file.setdefault(r["file"], []).append(tuple(r)[1:])
        rows, sent = rows.withColumn("own", F.lit(None).cast("array<int>")), rows.sparkSession.sparkContext.broadcast(by_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for part in _parts(batches, "file", "block", "n", "text", "own"):
            out: list[tuple] = []
            for file, block, n, text, own in zip(*part):
                if file not in known:
                    known = {file: _environment([tuple(x.values()) for x in own or []] if sent is None else sent.value.get(file, []), base or file)}
                at = known[file]
                low, high = 0, len(at)  # the last directive before the statement
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if at[mid][0] < (block, n) else (low, mid)
                reader = _Reader(at[low][1], at[low][2], f"{file} {block} {n}")
                try:
                    out += [(*x, None, file) for x in reader.triples(text)]
                except (_Bad, RecursionError):
                    out.append((None,) * 7 + (text, file))
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], [*S.COLUMNS, "bad", "file"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], [*S.COLUMNS, "bad", "file"])

    return rows.mapInArrow(run, _PARSED)


def read_turtle(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """The triples of Turtle files, each once; large files are read by many tasks.

    Blank nodes keep their labels, which hold over all files that are read together, as parts of one
    graph do; unlabelled ones are named by their place. Relative IRIs are resolved by the file's
    own base, else `base`, else the file's place. Statements that aren't understood are left out and
    are the rows of `bad_turtle`.
    """
    return _parsed(statements(spark, path), base).where("bad is null").select(*S.COLUMNS).distinct()


def bad_turtle(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(file, text): statements that aren't understood."""
    return _parsed(statements(spark, path), base).where("bad is not null").select("file", F.col("bad").alias("text"))


#: Characters that IRIs can't hold as they are.
BAD_IRI = re.compile(r"""[\x00-\x20<>"{}|^`\\]""")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")


def turtle_lines(t: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): lines of Turtle; each partition starts with the prefixes and can be a file of its own.

    Rows are sorted within their partition, not dealt anew: a subject's rows that stand together are one
    statement over several lines, however many they are.
    """
    ordered = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def iri(x: str) -> str:
        for name, start in ordered:
            if x.startswith(start) and _PLAIN.fullmatch(x[len(start) :]):
                return f"{name}:{x[len(start) :]}"
        return "<" + BAD_IRI.sub(lambda m: f"\\u{ord(m[0]):04X}", x) + ">"

    def text(x: str) -> str:
        for character, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            x = x.replace(character, code)
        return f'"{x}"'

    def term(o: str, kind: str, dt: str, lang: str) -> str:
        if kind != "literal":
            return o if kind == "bnode" else iri(o)
        return text(o) + (f"@{lang}" if lang else "" if dt in ("", S.XSD + "string") else f"^^{iri(dt)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [f"@prefix {name}: <{BAD_IRI.sub(lambda m: f'{chr(92)}u{ord(m[0]):04X}', start)}> ." for name, start in sorted((prefixes or {}).items())]
        s = p = None
        for part in _parts(batches, *S.COLUMNS):
            for s2, s_kind, p2, o, kind, dt, lang in zip(*part):
                o = term(o, kind, dt, lang)
                predicate = "a" if p2 == S.TYPE else iri(p2)
                if s2 != s:
                    if s is not None:
                        lines[-1] += " ."
                    lines.append(f"{term(s2, s_kind, '', '')} {predicate} {o}")
                elif p2 != p:
                    lines[-1] += " ;"
                    lines.append(f"    {predicate} {o}")
                else:
                    lines[-1] += " ,"
                    lines.append(f"        {o}")
                s, p = s2, p2
            yield pa.RecordBatch.from_arrays([pa.array(lines[:-1], pa.string())], ["value"])
            lines = lines[-1:]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([lines[0] + " ." if s is not None else lines[0]] + lines[1:], pa.string())], ["value"])

    return t.where("s_kind <> 'literal'").select(*S.COLUMNS).sortWithinPartitions("s", "p").mapInArrow(run, "value string")


def write_turtle(t: DataFrame, path: str, prefixes: dict[str, str] | None = None, mode: str = "error") -> None:
    """Writes the graph as Turtle files, in parallel and without a shuffle."""
    turtle_lines(t, prefixes).write.mode(mode).text(path)
