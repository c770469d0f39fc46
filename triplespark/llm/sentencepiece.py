"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut wherever no piece joins two neighbouring characters, so no piece and no merge
crosses a cut, whatever the model. For each distinct unit its substrings of up to the longest
piece's length are exploded and joined with the piece table; what is found are the lattice's
edges, grouped by unit again and folded with `aggregate`: for unigram models into the
best-scoring path (Viterbi), for BPE models by the merges in the order of their scores, which
is what those models mean. Characters without a piece become pieces for their bytes.

The most frequent units, at most `HEAD`, are broadcast with their ids. Each text travels as the
numbers of its units, dealt once into buckets, in which its rarer units come to it by joins.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SMALL_BATCHES, bucketed, dropped, written

SPACE = "\u2581"
#: The most units that are broadcast.
HEAD = 500_000
#: Units of a partition while their edges are grouped, and the most partitions.
UNITS_EACH = 20_000
MOST_PARTS = 100_000
#: Units in the texts of a bucket, and the most buckets.
UNITS_A_BUCKET = 4_000_000
MOST_BUCKETS = 50_000
#: Characters of the longest unit whose lattice is folded.
LONG = 250
#: Score of a character without a piece, below the model's least score.
PENALTY = 10.0
#: Bytes of texts and units that a task takes at a time, and counts of units that it holds.
CHARS_EACH = 6_000_000
UNITS_AT_ONCE = 300_000
HELD = 400_000


@dataclass
class Model:
    """Pieces and scores by id, the ids of byte pieces, ids that stand for no text, and the kind."""

    pieces: list[str]
    scores: list[float]
    bytes: dict[int, int]
    hidden: set[int]
    unknown: int
    bpe: bool
    prefix: bool = True


def read_model(path: str) -> Model:
    """The tables of the model file at `path` on the driver; its own encoder is not used."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kinds = proto.SentencePiece
    of = lambda *types: [i for i, x in enumerate(proto.pieces) if x.type in types]
    return Model(
        [x.piece for x in proto.pieces], [x.score for x in proto.pieces], {int(proto.pieces[i].piece[1:-1], 16): i for i in of(kinds.BYTE)},
        set(of(kinds.CONTROL, kinds.UNKNOWN)), of(kinds.UNKNOWN)[0], proto.trainer_spec.model_type == proto.trainer_spec.BPE, proto.normalizer_spec.add_dummy_prefix,
    )


class Cutter:
    """Cuts texts into units: neighbours stay together if some piece holds both."""

    def __init__(self, model: Model):
        pieces = [p for p, _, _ in _usable(model)]
        joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        letters = sorted({c for x in joined for c in x})
        self._place = np.zeros(0x110000, np.int32)
        self._place[[ord(c) for c in letters]] = np.arange(len(letters)) + 1
        self._together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x in joined:
            self._together[tuple(self._place[[ord(c) for c in x]])] = True
        self.prefix = model.prefix
        #: Whether every run of spaces begins a unit, so that the words of a text can be cut on their own.
        self.by_word = not any(x[1] == SPACE != x[0] for x in joined)
        self._runs = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _cut(self, parts: pa.Array, space: bool) -> tuple[pa.Array, np.ndarray]:
        """The units of all parts, and how many each has; `space` says that a space stands before each."""
        glue = SPACE if space else ""
        data = (glue + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), glue)[0].as_py()).encode()
        sizes = pc.utf8_length(parts).to_numpy() + len(glue)
        begins = np.cumsum(sizes, dtype=np.int64) - sizes
        known = self._place[np.frombuffer(data.decode().encode("utf-32-le"), "<u4")]
        cuts = np.ones(len(known), bool)
        cuts[1:] = ~self._together[known[:-1], known[1:]]
        cuts[begins] = True
        raw = np.frombuffer(data, np.uint8)
        offsets = np.append(np.flatnonzero((raw & 0xC0) != 0x80)[cuts], len(raw)).astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), np.add.reduceat(cuts, begins, dtype=np.int64)

    def units(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """For some of the non-empty texts at a time: their places and how many words each has, and of all words in order their numbers; then the units of all numbered words, and how many each has."""
        filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        plain = pa.array(np.zeros(len(texts), bool))
        if self.by_word and self.prefix:
            odd = [pc.match_substring(texts, x) for x in ("  ", SPACE)] + [pc.starts_with(texts, " "), pc.ends_with(texts, " ")]
            plain = pc.and_(filled, pc.fill_null(pc.invert(reduce(pc.or_, odd)), False))
        rest = pc.and_(filled, pc.invert(plain))
        for mask, space in ((plain, True), (rest, False)):
            at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            own = texts.take(pa.array(at))
            if space:
                lists = pc.split_pattern(own, " ")
                words, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
            else:
                whole = [(SPACE if self.prefix else "") + x.replace(" ", SPACE) for x in own.to_pylist()]
                parts = [self._runs.findall(x) if self.by_word else [x] for x in whole]
                words, n = pa.array([x for p in parts for x in p], pa.string()), np.array([len(p) for p in parts], np.int64)
            numbered = words.dictionary_encode()
            yield at, n, numbered.indices.to_numpy(), *self._cut(numbered.dictionary, space)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of texts with about `CHARS_EACH` bytes each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // CHARS_EACH
    edges = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in zip(edges, edges[1:]):
        yield texts.slice(a, b - a)


AT = 10  # bits of a place within a unit
BITS = 20  # bits of an id, and of a rank
_ends = lambda key: key.bitwiseAND(F.lit((1 << AT) - 1))
_key = lambda start, end: (start * (1 << AT) + end).cast("int")


def _ranks(model: Model) -> tuple[dict[int, int], list[float]]:
    """The rank of each id's score, best first and equal ones alike, and the score of each rank."""
    scores = sorted({s for _, _, s in _usable(model)}, reverse=True)
    number = {s: i for i, s in enumerate(scores)}
    return {i: number[s] for _, i, s in _usable(model)}, scores


def _edges(units: DataFrame, model: Model) -> DataFrame:
    """The columns of `units` with n (its characters), the edges e (place and value as one number) and the map m from places to values.

    A place is start and end, a value the rank of the piece's score and its id.
    """
    spark = units.sparkSession
    usable = _usable(model)
    if len(model.pieces) >= 1 << BITS:
        raise ValueError(f"a model of {1 << BITS} pieces or more")
    longest = max((len(p) for p, _, _ in usable), default=1)
    ranks, _ = _ranks(model)
    # The empty string finds an edge of its own in each unit, so that units without a piece stay.
    table = F.broadcast(spark.createDataFrame([("", 0), *((p, ranks[i] << BITS | i) for p, i, _ in usable)], "piece string, v long"))
    n = F.length("unit")
    own = units.columns
    starts = units.select(*own, F.explode(F.sequence(F.lit(0), n - 1)).alias("_s")).withColumn("_x", F.expr(f"substring(unit, _s + 1, {longest})"))
    first = F.when(F.col("_s") == 0, F.lit(0)).otherwise(F.lit(1))
    spans = starts.select(*own, "_s", "_x", F.explode(F.sequence(first, F.length("_x"))).alias("_k"))
    # Never null, which is said so that it isn't asked of each span.
    found = spans.withColumn("piece", F.coalesce(F.expr("left(_x, _k)"), F.lit(""))).join(table, "piece")
    place = F.when(F.col("_k") > 0, _key(F.col("_s"), F.col("_s") + F.col("_k"))).otherwise(F.lit(0)).cast("long")
    edges = found.groupBy(*own).agg(F.collect_list(F.shiftleft(place, 2 * BITS).bitwiseOR(F.col("v"))).alias("e"))
    values = F.transform("e", lambda x: x.bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
    return edges.select(*own, n.alias("n"), "e", F.map_from_arrays(F.transform("e", lambda x: F.shiftright(x, 2 * BITS).cast("int")), values).alias("m"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def _merged() -> Column:
    """The places of a BPE model's pieces: the neighbours with the best joint piece merge, the leftmost of equals.

    The symbols are numbers in order: the rank of the joint piece with the next one (above all
    ranks if there is none), start, end and the next one's end, so the least is the next merge.
    """
    none = 1 << BITS

    def symbol(start: Column, end: Column, after: Column) -> Column:
        rank = F.coalesce(F.shiftright(F.col("m")[_key(start, after)], BITS), F.lit(none)).cast("long")
        return F.shiftleft(rank, 3 * AT).bitwiseOR((start * (1 << 2 * AT) + end * (1 << AT) + after).cast("long"))

    start, end, after = (lambda x: _ends(F.shiftright(x, 2 * AT)), lambda x: _ends(F.shiftright(x, AT)), _ends)

    def merge(row: Column, best: Column) -> Column:
        def at(j: Column) -> Column:  # j counts from 1
            before = F.get(row, j - 2)
            fresh = symbol(start(best), after(best), after(F.get(row, j)))
            changed = F.when(j > 1, F.array(symbol(start(before), start(best), after(best)), fresh)).otherwise(F.array(fresh))
            return F.concat(F.slice(row, F.lit(1), F.greatest(j - 2, F.lit(0))), changed, F.slice(row, j + 2, F.greatest(F.size(row) - j - 1, F.lit(0))))

        return F.when(best >= F.lit(none << 3 * AT), row).otherwise(_bound(F.array_position(row, best).cast("int"), at))

    single = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: symbol(s, s + 1, s + 2))
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>"))
    row = F.aggregate(steps, single, lambda row, _: _bound(F.array_min(row), lambda best: merge(row, best)))
    return F.transform(row, lambda x: F.shiftright(x, AT).bitwiseAND(F.lit((1 << 2 * AT) - 1)).cast("int"))


def _best_path(scores: list[float]) -> tuple[Column, Column]:
    """Best score and last start for each end, and from those (as b) the places of the best path's pieces; of equals the one whose last piece begins last."""
    least = min(scores, default=0.0) - PENALTY
    table = F.split(F.lit(" ".join(map(repr, scores))), " ").cast("array<double>")
    place = lambda x: F.shiftright(x, 2 * BITS).cast("int")
    score = lambda x: F.get(table, F.shiftright(x, BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    start = lambda x: F.shiftright(place(x), AT)

    def step(best: Column, end: Column) -> Column:
        here = F.filter("e", lambda x: _ends(place(x)) == end)
        ways = F.transform(here, lambda x: F.struct((F.get(best, start(x))["score"] + score(x)).alias("score"), start(x).alias("start")))
        bare = F.struct((F.get(best, end - 1)["score"] + F.lit(least)).alias("score"), (end - 1).alias("start"))
        single = F.exists(here, lambda x: start(x) == end - 1)
        return F.concat(best, F.array(F.array_max(F.when(single, ways).otherwise(F.concat(ways, F.array(bare))))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start")))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), first, step)
    back = lambda cuts, _: F.when(cuts[0] > 0, F.concat(F.array(F.get(F.col("b"), cuts[0])["start"]), cuts)).otherwise(cuts)
    path = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.col("n")), back, lambda cuts: F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda c, j: _key(c, cuts[j + 1])))
    return best, path


def _long_ids(unit: str, model: Model, known: dict[str, int], longest: int) -> list[int]:
    """The ids of a unit of any length: the same merges from a heap, or the same best path position by position."""
    n = len(unit)
    if model.bpe:
        after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (i := known.get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-model.scores[i], a, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = after[a] if end[a] else n
            if end[a] and b < n and end[b] == stop:  # both halves are still what they were
                end[a], end[b], after[a] = stop, 0, after[b]
                if after[a] < n:
                    before[after[a]] = a
                offer(a)
                if before[a] >= 0:
                    offer(before[a])
        spans = [(a, end[a]) for a in range(n) if end[a]]
    else:
        least = min(model.scores, default=0.0) - PENALTY
        best: list[tuple[float, int]] = [(0.0, -1)]
        for stop in range(1, n + 1):
            ways = [(best[a][0] + model.scores[known[unit[a:stop]]], a) for a in range(max(0, stop - longest), stop) if unit[a:stop] in known]
            if unit[stop - 1] not in known:
                ways.append((best[stop - 1][0] + least, stop - 1))
            best.append(max(ways))
        spans, stop = [], n
        while stop:
            spans.append((best[stop][1], stop))
            stop = best[stop][1]
        spans.sort()
    out: list[int] = []
    for a, b in spans:
        i = known.get(unit[a:b])
        out.extend([i] if i is not None else [model.bytes[x] for x in unit[a:b].encode()] if model.bytes else [model.unknown])
    return out


def _usable(model: Model) -> list[tuple[str, int, float]]:
    """Pieces that stand for text as it is."""
    skipped = model.hidden | set(model.bytes.values())
    return [(p, i, float(s)) for i, (p, s) in enumerate(zip(model.pieces, model.scores)) if i not in skipped]


def segment(units: DataFrame, model: Model, longest: int | None = None) -> DataFrame:
    """`units` with the ids of each distinct non-empty `unit`; other columns stay. `longest` is the length of the longest one, if that is known.

    The fold's work grows with the square of a unit's length, so units of over `LONG` characters
    (runs in which every two neighbours stand together in a piece) are cut one by one in tasks,
    with the same result.
    """
    shared = units.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        known = {p: i for p, i, _ in _usable(own)}
        longest = max(map(len, known), default=1)
        for batch in batches:
            yield batch.assign(ids=[_long_ids(u, own, known, longest) for u in batch["unit"]])

    if longest is not None and longest <= LONG:
        return _folded(units, model)
    short, long = units.where(F.length("unit") <= LONG), units.where(F.length("unit") > LONG)
    schema = T.StructType([*units.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _folded(short, model).unionByName(long.mapInPandas(cut, schema))


def _folded(units: DataFrame, model: Model) -> DataFrame:
    lattice = _edges(units, model)
    if model.bpe:
        lattice = lattice.withColumn("places", _merged())
    else:
        best, path = _best_path(_ranks(model)[1])
        lattice = lattice.withColumn("b", best).withColumn("places", path)
    codes = F.array(*[F.lit(model.bytes.get(b, model.unknown)) for b in range(256)]) if model.bytes else None

    def bare(start: Column, size: Column) -> Column:
        """A character without a piece: its bytes, or the unknown piece."""
        if codes is None:
            return F.array(F.lit(model.unknown))
        digits = F.hex(F.encode(F.substring(F.col("unit"), start + 1, size), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.get(codes, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int")))

    def ids(place: Column) -> Column:
        start = F.shiftright(place, AT)
        return _bound(F.col("m")[place], lambda v: F.when(v.isNotNull(), F.array(v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))).otherwise(bare(start, _ends(place) - start)))

    return lattice.select(*units.columns, F.flatten(F.transform("places", ids)).alias("ids"))


def _unit_counts(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """(unit, c) for each unit of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("unit").aggregate([("c", "sum")]).rename_columns(["unit", "c"]).combine_chunks()

        for batch in batches:
            for texts in _slices(batch.column(0)):
                for _, _, numbers, units, n in cutter.units(texts):
                    times = np.bincount(numbers, minlength=len(n))
                    held.append(pa.table({"unit": units, "c": np.repeat(times, n)}))
                if sum(map(len, held)) > HELD:
                    held[:] = [summed()]
                    pa.default_memory_pool().release_unused()
                    if len(held[0]) > HELD * 3 // 4:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return docs.select(text).mapInArrow(run, "unit string, c long").groupBy("unit").agg(F.sum("c").alias("c"))


def _frequent(lexicon: DataFrame, most: int) -> int:
    """The least count such that at most `most` units have it."""
    step = F.floor(F.log2("c") * 16)
    rows = lexicon.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in rows:  # a row for each sixteenth of an octave
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return least


class Coder:
    """Texts as numbers of units: those of the head, and above them the text's own rarer units in their order."""

    def __init__(self, model: Model, head: list[str]):
        self.cutter, self.head = Cutter(model), pa.array(head, pa.string())

    def coded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str]] | None]:
        """The numbers of each text and its rarer units; None for a null text."""
        for own in _slices(texts):
            nulls = own.is_null().to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, list[str]] | None] = [None if x else (np.empty(0, np.int64), []) for x in nulls]
            for at, words, numbers, units, n in self.cutter.units(own):
                codes = pc.fill_null(pc.index_in(units, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                missing = np.flatnonzero(codes < 0)
                rare = units.take(pa.array(missing)).dictionary_encode()
                names = rare.dictionary.to_pylist()
                codes[missing] = -1 - rare.indices.to_numpy().astype(np.int64)
                begins = np.cumsum(n) - n
                flat = _spans(codes, begins[numbers], n[numbers])
                ends = np.concatenate([[0], np.cumsum(n[numbers])])[np.concatenate([[0], np.cumsum(words)])]
                for i, a, b in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    out[i] = self._own(flat[a:b], names)
            yield from out

    def _own(self, codes: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
        at = np.flatnonzero(codes < 0)
        if not len(at):
            return codes, []
        rare, first, back = np.unique(codes[at], return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes[at] = len(self.head) + place[back]
        return codes, [names[-1 - k] for k in rare[order]]


def _spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each span, one after the other."""
    shift = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return values[shift + np.arange(len(shift))]


def _packed(codes: np.ndarray) -> bytes:
    """Numbers below 2**28, seven bits to a byte and one for whether more follow, compressed."""
    codes = codes.astype(np.uint32)
    parts = np.stack([codes >> np.uint32(7 * k) & np.uint32(127) for k in range(4)], 1).astype(np.uint8)
    more = np.stack([codes >= 1 << 7 * k for k in range(1, 4)], 1)
    parts[:, :3] |= more.astype(np.uint8) << 7
    data = parts[np.concatenate([np.ones((len(codes), 1), bool), more], 1)].tobytes()
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True), np.uint8)
    ends = np.flatnonzero(raw < 128)
    size = np.diff(ends, prepend=-1)
    out = raw[ends].astype(np.int64)
    for k in range(1, 4):
        own = size > k
        out[own] = out[own] << 7 | raw[ends[own] - k] & 127
    return out


def encode(docs: DataFrame, model: Model, text: str = "text", ids: str = "ids", keep_text: bool = True, head: int = HEAD, decoded: str | None = None) -> DataFrame:
    """`docs` with the ids of each whole text as an array of int; null for a null text, empty for an empty one.

    Rows are known by hashes of what they hold, so keys are not needed, and repeated rows and
    null keys do no harm. A column of `docs` named like `ids` is replaced; the text itself is
    passed on only if `keep_text`. At most `head` units are broadcast. With `decoded` the text
    that the ids stand for is added under that name, as by `decode`.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in (ids, decoded, "_t", "_v", "_c", "_r", "_u") if c and c != text])
    passed = [c for c in docs.columns if keep_text or c != text]
    counted = written(_unit_counts(docs, model, text), "units", SMALL_BATCHES)
    distinct, total, longest = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max(F.length("unit")), F.lit(0))).first()
    # Small partitions, so that the edges of each are grouped in memory.
    parts = max(1, min(MOST_PARTS, distinct // UNITS_EACH))
    lexicon = segment(counted.repartition(parts, "unit"), model, longest)
    lexicon = written(lexicon, "lexicon", {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(10 * UNITS_EACH)})
    dropped(counted)
    often = F.col("c") >= _frequent(lexicon, head)
    # The commonest first, so that their numbers are small.
    known = lexicon.where(often).select("unit", "ids", "c").toArrow().sort_by([("c", "descending")])
    lists = known.column("ids").combine_chunks()
    table = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64))
    units = spark.sparkContext.broadcast((model, known.column("unit").combine_chunks()))
    values = spark.sparkContext.broadcast(table)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*units.value)
        for batch in batches:
            codes, rare = [], []
            for row in coder.coded(batch.column(text)):
                codes.append(None if row is None else _packed(row[0]))
                rare.append(" ".join(row[1]) if row and row[1] else None)  # no unit holds a space
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*passed, "_t", "_v")], pa.array(codes, pa.binary()), pa.array(rare, pa.string())], [*passed, "_t", "_v", "_c", "_r"])

    # Rows are known by two hashes of all they hold; rows that are equal throughout share their lists.
    plain = [F.col(c) for c in docs.columns if c == text or not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    keyed = docs.withColumns({"_t": F.xxhash64(*plain), "_v": F.xxhash64(F.lit(1), *plain)})
    fields = [docs.schema[c] for c in passed]
    kinds = {"_t": T.LongType(), "_v": T.LongType(), "_c": T.BinaryType(), "_r": T.StringType()}
    packed = keyed.select(*dict.fromkeys([*passed, text, "_t", "_v"])).mapInArrow(coded, T.StructType([*fields, *[T.StructField(c, k) for c, k in kinds.items()]]))
    # Texts are dealt once, into buckets in which their rarer units find them.
    buckets = max(1, min(MOST_BUCKETS, total // UNITS_A_BUCKET))
    packed = bucketed(packed, "texts", buckets, ["_t", "_v"], SMALL_BATCHES)
    tail = packed.select("_t", "_v", F.posexplode(F.split("_r", " ")).alias("j", "unit"))
    tail = tail.join(lexicon.where(~often).select("unit", "ids"), "unit").select("_t", "_v", "j", "ids")
    # Dealt before they are gathered: a partial list for each row would be several times as large.
    tail = tail.repartition(buckets, "_t", "_v").groupBy("_t", "_v").agg(F.collect_set(F.struct("j", "ids")).alias("_u"))
    out = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    texts = spark.sparkContext.broadcast(Texts(model)) if decoded else None
    kind = to_arrow_type(T.ArrayType(T.IntegerType()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, codes, total = 0, [], 0
            for i, c in enumerate(batch.column("_c")):
                c = c.as_py()
                codes.append(None if c is None else _unpacked(c))
                total += 0 if c is None else len(codes[-1])
                if total >= UNITS_AT_ONCE or i + 1 == batch.num_rows:
                    part = batch.slice(done, len(codes))
                    lists = _lists(codes, part.column("_u"), *values.value, kind)
                    more = [pa.array(texts.value.read(lists), pa.string())] if texts else []
                    yield pa.RecordBatch.from_arrays([*[part.column(p) for p in passed], lists, *more], out.fieldNames())
                    done, codes, total = i + 1, [], 0

    joined = packed.join(tail, ["_t", "_v"], "left").select(*passed, "_c", "_u")
    return joined.mapInArrow(whole, out)


def _lists(codes: list[np.ndarray | None], rare: pa.Array, flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The ids of several texts, from their numbers and from lists of their rarer units' places and ids; `flat` and `offsets` hold those of the head."""
    size = len(offsets) - 1
    n = np.array([0 if c is None else len(c) for c in codes], np.int64)
    at = np.concatenate([np.empty(0, np.int64), *[c for c in codes if c is not None]])
    own = np.flatnonzero(at >= size)
    lengths = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    units = rare.flatten()
    more, places = units.field("ids"), units.field("j").to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(more).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((places, np.repeat(np.arange(len(lengths)), lengths)))
    begins = np.concatenate([offsets, offsets[-1] + np.cumsum(sizes)])  # of the head's lists, then of the others
    # A rarer unit's number, less the head's size, is its place in its text's list.
    text = np.repeat(np.arange(len(n)), n)[own]
    at[own] = size + order[at[own] - size + (np.cumsum(lengths) - lengths)[text]]
    found = _spans(np.concatenate([flat, more.flatten().to_numpy(zero_copy_only=False)]), begins[at], begins[at + 1] - begins[at])
    ends = np.append(0, np.cumsum(begins[at + 1] - begins[at]))[np.append(0, np.cumsum(n))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()), type=kind, mask=pa.array([c is None for c in codes], pa.bool_()))


class Texts:
    """The bytes that each id stands for, and nothing for ids outside the model."""

    def __init__(self, model: Model):
        raw = [b"" if i in model.hidden else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        for byte, i in model.bytes.items():
            raw[i] = bytes([byte])
        raw.append(b"")
        self.data, self.offsets, self.prefix = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), model.prefix

    def read(self, lists: pa.Array) -> list[str | None]:
        """The text of each list of ids."""
        out: list[str | None] = []
        outside = len(self.offsets) - 2
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.flatnonzero(np.diff(np.cumsum(sizes) // UNITS_AT_ONCE, prepend=-1)).tolist()
        for a, b in zip(parts, [*parts[1:], len(lists)]):
            part = lists.slice(a, b - a)
            i = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.where((i >= 0) & (i < outside), i, outside)
            n = self.offsets[i + 1] - self.offsets[i]
            found = _spans(self.data, self.offsets[i], n).tobytes()
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes[a:b]))].tolist()
            for missing, x, y in zip(part.is_null().to_pylist(), ends, ends[1:]):
                if self.prefix and found[x : x + 1] == b" ":
                    x += 1
                out.append(None if missing else found[x:y].decode("utf-8", "replace"))
        return out


def decode(docs: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text that each array of ids stands for; null for a null array, empty for an empty one.

    Control pieces and ids outside the model stand for nothing, as do nulls; bytes that are not
    UTF-8 become replacement characters. A column named like `text` is replaced.
    """
    passed = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(Texts(model))
    schema = T.StructType([*[docs.schema[c] for c in passed], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(shared.value.read(batch.column(ids)), pa.string())], schema.fieldNames())

    return docs.select(*dict.fromkeys([*passed, ids])).mapInArrow(run, schema)
