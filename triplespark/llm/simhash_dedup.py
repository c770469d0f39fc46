"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments, and its point is the number of ones in each. A bit
that differs moves the point by one at most, so the Manhattan distance of two points is no more
than the number of differing bits. The range join for distances of up to 3 runs over the grid of
all points: points lie at an even distance if the sums of their coordinates have the same parity.

* At distance 0 or 2 both points have a common neighbour, a grid point one step from each.
* At distance 1 or 3 a grid point is one step from one of them and two from the other.

So each fingerprint is a *near* row of the grid points one step away, and those of an odd sum are
*far* rows of the grid points two steps away too; pairs with a near row in one grid point are all
pairs within reach, and they are verified by their differing bits. Steps that leave the grid are
not needed, because some meeting point always lies between the two.

Equal fingerprints are one row from the start. Grid points are sorted and streamed; each gives the
links that join its rows (a spanning forest), never all pairs. A grid point with more rows than
`ROWS` is not held: its rows are dealt again by the bits of three of six blocks, since two
fingerprints with up to three differing bits agree in three blocks, which leaves 33 bits or fewer
open and so bounds what shares a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, map_batches, written
from .jaccard_join import connected_components

WIDTH = 3
SEED = 42
#: Differing bits of linked fingerprints.
DISTANCE = 3
#: Segments of 4 bits, so that a coordinate is 0 to 4.
SEGMENTS = 16
SIDE = 5
#: Rows of a grid point that a task holds.
ROWS = 20_000
_POWERS = np.array([SIDE**i for i in range(SEGMENTS)], np.int64)
#: Six blocks of bits, and the masks of any three of them.
_ENDS = (0, 11, 22, 33, 44, 54, 64)
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_ENDS, _ENDS[1:])]
_MASKS = np.array([x | y | z for x, y, z in combinations(_BLOCKS, 3)], np.uint64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number; zero where there are no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def points(prints: np.ndarray) -> np.ndarray:
    """The number of ones in each segment of each fingerprint, (n, SEGMENTS)."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_count((prints[:, None] >> shifts) & np.uint64(15)).astype(np.int64)


def grid_rows(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(grid point, fingerprint, near) for the grid points in which each fingerprint takes part, as arrays."""
    at = points(prints)
    own = at @ _POWERS
    odd = at.sum(1) % 2 == 1
    steps = [(i, d, (at[:, i] + d >= 0) & (at[:, i] + d < SIDE)) for i in range(SEGMENTS) for d in (-1, 1)]
    for i, d, fits in steps:
        yield own[fits] + d * _POWERS[i], prints[fits], True
    twice = [(i, 2 * d, odd & (at[:, i] + 2 * d >= 0) & (at[:, i] + 2 * d < SIDE)) for i in range(SEGMENTS) for d in (-1, 1)]
    for i, d, fits in twice:
        yield own[fits] + d * _POWERS[i], prints[fits], False
    for (i, d, one), (j, e, other) in combinations(steps, 2):
        if i != j:
            fits = odd & one & other
            yield own[fits] + d * _POWERS[i] + e * _POWERS[j], prints[fits], False


def forest(prints: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links join: pairs of rows, at least one of them near, within DISTANCE."""
    left = np.arange(len(prints))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            i = queue.pop()
            hit = np.bitwise_count(prints[left] ^ prints[i]) <= DISTANCE
            if not near[i]:
                hit &= near[left]
            if hit.any():
                new = left[hit]
                left = left[~hit]
                queue.extend(new)
                a.append(np.full(len(new), prints[i], np.uint64))
                b.append(prints[new])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


_CELLS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("print", T.LongType()), T.StructField("near", T.BooleanType())])
_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("near", T.BooleanType())])


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)


def _cells(prints: DataFrame) -> DataFrame:
    """(cell, print, near) of each fingerprint (print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 2000):
                parts = list(grid_rows(values[at : at + 2000]))
                near = np.concatenate([np.full(len(c), n) for c, _, n in parts])
                yield _batch(_CELLS.names, np.concatenate([c for c, _, _ in parts]), np.concatenate([p for _, p, _ in parts]).view(np.int64), near)

    return prints.select("print").mapInArrow(run, _CELLS)


def _split(rows: DataFrame) -> DataFrame:
    """The rows (a: cell, b: print, near) of crowded grid points under keys of the cell and three blocks of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            cell, prints = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))
            near = batch.column("near").to_numpy(zero_copy_only=False)
            for n, mask in enumerate(_MASKS):
                key = ((cell * spread) ^ (prints & mask)) * spread + np.uint64(n)
                yield _batch(_CELLS.names, (key ^ (key >> np.uint64(29))).view(np.int64), prints.view(np.int64), near)

    return rows.mapInArrow(run, _CELLS)


def _links(cells: DataFrame, rows: int | None) -> DataFrame:
    """Links (a, b, null) within each cell; the rows of a cell with more than `rows` come back as (cell, print, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the last cell, which can go on
        over = None  # a cell with too many rows

        def given(cell: np.ndarray, prints: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What whole cells, sorted, give."""
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[first, len(cell)])
            nears = np.add.reduceat(near.astype(np.int64), first)
            pairs = first[(size == 2) & (nears > 0)]
            pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= DISTANCE] if len(pairs) else pairs
            a, b = [prints[pairs]], [prints[pairs + 1]]
            for at, n in zip(*(x[(size > 2) & (nears > 0)] for x in (first, size))):
                x, y = forest(prints[at : at + n], near[at : at + n])
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.bool_())], _FOUND.names)

        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            near = batch.column("near").to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            if over is not None:
                n = int(np.searchsorted(cell, over, "right"))
                if n:
                    yield _batch(_FOUND.names, cell[:n], prints[:n].view(np.int64), near[:n])
                    cell, prints, near = cell[n:], prints[n:], near[n:]
                if not len(cell):
                    continue
                over = None
            if held:
                cell, prints, near = (np.concatenate(x) for x in zip(*held, (cell, prints, near)))
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield from given(cell[:last], prints[:last], near[:last])
            held = [(cell[last:], prints[last:], near[last:])]
            if rows is not None and len(cell) - last > rows:
                over = int(cell[-1])
                yield _batch(_FOUND.names, cell[last:], prints[last:].view(np.int64), near[last:])
                held = []
        if held:
            yield from given(*held[0])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, _FOUND)


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(key, fingerprint, component_id) for each row of `docs`.

    fingerprint has 16 lowercase hex digits; a bit is 1 if it is set in over half of the XXH64 hashes
    of the `width`-word shingles, repeats included. Words are runs without white space, A-Z in
    lower case; fewer words than `width` give one shingle, and null, empty and wordless texts the
    fingerprint zero, which links like any other. Rows link at DISTANCE or fewer differing bits, and
    component_id is the smallest key reachable by links, the row's own included. `key` names the
    rows and is expected to be unique; rows with a null key get their fingerprint, are left out
    of all links, and have a null component. Other columns are not read. `rows` bounds what a task
    holds of a grid point and changes no result.
    """
    fields = [T.StructField("print", T.LongType())]
    read = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    described = written(map_batches(read, ["_key"], ["_text"], fields, lambda: lambda texts: [np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)]), "prints")
    known = written(described.where("_key is not null").groupBy("print").agg(F.min("_key").alias("rep")), "classes")
    found = written(_links(_cells(known), rows), "found")
    links = found.where("near is null").select("a", "b")
    crowded = found.where("near is not null")
    again = None
    if not crowded.isEmpty():
        again = written(_links(_split(crowded), None), "found")
        links = links.unionByName(again.select("a", "b"))
    ends = known.select(F.col("print").alias("a"), F.col("rep").alias("x")), known.select(F.col("print").alias("b"), F.col("rep").alias("y"))
    components = connected_components(links.distinct().join(ends[0], "a").join(ends[1], "b").select("x", "y"), "x", "y")
    dropped(found)
    if again is not None:
        dropped(again)
    owner = known.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = described.join(owner, "print", "left")
    return out.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("_key").isNotNull(), F.col("component_id")).alias("component_id"))
