"""Language-model scores from a weighted backoff automaton.

Words, pairs and triples of the whole training corpus make an interpolated model with absolute
discounting: a history h that is followed by the kept n-grams hw gives each of them
(count - `DISCOUNT`) / count of h besides what is left of its mass times the probability after
the next shorter history. All pairs and triples with at least `LEAST` occurrences are kept, at
every size of corpus. As an automaton, an arc carries such a probability, and a failure arc the
mass that is left.

1. Texts are cut into words once and put together in blocks of about `CHUNK` tokens, which are
   rows of a table.
2. For triples, then pairs, then words, each block sends the hashes of its distinct n-grams and
   how often its training texts hold them, sorted and packed, one row for each bucket of hashes.
   A bucket adds them up and answers each block in the order in which it asked; n-grams that are
   not kept are zeros. One of the blocks that hold a kept n-gram adds its discounted count to
   that of its history when histories are counted in the next round.
3. A block makes the part of the automaton that its own words can reach, and walks its texts from
   left to right, with failure arcs wherever a word doesn't follow. Many pieces of texts are walked
   at once, a word of each at a time.

N-grams so travel once, as about seven bytes, and are dealt by hashes alone, so no word or
history is hot. Words are known by 128 bits, pairs and triples by 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SMALL_BATCHES, written

#: Occurrences from which pairs and triples are kept.
LEAST = 2
DISCOUNT = 0.5
ADDED = 0.1
#: Tokens of a block, but for longer texts; a bucket has at most about twice as many n-grams.
CHUNK = 500_000
LEAST_BUCKETS = 48
#: Words of a text that are walked one after another, while those of other pieces are walked beside them.
PIECE = 128
#: Ids of the start and the end of a text in each block; no word holds a space or is empty.
START, END = 0, 1
MARKS = (b" start", b"")


def tokens(text: str | None) -> list[bytes]:
    """The words of a whole text (runs without white space, A-Z in lower case) and its end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), MARKS[END]]


@dataclass
class Automaton:
    """States from 0 (no history) on, over words 0 to size - 1.

    Arcs in the order of their keys, which are state * size + word, with log10 probability and next
    state; those of state 0 come first, one for each word. Of each state: the failure arc's weight
    and its next state.
    """

    size: int
    keys: np.ndarray
    logs: np.ndarray
    targets: np.ndarray
    weights: np.ndarray
    shorter: np.ndarray
    start: int

    @property
    def fails(self) -> dict[int, tuple[float, int]]:
        """Failure weight and state of all states but the empty one."""
        return {i + 1: x for i, x in enumerate(zip(self.weights[1:].tolist(), self.shorter[1:].tolist()))}

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and next states of one word from each state, over failure arcs where the word doesn't follow."""
        states, arcs, total = states.copy(), words.copy(), np.zeros(len(words))
        left = np.flatnonzero(states)
        while len(left):
            wanted = states[left] * self.size + words[left]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            arcs[left[there]] = at[there]
            left = left[~there]
            here = states[left]
            total[left] += self.weights[here]
            states[left] = self.shorter[here]
            left = left[states[left] > 0]
        return total + self.logs[arcs], self.targets[arcs]

    def walks(self, row: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Sum over the words of each text in order; texts stand in `row` one after another, each after a mark of its start.

        Texts are walked side by side in pieces of `piece` words, at least two. Two words determine the
        state after them, so any piece but a text's first sets out two words early without a history.
        """
        ends = np.cumsum(sizes)
        pieces = -(-(sizes - 1) // piece)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = (ends - sizes + 1)[owner] + place * piece
        early = np.where(place > 0, 2, 0)
        lengths = np.minimum(first + piece, ends[owner]) - first + early
        order = np.argsort(-lengths, kind="stable")
        at, early, lengths = (first - early)[order], early[order], lengths[order]
        states, total = np.where(early > 0, 0, self.start), np.zeros(len(order))
        for n in range(lengths[0] if len(order) else 0):
            live = np.searchsorted(-lengths, -n)  # those with over n words
            logs, states = self.step(states[:live], row[at[:live] + n])
            total[:live] += np.where(early[:live] > n, 0.0, logs)
        return np.bincount(owner[order], total, len(sizes))

    def walk(self, words: list[int]) -> float:
        """Sum over the words in order, from the start of a text on."""
        return float(self.walks(np.array([START, *words]), np.array([len(words) + 1]))[0])


def build(counts: np.ndarray, masses: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], total: int, distinct: int) -> Automaton:
    """The automaton over words 0 to len(counts) - 1.

    counts, masses: occurrences of each word in training, and the discounted counts of all kept
    pairs that it begins, together. pairs: first word, second word, count, discounted counts of
    the kept triples that it begins. triples: places of its first and second pair in `pairs`, last
    word, count. total, distinct: tokens and distinct tokens of training.
    """
    size = len(counts)
    a, b, c, m = pairs
    first, second, w, c3 = triples
    left = 1 - masses / np.maximum(counts, 1)
    single = (counts + ADDED) / (total + ADDED * (distinct + 1))
    double = (c - DISCOUNT) / np.maximum(counts[a], 1) + left[a] * single[b]
    left2 = 1 - m / np.maximum(c, 1)
    triple = (c3 - DISCOUNT) / c[first] + left2[first] * double[second]
    # Histories without kept followers are no states.
    one, two = masses > 0, m > 0
    word = np.where(one, np.cumsum(one), 0)
    pair = np.where(two, one.sum() + np.cumsum(two), word[b])
    keys = np.concatenate([np.arange(size), word[a] * size + b, pair[first] * size + w])
    order = np.argsort(keys)
    logs, targets = np.log10(np.concatenate([single, double, triple])), np.concatenate([word, pair, pair[second]])
    weights = np.log10(np.concatenate([[1.0], left[one], left2[two]]))
    shorter = np.concatenate([np.zeros(1 + one.sum(), np.int64), word[b[two]]])
    return Automaton(size, keys[order], logs[order], targets[order], weights, shorter, int(word[START]))


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values together, then the second ones, and so on."""
    return _compressor().compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpack(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_decompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two; the order of the two matters."""
    x = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


@dataclass
class Asked:
    """Distinct n-grams of a block in the order of their hashes: place of each token's n-gram (-1: none), a token of each n-gram, hashes, second hashes, times in training texts."""

    place: np.ndarray
    token: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    times: np.ndarray


@dataclass
class Block:
    """Words by id, texts one after another as ids (start, words, end), their numbers of ids, and whether they are for training."""

    words: list[bytes]
    row: np.ndarray
    sizes: np.ndarray
    training: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        """Two hashes of each word."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").reshape(-1, 2).astype(np.uint64)

    @cached_property
    def pairs(self) -> np.ndarray:
        """A hash of each token and the next one."""
        h = self.hashes[self.row, 0]
        return _mixed(h[:-1], h[1:])

    def asked(self, n: int) -> Asked:
        """All n-grams of `n` words; the start of a text is a word, too."""
        both, row = self.hashes, self.row
        h = both[:, 0]
        learned = np.repeat(self.training, self.sizes)
        place = np.full(len(row), -1)
        if n == 1:
            order = np.lexsort((both[:, 1], h))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            token = np.zeros(len(order), np.int64)
            place[:] = rank[row]
            token[place] = np.arange(len(row))
            return Asked(place, token, h[order], both[order, 1], np.bincount(place[learned], minlength=len(order)))
        inner = row != END
        at = np.flatnonzero(inner if n == 2 else inner & np.append(inner[1:], False))
        keys = self.pairs[at]
        if n == 3:
            keys = _mixed(keys, h[row[at + 2]])
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        number = np.cumsum(new) - 1
        place[at] = number
        keys = keys[new]
        return Asked(place, at[new], keys, np.zeros(len(keys), np.uint64), np.bincount(number[learned[at]], minlength=len(keys)))


_BLOCKS = "block long, n long, ids long, words binary, row binary, sizes binary, training binary, passed binary"
_ASKS = "bucket long, block long, keys binary, checks binary, times binary, masses binary"
_ANSWERS = "block long, grams int, bucket long, counts binary, masses binary, own binary, fresh long"


def _blocks(docs: DataFrame, text: Column, training: Column, passed: list[str], chunk: int) -> DataFrame:
    """Rows of whole texts in blocks; what is passed on stays in Arrow. n: tokens of training texts; ids: of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: dict[bytes, int] = {}
        row: list[int] = []
        sizes: list[int] = []
        learned: list[bool] = []
        parts: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            nonlocal number
            number += 1
            sink = pa.BufferOutputStream()
            kept = pa.Table.from_batches(parts)
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(kept)
            size, train = np.array(sizes, np.int64), np.array(learned, bool)
            values = [number - 1, int((size - 1)[train].sum()), len(row), zstandard.compress(b" ".join(list(ids)[2:]), 3), pack(np.array(row, np.int32)), pack(size), pack(train), sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip([x.split()[0] for x in _BLOCKS.split(", ")], values)})

        for batch in batches:
            at = 0
            for i, (x, train) in enumerate(zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist())):
                if not ids:
                    ids.update({w: k for k, w in enumerate(MARKS)})
                before = len(row)
                row.append(START)
                row.extend([ids.setdefault(w, len(ids)) for w in (x or b"").lower().split()])
                row.append(END)
                sizes.append(len(row) - before)
                learned.append(train)
                if len(row) >= chunk:
                    parts.append(batch.slice(at, i + 1 - at).select(range(2, batch.num_columns)))
                    at = i + 1
                    yield done()
                    ids, row, sizes, learned, parts = {}, [], [], [], []
            if at < batch.num_rows:
                parts.append(batch.slice(at).select(range(2, batch.num_columns)))
        if sizes:
            yield done()

    # A column always stands there, since a batch without any has no rows.
    columns = [F.coalesce(text.cast("string"), F.lit("")), F.coalesce(training, F.lit(False)), F.lit(True), *[F.col("`" + c.replace("`", "``") + "`") for c in passed]]
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, _BLOCKS)


def _block(x: pa.Table) -> tuple[int, Block, bytes]:
    r = x.to_pylist()[0]
    words = zstandard.decompress(r["words"])
    return r["block"], Block([*MARKS, *(words.split(b" ") if words else [])], unpack(r["row"], np.int32).astype(np.int64), unpack(r["sizes"], np.int64), unpack(r["training"], bool)), r["passed"]


def _asks(block: int, asked: Asked, masses: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket that the block's n-grams fall into."""
    bucket = (asked.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    there, cuts = np.unique(bucket, return_index=True)
    rows: list[list] = [[], [], [], [], [], []]
    for b, x, y in zip(there.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        for column, value in zip(rows, (b, block, pack(np.diff(asked.keys[x:y], prepend=np.uint64(0))), pack(asked.checks[x:y]), pack(asked.times[x:y].astype(np.int64)), pack(masses[x:y]))):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table({k.split()[0]: pa.array(v, t) for k, v, t in zip(_ASKS.split(", "), rows, kinds)})


def _counted(n: int) -> Callable[[pa.Table], pa.Table]:
    """Answers to all blocks that ask a bucket: count and discounted count of followers, zero unless kept; whether the block is the one that speaks for the n-gram."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("block").to_pydict()
        parts = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in rows["keys"]]
        keys = np.concatenate(parts)
        checks, times, masses = (np.concatenate([unpack(x, kind) for x in rows[c]]) for c, kind in (("checks", np.uint64), ("times", np.int64), ("masses", np.float64)))
        order = np.lexsort((checks, keys)) if n == 1 else np.argsort(keys, kind="stable")
        k, c = keys[order], checks[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        at = np.flatnonzero(new)
        total, mass = np.add.reduceat(times[order], at), np.add.reduceat(masses[order], at)
        kept = total >= (1 if n == 1 else LEAST)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        own = np.zeros(len(order), bool)
        own[order[at]] = kept
        total, mass = np.where(kept, total, 0)[number], np.where(kept, mass, 0.0)[number]
        ends = np.cumsum([len(p) for p in parts]).tolist()
        cut = [slice(x, y) for x, y in zip([0, *ends], ends)]
        size = len(cut)
        return pa.table({
            "block": pa.array(rows["block"], pa.int64()),
            "grams": pa.array([n] * size, pa.int32()),
            "bucket": pa.array(rows["bucket"], pa.int64()),
            "counts": pa.array([pack(total[x]) for x in cut], pa.binary()),
            "masses": pa.array([pack(mass[x]) for x in cut], pa.binary()),
            "own": pa.array([pack(own[x]) for x in cut], pa.binary()),
            "fresh": pa.array([int(own[x].sum()) for x in cut], pa.int64()),
        })

    return run


def _answers(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, discounted counts of followers and own n-grams of a block, in the order in which it asked."""
    found = sorted((r for r in rows.to_pylist() if r["grams"] == n), key=lambda r: r["bucket"])
    return tuple(np.concatenate([np.zeros(0, kind), *[unpack(r[c], kind) for r in found]]) for c, kind in (("counts", np.int64), ("masses", np.float64), ("own", bool)))


def lm_score(docs: DataFrame, training: Column, text: str = "text", keep_text: bool = True, chunk: int = CHUNK) -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score of each whole text.

    The model learns from the rows where `training` holds (null: it doesn't). Tokens are the words
    and one end; base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over them, score is the
    automaton's log10 probability with all pairs and triples that occur `LEAST` times in training.
    A null text is an empty one: its end alone. Repeated rows stay and count each time; null keys
    do no harm. Columns of `docs` named like the added ones are replaced. Without training rows N
    and V are 0. The text itself is passed on only if `keep_text`. A text longer than `chunk` is a
    block of its own.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    passed = [c for c in docs.columns if c.lower() not in added and (keep_text or c != text)]
    blocks = written(_blocks(docs, F.col(text), training, passed, chunk), "blocks", SMALL_BATCHES)
    train_tokens, ids = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("ids")).first())
    buckets = max(LEAST_BUCKETS, ids // (2 * chunk))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, block, _ = _block(pa.Table.from_batches([batch.slice(i, 1)]))
                asked = block.asked(3)
                yield from _asks(number, asked, np.zeros(len(asked.keys)), buckets).to_batches()

    def shorter(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            number, block, _ = _block(left)
            longer, asked = block.asked(n + 1), block.asked(n)
            counts, _, own = _answers(right, n + 1)
            masses = np.bincount(asked.place[longer.token[own]], counts[own] - DISCOUNT, len(asked.keys))
            return _asks(number, asked, masses, buckets)

        return run

    bare = blocks.select("block", "words", "row", "sizes", "training", F.lit(b"").alias("passed"))
    together = lambda x: bare.groupBy("block").cogroup(x.groupBy("block"))
    answers: list[DataFrame] = []
    for n in (3, 2, 1):
        asks = bare.mapInArrow(triples, _ASKS) if n == 3 else together(answers[-1]).applyInArrow(shorter(n), _ASKS)
        answers.append(written(asks.groupBy("bucket").applyInArrow(_counted(n), _ANSWERS), f"answers{n}", {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}))
    fresh = answers[-1].agg(F.sum("fresh")).first()[0] or 0
    # The start of a text is counted as a word, but is no token.
    distinct = max(0, fresh - 1)
    fields = [*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(passed)], *[T.StructField(c, T.LongType() if c[0] in "nt" else T.DoubleType()) for c in added]]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block, kept = _block(left)
        row = block.row
        one, two, three = (block.asked(n) for n in (1, 2, 3))
        (c1, m1, _), (c2, m2, _), (c3, _, _) = (_answers(right, n) for n in (1, 2, 3))
        counts, masses = np.zeros(len(block.words), np.int64), np.zeros(len(block.words))
        counts[row], masses[row] = c1[one.place], m1[one.place]
        pairs, triples_ = np.flatnonzero(c2), np.flatnonzero(c3)
        at, at3 = two.token[pairs], three.token[triples_]
        number = np.full(len(two.keys), -1)
        number[pairs] = np.arange(len(pairs))
        automaton = build(counts, masses, (row[at], row[at + 1], c2[pairs], m2[pairs]), (number[two.place[at3]], number[two.place[at3 + 1]], row[at3 + 2], c3[triples_]), train_tokens, distinct)
        ends = np.cumsum(block.sizes)
        score = automaton.walks(row, block.sizes)
        real = row != START
        owner = np.repeat(np.arange(len(ends)), block.sizes)[real]
        sums = lambda x: np.bincount(owner, x, len(ends))
        made = [block.sizes - 1, sums(counts[row[real]] > 0).astype(np.int64), np.full(len(ends), train_tokens), sums(automaton.logs[row[real]]), score]
        table = pa.ipc.open_stream(kept).read_all()
        arrays = [*table.columns[1:], *[pa.array(x, k) for x, k in zip(made, kinds[len(passed) :])]]
        return pa.table(arrays, names=[f.name for f in fields])

    every = answers[0].union(answers[1]).union(answers[2])
    out = blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(walk, T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], *added)
