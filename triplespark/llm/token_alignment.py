"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes in two ways. Where both cut at once a group ends, and each stretch
between neighbouring cuts of either is a link: a token of A and a token of B whose bytes overlap.
How often a pair of ids is linked in the whole corpus is counted outside memory:

1. Tasks encode a block of documents at a time. A block's records (pair, document, times) are sorted
   with B's id first, dealt by radix of B's id to `RADIX` parts, and each part of a block is one
   zstd-compressed run. Runs are rows of a table in the shared folder.
2. Runs of one part are merged by a heap over the next id of B in each, so that all records of an id
   of B stand together and its pairs are counted at once. A part is dealt to several groups of
   blocks, as many as the number of bytes asks for, so that neither a frequent id nor a large corpus
   makes a group large; what the groups count is added up by pair.
3. The counts, with each id of B's highest, go back to the groups in which the pair occurs. The
   runs are merged once more beside them in the same order, and what each document's links gather
   is streamed out as sums for each block, which are added up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, written

#: Parts that records are dealt to by B's id.
RADIX = 16
#: Bytes of texts in a block, and in the blocks whose runs make a group.
BLOCK = 2 << 20
GROUP = 128 << 20
#: Bits of a document's number within its block, and of an id.
_DOC, _ID = 20, 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "200"}
#: Words of other categories, numbers and white space as the byte-level pre-tokenizer cuts them (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Encoder:
    """A tokenizer in a task: `encode` gives the ids of a whole text, `pieces` each id's bytes."""

    encode: Callable[[str], np.ndarray]
    pieces: list[bytes]


def byte_level(path: str) -> Callable[[], Encoder]:
    """The byte-level BPE of a tokenizer file, for texts with a space put before them; special tokens' strings are plain text.

    A file whose ids are in the order of its merges is encoded by ranks, which is the same and faster.
    """

    def start() -> Encoder:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {x["id"] for x in file["added_tokens"]}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        model = file["model"]
        own = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if i not in special}
        pieces = [own.get(i, b"") for i in range(max(own) + 1)]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if file["normalizer"] is None and file["pre_tokenizer"] == usual and [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))) and not model.get("ignore_merges"):
            ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in own.items()}, special_tokens={})
            return Encoder(lambda text: ranks.encode_to_numpy(" " + text, disallowed_special=()), pieces)
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return Encoder(lambda text: np.array(whole.encode(" " + text, add_special_tokens=False).ids, np.int32), pieces)

    return start


def piece_level(path: str) -> Callable[[], Encoder]:
    """The SentencePiece model of a file, which puts a space before texts itself."""

    def start() -> Encoder:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        return Encoder(lambda text: np.array(model.encode(text), np.int32), pieces)

    return start


@dataclass
class Aligned:
    """The tokens of a block of documents: ids and ends of A and B, ends of the documents, ends of groups."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    doc_end: np.ndarray
    group_end: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's token, B's token and the document of each link, in the order of bytes."""
        cut = np.concatenate([self.a_end, self.b_end])
        cut.sort(kind="stable")
        cut = cut[np.r_[True, cut[1:] != cut[:-1]]] if len(cut) else cut
        return np.searchsorted(self.a_end, cut), np.searchsorted(self.b_end, cut), np.searchsorted(self.doc_end, cut)


def align(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Documents that both tokenizers cover alike, one after another as one text."""
    ids_a, ids_b = (np.concatenate(ids).astype(np.int64) for ids in (a, b))
    a_end, b_end = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    n = np.cumsum([len(x) for x in a], dtype=np.int64)
    return Aligned(ids_a, ids_b, a_end, b_end, a_end[n - 1], np.intersect1d(a_end, b_end, assume_unique=True))


def group_texts(x: Aligned, words_a: list[bytes], words_b: list[bytes]) -> list[bytes]:
    """The groups of each document: `a1,a2|b1;a3|b2,b3`; words_a and words_b have each id in decimals with `,` and then with `|` or `;`."""
    last_a, last_b = np.searchsorted(x.a_end, x.group_end), np.searchsorted(x.b_end, x.group_end)
    n_a, n_b = len(words_a) // 2, len(words_b) // 2
    # A token of A stands behind all tokens of groups before its own, one of B behind those of A in its group, too.
    before_b = np.r_[0, last_b + 1]
    at_a = np.arange(len(x.a)) + before_b[np.searchsorted(last_a, np.arange(len(x.a)))]
    at_b = np.arange(len(x.b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(x.b)))]
    code_a, code_b = x.a.copy(), x.b + 2 * n_a
    code_a[last_a] += n_a
    code_b[last_b] += n_b
    codes = np.empty(len(x.a) + len(x.b), np.int64)
    codes[at_a], codes[at_b] = code_a, code_b
    words = words_a + words_b
    ends = np.searchsorted(x.a_end, x.doc_end) + np.searchsorted(x.b_end, x.doc_end) + 2
    out, start = [], 0
    for end in ends.tolist():
        out.append(b"".join(map(words.__getitem__, codes[start:end].tolist()))[:-1])
        start = end
    return out


_RECORDS = (np.uint64, np.uint32, np.uint32)


def packed(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """A run: sorted records, the pairs as differences."""
    n = len(pairs)
    steps = np.diff(pairs, prepend=np.uint64(0))
    columns = [np.frombuffer(x.astype(t).tobytes(), np.uint8).reshape(n, -1).T.tobytes() for x, t in zip((steps, docs, times), _RECORDS)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns))


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, documents and times of a run."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    widths = [np.dtype(t).itemsize for t in _RECORDS]
    n, out, at = len(raw) // sum(widths), [], 0
    for t, w in zip(_RECORDS, widths):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
        at += n * w
    return np.cumsum(out[0], dtype=np.uint64).view(np.int64), out[1], out[2]


def merged(runs: list[bytes]) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each id of B in order, the run's number, ids of A, documents and times of its records in each run that has it.

    A heap holds the next id of B of each run.
    """
    opened = []
    heap = []
    for n, run in enumerate(runs):
        pairs, docs, times = unpacked(run)
        b = pairs >> _ID
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
        opened.append(((pairs & ((1 << _ID) - 1)).astype(np.int32), docs, times, b[first].tolist(), [*first.tolist(), len(b)]))
        if len(b):
            heap.append((opened[-1][3][0], n, 0))
    heapq.heapify(heap)
    while heap:
        b, parts = heap[0][0], []
        while heap and heap[0][0] == b:
            _, n, k = heap[0]
            a, docs, times, ids, starts = opened[n]
            own = slice(starts[k], starts[k + 1])
            parts.append((n, a[own], docs[own], times[own]))
            if k + 1 < len(ids):
                heapq.heapreplace(heap, (ids[k + 1], n, k + 1))
            else:
                heapq.heappop(heap)
        yield b, parts


_ENCODED = "doc {doc}, block long, n int, part int, run binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROW = ("doc", "block", "n", "part", "run", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _encoded(docs: DataFrame, start_a: Callable[[], Encoder], start_b: Callable[[], Encoder], block: int) -> DataFrame:
    """Two kinds of rows of docs (doc, text): one for each document with its numbers (run null), and one for each run of a block."""
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), *T._parse_datatype_string(_ENCODED.format(doc="long")).fields[1:]])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = start_a(), start_b()
        size_a, size_b = (np.array([len(x) for x in e.pieces], np.int64) for e in (a, b))
        words_a, words_b = ([b"%d%s" % (i, end) for end in (b",", last) for i in range(len(e.pieces))] for e, last in ((a, b"|"), (b, b";")))
        blocks = 0

        def done(keys: list, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            number = (TaskContext.get().partitionId() << 32) + blocks
            blocks += 1
            good = []
            for n, raw in enumerate(texts):
                if raw:
                    text = raw.decode("utf-8", "replace")
                    i, j = a.encode(text), b.encode(text)
                    if all(b"".join(map(e.pieces.__getitem__, ids.tolist())) == b" " + raw for e, ids in ((a, i), (b, j))):
                        good.append((n, i, j))
            numbers = np.zeros((5, len(keys)), np.int64)
            sha = [""] * len(keys)
            if good:
                own = np.array([n for n, _, _ in good])
                x = align([i for _, i, _ in good], [j for _, _, j in good], size_a, size_b)
                numbers[0, own], numbers[1, own] = [len(i) for _, i, _ in good], [len(j) for _, _, j in good]
                numbers[2, own] = np.bincount(np.searchsorted(x.doc_end, x.group_end), minlength=len(own))
                for n, text in zip(own.tolist(), group_texts(x, words_a, words_b)):
                    sha[n] = hashlib.sha256(text).hexdigest()
                i, j, doc = x.links()
                numbers[3, own] = np.bincount(doc, minlength=len(own))
                key = (x.b[j] << (_ID + _DOC)) | (x.a[i] << _DOC) | own[doc]
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                times, key = np.diff(np.r_[first, len(key)]), key[first]
                part = (key >> (_ID + _DOC)) % RADIX
                for p in range(RADIX):
                    mine = part == p
                    if mine.any():
                        k = key[mine]
                        packs = packed((k >> _DOC).astype(np.uint64), k & ((1 << _DOC) - 1), times[mine])
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, number, None, p, packs, None, None, None, None, None), kinds)], _ROW)
            values = (keys, [number] * len(keys), range(len(keys)), [None] * len(keys), [None] * len(keys), *numbers[:4], sha)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], _ROW)

        keys: list = []
        texts: list[bytes | None] = []
        size = 0
        for batch in batches:
            for k, x in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                keys.append(k)
                texts.append(x)
                size += len(x or b"")
                if size >= block or len(keys) == 1 << _DOC:
                    yield from done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield from done(keys, texts)

    return docs.mapInArrow(run, schema)


def _counts(group: pa.Table) -> pa.Table:
    """(part, salt, b, a, n): the links of each pair in a group's runs."""
    parts: list[np.ndarray] = []
    for b, found in merged(group.column("run").to_pylist()):
        a = np.concatenate([x[1] for x in found])
        n = np.bincount(a, np.concatenate([x[3] for x in found])).astype(np.int64)
        ids = np.flatnonzero(n)
        parts.append(np.stack([np.full(len(ids), b), ids, n[ids]]))
    b, a, n = np.concatenate(parts, 1) if parts else np.empty((3, 0), np.int64)
    own = [np.full(len(b), group.column(c)[0].as_py(), np.int32) for c in ("part", "salt")]
    return pa.table([pa.array(x) for x in (*own, b.astype(np.int32), a.astype(np.int32), n)], ["part", "salt", "b", "a", "n"])


def _gathered(group: pa.Table, counts: pa.Table) -> pa.Table:
    """(block, n, n_best, count_sum): what the links of each document gather in a group's runs, from the counts (b, a, total, best)."""
    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], ["block", "n", "n_best", "count_sum"])
    if not group.num_rows or not counts.num_rows:
        return empty
    pair = (counts.column("b").to_numpy().astype(np.int64) << _ID) | counts.column("a").to_numpy()
    order = np.argsort(pair)
    pair, total, best = pair[order], counts.column("total").to_numpy()[order], counts.column("best").to_numpy()[order]
    blocks = group.column("block").to_pylist()
    sums = [np.zeros((2, 0), np.int64) for _ in blocks]
    for b, found in merged(group.column("run").to_pylist()):
        low, high = np.searchsorted(pair, [b << _ID, (b + 1) << _ID])
        for n, a, docs, times in found:
            at = low + np.searchsorted(pair[low:high], (b << _ID) | a.astype(np.int64))
            if docs.max() >= sums[n].shape[1]:
                sums[n] = np.pad(sums[n], ((0, 0), (0, 2 * int(docs.max()) + 1 - sums[n].shape[1])))
            np.add.at(sums[n][0], docs, times.astype(np.int64) * best[at])
            np.add.at(sums[n][1], docs, times.astype(np.int64) * total[at])
    out = []
    for block, s in zip(blocks, sums):
        n = np.flatnonzero(s[1])
        out.append(pa.table([pa.array(x) for x in (np.full(len(n), block), n.astype(np.int32), s[0][n], s[1][n])], ["block", "n", "n_best", "count_sum"]))
    return pa.concat_tables(out)


def token_alignment(docs: DataFrame, start_a: Callable[[], Encoder], start_b: Callable[[], Encoder], key: str = "doc_id", text: str = "text", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of `docs`.

    n_a and n_b are the tokens of both tokenizers, n_groups the stretches between bytes where both
    end a token, n_links the pairs of tokens whose bytes overlap. n_best counts the links whose
    pair is as frequent in the corpus as any of its id of B, count_sum adds up the frequencies of
    all links' pairs, and groups_sha256 is the hash of the groups' ids. Null and empty texts, and
    texts whose tokens don't give back a space and the text, have no tokens: zeros and an empty
    hash. Each row counts, also repeated ones and those with a null key. Other columns are not read.
    A text is held whole by the task that encodes it; `block` and `group` change no result.
    """
    read = docs.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("text"))
    size = read.agg(F.sum(F.length("text"))).first()[0] or 0
    encoded = written(_encoded(read, start_a, start_b, block), "encoded", _BATCHES)
    runs = encoded.where("run is not null").select("part", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-size // group)))).cast("int").alias("salt"), "block", "run")
    counted = written(runs.groupBy("part", "salt").applyInArrow(_counts, "part int, salt int, b int, a int, n long"), "counts")
    totals = counted.groupBy("b", "a").agg(F.sum("n").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").select("b", "a", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = counted.select("part", "salt", "b", "a").join(known, ["b", "a"])
    gathered = runs.groupBy("part", "salt").cogroup(back.groupBy("part", "salt")).applyInArrow(_gathered, "block long, n int, n_best long, count_sum long")
    sums = written(gathered, "gathered").groupBy("block", "n").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = encoded.where("run is null").select("doc", "block", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["block", "n"], "left")
    zero = F.lit(0).cast("long")
    dropped(counted)
    return rows.select(F.col("doc").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
