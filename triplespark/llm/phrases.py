"""Phrase collocation mining by SON partitioning.

Texts are dealt to `SHARDS` shards by a hash of their content. A phrase that occurs `support` times
occurs `(support - 1) // SHARDS + 1` times in some shard, because otherwise its counts could not add
up to the support. Each shard is mined completely at that lowered support, level by level: words,
then pairs of frequent words, then triples and quadruples of frequent pairs. The union of what is
frequent in a shard is counted over all texts exactly.

Within a shard n-grams go by 61-bit hashes, and what is frequent is told to the next level by a bit
map of bounded size. Both can only let more through, so no frequent phrase is lost; whatever passes
is counted by its words in the last pass. Tasks count a block of words at a time before anything is
shuffled, so a common n-gram is a row for each block, not for each place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SMALL_BATCHES, UPPER, dropped, written

SUPPORT = 30
SHARDS = 7
#: Words of the longest phrases.
LONGEST = 4
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
SHARE = 80
#: Words that a task counts at a time.
BLOCK = 2_000_000
#: Most bits of a map of frequent n-grams; beyond it more n-grams pass and are counted.
MOST_BITS = 1 << 28
#: Beyond this, numbers that stand for a phrase's language and words are dealt anew.
LARGEST = 1 << 62
#: Salts among which each language's best phrases are found first.
SALTS = 64
UNKNOWN = "und"

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, tabs as spaces, and ends of pieces as a byte that no text has.
_BYTES = bytes.maketrans(UPPER.encode() + b"\t" + _ENDS, UPPER.lower().encode() + b" " + b"\xff" * len(_ENDS))
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_SHARD_BITS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of a common hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with the byte 0xFF at the end of each piece."""
    return text.translate(_BYTES).replace(b"\xff", b" \xff ").split(b" ")


class Block:
    """The words of some texts as numbers: ids (-1 at the end of a piece), and language and shard of each place."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.end, self.none = self.vocabulary[b"\xff"], self.vocabulary[b""]
        self.parts: list[np.ndarray] = []
        self.langs: dict[bytes, int] = defaultdict()
        self.langs.default_factory = self.langs.__len__
        self.owners: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, text: bytes, lang: bytes, shard: int) -> None:
        words = tokens(text)
        words.append(b"\xff")
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        ids = ids[ids != self.none]
        self.parts.append(ids)
        self.owners.append((self.langs[lang], shard, len(ids)))
        self.size += len(ids)

    def close(self) -> None:
        self.ids = np.concatenate(self.parts)
        lang, shard, size = (np.array(x, np.int64) for x in zip(*self.owners))
        self.lang, self.shard = np.repeat(lang, size), np.repeat(shard, size)
        self.words = list(self.vocabulary)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.lang_hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.langs), np.uint64, len(self.langs))
        self.run = self.ids != self.end
        self.ids[~self.run] = -1

    def starts(self, k: int) -> np.ndarray:
        """Places where `k` words stand in one piece."""
        ok = self.run
        for j in range(1, k):
            ok = ok[:-1] & self.run[j:]
        return np.flatnonzero(ok)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """61-bit hashes of language and words for the n-grams at `at`."""
        h = self.lang_hashes[self.lang[at]] + np.uint64(k)
        for j in range(k):
            h = _mix(h ^ (self.hashes[self.ids[at + j]] * _P[j % len(_P)]))
        return h >> np.uint64(_SHARD_BITS)

    def codes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hash and shard as one number."""
        return (self.keys(at, k) << np.uint64(_SHARD_BITS)) | self.shard[at].astype(np.uint64)

    def numbers(self, at: np.ndarray, k: int, largest: int = LARGEST) -> np.ndarray:
        """A number for each place, the same for the same language and words and for no others; numbers that could pass `largest` are dealt anew on the way."""
        out, most, size = self.lang[at], len(self.langs), len(self.words)
        for j in range(k):
            if most * size > largest:  # numbered anew, so that the next word fits in
                known, out = np.unique(out, return_inverse=True)
                most = len(known)
            out, most = out * size + self.ids[at + j], most * size
        return out


def _bits(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of each code in a map of `size` bits, a power of two."""
    mixed = _mix(codes)
    return [mixed & np.uint64(size - 1), (mixed >> np.uint64(32)) & np.uint64(size - 1)]


def _passes(codes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each code may be in the map."""
    out = np.ones(len(codes), bool)
    for at in _bits(codes, 64 * len(bitmap)):
        out &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bit_map(codes: DataFrame, most_bits: int = MOST_BITS) -> Broadcast:
    """A map of the codes (code) with two bits for each, sent to all tasks; its size follows their number up to `most_bits`."""
    spark = codes.sparkSession
    size = 1 << 16
    n = codes.count()
    while size < min(16 * n, most_bits):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for at in _bits(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64), size):
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        full = np.flatnonzero(words)
        for x in range(0, len(full), 100_000):
            part = full[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], ["word", "bits"])

    rows = codes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def _by_block(texts: DataFrame, block: int, schema: str, work: Callable[[Block], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `work` gives for each block of the texts (text, lang, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block()
        for batch in batches:
            for text, lang, shard in zip(*(batch.column(c) for c in ("text", "lang", "shard"))):
                own.add(text.as_py(), lang.as_py(), shard.as_py())
                if own.size >= block:
                    own.close()
                    yield from work(own)
                    own = Block()
        if own.size:
            own.close()
            yield from work(own)

    return texts.mapInArrow(run, schema)


def _counted(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    values, n = np.unique(codes, return_counts=True)
    for at in range(0, len(values), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(values[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int32))], ["code", "n"])


def _frequent(texts: DataFrame, block: int, least: int, work: Callable[[Block], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(code): the n-grams that `work` gives codes of, where a shard has `least`."""
    rows = _by_block(texts, block, "code long, n int", work)
    return written(rows.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("code"), "frequent", SMALL_BATCHES)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, shards: int = SHARDS, block: int = BLOCK, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, k, n): all phrases of up to four words with `support` occurrences in a language, and with k = 0 each language's words.

    The table is written to the shared folder.
    """
    if not 0 < shards <= 1 << _SHARD_BITS:
        raise ValueError(f"1 to {1 << _SHARD_BITS} shards")
    least = (support - 1) // shards + 1
    raw = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(raw.cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).cast("binary").alias("lang"), F.pmod(F.xxhash64(raw), F.lit(shards)).cast("int").alias("shard"))

    def words(b: Block) -> Iterator[pa.RecordBatch]:
        yield from _counted(b.codes(b.starts(1), 1))

    one = _frequent(read, block, least, words)
    map1 = bit_map(one, most_bits)

    def pairs(b: Block) -> Iterator[pa.RecordBatch]:
        ok = np.zeros(len(b.ids) + LONGEST, bool)
        at = b.starts(1)
        ok[at] = _passes(b.codes(at, 1), map1.value)
        at = b.starts(2)
        yield from _counted(b.codes(at[ok[at] & ok[at + 1]], 2))

    two = _frequent(read, block, least, pairs)
    map2 = bit_map(two, most_bits)

    def longer(b: Block) -> Iterator[pa.RecordBatch]:
        ok = np.zeros(len(b.ids) + LONGEST, bool)
        at = b.starts(2)
        ok[at] = _passes(b.codes(at, 2), map2.value)
        for k in range(3, LONGEST + 1):
            at = b.starts(k)
            for j in range(k - 1):
                at = at[ok[at + j]]
            yield from _counted(b.codes(at, k))

    more = _frequent(read, block, least, longer)
    union = one.unionByName(two).unionByName(more).select(F.shiftrightunsigned("code", _SHARD_BITS).alias("code"))
    chosen = bit_map(union, most_bits)

    def whole(b: Block) -> Iterator[pa.RecordBatch]:
        langs = list(b.langs)
        for code, n in enumerate(np.bincount(b.lang[b.run], minlength=len(langs))):
            yield _phrases([langs[code]], [b""], 0, [int(n)])
        for k in range(1, LONGEST + 1):
            at = b.starts(k)
            at = at[_passes(b.keys(at, k), chosen.value)]
            if not len(at):
                continue
            code = b.numbers(at, k)
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            first = at[first]
            for x in range(0, len(first), 50_000):
                part = first[x : x + 50_000]
                rows = zip(*(b.ids[part + j].tolist() for j in range(k)))
                phrases = [b" ".join([b.words[i] for i in row]) for row in rows]
                yield _phrases([langs[i] for i in b.lang[part].tolist()], phrases, k, n[x : x + 50_000])

    rows = _by_block(read, block, "lang binary, phrase binary, k int, n long", whole)
    counted = rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= support))
    out = written(counted.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "k", "n"), "phrases", SMALL_BATCHES)
    for x in (one, two, more):
        dropped(x)
    for m in (map1, map2, chosen):
        m.unpersist()
    return out


def _phrases(langs: list[bytes], phrases: list[bytes], k: int, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), pa.array(phrases, pa.binary()), pa.array(np.full(len(langs), k, np.int32)), pa.array(np.asarray(n, np.int64))], ["lang", "phrase", "k", "n"])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    A-Z count as lower case; phrases don't cross the ends of pieces (`.,;:!?` and line ends), words
    are runs without spaces and tabs. a, l and r are the occurrences of the phrase and of the two
    parts of its lowest-scoring cut (of equal ones the first), n the language's words, and the score
    floor(2000000 a / (l + r)), in exact decimals. Phrases with fewer than `support` occurrences
    don't count, nor do those of which a longer one around them has SHARE percent. Null texts count
    as empty, null languages as UNKNOWN; repeated rows count each time; a language without
    phrases gives no row. Other columns are not read. `options` go to `phrase_counts`.
    """
    counts = phrase_counts(docs, text, lang, support, **options)
    parts = counts.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    found = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    slices = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = found.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", slices(F.lit(1), F.col("cut")).alias("first"), slices(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div cast(l + r as decimal(20,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # What stands inside a longer phrase, with the most occurrences of one around it.
    inside = found.where("k > 2").select("lang", "w", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = inside.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    around = inside.groupBy("lang", slices(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    held = F.col("around").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * SHARE
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | ~held).select("lang", "phrase", "a", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("x", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("x") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
