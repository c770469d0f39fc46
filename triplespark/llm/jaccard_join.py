"""N-gram Jaccard join with partition signatures (PartEnum).

A document's features are its distinct shingles. Sizes are cut into bands whose ends differ by
the factor of the threshold, so that two similar sets lie in the same or in neighbouring bands;
each set takes part in the instance of its band and in the next one. In an instance whose
largest size is u, similar sets differ in at most k = 2u(1-t)/(1+t) features. The feature
domain is hashed into n1 groups of n2 partitions. Some group differs in at most
k2 = ceil((k+1) / n1) - 1 of its partitions, so a set's signatures are the contents of all
subsets of n2 - k2 partitions of a group. Each instance takes the n1, n2 and k2 with the fewest
signatures that hold `FEATURES` features or more, and a few groups to spare.

Subsets without a feature carry nothing, as long as enough groups have more than k2 filled
partitions: then a similar set shares a subset with a feature. A set in which that fails is
dealt again by the next hash function, as is any similar set that it shares nothing with,
because that fails for both. So no bucket gathers sets that have nothing in common.

Exact copies are one class from the start, and each class is one vertex. A bucket of classes
with the same signature is a star around one of its classes, in each of several rounds around
another; what the stars leave in different components is compared pair by pair within the
bucket, so no link between different components is lost, and a bucket that is one component by
then emits no pair. Pairs whose sketches differ in
more bits than similar sets may differ in features are dropped within the join; that bound is
exact, so it drops no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, map_batches, written

PERCENT = 85
WIDTH = 4
#: Features that a signature should hold on average.
FEATURES = 4.5
#: Hash functions that a set is dealt by until enough partitions are filled.
AGAIN = 16
#: Words of 64 bits in a set's sketch.
SKETCH = 16
#: Rounds of stars before what is left is compared pair by pair.
STARS = 3
_WORDS = [f"k{i}" for i in range(SKETCH)]

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of a common hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles.

    Words are runs without white space, A-Z in lower case. Fewer words than `width` give one
    shingle of them all; no words give none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mix(out ^ (w[k : k + n] * _P[k % len(_P)]))
    return np.unique(out)


class Bands:
    """Instances of bands for a threshold in percent: the largest size u of each, and how its signatures are made."""

    def __init__(self, percent: int):
        self.percent = percent
        self.upper = [1]
        self.shapes: list[tuple[int, int, int, int]] = []

    def band(self, size: int) -> int:
        while self.upper[-1] < size:
            self.upper.append((self.upper[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.upper, size))

    def partitions(self, band: int) -> tuple[int, int, int, int]:
        """k, n1, n2 and k2 of an instance."""
        while len(self.upper) <= band:
            self.upper.append((self.upper[-1] + 1) * 100 // self.percent)
        while len(self.shapes) <= band:
            u, least = self.upper[len(self.shapes)], (self.upper[len(self.shapes) - 1] if self.shapes else 0) + 1
            k = 2 * u * (100 - self.percent) // (100 + self.percent)
            ways = []
            for k2 in range(min(k, 3) + 1):
                # Some groups to spare, so that a few without enough filled partitions do no harm.
                n1 = -(-(k + 1) // (k2 + 1)) + k // 25
                for n2 in range(k2 + 2, k2 + 5) if k2 else (1,):
                    held = least * (n2 - k2) / (n1 * n2)
                    ways.append((held < FEATURES, n1 * math.comb(n2, k2) if held >= FEATURES else -held, k2, n1, n2))
            k2, n1, n2 = min(ways)[2:]
            self.shapes.append((k, n1, n2, k2))
        return self.shapes[band]


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set in its two instances, distinct."""
    if not len(features):
        return np.empty(0, np.int64)
    found, own = [], bands.band(len(features))
    content = _mix(features ^ _P[2])
    for band in (own, own + 1):
        k, n1, n2, k2 = bands.partitions(band)
        for again in range(AGAIN):
            place = (_mix(features * np.uint64(2 * again + 1) ^ _P[1]) % np.uint64(n1 * n2)).astype(np.int64)
            filled = np.bincount(place, minlength=n1 * n2).reshape(n1, n2) > 0
            enough = (filled.sum(1) > k2).sum() * (k2 + 1) > k
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, place, content)
            parts = _mix(sums + _mix(np.arange(n1 * n2, dtype=np.uint64) * _P[3] + np.uint64((band + 1) * AGAIN + again))).reshape(n1, n2)
            for n, subset in enumerate(combinations(range(n2), n2 - k2)):
                own_parts = np.add.reduce(parts[:, subset], 1, dtype=np.uint64)
                # After the last function sets that are still too unevenly dealt share their empty subsets.
                emit = filled[:, subset].any(1) | (again + 1 == AGAIN and not enough)
                found.append(_mix(own_parts[emit] + np.uint64(n << 32)))
            if enough:
                break
    return np.unique(np.concatenate(found).view(np.int64))


def sketch(features: np.ndarray) -> np.ndarray:
    """SKETCH words of 64 bits: the parity of the features that hash to each bit.

    A feature that only one of two sets has flips one bit, so the sketches of two sets differ in
    no more bits than the sets do in features.
    """
    bits = np.bincount((_mix(features ^ _P[0]) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_hash(features: np.ndarray) -> tuple[int, int]:
    """128 bits for a set: two sums of independently spread features."""
    if not len(features):
        return 0, 0
    return tuple(int(_mix(np.array([np.add.reduce(_mix(features ^ p))], np.uint64))[0].view(np.int64)) for p in (_P[6], _P[7]))  # type: ignore[return-value]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of `edges`; the component is its smallest node.

    Rounds of joins: each node takes the smallest label around it, then its label's label, and
    each round is written to the shared folder; it ends when no label changes.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x <> y").distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("n"))
        jump = labels.select(F.col("x").alias("c"), F.col("c").alias("cc"))
        new = labels.join(near, "x").join(jump, "c").select("x", F.least("c", "n", "cc").alias("c"), (F.least("c", "n", "cc") < F.col("c")).alias("moved"))
        new = written(new, "labels")
        dropped(labels)
        labels = new.select("x", "c")
        if new.where("moved").isEmpty():
            dropped(both)
            return labels.select(F.col("x").alias("node"), F.col("c").alias("component"))


def _described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n_shingles, h1, h2 and the sketch for each row."""

    def describe(texts: list[str | None]) -> list[list]:
        sets = [shingles(x, width) for x in texts]
        h = [set_hash(x) for x in sets]
        words = np.array([sketch(x) for x in sets], np.int64).reshape(len(sets), SKETCH)
        return [[len(x) for x in sets], [x[0] for x in h], [x[1] for x in h], *words.T]

    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "h1", "h2", *_WORDS)]
    return map_batches(docs, [key], [text], fields, lambda: describe)


def _signed(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(sig, h1) for each signature of each row that has a shingle; equal texts of a batch once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for batch in batches:
            sigs, owners, seen = [], [], set()
            for x in batch[text]:
                features = shingles(x if isinstance(x, str) else None, width)
                h = set_hash(features)
                if h in seen or not len(features):
                    continue
                seen.add(h)
                sigs.append(signatures(features, bands))
                owners.append(np.full(len(sigs[-1]), h[0], np.int64))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs), "h1": np.concatenate(owners)})

    return docs.select(text).mapInPandas(run, "sig long, h1 long")


def _near(percent: int) -> Column:
    """Whether the sizes and sketches of a pair (columns ending in _a and _b) allow a link."""
    both = F.col("n_a") + F.col("n_b")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in _WORDS])
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * apart <= (100 - percent) * both)


def _sided(rows: DataFrame, side: str) -> DataFrame:
    """`rows` with their columns, but sig and lead, named for one side of a pair."""
    return rows.select(*[F.col(c).alias(c if c == "sig" else f"{c}_{side}") for c in rows.columns])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose texts (class_id, t) reach the threshold."""
    both = pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")).join(texts.toDF("class_a", "text_a"), "class_a").join(texts.toDF("class_b", "text_b"), "class_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
            keep = []
            for ta, tb in zip(batch["text_a"], batch["text_b"]):
                if ta != last[0]:
                    last = (ta, shingles(ta, width))
                x, y = last[1], shingles(tb, width)
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both_n >= percent * (len(x) + len(y) - both_n))
            yield batch.loc[keep, ["class_a", "class_b"]].rename(columns={"class_a": "a", "class_b": "b"})

    kind = dict(texts.dtypes)["class_id"]
    return both.mapInPandas(run, f"a {kind}, b {kind}")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for each row of `docs`.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest key reachable by links, the row's own included. Null and empty
    texts, and texts without words, have no shingles and link with nothing. `key` names the
    rows and is expected to be unique; rows with a null key are left out of all links and are
    their own component (null). Other columns are not read.
    """
    docs = docs.select(key, text)
    described = written(_described(docs, key, text, width), "sets")
    filled = described.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    classes = written(filled.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min(key).alias("class_id"), *[F.first(k).alias(k) for k in _WORDS]), "classes")
    known = classes.select("h1", "h2", "class_id", "n", *_WORDS)
    # Dealt once by signature: the leaders and their members are found in the same stage, streaming.
    signed = _signed(docs.where(F.col(key).isNotNull()), text, width, percent).repartition("sig")
    leaders = signed.groupBy("sig").agg(F.min("h1").alias("lead"), F.max("h1").alias("last")).where("lead <> last")
    members = written(signed.join(leaders.select("sig"), "sig").distinct(), "buckets")
    texts = known.join(members.select("h1").distinct(), "h1", "left_semi").select(F.col("class_id").alias(key))
    texts = written(docs.join(texts, key, "left_semi").select(F.col(key).alias("class_id"), F.col(text).alias("t")), "texts")
    owner = known.withColumn("component", F.col("class_id"))
    mixed, linked = members, None
    for star in range(STARS + 1):
        rest = written(mixed.join(owner, "h1"), "mixed")
        if rest.isEmpty():
            break
        left, right = _sided(rest, "a"), _sided(rest, "b")
        if star < STARS:  # each bucket is a star around one of its classes, another one each time
            lead = rest.groupBy("sig").agg(F.min_by("h1", F.xxhash64("h1", F.lit(star))).alias("lead"))
            left = left.join(lead, (left["sig"] == lead["sig"]) & (F.col("h1_a") == F.col("lead"))).select(left["sig"], *[c for c in left.columns if c != "sig"])
            apart = F.col("component_a") != F.col("component_b")
        else:  # what is left in different components is compared within its buckets
            apart = F.col("component_a") < F.col("component_b")
        pairs = left.join(right, (left["sig"] == right["sig"]) & apart & _near(percent))
        pairs = pairs.select(F.least("class_id_a", "class_id_b").alias("a"), F.greatest("class_id_a", "class_id_b").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        found = _verified(pairs, texts, width, percent)
        linked = written(found if linked is None else linked.unionByName(found), "links")
        dropped(pairs)
        dropped(rest)
        components = connected_components(linked)
        owner = known.join(components.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        placed = mixed.join(owner.select("h1", "component"), "h1")
        several = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
        mixed = written(mixed.join(several, "sig", "left_semi"), "buckets")
    ids = owner.select("h1", "h2", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    out = described.join(ids, ["h1", "h2", "n_shingles"], "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", F.col(key)).alias("component_id"))
