"""Quality by nearest neighbours among labelled texts in a latent-semantic space.

A text is a vector of hashed words (A-Z in lower case) and hashed shapes: its bytes are reduced
to classes (letters by case, digits, spaces, each mark) and counted in runs of three, together
with bins of how much its words and lines repeat and of its length. Counts are damped, weighted
by inverse document frequency and projected onto the leading singular vectors of a bounded
labelled sample. The sample's vectors are broadcast; every
text gets exact cosine products with all of them, in blocks, and its nearest neighbours vote by
their similarity, with all that are as near as the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Bounds: labelled texts for each label, labels in a sample, dimensions, neighbours.
PER_LABEL = 1200
RANK = 48
NEIGHBOURS = 25
BLOCK = 512

BINS = 16
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_N = 7 + len(_MARKS)


def _kind(c: int) -> int:
    """Class of a byte: control, blank, line feed, small, capital, digit, beyond ASCII, or the mark itself."""
    x = chr(c)
    if c > 127:
        return 6
    for n, group in enumerate((" \t", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"), 1):
        if x in group:
            return n
    return 7 + _MARKS.index(x) if x in _MARKS else 0


_KINDS = np.array([_kind(c) for c in range(256)])
WIDTH = 2048
WORDS = 2048
#: Length of the part of a vector that its words make; its shapes' part has length 1.
WORDING = 0.5
SIZE = WIDTH + 4 * BINS + WORDS


def counts(text: str | None) -> np.ndarray:
    """Damped counts of the whole text's shapes and words, of length 1; zeros for a null or empty text."""
    out = np.zeros(SIZE, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "replace")
    k = _KINDS[np.frombuffer(data, np.uint8)]
    if len(k) > 2:
        triple = (k[:-2] * _N + k[1:-1]) * _N + k[2:]
        out[:WIDTH] = np.bincount(triple * 40503 % 65521 % WIDTH, minlength=WIDTH)
    out[:WIDTH] = np.log1p(out[:WIDTH] * (1000 / len(k)))
    norm = np.linalg.norm(out)
    if norm:
        out /= norm
    words, lines = data.split(), data.split(b"\n")
    shares = (1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(words) / 4000) ** 0.5, sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words)))
    for n, share in enumerate(shares):  # neighbouring bins share the weight
        at = share * (BINS - 1)
        low = min(int(at), BINS - 2)
        out[WIDTH + n * BINS + low] += 0.5 * (1 - (at - low))
        out[WIDTH + n * BINS + low + 1] += 0.5 * (at - low)
    if words:
        spoken = np.fromiter(map(crc32, data.lower().split()), np.int64, len(words)) % WORDS
        own = np.log1p(np.bincount(spoken, minlength=WORDS) * (100 / len(words)))
        out[-WORDS:] = own * (WORDING / np.linalg.norm(own))
    return out / np.linalg.norm(out)


@dataclass
class Neighbours:
    """The labelled sample in latent space."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours of each row."""
        prior = float(self.labels.mean())
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            s = self.project(x[at : at + BLOCK]) @ self.vectors.T
            least = np.partition(s, -k, axis=1)[:, -k, None]
            weight = np.where(s >= least, np.maximum(s, 0) ** 8, 0)
            total, vote = weight.sum(1), weight @ self.labels
            out[at : at + BLOCK] = np.where(total > 0, vote / np.where(total > 0, total, 1), prior)
        return np.clip(out, 0, 1)


def _leading(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of a matrix, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(3).normal(size=(x.shape[1], min(rank + 8, x.shape[1])))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    return (basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :rank]).astype(np.float32)


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Neighbours | None:
    """Neighbours from a bounded sample of `labels` (key, label 0 or 1); None if nothing is labelled.

    About PER_LABEL keys of each label are taken by a hash of the key. Null labels, null keys
    and labels other than 0 and 1 teach nothing.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("double").alias("y")).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for y, n in sizes.items() for x in (F.lit(y), F.lit(min(1.0, PER_LABEL / n)))])
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    taken = known.where(chance < share[F.col("y")]).orderBy(chance, key).limit(3 * PER_LABEL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [counts(t if isinstance(t, str) else None).astype(np.float16).tobytes() for t in batch[text]]})

    rows = docs.select(key, text).join(F.broadcast(taken), key).select("y", text).mapInPandas(run, "y double, x binary").toPandas()
    if not len(rows):
        return None
    x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
    order = np.lexsort([*x[:, :8].T, rows["y"]])  # the sample's order doesn't depend on how it came
    x, y = x[order], rows["y"].to_numpy()[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    basis = _leading(x * idf, min(RANK, len(x)))
    out = Neighbours(idf, basis, np.empty(0), y)
    out.vectors = out.project(x)
    return out


def quality_classifier(docs: DataFrame, model: Neighbours | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on).

    Null and empty texts have no direction and get the sample's share of label 1; without a
    model every score is 0.5. Columns of `docs` named like the added ones are replaced; repeated
    rows get equal scores.
    """
    passed = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def judge(texts: list[str | None]) -> list[list]:
            scores: list[float] = []
            for at in range(0, len(texts), BLOCK):
                x = np.stack([counts(t) for t in texts[at : at + BLOCK]])
                scores.extend(known.scores(x) if known else [0.5] * len(x))
            return [scores, [int(s >= 0.5) for s in scores]]

        return judge

    return map_batches(docs, passed, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)
