"""Language identification: a convolutional network over bytes.

Texts are lower-cased, everything but letters becomes a space, and the UTF-8 bytes are cut into
windows of fixed length that cover the whole text. Filters of several widths slide over each
window, their largest responses feed a softmax, and a text's scores are the mean over its
windows. The network is trained with numpy on a bounded sample of labelled windows; a filter of
width w is a table of responses by place and byte, so that applying it is looking up tables.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: texts of each language, and in all.
PER_LANGUAGE = 500
SAMPLE = 100_000
WINDOWS_EACH = 4
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def _bytes(text: str) -> bytes:
    """Letters in lower case, with one space for each run of anything else."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "ignore")


def _windows(data: bytes) -> np.ndarray:
    """All of `data` in rows of WINDOW bytes; the last is filled up with spaces."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW), dtype=np.uint8).reshape(n, WINDOW)


class ByteNetwork:
    """Multi-width byte filters, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = np.zeros((len(WIDTHS) * FILTERS, len(labels)), dtype=np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)
        self.tables: list[list[np.ndarray]] | None = None

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        return [sum(table[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w)) for w, table in zip(WIDTHS, self.filters)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteNetwork:
        """Adam steps on the cross entropy; a pooled filter's gradient reaches the bytes at its largest response."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part, want = x[order[at : at + batch]], y[order[at : at + batch]]
                rows = np.arange(len(part))
                pooled, places = [], []
                for r in self._responses(part):
                    where = r.argmax(1)
                    places.append(where)
                    pooled.append(np.take_along_axis(r, where[:, None, :], 1)[:, 0])
                flat = np.concatenate(pooled, 1)
                hidden = np.tanh(flat)
                p = _softmax(hidden @ self.out + self.bias)
                p[rows, want] -= 1
                p /= len(part)
                back = (p @ self.out.T) * (1 - hidden**2)
                grads = []
                for n, w in enumerate(WIDTHS):
                    own, g = back[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(self.filters[n])
                    for k in range(w):
                        np.add.at(g[k], (part[rows[:, None], places[n] + k], np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [hidden.T @ p, p.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def prepare(self) -> ByteNetwork:
        """Joins the tables of neighbouring bytes to tables of byte pairs, for fewer look-ups."""
        self.tables = []
        for w, f in zip(WIDTHS, self.filters):
            pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self.tables.append(pairs + ([f[w - 1]] if w % 2 else []))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window."""
        codes = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, tables in zip(WIDTHS, self.tables):
            n = WINDOW - w + 1
            r = tables[0][codes[:, :n]]
            for k, table in enumerate(tables[1:], 1):
                r += table[codes[:, 2 * k : 2 * k + n]] if len(table) > 256 else table[x[:, 2 * k : 2 * k + n]]
            pooled.append(r.max(1))
        return _softmax(np.tanh(np.concatenate(pooled, 1)) @ self.out + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _predict(network: ByteNetwork, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores, chunk = [UNKNOWN] * len(texts), [0.0] * len(texts), 256
    waiting: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        x = np.concatenate([w for _, w in waiting])
        p = np.concatenate([network.probabilities(x[i : i + chunk]) for i in range(0, len(x), chunk)])
        weight = np.maximum((x != 32).sum(1), 1).astype(np.float64)
        ends = np.cumsum([len(w) for _, w in waiting])
        for (i, w), end in zip(waiting, ends):
            mean = np.average(p[end - len(w) : end], axis=0, weights=weight[end - len(w) : end])
            names[i], scores[i] = network.labels[int(mean.argmax())], float(min(1.0, mean.max()))
        waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)) and (data := _bytes(text)):
            waiting.append((i, _windows(data)))
            size += len(waiting[-1][1])
            if size >= 4096:
                settle()
                size = 0
    if waiting:
        settle()
    return names, scores


def train_language_id(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang") -> ByteNetwork | None:
    """A network fitted to a bounded sample of `labelled`; None if no row has a language and a letter.

    The sample takes about PER_LANGUAGE texts of each language, fewer if that were over SAMPLE in
    all, by a hash of `key`, and of each text up to WINDOWS_EACH windows spread over its length.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    counts = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "lang string, share double")
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    size = 2 * WINDOW
    starts = [F.greatest(F.lit(1), ((F.length(text) - size) * i / max(1, WINDOWS_EACH - 1)).cast("int") + 1) for i in range(WINDOWS_EACH)]
    cut = F.array_distinct(F.array(*[F.substring(F.col(text), s, F.lit(size)) for s in starts]))
    taken = rows.select(F.col(lang).cast("string").alias("lang"), cut.alias("parts"), chance.alias("chance")).join(F.broadcast(shares), "lang").where("chance < share")
    sample = taken.orderBy("chance", "lang", "parts").limit(2 * each * len(counts)).toPandas()
    labels = [r["lang"] for r in counts]
    x, y = [], []
    for name, parts in zip(sample["lang"], sample["parts"]):
        for part in parts:
            if data := _bytes(part):
                x.append(_windows(data[:WINDOW])[0])
                y.append(labels.index(name))
    if not x:
        return None
    return ByteNetwork(labels).fit(np.stack(x), np.array(y))


def language_id(docs: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred (a learned language) and score (its probability, 0 to 1).

    A null text or one without a letter gets `und` and 0, as does every text if there is no
    network. Rows are judged each, so repeated rows get equal results. Columns of `docs` named
    lang_pred or score are replaced; all others are passed on.
    """
    passed = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        net = shared.value and shared.value.prepare()
        return lambda texts: _predict(net, texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))

    return map_batches(docs, passed, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)
