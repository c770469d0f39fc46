"""Benchmark decontamination: test items found in texts within an edit budget.

An item with a budget of k edits is split into k + 1 pieces; a text that holds the item within
the budget holds at least one piece unchanged. One automaton finds all pieces of a block of
items in one pass over each whole text, and bit-parallel edit distance verifies the places.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Edits allowed for each character of an item.
BUDGET = 0.05
#: Characters of items in one pass over the texts; more items take more passes.
BLOCK = 20_000_000
#: Items shorter than this match at word ends only.
SHORT = 40

#: Every ASCII character but letters and digits becomes a space.
_ASCII = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> str:
    """Lower case, with one space for each run of anything but letters and digits."""
    if not isinstance(text, str):
        return ""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if not c.isalnum():
                text = text.replace(c, " ")
    return b" ".join(text.encode("utf-8", "ignore").translate(_ASCII).split()).decode()


def best_place(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of `text` nearest to `item`, if within `most` edits; the first of equals.

    Myers' bit vectors: bit i tells how the distance changes from row i to i + 1.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | (full & ~(d0 | up)), d0 & up
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp = hp << 1 & full
        up, down = (hn << 1 & full) | (full & ~(d0 | hp)), d0 & hp
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, j + 1)
    return best


class Items:
    """A block of items: their pieces in one automaton."""

    def __init__(self, items: list[tuple[object, str]], budget: float = BUDGET):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            if not (words := plain(text)):
                continue
            words = f" {words} " if len(words) < SHORT else words
            n, most = len(self.items), int(len(words) * budget)
            self.items.append((key, words, most))
            ends = [len(words) * i // (most + 1) for i in range(most + 2)]
            for a, b in zip(ends, ends[1:]):
                pieces.setdefault(words[a:b], []).append((n, a))
        self.find = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.find.add_word(piece, (len(piece), places))
        if pieces:
            self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, distance, end in the plain text) for each item that the whole text holds; its best place, the first of equals."""
        if not self.items or not (words := plain(text)):
            return []
        words = f" {words} "
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.find.iter(words):
            for n, a in places:
                starts.setdefault(n, set()).add(end + 1 - length - a)
        # Hits come by their end, so starts are in order only once all are known.
        spans: dict[int, list[list[int]]] = {}
        for n, all_starts in starts.items():
            most, seen = self.items[n][2], spans.setdefault(n, [])
            for start in sorted(all_starts):
                if seen and start - seen[-1][1] <= most:
                    seen[-1][1] = start
                else:
                    seen.append([start, start])
        found = []
        for n, merged in spans.items():
            key, item, most = self.items[n]
            best = None
            for first, last in merged:
                low, high = max(0, first - most), last + len(item) + most
                if first >= 0 and words[first : first + len(item)] == item:
                    place = (0, first + len(item))
                else:
                    near = best_place(item, words[low:high], most)
                    place = near and (near[0], near[1] + low)
                if place and (best is None or place < best):
                    best = place
            if best:
                found.append((key, best[0], best[1] - 1))
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """(key, item_id, distance, end) for each row of `docs` and item that its whole text holds.

    Case, punctuation and white space don't count. `distance` is the least number of edits, at
    most `budget` for each character of the item; `end` is where the best place ends in the
    plain text, the first of equals. Null and empty texts hold nothing, null and empty items
    are in no text, and repeated rows are reported each. Items are read in blocks of `block`
    characters, each with a pass of its own, so a benchmark of any size is searched.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block))
    schema = T.StructType([docs.schema[key], T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("distance", T.LongType()), T.StructField("end", T.LongType())])
    arrow = to_arrow_schema(schema)
    docs = docs.select(key, text)
    out = None
    for n in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n).orderBy("item", "text")
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, budget)
            for batch in batches:
                rows = [(k, *m) for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()) for m in known.matches(t)]
                columns = list(zip(*rows)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        found = docs.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out
