"""Token alignment, collocations and SimHash components against plain Python and the tokenizers' libraries."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from triplespark.llm import phrases as P
from triplespark.llm import simhash_dedup as H
from triplespark.llm import token_alignment as A

from .test_operators import awkward, prose  # noqa: F401

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoders():
    return A.byte_level(tokenizers.path("byte_bpe_50k.json")), A.piece_level(tokenizers.path("piece_bpe_32k.model"))


ODD = [
    None, "", " ", "\n\n  x", "a" * 3000, "<|endoftext|> and <s> </s> <unk> <0x0A>", "▁ one ▁▁two", "Ünï 日本語 \U0001f600\x00\x0b", "It's they'll 've 12345 67\t\t8", "same text here", "same text here",
    "é è ‍́ ﻿", " leading and trailing ", prose(5, 4000), "\r\n\r\n", "\U0010ffff͸",
]


def aligned_by_hand(texts):
    """Rows from the libraries' own encoders, byte by byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    byte = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in byte.values())}
    docs, pairs = [], Counter()
    for text in texts:
        x = []
        if text:
            enc = a.encode(" " + text, add_special_tokens=False)
            ids_b = b.encode(text)
            bytes_a = [bytes(byte[c] for c in t) for t in enc.tokens]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                own_a = [n for n, t in enumerate(bytes_a) for _ in t]
                own_b = [n for n, t in enumerate(bytes_b) for _ in t]
                links = sorted(set(zip(own_a, own_b)))
                groups, i, j = [([], [])], -1, -1
                for at, (m, n) in enumerate(zip(own_a, own_b)):
                    if m != i and n != j and at:
                        groups.append(([], []))
                    if m != i:
                        groups[-1][0].append(enc.ids[m])
                    if n != j:
                        groups[-1][1].append(ids_b[n])
                    i, j = m, n
                text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
                x = [len(enc.ids), len(ids_b), len(groups), [(enc.ids[m], ids_b[n]) for m, n in links], hashlib.sha256(text.encode()).hexdigest()]
                pairs.update(x[3])
        docs.append(x)
    highest = defaultdict(int)
    for (_, n), c in pairs.items():
        highest[n] = max(highest[n], c)
    return [(x[0], x[1], x[2], len(x[3]), sum(pairs[p] == highest[p[1]] for p in x[3]), sum(pairs[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in docs]


@pytest.mark.parametrize("block, group", [(A.BLOCK, A.GROUP), (300, 4000)])
def test_alignment_against_brute_force(spark, encoders, block, group):
    texts = ODD + [prose(n % 7, 30 + n) for n in range(40)]
    docs = spark.createDataFrame([(n if n else None, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    found = A.token_alignment(docs, *encoders, block=block, group=group).collect()
    expected = {(n if n else None): row for n, row in enumerate(aligned_by_hand(texts))}
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:] == expected[r["doc_id"]], r["doc_id"]


def test_alignment_of_awkward_rows(spark, awkward, encoders):  # noqa: F811
    rows = A.token_alignment(awkward, *encoders).collect()
    assert len(rows) == awkward.count()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows)
    assert A.token_alignment(awkward.where("false"), *encoders).collect() == []


def test_runs_round_trip():
    r = np.random.default_rng(1)
    pairs = np.sort(r.integers(0, 1 << 39, 1000)).astype(np.uint64)
    docs, times = r.integers(0, 1 << 20, 1000), r.integers(1, 70_000, 1000)
    for x, y in zip(A.unpacked(A.packed(pairs, docs, times)), (pairs.astype(np.int64), docs, times)):
        assert (x == y).all()
    parts = [A.packed(pairs[n::3], docs[n::3], times[n::3]) for n in range(3)]
    seen = [(b, int(a), int(d)) for b, found in A.merged(parts) for _, ids, ds, _ in found for a, d in zip(ids, ds)]
    assert [b for b, _, _ in seen] == sorted(int(p) >> 20 for p in pairs)
    assert sorted(seen) == sorted((int(p) >> 20, int(p) & ((1 << 20) - 1), int(d)) for p, d in zip(pairs, docs))


def mined_by_hand(rows, support, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if c >= support and len(p) > 1}
        kept = []
        for p, a in found.items():
            around = [c for q, c in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= 80 * a for c in around):
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows():
    r = random.Random(3)
    words = ["the", "old", "Stone", "bridge", "é", "of", "sand", "a\x00b", "x_1"]
    rows = [(" ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\t", "\n"]) for _ in range(r.randint(1, 60))), r.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("New York City hall. " * 6, "en"), (None, "fr"), ("", "fr"), ("one one one one one one one one one", "es"), ("quick brown fox jumps", "de")] * 3
    return rows + [("quick brown fox jumps", "de")] * 9


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 3, "block": 50}, {"block": 400, "most_bits": 1 << 16}])
@pytest.mark.parametrize("support", [3, 10])
def test_collocations_against_brute_force(spark, options, support):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, n int, phrase int").repartition(3)
    found = sorted(tuple(r) for r in P.collocations(docs, support=support, **options).collect())
    assert found == mined_by_hand(rows, support)


def test_numbers_of_phrases():
    r = random.Random(3)
    block = P.Block()
    for n in range(60):
        block.add(" ".join(r.choice("abcdefgh") for _ in range(40)).encode(), f"l{n % 3}".encode(), 0)
    block.close()
    for k in range(1, P.LONGEST + 1):
        at = block.starts(k)
        phrases = [(block.lang[x], *block.ids[x : x + k]) for x in at]
        for largest in (P.LARGEST, 20_000):  # without and with numbers that don't fit
            found = block.numbers(at, k, largest).tolist()
            assert len(set(found)) == len(set(phrases)) == len(set(zip(found, phrases)))


def test_collocations_of_awkward_rows(spark, awkward):  # noqa: F811
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    assert sorted(tuple(r) for r in P.collocations(awkward, top=7).collect()) == mined_by_hand(rows, 30, 7)
    assert P.collocations(awkward.where("false")).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 5_000_000_000_000
    counts = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, 2 * big + 1), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, n long")
    monkeypatch.setattr(P, "phrase_counts", lambda *a, **b: counts)
    row = P.collocations(None).first()
    assert row["score"] == 2000000 * (big - 1) // (3 * big + 2)


def test_frequent_phrases_are_frequent_in_a_shard():
    for support in range(1, 80):
        for shards in range(1, 9):
            least = (support - 1) // shards + 1
            assert shards * (least - 1) < support


def words_of(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def print_by_hand(text):
    words = words_of(text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    owner = {k: k for k in prints}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                owner[y] = x
    return {k: root(k) for k in keys}


def test_fingerprints(awkward):  # noqa: F811
    texts = [r["text"] for r in awkward.collect()]
    assert [H.fingerprint(None if t is None else t.encode()) for t in texts] == [print_by_hand(t) for t in texts]


def simhash_texts():
    r = random.Random(9)
    texts = [None, "", " ", "one", "ONE", "two words"]
    for n in range(25):
        base = [r.choice("river stone green walk light paper seven under over hill lake".split()) + str(r.randint(0, 9)) for _ in range(r.choice([40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("rows", [H.ROWS, 1])
def test_simhash_components_against_brute_force(spark, rows):
    texts = simhash_texts()
    docs = spark.createDataFrame([(n + 5, t, 1, 2) for n, t in enumerate(texts)], "doc_id long, text string, print int, component int")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.simhash_dedup(docs, rows=rows).collect()}
    prints = {n + 5: print_by_hand(t) for n, t in enumerate(texts)}
    expected = components_by_hand(prints)
    assert len(set(expected.values())) < len(set(prints.values()))
    assert found == {k: (f"{prints[k]:016x}", expected[k]) for k in prints}


def test_simhash_awkward_rows(awkward):  # noqa: F811
    rows = H.simhash_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert H.simhash_dedup(awkward.where("false")).collect() == []


@pytest.mark.parametrize("rows", [H.ROWS, 3])
def test_all_links_of_fingerprints(spark, rows):
    """Every number of differing bits around random, empty and full fingerprints, and a chain of near ones."""
    r = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for centre in [0, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(30))]:
        for bits in (1, 2, 3, 4, 5):
            for _ in range(3):
                prints.add(centre ^ sum(1 << b for b in r.sample(range(64), bits)))
        prints.add(centre)
    chain = r.getrandbits(64)
    for step in range(20):
        chain ^= sum(1 << b for b in r.sample(range(64), 3))
        prints.add(chain)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    cells = H._cells(spark.createDataFrame([(x,) for x in signed], "print long"))
    links = H._links(cells, rows)
    found = [(x["a"], x["b"]) for x in links.where("near is null").collect()]
    found += [(x["a"], x["b"]) for x in H._links(H._split(links.where("near is not null")), None).collect()]
    as_unsigned = {x: x % (1 << 64) for x in signed}
    assert all((as_unsigned[a] ^ as_unsigned[b]).bit_count() <= 3 for a, b in found)
    by_links = {x: x for x in signed}

    def root(x):
        while by_links[x] != x:
            x = by_links[x]
        return x

    for a, b in found:
        x, y = sorted((root(a), root(b)))
        by_links[y] = x
    assert {x: root(x) for x in signed} == components_by_hand(as_unsigned)
