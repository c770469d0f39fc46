"""The training-data operators on small and awkward inputs, against plain Python."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplespark.llm import decontaminate as D
from triplespark.llm import html_extract as H
from triplespark.llm import jaccard_join as J
from triplespark.llm import language_id as L
from triplespark.llm import license_scan as C
from triplespark.llm import lm_score as M
from triplespark.llm import quality_classifier as K
from triplespark.llm import quality_rules as Q
from triplespark.llm import sentencepiece as E
from triplespark.llm import url_filters as U

BIG = (1 << 62) + 1
WORDS = "the of and to in that house river stone green walk light paper seven under over".split()


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n)) + "."


#: Null, empty and blank texts, ties and repeats, control characters, scripts, a very long text; null and very large keys.
AWKWARD = [None, "", " \n\t", "x", "#$%&| !!", prose(1), prose(1), "Ünï 日本語 \U0001f600 \x00\x0b", "a\n" * 50, "MIT License. " * 40, prose(2, 30_000), "wwww" * 5000]


@pytest.fixture(scope="module")
def awkward(spark):
    keys = [None, BIG, *range(2, len(AWKWARD))]
    rows = [(k, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", "mine", i, "d", 0.5) for i, (k, t) in enumerate(zip(keys, AWKWARD))]
    # Columns with names that the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, f string, n long, grp string, score double")


@pytest.fixture(scope="module")
def model():
    return E.Model(["<unk>", "▁", "a", "b", "ab", "▁ab", "ba"], [0, -2.0, -3.0, -3.0, -2.5, -4.0, -2.6], {}, {0}, 0, False)


def runs(model):
    network = L.ByteNetwork(["de", "en"])
    return {
        "license": lambda d: C.license_scan(d),
        "language": lambda d: L.language_id(d, network),
        "no language": lambda d: L.language_id(d, None),
        "jaccard": lambda d: J.jaccard_join(d),
        "rules": lambda d: Q.quality_rules(d),
        "lm": lambda d: M.lm_score(d, F.lit(True)),
        "lm without training": lambda d: M.lm_score(d, F.lit(False)),
        "classifier": lambda d: K.quality_classifier(d, None),
        "pieces": lambda d: E.decode(E.encode(d, model), model),
        "urls": lambda d: U.url_filters(d, "text"),
        "html": lambda d: H.extract_html(d, "text", "main"),
    }


@pytest.mark.parametrize("name", runs(None))
def test_awkward_and_empty(awkward, model, name):
    run = runs(model)[name]
    out = run(awkward)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in awkward.collect()}
    if name != "jaccard":
        assert {"f", "n", "grp"} <= set(out.columns) and all(r["f"] == "mine" and r["grp"] == "d" for r in rows)
    assert run(awkward.limit(0)).collect() == []


def test_decontaminate_awkward(spark, awkward):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " . "), (4, prose(1)), (5, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(awkward, items).collect()}
    assert got == {(5, 4), (6, 4), (3, 5)}
    assert D.decontaminate(awkward, items.limit(0)).collect() == [] and D.decontaminate(awkward.limit(0), items).collect() == []
    blocks = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(awkward, items, block=100).collect()}
    assert blocks == got


def edits(a: str, b: str) -> int:
    """Least edits of `a` to any substring of `b`."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_matching_against_brute_force():
    r = random.Random(5)
    items = [(n, D.plain(prose(100 + n, 12))) for n in range(6)]
    known = D.Items(items, 0.1)
    for trial in range(60):
        n, item = r.choice(items)
        x = list(item)
        for _ in range(r.randrange(12)):
            at = r.randrange(len(x))
            x[at : at + 1] = r.choice([[], [x[at], "q"], ["z"]])
        text = prose(trial, 15) + " " + "".join(x) + " " + prose(trial + 1, 15)
        want = {k: edits(w, f" {D.plain(text)} ") for k, w, m in known.items if edits(w, f" {D.plain(text)} ") <= m}
        assert {k: d for k, d, _ in known.matches(text)} == want


def test_items_that_repeat_a_passage():
    """Copies edited before the passage comes back: the first hits by end have the later starts."""
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    for trial in range(40):
        head = letters(60)
        item = head + letters(140) + head + letters(140)
        known = D.Items([(1, item)])
        most = known.items[0][2]
        copy = list(item)
        for at in sorted(r.sample(range(200), r.randrange(9, most + 3))):
            copy[at] = "~" if trial % 2 else r.choice("xyz")
        text = letters(70) + "".join(copy).replace("~", "q") + letters(250)
        want = edits(item, f" {text} ")
        assert [d for _, d, _ in known.matches(text)] == ([want] if want <= most else [])
    # The case of the review: eleven edits in the pieces before the passage's return.
    head = letters(60)
    item = head + letters(140) + head + letters(140)
    copy = "".join("é" if i < 200 and i % 19 == 9 else c for i, c in enumerate(item))
    assert [d for _, d, _ in D.Items([(1, item)]).matches(letters(69) + copy + letters(250))] == [11]


def test_components_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for base in range(12):
        words = prose(base, r.choice([3, 12, 60, 200])).split()
        for _ in range(r.choice([1, 4, 9])):
            copy = list(words)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = r.choice(WORDS) + "x"
            texts.append(" ".join(copy))
    texts += [None, "", "one two", "ONE  two", "one two"]
    sets = [set() if not t or not t.split() else ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}) for t in texts for w in [(t or "").lower().split()]]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    got = {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(s), up[i]) for i, s in enumerate(sets)}


def test_signatures_and_sketches_lose_no_pair():
    r = np.random.default_rng(1)
    bands = J.Bands(85)
    for size in (5, 8, 20, 60, 300):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))
            out = r.integers(0, max(1, size // 12) + 1)
            b = np.unique(np.concatenate([a[out:], r.integers(0, 1 << 62, r.integers(0, max(1, size // 12) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(J.signatures(a, bands)) & set(J.signatures(b, bands))
            apart = sum(int(x).bit_count() for x in (J.sketch(a) ^ J.sketch(b)).view(np.uint64))
            assert apart <= len(a) + len(b) - 2 * both


def test_subsets_of_partitions_are_enumerated():
    bands = J.Bands(85)
    shapes = [bands.partitions(b) for b in range(bands.band(3000))]
    assert all(n1 * (k2 + 1) > k and n2 > k2 for k, n1, n2, k2 in shapes) and any(k2 for _, _, _, k2 in shapes)
    r = np.random.default_rng(8)
    for size in (7, 9, 13, 20, 23, 48):
        a = r.integers(0, 1 << 62, size).astype(np.uint64)
        k, n1, n2, k2 = bands.partitions(bands.band(size))
        assert len(J.signatures(a, bands)) >= min(n1 * math.comb(n2, k2), size) / 2


def test_unrelated_sets_share_no_bucket():
    """Also those whose features fall into few partitions."""
    r = np.random.default_rng(2)
    bands = J.Bands(85)
    for size in (1, 2, 5, 6, 7, 8, 10, 13, 20, 60, 200):
        n = 4000 if size < 60 else 800
        held = Counter()
        for _ in range(n):
            held.update(J.signatures(np.unique(r.integers(0, 1 << 62, size).astype(np.uint64)), bands).tolist())
        assert max(held.values()) == 1


def test_unevenly_dealt_sets_are_dealt_again():
    """Pairs of which both have all features in few partitions of the first function, and differ in each of these."""
    r = np.random.default_rng(3)
    bands = J.Bands(85)
    k, n1, n2, k2 = bands.partitions(bands.band(7))
    place = lambda x: int(J._mix(np.array([x], np.uint64) ^ J._P[1])[0] % np.uint64(n1 * n2))
    pool = [x for x in r.integers(0, 1 << 62, 4000).astype(np.uint64) if place(x) == 0]
    for i in range(0, 700, 7):
        a = np.sort(np.array(pool[i : i + 7], np.uint64))
        b = a[1:]  # 6 of 7
        assert set(J.signatures(a, bands)) & set(J.signatures(b, bands))


def test_statistics_against_brute_force(spark, awkward):
    for r in Q.text_statistics(awkward.select("doc_id", "text")).collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_outliers(spark):
    good = [(i, prose(i, 100), "en", "a") for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in prose(i, 100).split()), "en", "a") for i in range(10)]
    out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[1000 + i] for i in range(10)) and all(out[i] for i in range(150))


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_outliers_are_many(spark, share):
    """A group of which a large share is junk of one kind."""
    n = 200
    junk = int(n * share)
    for worse in (lambda w: f"{w}###", str.upper):
        rows = [(i, " ".join(map(worse, prose(i, 100).split())) if i < junk else prose(i, 100), "en", "a") for i in range(n)]
        out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert [i for i in range(n) if out[i]] == list(range(junk, n))


def least_determinant(x: np.ndarray, starts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps from each start (mean, inverse): log-determinant, mean and covariance of the best half."""
    floors = np.diag(np.square(Q.FLOORS))
    best = (np.inf, None, None)
    for m, inv in starts:
        last = np.inf
        while True:
            z = x - m
            d = np.einsum("ij,jk,ik->i", z, inv, z)
            own = x[d <= np.sort(d)[(len(x) + 1) // 2 - 1]]
            m, cov = own.mean(0), Q.HALF * np.cov(own.T, bias=True) + floors
            inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            if det < best[0]:
                best = (det, m, cov)
            if det >= last - 1e-6:
                break
            last = det
    return best


def stated_starts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Medians and deviations, all rows, and the half nearest to the median in each feature."""
    middle = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
    floors = np.square(Q.FLOORS)
    m = np.array([middle(c) for c in x.T])
    mad = np.array([middle(c) for c in np.abs(x - m).T])
    sets = [x] + [x[np.abs(x[:, i] - m[i]) <= mad[i]] for i in range(Q.D)]
    return [(m, np.diag(1 / ((1.4826 * mad) ** 2 + floors)))] + [(s.mean(0), np.linalg.inv(np.cov(s.T, bias=True) + np.diag(floors))) for s in sets]


def random_starts(x: np.ndarray, r: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    sets = [x[r.choice(len(x), Q.D + 1, replace=False)] for _ in range(100)]
    return [(s.mean(0), np.linalg.inv(np.cov(s.T, bias=True) + np.diag(np.square(Q.FLOORS)))) for s in sets]


def reweighted(x: np.ndarray, m: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    near = x[d <= max(np.sort(d)[(len(x) + 1) // 2 - 1] / 4.35, 1.0) * 12.83]
    return near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) + np.diag(np.square(Q.FLOORS)))


@pytest.mark.parametrize("groups", [20_000, 0])
def test_estimates_match_numpy(spark, monkeypatch, groups):
    """The estimates from all starts; with params broadcast, and with salted groups. Random starts find no half that is much better."""
    monkeypatch.setattr(Q, "GROUPS", groups)
    monkeypatch.setattr(Q, "BEST", 7)
    r = np.random.default_rng(4)
    want, rows = {}, []
    for name, share in (("a", 0.0), ("b", 0.25), ("c", 0.42)):
        mix = r.normal(size=(Q.D, Q.D)) * 0.4
        x = r.normal(size=(300, Q.D)) @ mix
        x[: int(300 * share)] += 6
        det, m, cov = least_determinant(x, stated_starts(x))
        assert det < least_determinant(x, random_starts(x, r))[0] + 0.15
        want[name] = reweighted(x, m, cov)
        assert share == 0 or abs(want[name][0]).max() < 0.3
        rows += [(name, v.tolist()) for v in x]
    got = Q.minimum_covariance(spark.createDataFrame(rows, "grp string, f array<double>")).collect()
    assert sorted(g["grp"] for g in got) == ["a", "b", "c"]
    for g in got:
        assert np.allclose(g["m"], want[g["grp"]][0], atol=1e-6) and np.allclose(g["inv"], want[g["grp"]][1], rtol=1e-4, atol=1e-6)


def test_verdict_against_brute_force(spark, monkeypatch):
    """Every row's distance and verdict, by the estimate of its source, its language or the whole table."""
    rows = []
    for i in range(260):
        x = prose(i, 60 + i % 50)
        x = " ".join(f"{w}##" for w in x.split()) if i % 23 == 0 else x.upper() if i % 31 == 0 else x
        lang, source = ("en", "a") if i < 120 else ("en", "b") if i < 150 else ("de", None) if i < 240 else (None, "c")
        rows.append((i, x, lang, source))
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, "one two " * 40, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    x = {q["doc_id"]: (np.array(q["v"]), q["bad"]) for q in Q.text_statistics(docs).select("doc_id", Q.features().alias("v"), Q.base_failed().alias("bad")).collect()}
    good = [k for k, (_, bad) in x.items() if not bad]
    place = {k: (lang, source) for k, _, lang, source in rows}
    monkeypatch.setattr(Q, "BEST", 7)
    estimates: dict = {}

    def estimate(level: tuple) -> tuple[np.ndarray, np.ndarray]:
        if level not in estimates:
            own = np.array([x[k][0] for k in good if place[k][: len(level)] == level])
            estimates[level] = reweighted(own, *least_determinant(own, stated_starts(own))[1:])
        return estimates[level]

    size = lambda level: sum(place[k][: len(level)] == level for k in good)
    out = {q["doc_id"]: q for q in Q.quality_rules(docs).collect()}
    assert len(out) == len(rows) and any(not out[k]["kept"] for k in good) and sum(out[k]["kept"] for k in good) > 200
    for k, (v, bad) in x.items():
        level = next(n for n in (place[k], place[k][:1], ()) if n == () or size(n) >= 60)
        m, inv = estimate(level)
        d2 = float((v - m) @ inv @ (v - m))
        assert out[k]["base_failed"] == bad and out[k]["kept"] == (not bad and d2 <= Q.CUT)
        if not bad:
            assert abs(out[k]["d2"] - d2) < 1e-4 * max(1.0, d2)


def test_determinant_matches_numpy(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(Q.D, Q.D))
    a = a @ a.T + np.eye(Q.D)
    got = spark.createDataFrame([(a.tolist(),)], "m array<array<double>>").select(Q._log_det(F.col("m"))).first()[0]
    assert np.isclose(got, np.linalg.slogdet(a)[1])


def test_inverse_matches_numpy(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(Q.D, Q.D))
    a = a @ a.T + np.eye(Q.D)
    got = spark.createDataFrame([(a.tolist(),)], "m array<array<double>>").select(Q._inverse(F.col("m"))).first()[0]
    assert np.allclose(got, np.linalg.inv(a))


def test_licences(spark):
    mit = C.TEMPLATES[3].text.capitalize()
    rows = [(1, "GNU General-Public  LICENSE and the mit license"), (2, mit), (3, "apache\nlicense " * 3), (4, "gnu public general license"), (5, None)]
    got = {r["doc_id"]: r for r in C.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 6, "gpl,mit")
    assert got[2]["labels"] == "mit" and got[2]["base_labels"] == "" and got[2]["score"] > 0.9
    assert (got[3]["n_base"], got[3]["last_word"], got[3]["labels"]) == (3, 4, "apache")
    assert got[4]["n_base"] == got[5]["n_base"] == 0 and got[4]["score"] == got[5]["score"] == 0 and got[5]["first_word"] is None


def test_licences_against_brute_force(spark):
    """All base columns, with letters beyond A-Z that lower to ASCII left alone."""
    r = random.Random(7)
    pool = "gnu GPL general Public license Apache LICENSE cc by MIT the \u212aernel of".split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(30))) + r.choice(["", "\n", " CC-BY! apache-license", "M\u0130T license"]) for _ in range(300)]
    for q in C.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[q["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(i, label) for phrase, label in C.BASE.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places = [i for i, _ in found]
        assert (q["n_words"], q["n_base"], q["first_word"], q["last_word"]) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert q["base_labels"] == ",".join(sorted({x for _, x in found})) and {x for _, x in found} <= set(q["labels"].split(","))


def test_network_probabilities_against_a_loop():
    """The forward pass, window by window, position by position."""
    network = L.ByteNetwork(["de", "en", "fr"], seed=3)
    r = np.random.default_rng(4)
    network.out, network.bias = r.normal(size=network.out.shape).astype(np.float32), r.normal(size=3).astype(np.float32)
    x = r.integers(97, 123, (5, L.WINDOW)).astype(np.uint8)
    for row, got in zip(x, network.prepare().probabilities(x)):
        pooled = []
        for w, table in zip(L.WIDTHS, network.filters):
            responses = [sum(table[k][row[i + k]] for k in range(w)) for i in range(L.WINDOW - w + 1)]
            pooled.append(np.max(responses, 0))
        z = np.tanh(np.concatenate(pooled)) @ network.out + network.bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-3)


def test_all_languages_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 20, f"l{i % 230}") for i in range(460)]
    network = L.train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id"))
    assert len(network.labels) == 230


def test_languages(spark):
    rows = []
    for i in range(160):
        r = random.Random(i)
        pick = ["ich", "und", "der", "straße", "über", "nicht", "schön"] if i % 2 else ["the", "and", "with", "street", "over", "not", "nice"]
        rows.append((i, " ".join(r.choice(pick) for _ in range(40)), "de" if i % 2 else "en"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = L.train_language_id(d.where("doc_id < 120"), F.col("doc_id"))
    got = L.language_id(d.where("doc_id >= 120"), network).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    assert [tuple(r)[-2:] for r in L.language_id(spark.createDataFrame([(1, "123 !")], "doc_id long, text string"), network).collect()] == [("und", 0.0)]


def plain_model(learned):
    """Plain counts of words, pairs and triples of the training texts, and the log-probability of a text."""
    start = b" start"
    rows = [[start, *t] for t in learned]
    one, two, three = (Counter(g for r in rows for g in zip(*[r[k:] for k in range(n)])) for n in (1, 2, 3))
    two, three = ({g: c for g, c in x.items() if c >= 2} for x in (two, three))
    total = sum(map(len, learned))
    distinct = len({w for t in learned for w in t})
    used2, used3 = Counter(), Counter()
    for (a, _), c in two.items():
        used2[a] += c - 0.5
    for (a, b, _), c in three.items():
        used3[a, b] += c - 0.5
    first = lambda w: (one[(w,)] + 0.1) / (total + 0.1 * (distinct + 1))

    def second(a, w):
        return (two[a, w] - 0.5 if (a, w) in two else 0) / max(one[(a,)], 1) + (1 - used2[a] / max(one[(a,)], 1)) * first(w)

    def third(a, b, w):
        t = two.get((a, b), 1)
        return (three[a, b, w] - 0.5 if (a, b, w) in three else 0) / t + (1 - used3[a, b] / t) * second(b, w)

    def score(words):
        row = [start, *words]
        return sum(math.log10(third(*row[i - 2 : i + 1]) if i > 1 else second(*row[:2])) for i in range(1, len(row)))

    return one, two, three, used2, used3, total, distinct, first, score


def test_automaton_sums_to_one():
    learned = [M.tokens(prose(i, 60)) for i in range(40)]
    one, two, three, used2, used3, total, distinct, _, score = plain_model(learned)
    words = [b" start", b"", *sorted({w for t in learned for w in t if w})]
    ids = {w: i for i, w in enumerate(words)}
    pairs = [(ids[a], ids[b], c, used3[a, b]) for (a, b), c in two.items()]
    at = {g: i for i, g in enumerate(two)}
    triples = [(at[g[:2]], at[g[1:]], ids[g[2]], c) for g, c in three.items()]
    a = M.build(np.array([one[(w,)] for w in words]), np.array([float(used2[w]) for w in words]), tuple(map(np.array, zip(*pairs))), tuple(map(np.array, zip(*triples))), total, distinct)
    begin = a.start
    for t in learned[:5]:
        assert abs(a.walk([ids[w] for w in t]) - score(t)) < 1e-6
    for state in (0, *a.fails):
        a.start = state
        mass = sum(10 ** a.walk([w]) for w in range(1, len(words)))
        rest = 0.0
        while state:
            log, state = a.fails[state]
            rest += log
        assert abs(mass + 10**rest * 0.1 / (total + 0.1 * (distinct + 1)) - 1) < 1e-6
    assert begin and len(a.fails) > 20


def test_texts_are_walked_side_by_side(spark, monkeypatch):
    """Pieces of texts take a word of each at a time, as many rounds as a piece has words, and give each text's whole walk."""
    rows = [(i, prose(i % 9, 1 + i * i)) for i in range(30)] + [(30, None), (31, prose(3, 4 * M.PIECE) + " unheard of")]
    learned = [M.tokens(t) for i, t in rows if i % 5]
    one, two, three, used2, used3, total, distinct, _, score = plain_model(learned)
    words = [b" start", b"", *sorted({w for _, t in rows for w in M.tokens(t) if w})]
    ids = {w: i for i, w in enumerate(words)}
    at = {g: i for i, g in enumerate(two)}
    pairs = [(ids[a], ids[b], c, used3[a, b]) for (a, b), c in two.items()]
    triples = [(at[g[:2]], at[g[1:]], ids[g[2]], c) for g, c in three.items()]
    a = M.build(np.array([one[(w,)] for w in words]), np.array([float(used2[w]) for w in words]), tuple(map(np.array, zip(*pairs))), tuple(map(np.array, zip(*triples))), total, distinct)
    texts = [[0, *[ids[w] for w in M.tokens(t)]] for _, t in rows]
    row, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    rounds, step = [], M.Automaton.step
    monkeypatch.setattr(M.Automaton, "step", lambda *x: rounds.append(len(x[1])) or step(*x))
    expected = [score(M.tokens(t)) for _, t in rows]
    for piece in (2, 3, 50, M.PIECE, 10**6):
        rounds.clear()
        assert np.abs(a.walks(row, sizes, piece) - expected).max() < 1e-6
        assert len(rounds) == min(piece + 2, sizes.max() - 1) and min(rounds) > 0
    assert a.walks(row[:0], sizes[:0]).tolist() == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in M.lm_score(docs, F.col("doc_id") % 5 != 0).collect():
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-6


@pytest.mark.parametrize("chunk", [40, M.CHUNK])
def test_scores_by_brute_force(spark, chunk, monkeypatch):
    """All pairs and triples from two occurrences on, however texts fall into blocks."""
    monkeypatch.setattr(M, "LEAST_BUCKETS", 3)
    rows = [(i, f"{prose(i % 25, 40)} rare{i % 7} pair{i % 7} here{i % 7}") for i in range(60)] + [(60, None), (61, "never rare1 PAIR1 seen"), (62, ""), (63, "x"), (None, "rare1\x0bpair1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = [M.tokens(t) for i, t in rows if i and i % 5]
    one, *_, total, distinct, first, score = plain_model(learned)
    got = M.lm_score(docs, F.col("doc_id") % 5 != 0, chunk=chunk).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, rows))
    for r in got:
        words = M.tokens(r["text"])
        assert abs(r["score"] - score(words)) < 1e-6
        assert abs(r["base_score"] - sum(math.log10(first(w)) for w in words)) < 1e-6
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(one[(w,)] > 0 for w in words), total)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_scores_without_training_or_rows(spark):
    rows = [(i, "alpha beta") for i in range(5)] + [(9, "gamma alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.lm_score(docs, F.lit(None).cast("boolean")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 6
    assert M.lm_score(docs.limit(0), F.lit(True)).collect() == []
    got = M.lm_score(docs.withColumns({"block": F.lit(1), "Score": F.lit("x"), "b.c": F.array(F.lit(2))}), F.col("doc_id") < 5, keep_text=False)
    assert got.columns == ["doc_id", "block", "b.c", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {(r["doc_id"], r["block"], tuple(r["b.c"]), r["n_known"]) for r in got.collect()} == {*[(i, 1, (2,), 3) for i in range(5)], (9, 1, (2,), 2)}


def test_url_rules():
    globs = [U.Glob("block", "*.ads.*", "*"), U.Glob("block", "*", "*/b?n/*x")]
    a = U.WildcardAutomaton([g.tokens() for g in globs])
    r = random.Random(1)
    urls = [("".join(r.choice(".adsb") for _ in range(r.randrange(9))), "".join(r.choice("/bnx") for _ in range(r.randrange(10)))) for _ in range(500)]
    got = a.matches([f".{h}".encode() + b"\xff" + p.encode() for h, p in urls])
    like = lambda g, x: re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), x) is not None
    for (h, p), row in zip(urls, got):
        assert row.tolist() == [like(g.host, f".{h}") and like(g.path, p) for g in globs]


def test_url_filters(spark):
    urls = [None, "", "no", "http://COM/en/", "https://a.Example.com/en/7?x", "http://b.net/de/8", "http://example.net/de/8#s", "http://x.org/a.com/en/", "http://com/en", "http://x.ads.y/", "http://notcom/en/"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in U.url_filters(spark.createDataFrame([(u,) for u in urls], "url string")).collect()]
    assert [g[2] for g in got] == [None, None, None, "com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, None, None, None]
    assert [g[3] for g in got] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert got[4][:2] == ("a.example.com", "/en/7") and got[0][:2] == ("", "")


def test_url_globs_of_hosts_and_paths(spark):
    """The list as it stands, each pattern alone against every host and path."""
    hosts = ["m.casino-win.example.com", "free-bets.example.com", "bets.example.com", "alphabets.example.com", "cheap-pills.example.com", "spills.example.com", "x.ads.y", "ads.x.com", "roads.x.com", "a.xxx", "xxx.a.com", ""]
    paths = ["", "/", "/ads/1", "/roads/1", "/x/banner1/y", "/x/banners/y", "/x/banner/y", "/login?x", "/a/login.html", "/f.exe", "/f.exe.html", "/cart", "/cart/1"]
    like = lambda g, x: re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), x) is not None
    rows = [(f"http://{h}{p}",) for h in hosts for p in paths]
    for r in U.url_filters(spark.createDataFrame(rows, "url string"), rules=()).collect():
        assert r["verdict"] == ("block" if any(like(g.host, f".{r['host']}") and like(g.path, r["path"]) for g in U.GLOBS) else "allow")


def test_html():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></ul></nav><div class="cookie-notice">We use, cookies, a lot.</div>
    <div id=wrap><div class="content"><h1>T &amp; t</h1><p>One, two, three and a&nbsp;long
    text here.<p>Second <b>bold</b> paragraph.<ul><li>item one<li>item two</ul></div>
    <aside>Side, bar, text, that is long, very long.</aside></div><section id="comments"><p>Nice, article, I, say.</p></section><form><p>Mail</p></form><script>var x = "<p>no</p>";</script><footer>f</footer></body></html>"""
    assert H.main_text(page) == "T & t\nOne, two, three and a long text here.\nSecond bold paragraph.\nitem one\nitem two"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("just text") == "just text"
    assert H.main_text("<b>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("names", ["content has-sidebar", "entry-content comments-open", "main-content with-sidebar", "post social-share-enabled", "no-sidebar", "article-body share"])
def test_html_names_around_an_article(names):
    text = [f"{prose(i, 40)} One, two, {i}." for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in text)
    assert H.main_text(f'<div><nav>Home</nav><div class="{names}">{body}</div><div class="sidebar"><p>Other, things.</p></div></div>') == "\n".join(text)


def test_html_keeps_long_articles_whole():
    long = [f"{prose(i, 40)} One, two, three, four, {i}." for i in range(40)]
    paragraphs = "".join(f"<p>{x}</p>" for x in long)
    whole = "\n".join([*long, "Closing words."])
    for page in (
        f"<article><div>{paragraphs}</div><div><p>Closing words.</p></div></article>",
        f"<main><div><div>{paragraphs}</div></div><section><p>Closing words.</p></section></main>",
        f"<body><div>{paragraphs}</div><div><p>Closing words.</p></div></body>",
        f'<div class="content has-sidebar">{paragraphs}<p>Closing words.</p><div class="sidebar"><p>Other, things.</p></div></div>',
        f'<div class="post with-comments">{paragraphs}<p>Closing words.</p></div><div id="comments"><p>Nice, I say.</p></div>',
        f'<section class="share-enabled">{paragraphs}<p>Closing words.</p><nav>Home</nav></section>',
    ):
        assert H.main_text(page) == whole
    links = "".join(f"<a href=x>Other article {i}</a> " for i in range(9))
    assert H.main_text(f"<article>{paragraphs}<p>Closing words.</p></article><div>{links}</div>") == whole


HOSTILE = {
    "open tags": ("<a", 0), "open quotes": ("<a x='", 0), "bold": ("<b>", "</i>"), "links": ("<a>", 0), "paragraphs in bold": ("<p><b>", 0), "mixed quotes": ("<a '\">", 0), "rows": ("<tr><td>", 0),
    "headers": ("<div>", "<header></header>"), "items": ("<div>", "<li></li>"), "comments": ("<!--", 0), "raw": ("<script>", "</script"), "number": ("&#", "9"), "zeros": ("&#", "0"), "less than": ("<", 0),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_malformed_pages_take_linear_time(name):
    first, second = HOSTILE[name]
    build = lambda n: f"<p>Before, all.</p>{first * n}{second * n if second else ''}"
    times = []
    for size in (125_000, 1_000_000):
        page = build(size // len(first + (second or "")))
        began = time.process_time()
        H.main_text(page)
        times.append(time.process_time() - began)
    assert times[1] < 8 and times[1] < 30 * max(times[0], 0.05)


def test_html_malformed_pages():
    assert H.main_text("<p>a < b <3 & c&lt;d &#0000065; &#99999999999; &#xFFFFFFFFFF;</p>") == "a < b <3 & c<d A \ufffd \ufffd"
    assert H.main_text("<p>one</p><p>two</p></article></div><p>three<b") == "one\ntwo\nthree"
    assert H.main_text("<p title=\"a>b\">one</p><p title='>two</p>") == "one\ntwo"
    assert H.main_text("<p>one<!-- <p>two</p>") == "one"
    assert H.main_text("<p>one</p><script>if (a</b) x</script ><p>two</p>") == "one\ntwo"
    assert H.main_text("<ul><li>a, one<li>b, two<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a, one\nb, two\nc\nd\ne\nf\ng"


def test_html_scores_against_brute_force():
    """The points of every container in random trees, worked out block by block and ancestor by ancestor."""
    r = random.Random(11)

    def grow(depth: int) -> tuple:
        if depth == 0 or r.random() < 0.2:
            words = [r.choice(WORDS) + r.choice(["", "", ","]) for _ in range(r.randrange(3, 60))]
            return "p", " ".join(words) + ".", r.choice([0, 0, 0, len(words) // 2])
        return "div", [grow(depth - 1) for _ in range(r.randrange(1, 5))], 0

    def html(node: tuple) -> str:
        if node[0] == "div":
            return f"<div>{''.join(map(html, node[1]))}</div>"
        words = node[1].split()
        return f"<p><a href=x>{' '.join(words[: node[2]])}</a> {' '.join(words[node[2] :])}</p>"

    def blocks(node: tuple, path: tuple = ()) -> list[tuple]:
        if node[0] == "p":
            linked = len(" ".join(node[1].split()[: node[2]]))
            return [(path, node[1], linked / len(node[1]))]
        return [b for i, x in enumerate(node[1]) for b in blocks(x, (*path, i) if x[0] == "div" else path)]

    for trial in range(80):
        tree = ("div", [grow(3) for _ in range(3)], 0)
        found = blocks(tree)
        # Paths name the containers: () is the outermost div, and above it stands the page.
        points: Counter = Counter()
        for path, text, share in found:
            worth = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - share)
            chain = [path[:k] for k in range(len(path), -1, -1)] + ["page"]
            for level, at in enumerate(chain):
                points[at] += worth * (1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level))
        inside = lambda at: [b for b in found if at == "page" or b[0][: len(at)] == at]
        density = lambda at: sum(len(t) * s for _, t, s in inside(at)) / max(1, sum(len(t) for _, t, _ in inside(at)))
        best = max(points, key=lambda at: (points[at] * (1 - density(at)), at == "page", -len(at)))
        page = H.Page(html(tree))
        assert [(t, round(s, 6)) for _, t, s in page.blocks] == [(t, round(s, 6)) for _, t, s in found]
        text = H.main_text(html(tree)).split("\n")
        want = [t for _, t, _ in inside(best)]
        assert [t for t in text if t in want] == want  # the best container whole and in order
        for at in {b[0][: len(best) if best != "page" else 0] for b in found} if best not in ("page", ()) else ():
            if at != best and at[:-1] == best[:-1]:  # its siblings by their share of links
                assert all((t in text) == (density(at) < 0.25) for _, t, _ in inside(at))


def test_classifier(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(f"{w.upper()}!!" for w in prose(i, 60).split())) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = K.train_quality(docs, labels.where("doc_id < 80"))
    got = K.quality_classifier(docs.where("doc_id >= 80"), model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    x = np.stack([K.counts(r["text"]) for r in got])
    near = model.project(x) @ model.vectors.T
    for i, r in enumerate(got):
        top = np.argsort(-near[i])[: K.NEIGHBOURS]
        w = np.maximum(near[i][top], 0) ** 8
        assert abs(r["score"] - (w * model.labels[top]).sum() / w.sum()) < 1e-4
    assert K.train_quality(docs, labels.limit(0)) is None


def best_segment(text: str, scores: dict[str, float], penalty: float) -> float:
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in scores:
                best[end] = max(best[end], best[start] + scores[piece])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + penalty)
    return best[-1]


def test_viterbi(spark, model):
    scores = dict(zip(model.pieces[1:], model.scores[1:]))
    r = random.Random(8)
    units = ["▁" + "".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    least = min(model.scores) - E.PENALTY
    for row in E.segment(spark.createDataFrame([(u,) for u in set(units)], "unit string"), model).collect():
        got = sum(least if i == 0 else model.scores[i] for i in row["ids"])
        assert abs(got - best_segment(row["unit"], scores, least)) < 1e-9


def test_pieces_match_the_library(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=path), E.read_model(path)
    texts = [*AWKWARD[:10], " a  b\n c ", "日本語\U0001f600x", prose(4, 500), "www.example.com/x?y=1&z=é"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    # All units broadcast, some, and none, so that they come by joins; and texts read as the ids are made.
    for found in (E.decode(E.encode(docs, model), model), E.decode(E.encode(docs, model, head=40), model), E.encode(docs, model, head=0, decoded="decoded")):
        rows = found.collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["ids"], r["decoded"]) == ((None, None) if r["text"] is None else (library.encode(r["text"]), r["text"]))


def test_numbers_of_units_packed():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        codes = np.concatenate([r.integers(0, 1 << k, n) for k in (3, 7, 8, 14, 15, 21, 22, 28)]) if n else np.empty(0, np.int64)
        assert np.array_equal(E._unpacked(E._packed(codes)), codes)
    edge = np.array([0, 127, 128, (1 << 14) - 1, 1 << 14, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    assert np.array_equal(E._unpacked(E._packed(edge)), edge)


def test_pieces_of_a_unigram_model(spark, model):
    """Whole texts through the Viterbi fold: no other segmentation scores better, and the pieces give the text back."""
    scores = dict(zip(model.pieces[1:], model.scores[1:]))
    model = E.Model(model.pieces, model.scores, {}, {0}, 0, False, True)
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 8))) for _ in range(40)]
    for row in E.decode(E.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model, head=10), model).collect():
        assert row["decoded"] == row["text"]
        assert abs(sum(model.scores[i] for i in row["ids"]) - best_segment("▁" + row["text"].replace(" ", "▁"), scores, -100.0)) < 1e-9


ARTICLE = [f"{prose(i, 40)} One, two, {i}." for i in range(6)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in ARTICLE)


@pytest.mark.parametrize("page", [
    f'<body><form id="aspnetForm"><div class="nav">Home</div><div>{PARAGRAPHS}</div><input name=q><button>Go</button></form></body>',
    f'<body><form id="aspnetForm"><nav>Home</nav><article>{PARAGRAPHS}</article></form></body>',
    "<body><div>" + "".join(f'<div class="elementor-widget elementor-widget-text"><p>{x}</p></div>' for x in ARTICLE) + '</div><div class="widget"><p>Other, things.</p></div></body>',
    f'<body><article>{PARAGRAPHS}<form><p>Send us your mail, please.</p><input name=mail></form></article></body>',
    f'<body><div class="page"><div class="site-header"><p>Site, name.</p></div><div class="content">{PARAGRAPHS}</div></div></body>',
])
def test_html_everyday_pages(page):
    assert H.main_text(page) == "\n".join(ARTICLE)


@pytest.mark.parametrize("outer", ["<article>{}</article>", '<div class="post">{}</div>', "<main><div>{}</div></main>"])
@pytest.mark.parametrize("name", ["article-header", "post-header", "header"])
def test_html_headers_of_the_article(outer, name):
    page = outer.format(f'<div class="{name}"><h1>Title</h1><p>A standfirst, in one line.</p></div>{PARAGRAPHS}')
    assert H.main_text(f"<body><nav>Home</nav>{page}</body>") == "\n".join(["Title", "A standfirst, in one line.", *ARTICLE])


def test_html_sections_and_sources_of_the_article():
    sections = "".join(f'<section id="{x}"><h2>On {x}</h2><p>{ARTICLE[i]}</p></section>' for i, x in enumerate(("cookies", "login", "social")))
    want = [y for i, x in enumerate(("cookies", "login", "social")) for y in (f"On {x}", ARTICLE[i])]
    sources = ["A long title of a first source of the text", "A long title of a second source of the text", "A long title of a third source of the text"]
    listed = "".join(f"<li><a href=x>{x}</a></li>" for x in sources)
    away = '<h2>Related stories</h2><ul>' + listed.replace("source", "story") + "</ul>"
    page = f"<body><article><p>{ARTICLE[4]}</p>{sections}<h2>Sources</h2><ul>{listed}</ul>{away}<div class=social><a href=a>Share</a></div><div class=login><p>Log in, please.</p><input></div><div class=comments><p>{ARTICLE[5]}</p></div></article></body>"
    assert H.main_text(page) == "\n".join([ARTICLE[4], *want, "Sources", *sources, "Related stories"])
