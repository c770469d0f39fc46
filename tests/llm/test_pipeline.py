"""The queries opN_<name> by their contracts, and the pipeline stage by stage, on a small folder of awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triplespark.llm import queries as Q

from .test_operators import AWKWARD, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents: two hundred plain ones, copies, near copies, junk, a benchmark passage, and the awkward texts; null and repeated keys are left out."""
    r = random.Random(1)
    rows = [(i, prose(i, 90 + i % 40), "en", "src0" if i % 3 else "src1") for i in range(200)]
    rows += [(1000, prose(5, 95), "en", "src0"), (1001, prose(5, 95) + " extra", "en", "src0")]
    rows += [(1100 + i, "### " * 80 + prose(i, 70).upper(), "en", "src0") for i in range(4)]
    words = prose(77, 300).split()
    item = "one benchmark item with its own seldom words zebra quartz violin jumping over twelve lazy foxes near the frozen harbour"
    rows += [(1200, " ".join(words[:60]) + f" {item} " + " ".join(words[60:160]), "en", "src1")]
    rows += [(1300 + i, t, None if i % 2 else "en", None if i % 3 else "src1") for i, t in enumerate(AWKWARD)]
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(200), *range(1100, 1104)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a.com/en/x", "<p>One, two.</p>"), (2, None, None), (3, "https://x.Example.com/en/7", "<nav>Home</nav><article><p>Text &amp; more</p></article>"), (4, "no", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, {x[0]: x for x in rows}


def part(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


#: Columns that the contracts name first, with their types.
CONTRACTS = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_sentencepiece": "doc_id bigint, n_ids bigint, ids array<int>, same_text boolean",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, folder, name):
    path, docs = folder
    out = Q.queries()[name](spark, path)
    kinds = [x.rsplit(" ", 1) for x in CONTRACTS[name].split(", ")]
    assert out.dtypes[: len(kinds)] == [(c, k) for c, k in kinds]
    rows = out.collect()
    key = kinds[0][0]
    assert sorted(r[key] for r in rows) == (sorted(docs) if key == "doc_id" else [1, 2, 3, 4])
    for r in rows:
        if "held_out" in out.columns:
            assert r["held_out"] == (part(r["doc_id"], {"op3": 4, "op6": 10, "op9": 3}[name[:3]]) == {"op3": 2, "op6": 0, "op9": 1}[name[:3]])
        text = docs[r[key]][1] if key == "doc_id" else None
        if name == "op1_html_extraction":
            assert r["n_chars"] == len(r["text"]) and r["text"] == {1: "One, two.", 3: "Text & more"}.get(r["page_id"], "")
        elif name == "op2_license_scan":
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        elif name == "op3_language_id":
            assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
        elif name == "op5_quality_rules":
            w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            assert r["n_words"] == len(w) and r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["base_failed"] and r["kept"])
        elif name == "op9_quality_classifier":
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        elif name == "op10_sentencepiece":
            assert r["same_text"] and r["n_ids"] == (None if text is None else len(r["ids"])) if text is not None else r["ids"] is None
    if name == "op6_lm_score":
        counted = Counter(w for i, d in docs.items() if part(i, 10) for w in [*words_of(d[1]), ""])
        total, distinct = sum(counted.values()), len(counted)
        for r in rows:
            own = [*words_of(docs[r["doc_id"]][1]), ""]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counted for w in own), total)
            assert abs(r["base_score"] - sum(log10((counted[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)) < 1e-6 * max(1, len(own))
    if name == "op4_jaccard_join":
        found = {r["doc_id"]: r["component_id"] for r in rows}
        assert found[1000] == found[1001] == found[5] == 5 and found[1300] == 1300


def test_stages(spark, folder):
    """Each stage on what the one before kept: what goes, what stays, and the columns."""
    path, docs = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name != "sentencepiece":
            assert out.columns == columns
        rows = out.collect()
        kept[name] = {r["doc_id"] for r in rows}
        assert len(rows) == len(kept[name])
        now = spark.createDataFrame(rows, out.schema)
    plain = set(range(200))
    assert len(plain & kept["quality_rules"]) >= 190 and not kept["quality_rules"] & {1300, 1301, 1302, 1303, 1304, *range(1100, 1104)}
    assert kept["language_id"] >= plain & kept["quality_rules"] and all(any(map(str.isalpha, docs[i][1])) for i in kept["language_id"])
    copies = {5, 1000, 1001} & kept["language_id"]
    assert kept["jaccard_join"] & copies == {min(copies)} and len(plain & kept["jaccard_join"]) >= 190
    assert 1200 in kept["jaccard_join"] and kept["decontaminate"] == kept["jaccard_join"] - {1200}
    assert kept["sentencepiece"] == kept["decontaminate"] and all(r["n_ids"] == len(r["ids"]) > 0 for r in rows)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, path).collect()} == {r["doc_id"]: r["ids"] for r in rows}


def test_stages_of_an_empty_table(spark, folder):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == []


def test_decontaminate_query(spark, folder):
    path, _ = folder
    assert [(r["doc_id"], r["item_id"]) for r in Q.op8_decontaminate(spark, path).collect()] == [(1200, 1)]


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule of op7's contract with the verdict that it names there, on its host and on a subdomain."""
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    hosts = {"com/en/": "a.com", "example.com/en/7": "example.com", "net/de/": "poker.net", "example.net/de/8": "example.net", "org/es/": "a.org"}
    rows = [(n, f"http://{sub}{hosts[rule]}/{rule.partition('/')[2]}1") for n, (sub, rule) in enumerate((sub, rule) for sub in ("", "x.") for rule, _ in rules)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in Q.op7_url_filters(spark, str(tmp_path)).collect()}
    assert [got[n] for n in range(len(rows))] == rules * 2
