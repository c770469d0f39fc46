"""The operators applied to whole tables: queries opN_<name> and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_of, table
from .decontaminate import decontaminate
from .html_extract import extract_html
from .jaccard_join import jaccard_join
from .language_id import language_id, train_language_id
from .license_scan import license_scan
from .lm_score import lm_score
from .phrases import collocations
from .quality_classifier import quality_classifier, train_quality
from .quality_rules import quality_rules
from .sentencepiece import Model, encode, read_model
from .simhash_dedup import simhash_dedup
from .token_alignment import byte_level, piece_level, token_alignment
from .url_filters import GLOBS, RULES, Rule, url_filters


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", part_of("doc_id", 4) == 2)
    network = train_language_id(docs.where(~F.col("held_out")), F.col("doc_id"))
    return language_id(docs.select("doc_id", "held_out", "text"), network).drop("text")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (part_of("doc_id", 10) == 0).alias("held_out"), "text")
    return lm_score(docs, ~F.col("held_out"), keep_text=False)


#: The rules of op7's contract. URL_SQL still reads RULES, the operator's own, whose words for the two rules of `net` are the other way round.
CONTRACT_RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url"), rules=CONTRACT_RULES).drop("url")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(part_of("doc_id", 3) != 1))
    return quality_classifier(docs.select("doc_id", (part_of("doc_id", 3) == 1).alias("held_out"), "text"), model).drop("text")


def public_model(path: str | None = None) -> Model:
    """The model file at `path`; by default the public one that this machine's packages bring along."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return read_model(path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, their number, and whether they decode to the same text (by a 64-bit hash)."""
    model = public_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    out = encode(docs, model, keep_text=False, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.xxhash64("decoded") == F.col("hash")).alias("same_text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of the public byte-level and piece tokenizers; their files' places are parameters of the operator."""
    import public_tokenizers

    a, b = byte_level(public_tokenizers.path("byte_bpe_50k.json")), piece_level(public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment(table(spark, sf_dir, "documents"), a, b)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the components that three differing bits or fewer make."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_license_scan": op2_license_scan,
        "op3_language_id": op3_language_id,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm_score": op6_lm_score,
        "op7_url_filters": op7_url_filters,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_token_alignment": op11_token_alignment,
        "op12_collocations": op12_collocations,
        "op13_simhash": op13_simhash,
    }


#: Hosts, paths and rules as SQL; the query's fixed rules and globs in the order in which they count.
URL_SQL = (
    """with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r as (select *, case """
    + " ".join(f"when ends_with('.' || host, '.{x.text.partition('/')[0]}') and starts_with(path, '/{x.text.partition('/')[2]}') then '{x.text}'" for x in sorted(RULES, key=lambda x: -len(x.text)))
    + " end as rule from h) select page_id, host, path, rule, case "
    + " ".join(f"when rule = '{x.text}' then '{x.verdict}'" for x in RULES)
    + " "
    + " ".join(f"when ('.' || host) glob '{g.host}' and path glob '{g.path}' then '{g.verdict}'" for g in GLOBS)
    + " else 'allow' end as verdict from r"
)


#: All phrases counted by places, for each language.
PHRASE_SQL = """with t as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by 1),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*)::hugeint as a from g group by all having count(*) >= 30),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from f where k > 1),
s as (select c.lang, c.k, c.phrase, c.a, c.cut, x.a as l, y.a as r, (2000000::hugeint * c.a) // (x.a + y.a) as score from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
z as (select lang, a, string_split(phrase, ' ') as w, k, unnest(range(2, k)) as m from f where k > 2),
i as (select lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase from (select *, unnest(range(1, k - m + 2)) as i from z)),
o as (select lang, phrase, max(a) as around from i group by all),
r as (select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank, b.phrase, b.a, b.l, b.r, b.score from b left join o on o.lang = b.lang and o.phrase = b.phrase where o.around is null or 100 * o.around < 80 * b.a)
select r.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from r join n on n.lang = r.lang where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """op7's and op12's rows can be said in SQL; the others learn models, search within texts or use hashes and files that SQL lacks."""
    return {"op7_url_filters": URL_SQL, "op12_collocations": PHRASE_SQL}
