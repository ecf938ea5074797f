"""The registered queries of this subpackage: thin forms of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import quality_model

    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import wavelet

    return wavelet.roundtrip(table(spark, sf_dir, "documents")).drop("part", "shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import decontam

    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import packing

    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import kneser_ney

    return kneser_ney.perplexity(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import html_wrapper

    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS6 = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS6} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS6} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[k:k + least(len(w), 13) - 1], chr(1)) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM win),
dg AS (SELECT rid, l, k, array_to_string(w[k:k + l - 1], chr(1)) AS g FROM (SELECT rid, l, w, unnest(range(1, len(w) - l + 2)) AS k FROM d, ls WHERE len(w) >= l)),
h AS (SELECT rid, k, dg.l, item FROM dg JOIN win ON dg.l = win.l AND dg.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + l)) AS p FROM (SELECT DISTINCT rid, k, l FROM h)) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""


def _op7() -> str:
    """Measures, binomial tails by their terms, and cutoffs, as ``quality_rules`` states them."""
    from corvane.llm.quality_rules import ALPHAS, DELTA, GRID

    tests = ", ".join(f"('{rule}', {cut})" for rule, grid in GRID.items() for cut in grid)
    shares = [a / len(GRID) for a in ALPHAS]
    tail = lambda n, k, p: f"ln(list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({p}) + ({n} - j) * ln(1 - {p})))))"
    certified = lambda n, k: "CASE " + " ".join(f"WHEN {n} * ln(1 - {p}) <= lim THEN CASE WHEN {k} < {p} * {n} THEN {tail(n, k, p)} <= lim ELSE false END" for p in shares) + " END"
    limits = ", ".join(f"min(CASE WHEN rule = '{rule}' AND {{0}} THEN cut END) AS cut_{rule}" for rule in GRID)
    beyond = " OR ".join(f"coalesce(v_{rule} > CASE WHEN c.stratum IS NOT NULL THEN c.cut_{rule} ELSE pl.cut_{rule} END, false)" for rule in GRID)
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0) || 'null') AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1)) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
m AS (SELECT w.rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
v AS (SELECT *, n_symbols / nullif(word_chars, 0) AS v_symbols_per_char, n_dup_lines / nullif(n_lines, 0) AS v_dup_line_share, n_repeat_words / nullif(n_words, 0) AS v_repeat_word_share, word_chars / nullif(n_words, 0) AS v_chars_per_word,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT * FROM v WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests(rule, cut) AS (VALUES {tests}),
k AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (WHERE CASE rule {" ".join(f"WHEN '{rule}' THEN v_{rule}" for rule in GRID)} END > cut) AS k FROM good, tests GROUP BY ALL),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY rule, cut) AS BIGINT) AS pn, CAST(sum(k) OVER (PARTITION BY rule, cut) AS BIGINT) AS pk, ln({DELTA} / ((count(*) OVER (PARTITION BY rule, cut) + 1) * {len(GRID)})) AS lim FROM k),
a AS (SELECT *, {certified("n", "k")} AS own, coalesce({certified("pn", "pk")}, false) AS pool FROM p),
c AS (SELECT stratum, {limits.format("coalesce(own, pool AND k <= " + str(shares[-1]) + " * n)")} FROM a GROUP BY stratum),
pl AS (SELECT {limits.format("pool")} FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND NOT ({beyond}) AS kept FROM v LEFT JOIN c ON c.stratum = v.stratum CROSS JOIN pl"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": _OP6, "op7_quality_rules": _op7()}
