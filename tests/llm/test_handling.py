"""Rows and columns that no operator may trip over: nulls, empty, long and repeated texts, ties, extra columns of clashing names, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use or give themselves.
CLASH = ["fp", "row", "content", "root", "found", "new", "n_words", "spans", "full_spans", "items", "host", "part", "shard", "at", "n", "bands", "stratum", "held_out", "score", "rank", "base", "key",
         "__corvane_n_words", "__corvane_words", "__corvane_fp", "__corvane_found", "kept", "range", "salt", "wrapper", "h", "id", "component_id", "start", "length"]


@pytest.fixture(scope="module")
def odd(spark):
    """A few of the real documents, each of them twice, with every odd row."""
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "n_chars")
    rows = [(9000, None, "en", None), (9001, "", None, 0), (9001, "", None, 0), (9002, " \n\t ", "xx", 4), (None, "no id here, none at all", "en", 23), (None, None, None, None), (9003, "long " * 60_000, "en", 300_000),
            (9004, "x" * 100_000, "de", 100_000), (9005, "tie one", "en", 7), (9005, "tie two", "en", 7), (9006, "\x00 ퟿ é <|endoftext|> AKIA" + "Q" * 20, "fr", 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return real.unionByName(real).unionByName(df).cache()


def with_clashes(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH if c not in df.columns))


def operators(spark):
    from corvane.llm import decontam, kneser_ney, packing, pii, quality_model, quality_rules, secret_scan, simhash, wavelet

    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    return {
        "op1": secret_scan.scan, "op2": simhash.near_duplicates, "op3": pii.report, "op4": lambda d: quality_model.classify(d, labels), "op5": lambda d: wavelet.roundtrip(d).drop("part", "shard"),
        "op6": lambda d: decontam.contamination(d, bench), "op7": lambda d: quality_rules.judge(d, labels), "op8": lambda d: packing.pack(d).select("doc_id", "length", "doc_tokens", "start"),
        "op9": kneser_ney.perplexity,
    }


def rows_of(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 10)])
def test_operator_takes_odd_rows_and_names(spark, odd, name):
    run = operators(spark)[name]
    want = rows_of(run(odd))
    assert want == rows_of(run(with_clashes(odd).repartition(3)))
    if name != "op8":
        assert sum(want.values()) == odd.count()
    assert run(with_clashes(odd).where("false")).count() == 0


def test_pages_take_odd_rows_and_names(spark):
    from corvane.llm import html_wrapper

    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    rows = [(900, None, None), (901, "http://h/1", ""), (901, "http://h/1", ""), (None, "not a url", "<p>x"), (902, "http://h/2", "<article><p>" + "long " * 50_000), (903, "http://h/3", "<div>" * 20_000 + "deep")]
    df = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = rows_of(html_wrapper.extract(df))
    assert want == rows_of(html_wrapper.extract(with_clashes(df).repartition(3))) and sum(want.values()) == df.count()
    texts = {r.page_id: r.text for r in html_wrapper.extract(df).where("page_id >= 900").collect()}
    assert texts[900] == "" and texts[901] == "" and texts[902] == " ".join(["long"] * 50_000) and texts[903] == "deep"


def test_stages_take_odd_rows_and_names(spark, odd, tmp_path):
    import corpus_pipeline

    plain, clash = odd, with_clashes(odd)
    for name, stage in corpus_pipeline.STAGES:
        one, two = stage(spark, plain, SF), stage(spark, clash, SF)
        if name == "packing":
            assert one.agg(F.sum("length")).first() == two.agg(F.sum("length")).first()
        else:
            assert one.columns == plain.columns and two.columns == clash.columns
            one.write.parquet(a := str(tmp_path / f"{name}-a"))
            two.write.parquet(b := str(tmp_path / f"{name}-b"))
            plain, clash = spark.read.parquet(a), spark.read.parquet(b)
            assert rows_of(plain) == rows_of(clash.select(*plain.columns))
            if name == "quality_rules":
                assert plain.where("doc_id IN (9000, 9001, 9002) OR text IS NULL").count() == 0
        assert stage(spark, with_clashes(odd).where("false"), SF).count() == 0
