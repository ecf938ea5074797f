"""Small literal cases, with results worked out by hand."""

import html
import json
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane import tables
from corvane.functions import text as X
from corvane.operators import agreement, audit, scoring, selection, verdicts
from corvane.sources import readers, sinks
from corvane.streaming import resume


def one(df):
    return df.collect()[0]


def test_two_level_score(spark):
    rows = [(1, "q1", 0.60, 1), (1, "q1", 0.55, 0), (1, "q2", 1.00, 1), (2, "q1", 0.60, 1), (2, "q1", 0.55, 1), (2, "q9", 0.0, 1)]
    df = spark.createDataFrame(rows, "run int, question string, weight double, met int")
    assert one(scoring.two_level_score(df)).score == pytest.approx(88.043478, abs=1e-6)
    per = {r.question: r.score for r in scoring.question_scores(df).collect()}
    assert per["q1"] == pytest.approx(0.760870, abs=1e-6) and per["q2"] == 1.0 and "q9" not in per


def test_majority_vote(spark):
    rows = [("a", "A", 1, 1), ("a", "A", 2, 0), ("a", "A", 3, 1), ("a", "B", 1, 1), ("a", "B", 3, 0), ("b", "C", 1, 1), ("b", "C", 2, 0)]
    got = scoring.majority_vote(spark.createDataFrame(rows, "q string, c string, run int, met int"), "q", "c", "run", "met")
    assert {r.c: r.majority for r in got.collect()} == {"A": 1, "B": 0, "C": 1}


def test_kappas(spark):
    rows = list(zip([1, 1, 0, 0, 1, 0, 1, 1], [1, 0, 0, 0, 1, 1, 1, 1]))
    df = spark.createDataFrame(rows, "a int, b int")
    assert one(agreement.cohen_kappa(df, "a", "b")).kappa == pytest.approx(0.466667, abs=1e-6)
    assert one(agreement.cohen_kappa(df.withColumn("a", F.lit(1)), "a", "b")).kappa is None
    fleiss = [(i, v) for i, t in enumerate([(1, 1, 1), (1, 0, 1), (0, 0, 0), (0, 0, 1)]) for v in t]
    assert one(agreement.fleiss_kappa(spark.createDataFrame(fleiss, "i int, v int"), "i", "v")).kappa == pytest.approx(1 / 3)
    matrix = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    long = [(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    assert one(agreement.icc_2_1(spark.createDataFrame(long, "i int, j int, v double"), "i", "j", "v")).icc == pytest.approx(0.289764, abs=1e-6)


def test_paired_tests(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, -4.0, 5.0, 0.0)], "d double")
    r = one(agreement.signed_rank(d, "d"))
    assert (r.n, r.w_plus, r.w_minus, r.w) == (5, 11.0, 4.0, 4.0)
    e = spark.createDataFrame([(2.0, 4.0, 1.0, 4.0, 3, 3)], "ma double, mb double, va double, vb double, na int, nb int")
    r = one(e.select(agreement.cohens_d(*(F.col(c) for c in e.columns)).alias("d")).withColumn("l", agreement.effect_label(F.col("d"))))
    assert r.d == pytest.approx(-1.264911, abs=1e-6) and r.l == "grande"
    p = spark.createDataFrame([(x,) for x in (0.01, 0.0125, 0.02, 0.5)], "p double")
    assert [r.p for r in agreement.bonferroni(p, "p").where("significant").collect()] == [0.01]
    with pytest.raises(ValueError):
        agreement.bonferroni(p.limit(0), "p")
    assert agreement.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)


def test_prefix_and_quota(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate((5, 9, 3, 4))], "g string, pos int, cost int")
    assert [r.cost for r in selection.budget_prefix(df, ["pos"], "cost", 12).orderBy("pos").collect()] == [5]
    assert [r.cost for r in selection.quota_fill(df, "g", ["pos"], "cost", F.lit(12)).orderBy("pos").collect()] == [5, 3, 4]


def test_running_total_over_many_partitions(spark):
    n = 400_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("o"), "id", (F.col("id") % 97).alias("c"), F.concat(F.lit("text "), "id").alias("more"), F.lit(1).alias("range"))
    rows = selection.running_total(df.repartition(12), ["o", "id"], "c").orderBy("o", "id").select("c", "running", "more", "id", "range").collect()
    total = 0
    for r in rows:
        total += r.c
        assert r.running == total and r.more == f"text {r.id}" and r["range"] == 1
    assert len(rows) == n


def test_ranks_numbers_and_lags_of_a_hot_group(spark):
    n = 100_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"))
    pdf = df.toPandas().sort_values(["g", "v", "id"])
    pdf["n"] = pdf.groupby("g").cumcount() + 1
    pdf["before"] = pdf.groupby("g")["id"].shift()
    got = tables.lagged(tables.numbered(df, ["g"], ["v", "id"], "n"), ["g"], ["v", "id"], "id", "before").toPandas().sort_values(["g", "v", "id"])
    assert got["n"].tolist() == pdf["n"].tolist()
    assert got["before"].fillna(-1).tolist() == pdf["before"].fillna(-1).tolist()
    ranks = agreement.global_average_rank(df.withColumn("more", F.lit("x")), "v", "r").toPandas().sort_values("id")
    assert ranks["r"].tolist() == pdf.sort_values("id")["v"].rank(method="average").tolist()


def test_coefficients_without_a_denominator(spark):
    one_item = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "i int, j int, v double")
    one_rater = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.0)], "i int, j int, v double")
    constant = spark.createDataFrame([(i, j, 1.0) for i in (1, 2) for j in (1, 2)], "i int, j int, v double")
    for df in (one_item, one_rater, constant, constant.where("false")):
        assert one(agreement.icc_2_1(df, "i", "j", "v")).icc is None
    for df in (one_rater, constant, constant.where("false")):
        assert one(agreement.fleiss_kappa(df, "i", "v")).kappa is None


def test_wilcoxon_p_and_report(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 21)] + [(-5.0,), (0.0,)], "d double")
    r = one(agreement.signed_rank(d, "d"))
    # 21 differences, the two fives share ranks 5 and 6: W = 5.5, mean 115.5, variance 21 * 22 * 43 / 24 - 6 / 48.
    z = (5.5 - 115.5) / (21 * 22 * 43 / 24 - 6 / 48) ** 0.5
    assert r.n == 21 and r.w == 5.5 and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(-z / 2**0.5), abs=2e-7)
    assert one(agreement.signed_rank(d.where("d = 0"), "d")).p == 1.0
    rows = [(m, "k", q, s) for q in range(30) for m, s in (("a", q / 30), ("b", q / 30 + 0.1 + q / 1000))]
    rep = agreement.comparison_report(spark.createDataFrame(rows, "model string, kind string, question int, score double"), [("a", "b"), ("a", "c")], ["k"]).collect()
    assert [r.pair for r in rep] == ["a→b"] and rep[0].delta == pytest.approx(0.1145) and rep[0].significant and rep[0].p < 1e-5


def test_bootstrap_interval(spark):
    rows = [(c, int((c * 7 + i) % 10 < 6), int((c * 7 + i) % 10 < 6) if i % 4 else i % 2) for c in range(60) for i in range(9)]
    df = spark.createDataFrame(rows, "c int, a int, b int")
    r = one(agreement.bootstrap_kappa(df, "c", "a", "b", 1000))
    rng, per = random.Random(5), {}
    for c, a, b in rows:
        per.setdefault(c, []).append((a, b))

    def kappa(pairs):
        n = len(pairs)
        po = sum(a == b for a, b in pairs) / n
        pa, pb = sum(a for a, _ in pairs) / n, sum(b for _, b in pairs) / n
        pe = pa * pb + (1 - pa) * (1 - pb)
        return (po - pe) / (1 - pe)

    draws = sorted(kappa([p for _ in per for p in per[rng.randrange(60)]]) for _ in range(600))
    assert r.ci[0] == pytest.approx(draws[15], abs=0.03) and r.ci[1] == pytest.approx(draws[-15], abs=0.03)


def test_keep_longest(spark):
    df = spark.createDataFrame([("k", "aa", 1), ("k", "bbb", 2), ("k", "ccc", 3)], "k string, t string, p int")
    assert one(selection.keep_longest(df, "k", "t", "p")).t == "bbb"


def test_greedy_diverse(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.01]), (0, 3, [0.0, 1.0])], "g int, p int, v array<double>")
    assert [r.p for r in selection.greedy_diverse(df, "g", "p", "v").orderBy("p").collect()] == [1, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b", "aa. bb. cccc. d", "Art. 1.045. x\nArt. 75-A. y")], "a string, b string, c string")
    r = one(df.select(X.squeeze(F.col("a")).alias("s"), X.sentence_chunks(F.col("b"), 8).alias("ch"), X.sentence_chunks(F.col("b"), 99).alias("whole"),
                      X.article_numbers(F.col("c")).alias("n"), X.articles(F.col("c"), thousands=False).alias("ref")))
    assert r.s == "a b" and r.ch == ["aa. bb.", "cccc. d"] and r.whole == ["aa. bb. cccc. d"]
    assert r.n == [1045, 75] and [x.number for x in r.ref] == [1, 75]
    yes = spark.createDataFrame([("SIM",), ("Não.",), ("NO",), ("talvez",), ("ASSIM",)], "x string")
    assert [r[0] for r in yes.select(X.yes_no(F.col("x"))).collect()] == [1, 0, 0, 0, 1]
    ref = spark.createDataFrame([("JURIS:STF:SUM:VINC:0010",)], "x string").select(X.references(F.col("x")).alias("r"))
    assert [(x["type"], x["number"]) for x in one(ref).r] == [("SUM", "0010")]
    num = spark.createDataFrame([(1.25,), (None,)], "x double").select(X.comma_number(F.col("x"), 2))
    assert [r[0] for r in num.collect()] == ["1,25", "—"]


def test_verdict_shapes():
    forms = ['```json\n{"resultado": [{"letra": "A", "acerto": 1,}]}\n```', '[{"numero": "5.1", "acerto": "true"}]', '{"A": {"acerto": 1}}', '{"criterios": [{"letra": "B", "raciocinio": "a\nb", "acerto": 0}]}']
    assert [[(r["key"], r["met"]) for r in verdicts.parse_verdict(f)] for f in forms] == [[("A", 1)], [("5.1", 1)], [("A", 1)], [("B", 0)]]
    assert verdicts.parse_verdict("nothing here") is None and verdicts.parse_verdict(None) is None
    broken = '{"resultado": [{"letra": "A", "raciocinio": "citou o art. 5º, "caput", da CF, e "só", disse", "acerto": 1}, {"letra": "B", "acerto": 0, "raciocinio": "fim"'
    assert [(r["key"], r["met"], r["reason"]) for r in verdicts.parse_verdict(broken)] == [("A", 1, 'citou o art. 5º, "caput", da CF, e "só", disse'), ("B", 0, "fim")]
    assert verdicts.lenient_json("talk {no} then [1, 2.5, true, None,] more") == [1, 2.5, True, None]
    assert verdicts.slot_gap(4) == pytest.approx(37.5) and verdicts.retry_wait(3, False) == 8.0


def test_verdict_column(spark):
    forms = ['{"resultado": [{"letra": "A", "parte": "1", "pontos": 0.5, "acerto": 1, "raciocinio": "x"}]}', '[{"numero": 5, "acerto": "True"}]', None, "nothing", '{"criterios": [{"letra": "B", "acerto": true, "pontos": 2}]}']
    got = spark.createDataFrame(list(enumerate(forms)), "i int, a string").select("i", verdicts.verdicts("a").alias("r")).orderBy("i").collect()
    assert [None if r.r is None else [(x.key, x.met, x.points) for x in r.r] for r in got] == [[("A", 1, 0.5)], [("5", 1, None)], None, None, [("B", 1, 2.0)]]


def test_judge_retries_and_generation(spark):
    tries, waits = [], []

    def chat(prompt, system=""):
        tries.append(prompt)
        if len(tries) < 3:
            raise verdicts.Throttled("slow down")
        return "SIM"

    assert verdicts.with_retries(chat, 5, sleep=waits.append)("p") == "SIM" and len(tries) == 3 and 20 <= waits[0] < 21 and 40 <= waits[1] < 41
    with pytest.raises(ValueError):
        verdicts.with_retries(lambda p, s="": "no", 2, accept=lambda a: a == "yes", sleep=waits.append)("p")
    rows = [("q1", "texto", "resp", "gab", [("c1", "um", 0.5), ("c2", "dois três", None)]), ("q2", "t", "r", "g", [])]
    df = spark.createDataFrame(rows, "q string, question string, answer_text string, key_text string, criteria array<struct<id:string,texto:string,pontuacao_max:double>>")
    got = {r.q: r for r in verdicts.judge_criteria(df, ["q"], "question", "answer_text", "key_text", "criteria", chat=lambda p, s="": "SIM" if "dois" in p else "Não").collect()}
    assert (got["q1"].n_criteria, got["q1"].n_met, got["q1"].earned, got["q1"].possible, got["q1"].score) == (2, 1, 1.0, 1.5, 0.6667)
    assert (got["q2"].n_criteria, got["q2"].n_met, got["q2"].score) == (0, 0, 0.0)
    qs = spark.createDataFrame([("a", "pa"), ("b", "pb")], "q string, p string")
    done = spark.createDataFrame([("a", "x"), ("a", "STUB:y")], "q string, answer string")
    made = verdicts.generate(qs, done, "q", "p", 3, chat=lambda p, s="": p.upper()).collect()
    assert sorted((r.q, r.run, r.answer) for r in made) == [("a", 2, "PA"), ("a", 3, "PA"), ("b", 1, "PB"), ("b", 2, "PB"), ("b", 3, "PB")]
    exp = spark.createDataFrame([("a", "card"), ("b", None)], "q string, expansion string")
    assert [(r.q, r.expansion) for r in verdicts.expand(qs, exp, "q", "p", chat=lambda p, s="": "E" + p).collect()] == [("b", "Epb")]


def test_leak_and_secret(spark):
    df = spark.createDataFrame([("b", "39-disc-civil-1"), ("b", "38-peca-penal"), ("b", "x39")], "b string, id string")
    r = one(audit.leak_by_prefix(df, "b", "id", [39, 40, 41]))
    assert (r.n_lines, r.n_exams, r.leaked) == (3, 2, [39])
    lines = ["x", 'api_key = "abcdefghijklmnop12345678"', 'token = "tooshort"', "senha: 'abcd'", "AKIA" + "A" * 16, "aws_secret_access_key=" + "x" * 20, "ghp_" + "a" * 20]
    s = spark.createDataFrame([(1, "\n".join(lines))], "i int, t string")
    assert sorted((r.line, r.pattern) for r in audit.scan_lines(s, "i", "t").collect()) == [(2, "api_key"), (4, "password"), (5, "aws_key"), (6, "aws_secret"), (7, "github_token")]
    with pytest.raises(ValueError):
        audit.ensure_none(audit.scan_lines(s, "i", "t"), "secrets")
    audit.ensure_none(s.where("false"), "secrets")


def test_contained_items_of_every_length(spark):
    w = [f"word{i}" for i in range(14)]
    texts = [(1, "so " + " ".join(w) + " it ends"), (2, " ".join(w[3:9]) + "\n" + " ".join(w)), (3, "xword0 word1 word2x"), (4, "word3\tword4  word5 word6"), (5, ""), (6, None), (None, "word7 word8")]
    items = [(n, " ".join(w[:n])) for n in range(1, 13)]
    items += [(20 + n, " ".join(w[3:3 + n])) for n in range(1, 10)] + [(40, ""), (41, None), (42, "d1 w"), (43, "word4  word5 word6"), (44, "3\tword4  w"), (45, "none of these here"), (46, " word8"), (47, "word9 ")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    want = sorted(((i, d) for i, a in items for d, t in texts if a is not None and t is not None and a in t), key=str)
    assert sorted(((r.item_id, r.doc_id) for r in audit.contained_items(docs, bench).collect()), key=str) == want
    few = bench.where("item_id IN (1, 42)")
    assert sorted(((r.item_id, r.doc_id) for r in audit.contained_items(docs, few).collect()), key=str) == [x for x in want if x[0] in (1, 42)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b", "n": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int").count() == 2
    kept = readers.jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int", bad="keep").cache()
    assert kept.where("_raw IS NOT NULL").count() == 1
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"q1": ["x", "y"]}))
    assert [(r.question, r.run, r.answer) for r in readers.answers(spark, str(tmp_path / "a.json")).collect()] == [("q1", 1, "x"), ("q1", 2, "y")]
    (tmp_path / "c.csv").write_text('a,b\n1,"two\nlines"\n')
    assert one(readers.csv(spark, str(tmp_path / "c.csv"))).b == "two\nlines"
    (tmp_path / "feed.xml").write_text('<feed><entry><title>Inf n. 12</title><link href="u"/></entry><entry><title>no</title></entry></feed>')
    assert [(r.number, r.url) for r in readers.atom(spark, str(tmp_path / "feed.xml")).collect()] == [(12, "u")]
    (tmp_path / "ab_raw_s42.jsonl").write_text('{"x": 1}\n')
    named = readers.by_file_name(spark, str(tmp_path / "ab_*.jsonl"), "x int", r"ab_(\w+?)_s(\d+)", ["regime", "seed"])
    assert one(named) == Row(x=1, regime="raw", seed="42")
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string")).splitlines()[-1] == "| 1 | — |"
    assert "<b>2.0</b>" in sinks.html_table(spark.createDataFrame([("r", 1.0, 2.0)], "l string, a double, b double"), "l", ["a", "b"])
    m = audit.manifest(spark, str(tmp_path), "x.jsonl")
    assert one(m).n_lines == 3


def test_search_source(spark, tmp_path):
    hits = [{"id": str(i), "date": f"20{20 + i // 10}-01-{i % 10 + 10}", "title": "t"} for i in range(40)] + [{"id": "39", "date": "2023-01-19"}]
    (tmp_path / "a.json").write_text("".join(json.dumps(h) + "\n" for h in hits[:25]))
    (tmp_path / "b.json").write_text("".join(json.dumps(h) + "\n" for h in hits[25:]))
    df = readers.search(spark, str(tmp_path), page_size=3)
    assert sorted(int(r.id) for r in df.collect()) == list(range(40))
    assert sorted(int(r.id) for r in df.where("date >= '2021-01-15' AND date <= '2021-01-17'").collect()) == [15, 16, 17]
    newest = readers.search(spark, f"file://{tmp_path}", since="2022-01-01", limit=3)
    assert [r.id for r in newest.collect()] == ["39", "38", "37"]
    none = readers.search(spark, str(tmp_path), until="2019-01-01")
    assert none.count() == 0


def test_seeded_fetch(spark):
    def fetch(url):
        if url == "b":
            raise OSError("gone")
        return url * 2

    got = readers.seeded(spark, spark.createDataFrame([("a",), ("b",), ("c",)], "u string"), "u", fetch, limit=2).collect()
    assert [(r.url, r.content, r.error) for r in got] == [("a", "aa", None), ("b", None, "OSError: gone")]


def test_streaming_resume(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.range(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    assert resume.run_available(spark, src, schema, out, log, ["id"]).count() == 5
    spark.range(3, 8).write.mode("append").parquet(src)
    assert resume.run_available(spark, src, schema, out, log, ["id"]).count() == 8


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert {r.k: r.v for r in sinks.upsert(old, new, ["k"], F.col("at")).collect()} == {"a": "y", "b": "z"}


def test_small_text_functions(spark):
    c = F.col
    row = lambda schema, *values: spark.createDataFrame([values], schema)
    df = row("a string, b string, n double", "  Peça ", "Estatuto da Criança e do Adolescente", 0.31)
    r = one(df.select(X.genre(c("a")).alias("g"), X.initials(c("b")).alias("i"), X.up_down(c("n")).alias("u"), X.truthy(F.lit(" True ")).alias("t"), X.starts_yes(F.lit(" Sim")).alias("y"), X.joined_key(F.lit(""), F.lit("1")).alias("k"),
                      X.joined_key(F.lit(0), F.lit("1")).alias("k0"), X.drop_cap(F.lit("Q 1\nUESTÃO\nQ\nUESTÃO 2")).alias("q"), X.strip_fence(F.lit("```json\nx {\"a\": 1} y\n```")).alias("f"),
                      X.statute_number(F.lit("Lei 9.099/1995"), "LF").alias("l"), X.alias(F.lit(" X "), {"x": "y"}, "z").alias("al"), X.token_count(F.lit(" a b\u00a0c ")).alias("tc")))
    assert (r.g, r.i, r.u, r.t, r.y, r.k, r.k0, r.q, r.f, r.l, r.al, r.tc) == ("peca", "ECA", "up", True, 1, None, "0-1", "QUESTÃO 1\nQUESTÃO 2", '{"a": 1}', "LF9099-1995", "y", 3)
    long = "x" * 320 + ". " + "y" * 2000
    r = one(row("t string", long).select(X.summary(F.lit(""), F.lit(None).cast("string"), c("t")).alias("s"), X.summary(F.lit("e" * 1300), F.lit(None).cast("string"), c("t")).alias("e"), X.summary(F.lit(""), F.lit("made"), c("t")).alias("m"),
                                         X.summary(F.lit(""), F.lit(""), F.lit("short. text")).alias("w")))
    assert r.s == "x" * 320 + "." and len(r.e) == 1200 and r.m == "made" and r.w == "short. text"
    r = one(row("t string", "intro <<ID=1>>\n**b** *x\ny*\n## h\n---\n\n\n\n*all*  \nend").select(X.sanitize_markdown(c("t")).alias("s")))
    assert r.s == "<<ID=1>>\nb x\ny\nh\n\nall\nend"
    r = one(row("t string", "EXCELENTÍSSIMO Senhor").select(X.is_narrative(c("t")).alias("a"), X.is_narrative(F.lit("### CASO 1\nJoão foi")).alias("b"), X.is_narrative(F.lit("")).alias("c"), X.strip_case_marker(F.lit("### CASO ### João")).alias("m")))
    assert (r.a, r.b, r.c, r.m) == (False, True, False, "João")


def test_entities_and_html_text(spark):
    texts = ["a &amp;lt; b &lt; c", "&eacute;&#233;&#xE9;&Eacute;", "&#128512; &hearts; &zzz; &", "&#0;&#55296;x", "", "&amp;amp;#38;"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.unescape(F.col("t")).alias("u")).orderBy("i").select("u").collect()]
    assert got == [html.unescape(t) if i != 3 else "&#0;\ufffdx".replace("&#0;", "\ufffd") for i, t in enumerate(texts)]
    page = "<head><title>no</title></head><body><nav>menu</nav><p>um&nbsp; dois</p><script>x<y</script><div>tr&ecirc;s<br>quatro</div></body>"
    assert one(spark.createDataFrame([(page,)], "h string").select(X.html_text(F.col("h")).alias("t"))).t == "um dois\ntrês\nquatro"


def test_pdf_and_frames(spark, tmp_path):
    import pandas as pd

    for name, data in (("a.pdf", b"%PDF-1.4 long enough"), ("b.pdf", b"<html>"), ("c.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    files = readers.pdf_like(spark, str(tmp_path), 10)
    got = readers.extract(files, lambda data: data[5:].decode()).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.text) for r in got] == [("a.pdf", "1.4 long enough")]
    pd.DataFrame({"id": range(25), "t": ["x"] * 25}).to_pickle(tmp_path / "frame.pkl")
    readers.convert_frame(spark, lambda: pd.read_pickle(tmp_path / "frame.pkl"), str(tmp_path / "out"), chunk=10)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("id")).first()[0] == 300


def test_booklet_pages(spark):
    from corvane.functions import exams

    pages = [("e", 1, "sua prova\nInformações gerais\nFiscal de sala\nx"), ("e", 2, "\n".join(map(str, range(30)))), ("e", 4, "QUESTÃO 2\nlinha dois\nmais (Valor: 0,50)"), ("e", 3, "PEÇA PRÁTICO-PROFISSIONAL\nATENÇÃO\nnada aqui identificação.\nO caso de Ana segue\nQUESTÃO 1\nDiga (Valor: 0,65)\nB) outra (Valor: 0,60)")]
    text = exams.booklet_text(spark.createDataFrame(pages, "k string, p int, t string"), "k", "p", "t")
    assert one(text.select(exams.document_task(F.col("text")).alias("t"))).t == "O caso de Ana segue"
    q = {r.number: r for r in exams.booklet_questions(text, "k", "text").collect()}
    assert sorted(q) == [1, 2] and (q[1].value_a, q[1].value_b, q[1].part_b) == (0.65, 0.6, "B) outra (Valor: 0,60)") and (q[2].value_a, q[2].value_b, q[2].part_b) == (0.5, 0.0, "")


def test_point_table(spark):
    from corvane.functions import exams

    table = "ITEM PONTUAÇÃO\n1. Endereçamento ao juiz (0,10)\n0,00/0,10\nA. Cabimento do recurso\nsegundo a lei 0,00/0,25/1,10\n5.1. Prazo (0,5)\n6. Valor 12,345 e 7,00"
    got = exams.criteria(spark.createDataFrame([("k", table)], "k string, t string"), ["k"], "t").orderBy("place").collect()
    assert [(r.criterion, r.text, r.points) for r in got] == [("1", "Endereçamento ao juiz", 0.1), ("A", "Cabimento do recurso segundo a lei", 1.1), ("5.1", "Prazo", 0.5), ("6", "Valor 12,345 e 7,00", 0.0)]


def test_html_text_of_all_pages(spark):
    """Against the same rules in plain Python, with the library's own reading of character references."""
    def plain(page):
        x = re.sub(r"(?is)<(script|style|nav|header|footer|aside|head)\b[^>]*>.*?</\1\s*>", " ", page)
        x = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n", x)
        x = re.sub(r"[ \t\x0b\f\r\xa0]+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", x)))
        return re.sub(r"\n{2,}", "\n", re.sub(r" ?\n ?", "\n", x)).strip(" \n")

    got = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", X.html_text(F.col("html")).alias("t")).collect()
    assert len(got) == 50 and all(r.t == plain(r.html) for r in got)


def test_package(spark, tmp_path):
    import tarfile

    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name * 3)
    files = readers.resolve(spark, str(tmp_path), "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    assert sinks.package(files, str(tmp_path / "x.tar.gz"), files) == 2
    with tarfile.open(tmp_path / "x.tar.gz") as t:
        assert {m.name: t.extractfile(m).read().decode() for m in t} == {"a.txt": "a.txt" * 3, "b.txt": "b.txt" * 3}
    with pytest.raises(ValueError):
        sinks.package(files, str(tmp_path / "y.tar.gz"), spark.createDataFrame([("c.txt",)], "path string"))
