"""Agreement, error and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import agreement, scoring
from corvane.plans.base import Registry, V, r6, table, verdict_rows

query = Registry()

#: Gold labels beside a rule's prediction and two more raters, in SQL.
G = ("g AS (SELECT l.doc_id, d.lang, d.n_chars, l.quality AS gold, CAST(d.n_chars >= 1000 AS INTEGER) AS pred, CAST(d.n_chars % 3 > 0 AS INTEGER) AS r3, "
     "CAST(d.n_chars % 5 > 0 AS INTEGER) AS r4 FROM labels l JOIN documents d USING (doc_id))")
_K = ("count(*) FILTER (WHERE {a} = 1 AND {b} = 1)::DOUBLE AS n11, count(*) FILTER (WHERE {a} = 1 AND {b} = 0)::DOUBLE AS n10, "
      "count(*) FILTER (WHERE {a} = 0 AND {b} = 1)::DOUBLE AS n01, count(*) FILTER (WHERE {a} = 0 AND {b} = 0)::DOUBLE AS n00")
_KAPPA = ("round(CASE WHEN n11 + n10 = 0 OR n01 + n00 = 0 OR n11 + n01 = 0 OR n10 + n00 = 0 THEN NULL ELSE ((n11 + n00) / (n11 + n10 + n01 + n00) - "
          "((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n11 + n10 + n01 + n00) ** 2) / (1 - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n11 + n10 + n01 + n00) ** 2) END, 6)")


def gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    n = F.col("n_chars")
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id").withColumns(
        {"pred": (n >= 1000).cast("int"), "r3": (n % 3 > 0).cast("int"), "r4": (n % 5 > 0).cast("int")})


def ratings(spark, d):
    """(doc_id, rater, value) of four raters."""
    names = ["gold", "pred", "r3", "r4"]
    return gold(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("rater"), F.col(n).cast("int").alias("value")) for n in names))).alias("x")).select("doc_id", "x.*")


_R = G + ", r AS (SELECT doc_id, 'gold' AS rater, gold AS value FROM g UNION ALL SELECT doc_id, 'pred', pred FROM g UNION ALL SELECT doc_id, 'r3', r3 FROM g UNION ALL SELECT doc_id, 'r4', r4 FROM g)"


@query(f"WITH {G}, k AS (SELECT {_K.format(a='gold', b='pred')} FROM g) SELECT {_KAPPA} AS kappa FROM k")
def kappa_vs_gold(spark, d):
    return agreement.cohen_kappa(gold(spark, d), "gold", "pred").select(r6("kappa").alias("kappa"))


@query(f"WITH {G}, k AS (SELECT lang, {_K.format(a='gold', b='pred')} FROM g GROUP BY lang HAVING count(*) > 3) SELECT lang, {_KAPPA} AS kappa FROM k")
def kappa_by_stratum(spark, d):
    k = agreement.cohen_kappa(gold(spark, d), "gold", "pred", ["lang"]).where("n11 + n10 + n01 + n00 > 3")
    return k.select("lang", r6("kappa").alias("kappa"))


@query(f"WITH {G} SELECT round(sum(CASE WHEN gold = 1 AND pred = 1 THEN 1.0 ELSE 0 END) / nullif(sum(gold), 0), 6) AS sensitivity, "
       "round(sum(CASE WHEN gold = 0 AND pred = 0 THEN 1.0 ELSE 0 END) / nullif(sum(1 - gold), 0), 6) AS specificity, round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy FROM g")
def confusion_rates(spark, d):
    g = gold(spark, d).agg(*agreement.counts_2x2("gold", "pred"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("acc"))
    c = F.col
    return g.select(r6(F.try_divide(c("n11"), c("n11") + c("n10"))).alias("sensitivity"), r6(F.try_divide(c("n00"), c("n00") + c("n01"))).alias("specificity"), r6("acc").alias("accuracy"))


@query(f"WITH {_R} SELECT rater, round(avg(CAST(value = gold AS INTEGER)), 6) AS accuracy, round(stddev_samp(CAST(value = gold AS INTEGER)), 6) AS sd, count(*) AS n FROM r JOIN g USING (doc_id) WHERE rater <> 'gold' GROUP BY rater")
def accuracy_vs_gold(spark, d):
    hit = (F.col("value") == F.col("gold")).cast("int")
    g = ratings(spark, d).where("rater <> 'gold'").join(gold(spark, d).select("doc_id", "gold"), "doc_id").groupBy("rater")
    return g.agg(r6(F.avg(hit)).alias("accuracy"), r6(F.stddev_samp(hit)).alias("sd"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {G}, j AS (SELECT *, n_chars < 4000 AS judged FROM g) SELECT round(avg(CAST(judged AS INTEGER)), 6) AS coverage, "
       "round(coalesce(abs(avg(gold) FILTER (WHERE judged) - avg(gold) FILTER (WHERE NOT judged)), 0), 6) AS bias FROM j")
def omission_bias(spark, d):
    g = gold(spark, d).withColumn("judged", F.col("n_chars") < 4000)
    a = g.agg(F.avg(F.col("judged").cast("int")).alias("cov"), F.avg(F.when(F.col("judged"), F.col("gold"))).alias("x"), F.avg(F.when(~F.col("judged"), F.col("gold"))).alias("y"))
    return a.select(r6("cov").alias("coverage"), r6(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(0.0))).alias("bias"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 4000)")
def gold_not_judged(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("n_chars < 4000").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_R}, k AS (SELECT a.rater AS r1, b.rater AS r2, {_K.format(a='a.value', b='b.value')} FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY ALL) SELECT r1, r2, {_KAPPA} AS kappa FROM k")
def rater_pairs_kappa(spark, d):
    return agreement.rater_pairs_kappa(ratings(spark, d), "doc_id", "rater", "value").select("r1", "r2", r6("kappa").alias("kappa"))


@query(f"WITH {_R}, i AS (SELECT doc_id, count(*) AS n, sum(value) AS y FROM r GROUP BY doc_id), t AS (SELECT avg((y * y + (n - y) * (n - y) - n) / (n * (n - 1.0))) AS p, sum(y) * 1.0 / sum(n) AS q FROM i) "
       "SELECT round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) AS kappa FROM t")
def fleiss_kappa(spark, d):
    return agreement.fleiss_kappa(ratings(spark, d), "doc_id", "value").select(r6("kappa").alias("kappa"))


@query(f"WITH {_R}, b AS (SELECT avg(value) AS m, count(DISTINCT doc_id) AS n, count(DISTINCT rater) AS k FROM r), x AS (SELECT sum(k * (rm - m) ** 2) AS ssr FROM (SELECT avg(value) AS rm FROM r GROUP BY doc_id), b), "
       "y AS (SELECT sum(n * (cm - m) ** 2) AS ssc FROM (SELECT avg(value) AS cm FROM r GROUP BY rater), b), z AS (SELECT sum((value - m) ** 2) AS sst FROM r, b), "
       "q AS (SELECT n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM b, x, y, z) SELECT round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM q")
def icc_2_1(spark, d):
    return agreement.icc_2_1(ratings(spark, d), "doc_id", "rater", "value").select(r6("icc").alias("icc"))


@query(f"WITH {_R} SELECT doc_id, CAST(sum(value) >= 2 AS INTEGER) AS gold FROM r WHERE rater <> 'gold' GROUP BY doc_id")
def gold_by_majority(spark, d):
    return ratings(spark, d).where("rater <> 'gold'").groupBy("doc_id").agg((F.sum("value") >= 2).cast("int").alias("gold"))


@query(f"WITH {G} SELECT lang, CASE WHEN count(DISTINCT gold) > 1 THEN 1 ELSE 0 END AS ambiguous, CAST(avg(gold) > 0.5 AS INTEGER) AS modal FROM g GROUP BY lang")
def modal_class(spark, d):
    return gold(spark, d).groupBy("lang").agg((F.count_distinct("gold") > 1).cast("int").alias("ambiguous"), (F.avg("gold") > 0.5).cast("int").alias("modal"))


_PAIRS = (f"WITH {V}, q AS (SELECT question, run, sum(met * weight) / sum(weight) AS s FROM v WHERE run IN (1, 2) GROUP BY ALL), p AS (SELECT a.question, a.s AS a, b.s AS b, a.s - b.s AS d FROM q a JOIN q b USING (question) WHERE a.run = 1 AND b.run = 2) ")


def _pairs(spark, d):
    v = verdict_rows(spark, d).where("run IN (1, 2)")
    s = v.groupBy("question", "run").agg((F.sum(F.col("met") * F.col("weight")) / F.sum("weight")).alias("s"))
    a, b = s.where("run = 1").select("question", F.col("s").alias("a")), s.where("run = 2").select("question", F.col("s").alias("b"))
    return a.join(b, "question").withColumn("d", F.col("a") - F.col("b"))


@query(_PAIRS + "SELECT question, round(d, 6) AS delta FROM p")
def paired_join_deltas(spark, d):
    return _pairs(spark, d).select("question", r6("d").alias("delta"))


_W = (f"WITH {V}, q AS (SELECT question, run, sum(weight) AS s FROM v WHERE run IN (1, 2) GROUP BY ALL), p AS (SELECT a.s - b.s AS d FROM q a JOIN q b USING (question) WHERE a.run = 1 AND b.run = 2 AND a.s <> b.s), "
      "r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM p) "
      "SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE, 4) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE, 4) AS w_minus FROM r")


@query(_W)
def wilcoxon_ranks(spark, d):
    s = verdict_rows(spark, d).where("run IN (1, 2)").groupBy("question", "run").agg(F.sum("weight").alias("s"))
    p = s.where("run = 1").select("question", F.col("s").alias("a")).join(s.where("run = 2").select("question", F.col("s").alias("b")), "question")
    w = agreement.signed_rank(p.select((F.col("a") - F.col("b")).alias("d")), "d")
    return w.select("n", F.round("w_plus", 4).alias("w_plus"), F.round("w_minus", 4).alias("w_minus"))


@query(f"WITH {V}, q AS (SELECT question, run, sum(weight) AS s FROM v WHERE run <= 3 GROUP BY ALL), f AS (SELECT * FROM q WHERE question IN (SELECT question FROM q GROUP BY 1 HAVING count(*) = 3)), "
       "r AS (SELECT run, rank() OVER (PARTITION BY question ORDER BY s) + (count(*) OVER (PARTITION BY question, s) - 1) / 2.0 AS r FROM f) SELECT run, round(sum(r)::DOUBLE, 4) AS rank_sum FROM r GROUP BY run")
def friedman_ranks(spark, d):
    q = verdict_rows(spark, d).where("run <= 3").groupBy("question", "run").agg(F.sum("weight").alias("s"))
    whole = q.groupBy("question").count().where("count = 3").select("question")
    r = q.join(whole, "question").withColumn("r", agreement.average_rank("s", ["question"]))
    return r.groupBy("run").agg(F.round(F.sum("r"), 4).alias("rank_sum"))


_FR = (f"WITH {V}, q AS (SELECT question, run, sum(weight) AS s FROM v WHERE run <= 3 GROUP BY ALL), f AS (SELECT * FROM q WHERE question IN (SELECT question FROM q GROUP BY 1 HAVING count(*) = 3)), "
       "r AS (SELECT question, run, s, rank() OVER (PARTITION BY question ORDER BY s) + (count(*) OVER (PARTITION BY question, s) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY question, s) AS t FROM f), "
       "n AS (SELECT count(DISTINCT question) AS n, sum(t * t - 1) AS ties FROM r), ss AS (SELECT sum(rs * rs) AS ss FROM (SELECT sum(r)::DOUBLE AS rs FROM r GROUP BY run)), "
       "c AS (SELECT n, (12 * ss / (n * 3 * 4) - 3 * n * 4) / (1 - ties / (n * 3 * 8.0)) AS chi2 FROM n, ss) ")


@query(_FR + "SELECT CAST(3 AS INTEGER) AS k, n, round(chi2, 4) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM c")
def friedman_test(spark, d):
    """Three treatments have two degrees of freedom, where the tail is exp(-chi2 / 2)."""
    q = verdict_rows(spark, d).where("run <= 3").groupBy("question", "run").agg(F.sum("weight").alias("s"))
    t = agreement.with_p_values(agreement.friedman(q, "question", "run", "s"))
    return t.select("k", "n", F.round("chi2", 4).alias("chi2"), r6("p").alias("p"))


@query("WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), ra AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) "
       "SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 4) AS mae FROM ra")
def pearson_spearman_mae(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    r = agreement.global_average_rank(agreement.global_average_rank(x, "a", "ra"), "b", "rb")
    return r.agg(r6(F.corr("a", "b")).alias("pearson"), r6(F.corr("ra", "rb")).alias("spearman"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("mae"))


@query(_PAIRS + "SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(corr(a, b) ** 2, 6) AS r2, round(avg(d), 6) AS bias FROM p")
def rmse_r2_bias(spark, d):
    dd = F.col("d")
    return _pairs(spark, d).agg(r6(F.sqrt(F.avg(dd * dd))).alias("rmse"), r6(F.avg(F.abs(dd))).alias("mae"), r6(F.corr("a", "b") ** 2).alias("r2"), r6(F.avg(dd)).alias("bias"))


_D = "WITH t AS (SELECT lang, avg(n_chars) AS m, var_samp(n_chars) AS v, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT a.lang AS a, b.lang AS b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM t a JOIN t b ON a.lang < b.lang) "


def _lang_effects(spark, d):
    t = table(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"), F.var_samp("n_chars").alias("v"), F.count(F.lit(1)).alias("n"))
    a, b = t.toDF("a", "ma", "va", "na"), t.toDF("b", "mb", "vb", "nb")
    p = a.join(b, F.col("a") < F.col("b"))  # a handful of groups
    return p.select("a", "b", agreement.cohens_d(*(F.col(c) for c in ("ma", "mb", "va", "vb", "na", "nb"))).alias("d"))


@query(_D + "SELECT a, b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'desprezível' WHEN abs(d) < 0.5 THEN 'pequeno' WHEN abs(d) < 0.8 THEN 'médio' ELSE 'grande' END AS label FROM p")
def cohens_d(spark, d):
    return _lang_effects(spark, d).select("a", "b", r6("d").alias("d"), agreement.effect_label(F.col("d")).alias("label"))


#: Two-sided p-values of z tests: the share of good documents of each source against that of all, in SQL by the error function's approximation.
_P = ("WITH s AS (SELECT source, count(*) AS n, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source), g AS (SELECT avg(quality) AS m FROM documents JOIN labels USING (doc_id)), "
      "z AS (SELECT source, abs(s.m - g.m) / sqrt(g.m * (1 - g.m) / n) / sqrt(2.0) AS x FROM s, g), u AS (SELECT source, x, 1 / (1 + 0.3275911 * x) AS t FROM z), "
      "p AS (SELECT source, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p FROM u) ")


def _source_p(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    s = j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("m")).crossJoin(F.broadcast(j.agg(F.avg("quality").alias("g"))))  # one row of totals
    z = (F.col("m") - F.col("g")) / F.sqrt(F.col("g") * (1 - F.col("g")) / F.col("n"))
    return s.select("source", agreement.normal_two_sided(z).alias("p"))


@query(_P + "SELECT source, round(0.05 / count(*) OVER (), 9) AS threshold, CAST(p < 0.05 / count(*) OVER () AS INTEGER) AS significant FROM p")
def bonferroni_flags(spark, d):
    b = agreement.bonferroni(_source_p(spark, d), "p")
    return b.select("source", F.round("threshold", 9).alias("threshold"), F.col("significant").cast("int").alias("significant"))


@query(_P + ", r AS (SELECT source, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p) SELECT source, round(least(1.0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM r")
def benjamini_hochberg(spark, d):
    return agreement.benjamini_hochberg(_source_p(spark, d), "p").select("source", r6("p_adjusted").alias("p_adjusted"))


@query("WITH s AS (SELECT l_suppkey, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1) SELECT round(median(sd), 6) AS median_sd, round(2 * 1.96 * median(sd), 6) AS threshold FROM s")
def noise_floor(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_quantity").alias("sd"))
    return s.agg(r6(F.median("sd")).alias("median_sd"), r6(2 * 1.96 * F.median("sd")).alias("threshold"))


@query()
def bootstrap_kappa_ci(spark, d):
    """Clusters are sources: documents of one share what they are drawn from."""
    g = gold(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return agreement.bootstrap_kappa(g, "source", "gold", "pred", 1000)


@query("WITH a AS (SELECT l_suppkey AS r, row_number() OVER (ORDER BY avg(l_quantity) DESC, l_suppkey) AS p1, row_number() OVER (ORDER BY avg(l_discount) DESC, l_suppkey) AS p2 FROM lineitem GROUP BY 1) SELECT round(corr(p1, p2), 6) AS rho FROM a")
def order_correlation(spark, d):
    from pyspark.sql import Window

    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"))
    pos = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), "l_suppkey"))  # noqa: E731  (one row a judge)
    return a.select(pos("x").alias("p1"), pos("y").alias("p2")).agg(r6(F.corr("p1", "p2")).alias("rho"))


_PAIR_NAMES = {"kappa_gold": ("gold", "pred"), "kappa_r3": ("r3", "pred"), "kappa_r4": ("r4", "pred"), "kappa_r5": ("r5", "pred"), "kappa_r3_r4": ("r3", "r4"), "kappa_r3_r5": ("r3", "r5"), "kappa_r4_r5": ("r4", "r5")}
_G5 = G + ", h AS (SELECT *, CAST(n_chars % 7 > 1 AS INTEGER) AS r5 FROM g)"


@query(f"WITH {_G5}, " + ", ".join(f"k{i} AS (SELECT {_K.format(a=a, b=b)} FROM h), x{i} AS (SELECT {_KAPPA} AS {n} FROM k{i})" for i, (n, (a, b)) in enumerate(_PAIR_NAMES.items()))
       + ", i AS (SELECT r3 + r4 + r5 AS y FROM h), t AS (SELECT avg((y * y + (3 - y) * (3 - y) - 3) / 6.0) AS p, sum(y) / (3.0 * count(*)) AS q FROM i) "
       "SELECT (SELECT count(*) FROM h) AS n, (SELECT round(avg(CAST(gold = pred AS INTEGER)), 6) FROM h) AS accuracy, " + ", ".join(_PAIR_NAMES)
       + ", round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) AS fleiss FROM t, " + ", ".join(f"x{i}" for i in range(len(_PAIR_NAMES))))
def alignment_report(spark, d):
    g = gold(spark, d).withColumn("r5", (F.col("n_chars") % 7 > 1).cast("int"))
    a = agreement.alignment(g, "pred", "gold", ["r3", "r4", "r5"])
    return a.select("n", *(r6(c).alias(c) for c in a.columns[1:]))


_MODEL_PAIRS = [("1", "2"), ("1", "3")]


def _model_scores(spark, d):
    """Runs of the verdict table as models, line status as kind of question."""
    v = verdict_rows(spark, d).where("run <= 3")
    return v.groupBy(F.col("run").cast("string").alias("model"), F.col("class").alias("kind"), "question").agg((F.sum(F.col("met") * F.col("weight")) / F.sum("weight")).alias("score"))


_REPORT = (f"WITH {V}, s AS (SELECT CAST(run AS VARCHAR) AS model, class AS kind, question, sum(met * weight) / sum(weight) AS score FROM v WHERE run <= 3 GROUP BY ALL), "
           "pr(a, b) AS (VALUES ('1', '2'), ('1', '3')), x AS (SELECT pr.a || '→' || pr.b AS pair, x.kind, x.score AS a, y.score AS b, y.score - x.score AS d FROM pr JOIN s x ON x.model = pr.a JOIN s y ON y.model = pr.b AND y.kind = x.kind AND y.question = x.question), "
           "m AS (SELECT pair, kind, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, count(*) AS n FROM x GROUP BY ALL), "
           "r AS (SELECT pair, kind, d, rank() OVER (PARTITION BY pair, kind ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pair, kind, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY pair, kind, abs(d)) AS t FROM x WHERE d <> 0), "
           "w AS (SELECT pair, kind, count(*) AS k, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w, sum((t * t - 1)::DOUBLE) AS ties FROM r GROUP BY ALL), "
           "z AS (SELECT pair, kind, w, abs((w - k * (k + 1) / 4.0) / sqrt(k * (k + 1) * (2 * k + 1) / 24.0 - ties / 48.0)) / sqrt(2.0) AS x FROM w), "
           "p AS (SELECT pair, kind, w, 1 / (1 + 0.3275911 * x) AS t, x FROM z), e AS (SELECT m.*, w, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p, "
           "(ma - mb) / sqrt(((n - 1) * va + (n - 1) * vb) / (2 * n - 2)) AS d FROM m JOIN p USING (pair, kind)) "
           "SELECT pair, kind, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(mb - ma, 4) AS delta, round(w, 2) AS w, round(p, 5) AS p, round(0.05 / count(*) OVER (), 6) AS threshold, p < 0.05 / count(*) OVER () AS significant, "
           "round(d, 4) AS d, CASE WHEN abs(d) < 0.2 THEN 'desprezível' WHEN abs(d) < 0.5 THEN 'pequeno' WHEN abs(d) < 0.8 THEN 'médio' ELSE 'grande' END AS label FROM e")


@query(_REPORT)
def comparison_report(spark, d):
    r = agreement.comparison_report(_model_scores(spark, d), _MODEL_PAIRS, ["O", "F"])
    return r.select("pair", "kind", *(F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "delta")), F.round("W", 2).alias("w"), F.round("p", 5).alias("p"), F.round("threshold", 6).alias("threshold"), "significant", F.round("d", 4).alias("d"), "label")


@query("WITH s AS (SELECT l_orderkey AS question, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS mean_score, l_discount AS mean FROM lineitem WHERE l_suppkey % 2 = 0 AND l_returnflag = 'N') SELECT question, round(coalesce(mean_score, mean, 0), 6) AS score FROM s")
def aligned_scores(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 2).cast("string").alias("model"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("question"),
                                            F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("mean_score"), F.col("l_discount").alias("mean"))
    return scoring.aligned_scores(li, "0", F.coalesce("mean_score", "mean", F.lit(0.0)), "N").select("question", r6("score").alias("score"))


_GATES = f"WITH {G}, j AS (SELECT lang, gold, n_chars < 4000 AS judged FROM g), c AS (SELECT lang, avg(CAST(judged AS INTEGER)) AS coverage, coalesce(abs(avg(gold) FILTER (WHERE judged) - avg(gold) FILTER (WHERE NOT judged)), 0) AS bias FROM j GROUP BY lang) "


@query(_GATES + "SELECT lang, round(coverage, 6) AS coverage, round(bias, 6) AS bias, CASE WHEN coverage < 0.95 THEN 'low coverage' WHEN bias > 0.2 THEN 'biased omission' ELSE 'ok' END AS state FROM c")
def coverage_gates(spark, d):
    g = gold(spark, d).withColumn("judged", F.col("n_chars") < 4000)
    a = g.groupBy("lang").agg(F.avg(F.col("judged").cast("int")).alias("coverage"), F.coalesce(F.abs(F.avg(F.when(F.col("judged"), F.col("gold"))) - F.avg(F.when(~F.col("judged"), F.col("gold")))), F.lit(0.0)).alias("bias"))
    return scoring.coverage_gates(a, "coverage", "bias", 0.95, 0.2).select("lang", r6("coverage").alias("coverage"), r6("bias").alias("bias"), "state")
