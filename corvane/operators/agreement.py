"""Agreement coefficients, error measures and paired tests, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import ship
from corvane.tables import fresh, materialize, ranged


def counts_2x2(a: str, b: str) -> list[Column]:
    return [F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa from a contingency table; null if a rater is constant or there is no row."""
    n = n11 + n10 + n01 + n00
    po = F.try_divide(n11 + n00, n)
    pe = F.try_divide((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00), n * n)
    constant = (n11 + n10 == 0) | (n01 + n00 == 0) | (n11 + n01 == 0) | (n10 + n00 == 0)
    return F.when((n == 0) | constant, F.lit(None).cast("double")).otherwise(F.try_divide(po - pe, 1 - pe))


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    table = df.groupBy(*by).agg(*counts_2x2(a, b))
    return table.withColumn("kappa", kappa(*(F.col(c) for c in ("n11", "n10", "n01", "n00"))))


def rater_pairs_kappa(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """Kappa of all pairs of raters r1 < r2; pairs meet per item, so work follows items times pairs of raters."""
    left = ratings.select(item, F.col(rater).alias("r1"), F.col(value).alias("v1"))
    right = ratings.select(item, F.col(rater).alias("r2"), F.col(value).alias("v2"))
    return cohen_kappa(left.join(right, item).where("r1 < r2"), "v1", "v2", ["r1", "r2"])


def fleiss_kappa(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """Fleiss' kappa for 0/1 ratings, the same number for each item; null for one rater, constant ratings or no item."""
    per = ratings.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("yes"))
    agree = F.col("yes") * F.col("yes") + (F.col("n") - F.col("yes")) ** 2 - F.col("n")
    per = per.withColumn("agree", F.try_divide(agree, F.col("n") * (F.col("n") - 1)))
    tot = per.agg(F.avg("agree").alias("p"), F.try_divide(F.sum("yes"), F.sum("n")).alias("y"))
    pe = F.col("y") * F.col("y") + (1 - F.col("y")) * (1 - F.col("y"))
    return tot.select(F.try_divide(F.col("p") - pe, 1 - pe).alias("kappa"))


def icc_2_1(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """Two-way random, single-measure intraclass correlation from sums of squares; null on a zero denominator."""
    base = ratings.agg(F.avg(value).alias("m"), F.count_distinct(item).alias("n"), F.count_distinct(rater).alias("k"))
    rows = ratings.groupBy(item).agg(F.avg(value).alias("rm"))
    cols = ratings.groupBy(rater).agg(F.avg(value).alias("cm"))
    one = F.broadcast(base)
    ssr = rows.crossJoin(one).agg(F.sum(F.col("k") * (F.col("rm") - F.col("m")) ** 2).alias("ssr"))
    ssc = cols.crossJoin(one).agg(F.sum(F.col("n") * (F.col("cm") - F.col("m")) ** 2).alias("ssc"))
    sst = ratings.crossJoin(one).agg(F.sum((F.col(value) - F.col("m")) ** 2).alias("sst"))
    t = base.crossJoin(ssr).crossJoin(ssc).crossJoin(sst)
    n, k = F.col("n"), F.col("k")
    msr, msc = F.try_divide(F.col("ssr"), n - 1), F.try_divide(F.col("ssc"), k - 1)
    mse = F.try_divide(F.col("sst") - F.col("ssr") - F.col("ssc"), (n - 1) * (k - 1))
    return t.select(F.try_divide(msr - mse, msr + (k - 1) * mse + k * F.try_divide(msc - mse, n)).alias("icc"))


def average_rank(column: str, by: Sequence[str]) -> Column:
    """Ranks from 1, ties averaged, within ``by``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return (F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / F.lit(2.0)).cast("double")


def global_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average ranks over all rows: ranks come from the counts of distinct values, so no window holds all rows."""
    n, value = fresh([*df.columns, out], "n", "value")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(value)).agg(F.count(F.lit(1)).alias(n))
    rows, part, base = ranged(counts, [value], n, "ranks")
    inner = Window.partitionBy(part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(base) + F.coalesce(F.sum(n).over(inner), F.lit(0))
    ranks = rows.select(value, (before + (F.col(n) + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(column) == F.col(value)).drop(value)


def signed_rank(df: DataFrame, diff: str) -> DataFrame:
    """Wilcoxon's W+, W-, W and the tie-corrected normal p without continuity correction; zero differences are left out."""
    d = df.where(F.col(diff) != 0).select(F.col(diff).alias("d"), F.abs(F.col(diff)).alias("m"))
    ranked = global_average_rank(d, "m", "r")
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"),
                      F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    ties = d.groupBy("m").count().agg(F.coalesce(F.sum(F.col("count") ** 3 - F.col("count")), F.lit(0.0)).alias("ties"))
    t = sums.crossJoin(ties).withColumn("w", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, sd)
    return t.withColumn("z", z).withColumn("p", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of the error function (absolute error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # The published coefficients of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def cohens_d(mean_a, mean_b, var_a, var_b, n_a, n_b) -> Column:
    """Difference of means over the pooled sample deviation; null below four values, 0 for no deviation."""
    squares = F.when(n_a > 1, (n_a - 1) * var_a).otherwise(0.0) + F.when(n_b > 1, (n_b - 1) * var_b).otherwise(0.0)
    pooled = F.sqrt(F.try_divide(squares, n_a + n_b - 2))
    return F.when(n_a + n_b < 4, F.lit(None).cast("double")).when(pooled == 0, 0.0).otherwise(F.try_divide(mean_a - mean_b, pooled))


def effect_label(d: Column) -> Column:
    """Labels of |d| at 0.2, 0.5 and 0.8 (fixed values)."""
    m = F.abs(d)
    return F.when(m < 0.2, "desprezível").when(m < 0.5, "pequeno").when(m < 0.8, "médio").otherwise("grande")


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``threshold`` = alpha over the number of tests, and whether p lies strictly below it; no test is an error."""
    n = df.count()
    if not n:
        raise ValueError("no test to correct for")
    return df.withColumns({"threshold": F.lit(alpha / n), "significant": F.col(p) < alpha / n})


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """Adjusted p-values by the step-up rule."""
    w = Window.partitionBy(F.lit(0)).orderBy(p)
    raw = F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / F.row_number().over(w)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal p-values share one
    return df.withColumn("__raw", raw).withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__raw")


def bootstrap_kappa(df: DataFrame, cluster: str, a: str, b: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of kappa over clusters drawn with replacement; degenerate draws are left out.

    Each cluster is one row of four counts. A draw gives each cluster a Poisson(1) weight from a hash of (seed, draw,
    cluster), so draws are sums and no cluster table is ever copied or collected.
    """
    per = df.groupBy(cluster).agg(*counts_2x2(a, b))
    spread = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", cluster), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, below = F.lit(0), float(np.exp(-1.0))
    term, total = below, below
    for k in range(1, 9):
        weight = F.when(u >= total, F.lit(k)).otherwise(weight)
        term /= k
        total += term
    sums = spread.withColumn("w", weight).groupBy("draw").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n11", "n10", "n01", "n00")))
    each = sums.select(kappa(*(F.col(c) for c in ("n11", "n10", "n01", "n00"))).alias("kappa"))
    return each.agg(F.percentile("kappa", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count("kappa").alias("draws"))


def friedman(df: DataFrame, block: str, treatment: str, value: str, least: int = 10) -> DataFrame:
    """Friedman's chi-square with tie correction, over blocks that have all treatments; null below three treatments or ``least`` blocks."""
    k = df.select(treatment).distinct().count()
    whole = df.groupBy(block).agg(F.count_distinct(treatment).alias("k")).where(F.col("k") == k).select(block)
    ranked = df.join(whole, block).withColumn("r", average_rank(value, [block]))
    sums = ranked.groupBy(treatment).agg(F.sum("r").alias("rs")).agg(F.sum(F.col("rs") ** 2).alias("ss"))
    n = whole.agg(F.count(F.lit(1)).alias("n"))
    ties = ranked.groupBy(block, value).count().agg(F.sum(F.col("count") ** 3 - F.col("count")).alias("ties"))
    t = sums.crossJoin(n).crossJoin(ties)
    raw = F.try_divide(12 * F.col("ss"), F.col("n") * k * (k + 1)) - 3 * F.col("n") * (k + 1)
    even = 1 - F.try_divide(F.col("ties"), F.col("n") * k * (k * k - 1))
    enough = (F.col("k") >= 3) & (F.col("n") >= least)
    t = t.withColumn("k", F.lit(k))
    return t.select("k", "n", F.when(enough, F.try_divide(raw, even)).alias("chi2"))


def alignment(df: DataFrame, judge: str, golden: str, humans: Sequence[str]) -> DataFrame:
    """One row: items, accuracy and kappa of a judge against the gold and each human, kappa of each pair of humans, and Fleiss' kappa of the humans."""
    pairs = [(golden, judge), *((h, judge) for h in humans), *((a, b) for i, a in enumerate(humans) for b in humans[i + 1:])]
    names = ["kappa_gold", *(f"kappa_{h}" for h in humans), *(f"kappa_{a}_{b}" for i, a in enumerate(humans) for b in humans[i + 1:])]
    sums = [F.count(F.lit(1)).alias("n"), F.avg((F.col(judge) == F.col(golden)).cast("int")).alias("accuracy")]
    for k, (a, b) in enumerate(pairs):
        sums += [c.alias(f"c{k}_{i}") for i, c in enumerate(counts_2x2(a, b))]
    n, yes = len(humans), sum(F.col(h) for h in humans)
    agree = F.lit(1.0) if n < 2 else (yes * yes + (n - yes) * (n - yes) - n) / float(n * (n - 1))
    sums += [F.avg(agree).alias("p"), F.avg(yes / float(n)).alias("q")]
    t = df.agg(*sums)
    pe = F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q"))
    kappas = [kappa(*(F.col(f"c{k}_{i}") for i in range(4))).alias(name) for k, name in enumerate(names)]
    return t.select("n", "accuracy", *kappas, F.try_divide(F.col("p") - pe, 1 - pe).alias("fleiss"))


def comparison_report(scores: DataFrame, pairs: Sequence[tuple[str, str]], kinds: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One row a pair of models and kind of question, by paired scores (model, kind, question, score).

    Means, their difference (b less a), Wilcoxon's W and p over the questions both answered, the threshold corrected for all tests,
    whether p lies below it, and Cohen's d with its label. Pairs without a common question are left out. ``pairs`` is a short fixed list.
    """
    parts = []
    for kind in kinds:
        for a, b in pairs:
            some = scores.where(F.col("kind") == kind)
            one = some.where(F.col("model") == a).select("question", F.col("score").alias("a"))
            two = some.where(F.col("model") == b).select("question", F.col("score").alias("b"))
            both = materialize(one.join(two, "question"), "pairs")
            w = signed_rank(both.select((F.col("b") - F.col("a")).alias("d")), "d").select("w", "p")
            m = both.agg(*(f(c).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("mean", F.avg), ("var", F.var_samp))), F.count(F.lit(1)).alias("n_pairs"))
            d = cohens_d(F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b"), F.col("n_pairs"), F.col("n_pairs"))
            row = m.crossJoin(w).where("n_pairs > 0")
            parts.append(row.select(F.lit(f"{a}→{b}").alias("pair"), F.lit(kind).alias("kind"), "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), F.col("w").alias("W"), "p", d.alias("d"), effect_label(d).alias("label")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return bonferroni(materialize(out, "report"), "p", alpha)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the series of the regularised gamma function."""
    a, half = df / 2.0, x / 2.0
    if half <= 0:
        return 1.0
    from math import exp, lgamma, log

    term = total = 1.0 / a
    for n in range(1, 2000):
        term *= half / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1.0 - total * exp(-half + a * log(half) - lgamma(a)))


def with_p_values(df: DataFrame) -> DataFrame:
    """``p`` beside ``chi2`` and ``k`` (a few summary rows)."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi2_tail(float(v), int(n) - 1) for v, n in zip(x, k)])

    return df.withColumn("p", tail("chi2", "k"))
