"""Weighted scores of rubric verdicts: multi-level means, rates, contrasts and tables.

A verdict table has one row per (run, question, criterion) with a weight and a 0/1 ``met``. Column names are parameters, so
one implementation serves any schema. Doubles are used throughout, never decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_fraction(df: DataFrame, by: Sequence[str], weight: str = "weight", met: str = "met", default_weight: float = 1.0) -> DataFrame:
    """Earned over possible points per group; groups whose weights sum to zero are left out, not scored 0."""
    w = F.coalesce(F.col(weight), F.lit(default_weight))
    sums = df.groupBy(*by).agg(F.sum(F.when(F.col(met) == 1, w).otherwise(0.0)).alias("earned"), F.sum(w).alias("possible"))
    return sums.where("possible > 0").withColumn("score", F.col("earned") / F.col("possible"))


def two_level_score(df: DataFrame, by: Sequence[str] = (), run: str = "run", question: str = "question", **kw) -> DataFrame:
    """Mean over questions within a run, then over runs, in percent. Not the flat mean where runs differ in questions."""
    per_question = weighted_fraction(df, [*by, run, question], **kw)
    per_run = per_question.groupBy(*by, run).agg(F.avg("score").alias("score"))
    return per_run.groupBy(*by).agg((100 * F.avg("score")).alias("score"))


def question_scores(df: DataFrame, by: Sequence[str] = (), run: str = "run", question: str = "question", **kw) -> DataFrame:
    """Mean over runs for each question."""
    per_run = weighted_fraction(df, [*by, run, question], **kw)
    return per_run.groupBy(*by, question).agg(F.avg("score").alias("score"))


def seed_mean(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean over the seeds that have a score; null if none has."""
    return df.groupBy(*by).agg(F.avg(score).alias("score"))


def majority_vote(df: DataFrame, question: str, criterion: str, run: str, met: str, reason: str | None = None) -> DataFrame:
    """A criterion is met if its votes reach half, rounded up, of the runs of its *question*; an absent run votes no.

    With ``reason``, the reasons given are listed in order of runs.
    """
    runs = df.groupBy(question).agg(F.count_distinct(run).alias("n_runs"))
    sums = [F.sum(met).cast("long").alias("votes")]
    if reason is not None:
        given = F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.coalesce(F.col(reason), F.lit("")).alias("t"))))
        sums.append(F.transform(given, lambda x: x["t"]).alias("reasons"))
    votes = df.groupBy(question, criterion).agg(*sums)
    need = F.floor((F.col("n_runs") + 1) / 2)
    return votes.join(runs, question).withColumn("majority", (F.col("votes") >= need).cast("int"))


def criteria_with_verdicts(criteria: DataFrame, verdicts: DataFrame, on: Sequence[str], met: str = "met") -> DataFrame:
    """Every criterion; an absent verdict counts as not met and not judged."""
    marked = verdicts.select(*on, F.col(met).alias("_met"))
    joined = criteria.join(marked, list(on), "left")
    return joined.withColumns({"met": F.coalesce("_met", F.lit(0)), "judged": F.col("_met").isNotNull().cast("int")}).drop("_met")


def quadrant(a: Column, b: Column, threshold: float = 0.05) -> Column:
    """Which of two gains lies strictly above the threshold."""
    return (F.when((a > threshold) & (b > threshold), "both").when(a > threshold, "only_a")
            .when(b > threshold, "only_b").otherwise("none"))


def gains_by_axes(df: DataFrame, axes: Sequence[str], gain: str, least: int = 20) -> DataFrame:
    """Mean gain for each value of each axis, as one grouping-sets pass; small groups are left out."""
    cols = [F.col(a) for a in axes]
    axis = F.coalesce(*(F.when(F.grouping(a) == 0, F.lit(a)) for a in axes))
    value = F.coalesce(*(c.cast("string") for c in cols))
    sets = df.groupingSets([[c] for c in cols], *cols)
    found = sets.agg(axis.alias("axis"), F.count(F.lit(1)).alias("n"), F.avg(gain).alias("gain"))
    return found.where(F.col("n") >= least).select("axis", value.alias("value"), "n", "gain").orderBy(F.desc("n"), "axis", "value")


def share_of_total(df: DataFrame, by: str, amount: str) -> DataFrame:
    """Sum per group and its percent of all; the window runs over groups, not rows."""
    sums = df.groupBy(by).agg(F.sum(amount).alias("total"))
    return sums.withColumn("percent", 100 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))))


def training_steps(examples: Column, epochs: int = 3, batch: int = 16) -> Column:
    """Steps of training: epochs times examples over the batch, rounded up, in whole numbers."""
    return F.floor((epochs * examples + batch - 1) / batch).cast("long")


def weighted_verdicts(verdicts: DataFrame, weights: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Verdicts with their criterion's weight, 0 where none is known."""
    return verdicts.join(weights.select(*keys, weight), list(keys), "left").withColumn(weight, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))


def stacked_seeds(df: DataFrame, by: Sequence[str], seed: str, run: str = "run", question: str = "question", **kw) -> DataFrame:
    """Question scores with the seed as a part of the key, for pairing conditions by (seed, question)."""
    return question_scores(df, [*by, seed], run, question, **kw)


def starting_scores(scores: DataFrame, starts: DataFrame, condition: str) -> DataFrame:
    """The score of the condition that each (model, regime) starts from; ``starts`` is a small table (model, regime, condition)."""
    return starts.join(scores, condition, "left")


def start_condition(model: Column, regime: Column, base: Column, seed: Column, family: Column) -> Column:
    """Name of the condition before tuning: the base model where the regime is ``nenhum``, else ``ab_regime_sseed_family``."""
    return F.when(regime == "nenhum", base).otherwise(F.concat_ws("_", F.lit("ab"), regime, F.concat(F.lit("s"), seed.cast("string")), family))


def aligned_scores(results: DataFrame, model: str, score: Column, kind: str | None = None) -> DataFrame:
    """(question, score) of a model, and of a kind of question if given; the caller orders both sides by question."""
    rows = results.where(F.col("model") == model)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).select("question", score.alias("score"))


def coverage_gates(df: DataFrame, coverage: str, bias: str, least: float = 0.85, most: float = 0.05) -> DataFrame:
    """Judges with their state: ``ok``, or what keeps them out."""
    state = F.when(F.col(coverage) < least, "low coverage").when(F.col(bias) > most, "biased omission").otherwise("ok")
    return df.withColumn("state", state)
