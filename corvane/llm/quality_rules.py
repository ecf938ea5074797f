"""Quality rules whose cutoffs are risk-controlled; DataFrame functions only.

Each rule rejects a document when one measure of its text lies beyond a cutoff. Candidate cutoffs are a fixed grid. For
each stratum (language), rule and cutoff, the labelled documents of good quality that the rule would reject are counted;
a cutoff is allowed if the exact binomial tail says that a false rejection rate above the rule's share of alpha would give so
few with probability ``DELTA`` at most, divided by the number of rules and strata (Bonferroni). The cutoffs of a rule are tested
in fixed sequence from lenient to strict, so they share one such part. The strictest allowed cutoff holds. Alpha is what all
rules together may reject of a stratum's good documents, an equal share each; it is the smallest of ``ALPHAS`` that the stratum's
number of labels can certify at all, and the counts have no say in it.

A stratum with too few labels for any alpha takes the cutoffs of all strata pooled, tested in the same way, but only as far as
its own good labels that a cutoff rejects are no more than the largest share of them; one without labels takes the pooled
cutoffs as they are. The promise then holds for the pool, not for the stratum. A pool with too few labels has no cutoffs.

Defined results: null and empty texts have no words and fail the base; a null language is a stratum of its own; repeated
rows are judged each; without labels only the base decides; an empty table gives no rows; a text of any length is measured
whole. ``keep`` passes columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize
from corvane.tables import small

#: Share of a stratum's good documents that all rules together may reject, from the wanted rate to what fewer labels can
#: certify, and the chance of a wrong promise in all.
ALPHAS = (0.02, 0.04, 0.08)
DELTA = 0.05
#: Rules with their candidate cutoffs, from lenient to strict.
GRID: dict[str, list[float]] = {
    "symbols_per_char": [0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "dup_line_share": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
    "repeat_word_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "chars_per_word": [40.0, 25.0, 18.0, 15.0, 12.0, 10.0],
}
#: Strata up to which their cutoffs are broadcast; beyond it they are joined.
MAX_BROADCAST_STRATA = 1000
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What names of added columns begin with, unless the table has such names.
PREFIX = "__corvane_"


def free_prefix(columns: list[str]) -> str:
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def _repeats(words: Column, n: Column) -> Column:
    """Words in windows of three that occur at least twice; windows are told apart by 64-bit hashes."""
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))
    return hashes


def measured(docs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """``docs`` with the measures of each text in columns whose names begin with a prefix."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, hashes, places = f"{prefix}words", f"{prefix}hashes", f"{prefix}places"
    step = docs.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
    step = step.withColumn(f"{prefix}n_words", F.size(words).cast("int"))
    n = F.col(f"{prefix}n_words")
    step = step.withColumn(hashes, F.when(n >= 3, _repeats(F.col(words), n)))
    h = F.col(hashes)
    # Windows are sorted with their places only where two are equal; equal neighbours give the places that repeat.
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = step.withColumn(places, ordered)
    p = F.col(places)
    size = F.size(p)
    same = F.zip_with(F.slice(p, F.lit(1), size - 1), F.slice(p, F.lit(2), size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(same)), lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn(f"{prefix}lines", lines)
    return step.withColumns({
        f"{prefix}n_words": n.cast("long"),
        f"{prefix}word_chars": F.length(F.array_join(words, "")).cast("long"),
        f"{prefix}n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        f"{prefix}n_dup_lines": (F.size(f"{prefix}lines") - F.size(F.array_distinct(f"{prefix}lines"))).cast("long"),
        f"{prefix}n_repeat_words": F.when(p.isNotNull(), F.size(covered)).otherwise(0).cast("long"),
        f"{prefix}n_lines": F.size(f"{prefix}lines").cast("long"),
    }).drop(words, hashes, places, f"{prefix}lines")


def rule_values(prefix: str = PREFIX) -> dict[str, Column]:
    """The value that each rule compares with its cutoff; null where it has none."""
    _m = lambda name: F.col(prefix + name)
    return {
        "symbols_per_char": F.try_divide(_m("n_symbols"), _m("word_chars")),
        "dup_line_share": F.try_divide(_m("n_dup_lines"), _m("n_lines")),
        "repeat_word_share": F.try_divide(_m("n_repeat_words"), _m("n_words")),
        "chars_per_word": F.try_divide(_m("word_chars"), _m("n_words")),
    }


def base_failed(prefix: str = PREFIX) -> Column:
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeats > 50 * n)


def _tail_log(n: Column, k: Column, p: float) -> Column:
    """Natural log of P(X <= k) for X binomial of n and p: exact terms, each from the one before, summed in logs."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(state["sum"], term), F.least(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda s: s["sum"])


def cutoffs(good: DataFrame, alphas: tuple[float, ...] = ALPHAS, delta: float = DELTA, prefix: str = PREFIX) -> DataFrame:
    """One row a stratum: the strictest allowed cutoff of each rule (null: none), from measured good documents.

    The row of the null stratum holds the pooled cutoffs.
    """
    values = rule_values(prefix)
    shares = [a / len(GRID) for a in alphas]
    tests = [(rule, cut) for rule, grid in GRID.items() for cut in grid]
    counts = [F.count_if(values[rule] > cut).alias(f"t{i}") for i, (rule, cut) in enumerate(tests)]
    per = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    per = per.withColumns({"strata": F.count(F.lit(1)).over(_all()), "pool_n": F.sum("n").over(_all()),
                           **{f"p{i}": F.sum(f"t{i}").over(_all()) for i in range(len(tests))}})
    rows = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"t{i}").alias("k"), F.col(f"p{i}").alias("pool_k"))
        for i, (rule, cut) in enumerate(tests)
    ]))
    each = per.select("stratum", "n", "strata", "pool_n", rows.alias("t")).select("stratum", "n", "strata", "pool_n", "t.*")
    limit = F.log(F.lit(delta) / ((F.col("strata") + 1) * len(GRID)))  # the pool counts as a stratum

    def certified(n: Column, k: Column) -> Column:
        """Null if there are too few labels. Only a test that could pass is summed: a rate at or above alpha cannot."""
        cases = F
        for alpha in shares:
            cases = cases.when(n * F.log(F.lit(1 - alpha)) <= limit, F.when(k < alpha * n, _tail_log(n, k, alpha) <= limit).otherwise(False))
        return cases

    # A stricter cutoff rejects no fewer, so those that pass are the first ones of the sequence.
    own, pool = certified(F.col("n"), F.col("k")), F.coalesce(certified(F.col("pool_n"), F.col("pool_k")), F.lit(False))
    each = each.withColumns({"allowed": F.coalesce(own, pool & (F.col("k") <= shares[-1] * F.col("n"))), "pool_allowed": pool})
    strict = lambda allowed: [F.min(F.when((F.col("rule") == rule) & F.col(allowed), F.col("cut"))).alias(f"{prefix}cut_{rule}") for rule in GRID]
    pooled = each.agg(*strict("pool_allowed")).select(F.lit(None).cast("string").alias("stratum"), *(f"{prefix}cut_{rule}" for rule in GRID))
    return each.groupBy("stratum").agg(*strict("allowed")).unionByName(pooled)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("\x00null"))


def good_rows(rows: DataFrame, labels: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The rows that are labelled as good."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias(f"{prefix}id")).distinct()
    return rows.join(good, F.col("doc_id") == F.col(f"{prefix}id"), "left_semi")


def found_cutoffs(measured_good: DataFrame, prefix: str = PREFIX) -> DataFrame:
    known = measured_good.select("doc_id", stratum().alias("stratum"), *(prefix + m for m in MEASURES))
    return materialize(cutoffs(known, prefix=prefix), "cutoffs")


def judged(rows: DataFrame, cut: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Measured rows (``doc_id``, ``lang``, measures) with ``kept`` and ``base_failed``, names prefixed, by cutoffs of strata."""
    cut = cut.withColumnRenamed("stratum", f"{prefix}stratum")
    pool = cut.where(F.col(f"{prefix}stratum").isNull()).first()
    small = cut.limit(MAX_BROADCAST_STRATA + 1).count() <= MAX_BROADCAST_STRATA
    found = rows.withColumn(f"{prefix}of", stratum()).join(F.broadcast(cut) if small else cut, F.col(f"{prefix}of") == F.col(f"{prefix}stratum"), "left")
    beyond = F.lit(False)
    for rule, value in rule_values(prefix).items():
        name = f"{prefix}cut_{rule}"
        limit = F.when(F.col(f"{prefix}stratum").isNotNull(), F.col(name)).otherwise(F.lit(pool[name]).cast("double"))
        beyond = beyond | F.coalesce(value > limit, F.lit(False))
    found = found.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}kept": ~base_failed(prefix) & ~beyond})
    return found.drop(f"{prefix}of", f"{prefix}stratum", *(f"{prefix}cut_{rule}" for rule in GRID))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: its measures, ``base_failed`` and ``kept``. Texts are measured once and not shuffled."""
    narrow = measured(docs.select("doc_id", "lang", "text")).drop("text")
    rows = materialize(narrow, "measures")
    done = judged(rows, found_cutoffs(good_rows(rows, labels)))
    return done.select("doc_id", *(F.col(PREFIX + m).alias(m) for m in MEASURES[:5]), F.col(f"{PREFIX}base_failed").alias("base_failed"), F.col(f"{PREFIX}kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. No text is written or shuffled.

    Good labelled ones are measured first, for the cutoffs; then all, in one pass. Where there are too many labels to send to every
    executor, the first pass measures all as well, and measures alone meet the labels.
    """
    prefix = free_prefix(docs.columns)
    good = labels.where("quality = 1").select(F.col("doc_id").alias(f"{prefix}id")).distinct()
    texts, sent = docs.select("doc_id", "lang", "text"), small(good)
    if sent is not good:
        found = measured(texts.join(sent, F.col("doc_id") == F.col(f"{prefix}id"), "left_semi"), prefix)
    else:
        found = good_rows(measured(texts, prefix).drop("text"), labels, prefix)
    cut = found_cutoffs(found, prefix)
    # A filter is not pushed below a column of this kind, so no measure is worked out more than once.
    rows = measured(docs, prefix).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    done = judged(rows, cut, prefix)
    return done.where(F.col(f"{prefix}kept") & (F.col(f"{prefix}row") >= 0)).select(*docs.columns)
