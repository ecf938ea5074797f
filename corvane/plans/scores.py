"""Score queries over the verdict-shaped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import agreement, scoring
from corvane.plans.base import Registry, V, r6, table, verdict_rows

query = Registry()
_AREA = ("area AS (SELECT o_orderkey AS question, c_mktsegment AS area, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey "
         "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")


def areas(spark, d):
    """Question, area and region: orders with their customer's segment and region."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("o_orderkey").alias("question"), F.col("c_mktsegment").alias("area"), F.col("r_name").alias("region"))


_Q = "q AS (SELECT {by} run, question, sum(CASE WHEN met = 1 THEN weight ELSE 0.0 END) / sum(weight) AS s FROM {src} GROUP BY ALL HAVING sum(weight) > 0)"


@query(f"WITH {V}, {_Q.format(by='', src='v')} SELECT round(100 * avg(m), 6) AS score FROM (SELECT run, avg(s) AS m FROM q GROUP BY run)")
def weighted_two_level_score(spark, d):
    return scoring.two_level_score(verdict_rows(spark, d)).select(r6("score").alias("score"))


@query(f"WITH {V}, {_Q.format(by='class,', src='v')} SELECT class, round(100 * avg(m), 6) AS score FROM (SELECT class, run, avg(s) AS m FROM q GROUP BY ALL) GROUP BY class")
def score_by_class(spark, d):
    return scoring.two_level_score(verdict_rows(spark, d), ["class"]).select("class", r6("score").alias("score"))


@query(f"WITH {V}, {_Q.format(by='', src='v')} SELECT question, round(avg(s), 6) AS score FROM q GROUP BY question")
def score_per_question(spark, d):
    return scoring.question_scores(verdict_rows(spark, d)).select("question", r6("score").alias("score"))


@query(f"WITH {V}, {_AREA}, w AS (SELECT v.*, area FROM v JOIN area USING (question)), {_Q.format(by='area,', src='w')} "
       "SELECT area, round(100 * avg(m), 6) AS score FROM (SELECT area, run, avg(s) AS m FROM q GROUP BY ALL) GROUP BY area")
def score_by_dimension(spark, d):
    return scoring.two_level_score(verdict_rows(spark, d).join(areas(spark, d), "question"), ["area"]).select("area", r6("score").alias("score"))


_PIV = f"WITH {V}, {_AREA}, w AS (SELECT v.*, area, region FROM v JOIN area USING (question)), {_Q.format(by='area, region,', src='w')}, " \
       "t AS (SELECT area, region, 100 * avg(m) AS s FROM (SELECT area, region, run, avg(s) AS m FROM q GROUP BY ALL) GROUP BY ALL) "
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _pivot(spark, d):
    long = scoring.two_level_score(verdict_rows(spark, d).join(areas(spark, d), "question"), ["area", "region"])
    wide = long.groupBy("area").pivot("region", _REGIONS).agg(F.first("score"))
    return wide.toDF("area", *(r.lower().replace(" ", "_") for r in _REGIONS))


@query(_PIV + "SELECT area, " + ", ".join(f"round(max(CASE WHEN region = '{r}' THEN s END), 6) AS {r.lower().replace(' ', '_')}" for r in _REGIONS) + " FROM t GROUP BY area")
def score_pivot_table(spark, d):
    wide = _pivot(spark, d)
    return wide.select("area", *(r6(c).alias(c) for c in wide.columns[1:]))


@query(_PIV + "SELECT area, round(max(s), 6) AS best FROM t GROUP BY area")
def score_best_of_row(spark, d):
    wide = _pivot(spark, d)
    return wide.select("area", r6(F.greatest(*wide.columns[1:])).alias("best"))


@query(_PIV + "SELECT area, round(max(s) - min(s), 6) AS ampl FROM t GROUP BY area HAVING count(s) >= 2")
def score_dispersion(spark, d):
    wide = _pivot(spark, d)
    w = wide.select("area", F.array_compact(F.array(*wide.columns[1:])).alias("x")).where(F.size("x") >= 2)
    return w.select("area", r6(F.array_max("x") - F.array_min("x")).alias("ampl"))


@query("WITH s AS (SELECT o_orderpriority AS cond, o_custkey % 3 AS seed, avg(o_totalprice) AS y FROM orders GROUP BY ALL), "
       "t AS (SELECT cond, CASE WHEN seed = 2 AND cond LIKE '1%' THEN NULL ELSE y END AS x FROM s) SELECT cond, round(avg(x), 4) AS score FROM t GROUP BY cond")
def seed_mean(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cond"), (F.col("o_custkey") % 3).alias("seed"), "o_totalprice")
    s = o.groupBy("cond", "seed").agg(F.avg("o_totalprice").alias("x"))
    s = s.withColumn("x", F.when((F.col("seed") == 2) & F.col("cond").startswith("1"), F.lit(None)).otherwise(F.col("x")))
    return scoring.seed_mean(s, ["cond"], "x").select("cond", F.round("score", 4).alias("score"))


_RATE = (f"WITH {V}, r AS (SELECT criterion, rater % 3 AS regime, avg(met) AS rate FROM v GROUP BY ALL), "
         "w AS (SELECT a.criterion, b.rate - a.rate AS da, c.rate - a.rate AS db FROM r a JOIN r b ON a.criterion = b.criterion AND b.regime = 1 "
         "JOIN r c ON a.criterion = c.criterion AND c.regime = 2 WHERE a.regime = 0) ")


def _deltas(spark, d):
    v = verdict_rows(spark, d).withColumn("regime", F.col("rater") % 3)
    r = v.groupBy("criterion").pivot("regime", [0, 1, 2]).agg(F.avg("met")).toDF("criterion", "c0", "c1", "c2").dropna()
    return r.select("criterion", (F.col("c1") - F.col("c0")).alias("da"), (F.col("c2") - F.col("c0")).alias("db"))


@query(_RATE + ", k AS (SELECT CASE WHEN da > 0.05 AND db > 0.05 THEN 'both' WHEN da > 0.05 THEN 'only_a' WHEN db > 0.05 THEN 'only_b' ELSE 'none' END AS quadrant FROM w) "
       "SELECT quadrant, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM k GROUP BY quadrant")
def rate_delta_quadrants(spark, d):
    k = _deltas(spark, d).groupBy(scoring.quadrant(F.col("da"), F.col("db")).alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.share_of_total(k.withColumn("x", F.col("n")), "quadrant", "x").select("quadrant", F.col("total").alias("n"), r6("percent").alias("percent"))


@query(_RATE + ", k AS (SELECT da, db, rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0 AS ra, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0 AS rb FROM w) "
       "SELECT round(corr(da, db), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k")
def gain_correlation(spark, d):
    r = agreement.global_average_rank(agreement.global_average_rank(_deltas(spark, d), "da", "ra"), "db", "rb")
    return r.agg(r6(F.corr("da", "db")).alias("pearson"), r6(F.corr("ra", "rb")).alias("spearman"))


@query(_RATE + ", x AS (SELECT da, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM w JOIN part ON criterion = p_partkey) "
       "SELECT axis, value, n, gain FROM (SELECT 'p_brand' AS axis, p_brand AS value, count(*) AS n, round(avg(da), 6) AS gain FROM x GROUP BY p_brand "
       "UNION ALL SELECT 'p_size', p_size, count(*), round(avg(da), 6) FROM x GROUP BY p_size) WHERE n >= 20")
def gain_by_axis_grouping_sets(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("criterion"), "p_brand", "p_size")
    g = scoring.gains_by_axes(_deltas(spark, d).join(p, "criterion"), ["p_brand", "p_size"], "da", 20)
    return g.select("axis", "value", "n", r6("gain").alias("gain"))


@query("SELECT CASE WHEN grouping(p_type) = 1 THEN 'all' ELSE p_type END AS type, CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS class, count(*) AS n, round(sum(p_retailprice), 4) AS points FROM part GROUP BY ROLLUP (p_type, p_brand)")
def totals_rollup(spark, d):
    g = table(spark, d, "part").rollup("p_type", "p_brand").agg(F.grouping("p_type").alias("a"), F.grouping("p_brand").alias("b"), F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 4).alias("points"))
    return g.select(F.when(F.col("a") == 1, "all").otherwise(F.col("p_type")).alias("type"), F.when(F.col("b") == 1, "all").otherwise(F.col("p_brand")).alias("class"), "n", "points")


@query(f"WITH {V}, nr AS (SELECT question, count(DISTINCT run) AS n_runs FROM v GROUP BY question), x AS (SELECT question, class AS criterion, CAST(sum(met) AS BIGINT) AS votes FROM v GROUP BY ALL) "
       "SELECT question, criterion, votes, n_runs, CAST(votes >= (n_runs + 1) // 2 AS INTEGER) AS majority FROM x JOIN nr USING (question)")
def majority_vote(spark, d):
    v = verdict_rows(spark, d).withColumn("c", F.col("class"))
    return scoring.majority_vote(v, "question", "c", "run", "met").withColumnRenamed("c", "criterion").select("question", "criterion", "votes", "n_runs", "majority")


@query("WITH c AS (SELECT o_orderkey AS question FROM orders), x AS (SELECT l_orderkey AS question, max(CAST(l_returnflag = 'N' AS INTEGER)) AS m FROM lineitem WHERE l_linenumber = 4 GROUP BY 1) "
       "SELECT c.question, coalesce(m, 0) AS met, CAST(m IS NOT NULL AS INTEGER) AS judged FROM c LEFT JOIN x USING (question)")
def criteria_left_verdicts(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"))
    x = verdict_rows(spark, d).where("run = 4").groupBy("question").agg(F.max("met").alias("met"))
    return scoring.criteria_with_verdicts(c, x, ["question"])


@query("SELECT l_returnflag AS grp, round(sum(l_quantity), 4) AS total, round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS percent FROM lineitem GROUP BY l_returnflag")
def group_share(spark, d):
    g = scoring.share_of_total(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return g.select(F.col("l_returnflag").alias("grp"), F.round("total", 4).alias("total"), r6("percent").alias("percent"))


@query("SELECT event_type AS block, count(*) AS examples, CAST((3 * count(*) + 15) // 16 AS BIGINT) AS steps FROM events GROUP BY event_type")
def training_steps(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("block")).agg(F.count(F.lit(1)).alias("examples"))
    return g.withColumn("steps", scoring.training_steps(F.col("examples")))


@query(f"WITH {V}, a AS (SELECT question, max(met) AS va FROM v WHERE run = 1 GROUP BY 1), b AS (SELECT question, max(met) AS vb FROM v WHERE run = 3 GROUP BY 1) "
       "SELECT coalesce(a.question, b.question) AS question, va, vb, CAST(coalesce(va <> vb, false) AS INTEGER) AS diverges FROM a FULL JOIN b ON a.question = b.question")
def condition_divergence(spark, d):
    v = verdict_rows(spark, d)
    a = v.where("run = 1").groupBy("question").agg(F.max("met").alias("va"))
    b = v.where("run = 3").groupBy("question").agg(F.max("met").alias("vb"))
    return a.join(b, "question", "full_outer").withColumn("diverges", F.coalesce(F.col("va") != F.col("vb"), F.lit(False)).cast("int"))


@query("WITH t AS (SELECT DISTINCT o_orderstatus AS s FROM orders), p AS (SELECT DISTINCT o_orderpriority AS p FROM orders), f AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY ALL) "
       "SELECT t.s AS status, p.p AS priority, f.n FROM t CROSS JOIN p LEFT JOIN f ON f.s = t.s AND f.p = p.p")
def factor_grid(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    grid = o.select("status").distinct().crossJoin(o.select("priority").distinct())  # levels of two factors, not rows
    facts = o.where("o_totalprice > 100000").groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(facts, ["status", "priority"], "left")


@query("SELECT l_orderkey AS question, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 4) AS points, round(sum(l_quantity), 4) AS possible FROM lineitem GROUP BY 1")
def points_of_possible(spark, d):
    g = scoring.weighted_fraction(verdict_rows(spark, d), ["question"])
    return g.select("question", F.round("earned", 4).alias("points"), F.round("possible", 4).alias("possible"))


@query(f"WITH {V}, t AS (SELECT c_mktsegment AS area, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) "
       "SELECT area, class, count(*) AS n FROM v JOIN t ON question = o_orderkey WHERE class = 'O' GROUP BY ALL")
def task_filter(spark, d):
    some = areas(spark, d).where(F.col("area").isin("BUILDING", "MACHINERY"))
    return verdict_rows(spark, d).where("class = 'O'").join(some, "question").groupBy("area", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'ab_' || lower(l_linestatus) || '_s' || l_linenumber || '_' || lower(l_returnflag) AS cond, lower(l_linestatus) AS regime, CAST(l_linenumber AS INTEGER) AS seed, lower(l_returnflag) AS fam, count(*) AS n FROM lineitem GROUP BY ALL")
def condition_labels(spark, d):
    name = F.concat_ws("_", F.lit("ab"), F.lower("l_linestatus"), F.concat(F.lit("s"), F.col("l_linenumber")), F.lower("l_returnflag"))
    g = table(spark, d, "lineitem").groupBy(name.alias("cond")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda k: F.regexp_extract("cond", r"^ab_(\w+?)_s(\d+)_(\w+)$", k)
    return g.select("cond", part(1).alias("regime"), part(2).cast("int").alias("seed"), part(3).alias("fam"), "n")


@query(f"WITH {V}, x AS (SELECT question, class AS criterion, CAST(sum(met) AS BIGINT) AS votes, md5(string_agg(run || ':' || criterion, '|' ORDER BY run, run || ':' || criterion)) AS reasons FROM v GROUP BY question, class) SELECT * FROM x")
def vote_reasons(spark, d):
    """Votes with the reasons given, in order of runs; run and part stand for a reason."""
    v = verdict_rows(spark, d).withColumn("reason", F.concat_ws(":", F.col("run").cast("string"), F.col("criterion").cast("string")))
    m = scoring.majority_vote(v, "question", "class", "run", "met", "reason")
    return m.select("question", F.col("class").alias("criterion"), "votes", F.md5(F.array_join("reasons", "|").cast("binary")).alias("reasons"))


@query("WITH w AS (SELECT p_partkey AS criterion, p_retailprice AS weight FROM part WHERE p_size > 10), x AS (SELECT l_orderkey AS question, l_linenumber AS run, coalesce(weight, 0.0) AS weight, CAST(l_returnflag = 'N' AS INTEGER) AS met FROM lineitem LEFT JOIN w ON criterion = l_partkey), "
       "q AS (SELECT run, question, sum(met * weight) / sum(weight) AS s FROM x GROUP BY ALL HAVING sum(weight) > 0) SELECT question, round(avg(s), 6) AS score FROM q GROUP BY question")
def looked_up_weights(spark, d):
    """Weights from a table of criteria; a criterion that it lacks weighs 0, and a question of such alone has no score."""
    w = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("criterion"), F.col("p_retailprice").alias("weight"))
    v = scoring.weighted_verdicts(verdict_rows(spark, d).drop("weight"), w, ["criterion"])
    return scoring.question_scores(v).select("question", r6("score").alias("score"))


_SEEDS = "WITH v AS (SELECT l_linenumber AS run, l_orderkey AS question, 42 + l_suppkey % 3 AS seed, l_linestatus AS cond, l_quantity AS weight, CAST(l_returnflag = 'N' AS INTEGER) AS met FROM lineitem), q AS (SELECT cond, seed, question, avg(s) AS s FROM (SELECT cond, seed, run, question, sum(met * weight) / sum(weight) AS s FROM v GROUP BY ALL) GROUP BY ALL) "


@query(_SEEDS + "SELECT a.seed, a.question, round(a.s - b.s, 6) AS delta FROM q a JOIN q b ON a.seed = b.seed AND a.question = b.question WHERE a.cond = 'O' AND b.cond = 'F'")
def stacked_seed_pairs(spark, d):
    """Two conditions paired by seed and question."""
    v = verdict_rows(spark, d).withColumnRenamed("class", "cond").withColumn("seed", 42 + F.col("rater") % 3)
    q = scoring.stacked_seeds(v, ["cond"], "seed")
    a, b = (q.where(F.col("cond") == c).select("seed", "question", F.col("score").alias(n)) for c, n in (("O", "a"), ("F", "b")))
    return a.join(b, ["seed", "question"]).select("seed", "question", r6(F.col("a") - F.col("b")).alias("delta"))


@query("WITH s AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'base_' || o_orderstatus ELSE 'ab_' || lower(left(substr(o_orderpriority, 3), 3)) || '_s' || CASE o_orderstatus WHEN 'F' THEN 43 ELSE 42 END || '_' || lower(o_orderstatus) END AS cond, avg(o_totalprice) AS score FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1), "
       "l AS (SELECT m.m AS model, r.r AS regime, CASE WHEN r.r = 'nenhum' THEN 'base_' || m.m ELSE 'ab_' || r.r || '_s' || CASE m.m WHEN 'F' THEN 43 ELSE 42 END || '_' || lower(m.m) END AS cond FROM (VALUES ('F'), ('O'), ('P')) m(m), (VALUES ('nenhum'), ('hig'), ('med'), ('low')) r(r)) "
       "SELECT model, regime, cond, round(score, 4) AS score FROM l LEFT JOIN s USING (cond)")
def starting_scores(spark, d):
    """The score that each model starts from in each regime; a condition that was not run stays null."""
    o = table(spark, d, "orders").where(~F.col("o_orderpriority").startswith("5"))
    p, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    seed = lambda c: F.when(c == "F", 43).otherwise(42)
    name = lambda model, regime: scoring.start_condition(model, regime, F.concat(F.lit("base_"), model), seed(model), F.lower(model))
    regime = F.when(p.startswith("1"), "nenhum").otherwise(F.lower(F.substring(p, 3, 3)))
    s = o.groupBy(name(st, regime).alias("cond")).agg(F.avg("o_totalprice").alias("score"))
    levels = spark.createDataFrame([(m, r) for m in "FOP" for r in ("nenhum", "hig", "med", "low")], "model string, regime string")
    starts = levels.withColumn("cond", name(F.col("model"), F.col("regime")))
    return scoring.starting_scores(s, starts, "cond").select("model", "regime", "cond", F.round("score", 4).alias("score"))
