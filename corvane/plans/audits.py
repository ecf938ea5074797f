"""Audit and relational queries: profiles, leaks, secrets, set operations, states, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import audit, selection, verdicts
from corvane.plans.base import Registry, r6, table
from corvane.sources import readers
from corvane.streaming import resume
from corvane.tables import lagged, shared_dir

query = Registry()


@query("SELECT count(*) AS n_rows, count(DISTINCT upper(trim(CAST(doc_id AS VARCHAR)))) AS n_ids, count(nullif(trim(text), '')) AS n_filled, CAST(floor(median(length(nullif(trim(text, ' '), '')))) AS INTEGER) AS median_length FROM documents")
def field_profile(spark, d):
    return audit.field_profile(table(spark, d, "documents"), ["doc_id"], "text")


@query("SELECT lang, source, count(*) AS n_lines, count(DISTINCT left(text, 120)) AS n_docs FROM documents GROUP BY ALL")
def granularity_ratio(spark, d):
    return audit.group_granularity(table(spark, d, "documents"), ["lang", "source"], "text", "^<<JURIS.BRUTO.([^>]+)>>")


@query("SELECT source, round(avg(CAST(l.doc_id IS NOT NULL AS INTEGER)), 6) AS coverage FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING 1 - avg(CAST(l.doc_id IS NOT NULL AS INTEGER)) > 0.2")
def coverage_drop(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("k", F.lit(1)), "doc_id", "left")
    g = j.groupBy("source").agg(F.avg(F.col("k").isNotNull().cast("int")).alias("c"))
    return g.where("1 - c > 0.2").select("source", r6("c").alias("coverage"))


@query("WITH a AS (SELECT DISTINCT upper('D' || doc_id) AS k FROM documents), b AS (SELECT DISTINCT upper('d' || doc_id) AS k FROM labels) SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, round((SELECT count(*) FROM a JOIN b USING (k)) * 1.0 / (SELECT count(*) FROM a), 6) AS share")
def cross_arm_pairing(spark, d):
    key = lambda p: X.normal_id(F.concat(F.lit(p), F.col("doc_id").cast("string"))).alias("k")
    p = audit.pairing(table(spark, d, "documents").select(key("D-")), table(spark, d, "labels").select(key("d.")), "k")
    return p.select("n_left", "n_right", "n_both", r6("share").alias("share"))


@query("SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def leak_containment(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item_text"))
    return audit.contained_items(table(spark, d, "documents").select("doc_id", "text"), items)


@query("WITH x AS (SELECT source AS block, lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') AS n FROM documents) SELECT block, count(*) AS n_lines, count(DISTINCT CAST(n AS INTEGER)) AS n_exams, min(CAST(n AS INTEGER)) AS first_exam, max(CAST(n AS INTEGER)) AS last_exam, "
       "coalesce(string_agg(DISTINCT CAST(CAST(n AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(CAST(n AS INTEGER) AS VARCHAR)) FILTER (WHERE CAST(n AS INTEGER) IN (39, 40, 41)), '') AS leaked FROM x GROUP BY block")
def leak_by_id_prefix(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("block"), F.concat(F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit("-disc-x")).alias("id"))
    return audit.leak_by_prefix(x, "block", "id", [39, 40, 41]).withColumn("leaked", F.array_join(F.col("leaked").cast("array<string>"), ","))


_RX = {name: rx.replace("'", "''") for name, rx in audit.SECRET_PATTERNS.items()}


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS n FROM documents) "
       + " UNION ALL ".join(f"SELECT doc_id, CAST(n AS INTEGER) AS line, '{name}' AS pattern FROM l WHERE regexp_matches(line, '{rx}')" for name, rx in _RX.items()))
def secret_scan_lines(spark, d):
    return audit.scan_lines(table(spark, d, "documents"), "doc_id", "text")


_PROFILE = ("WITH d AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)), p AS (SELECT source AS family, count(*) AS n_rows, count(DISTINCT CASE WHEN n_chars > 15000 THEN lang ELSE 'x' END) AS n_ids, "
            "avg(CAST(length(text) >= 1000 AS INTEGER)) AS filled, avg(CAST(n_chars >= 300 AS INTEGER)) AS before, avg(CAST(n_chars >= 1500 AS INTEGER)) AS after, max(n_chars) >= 12000 AS expanded, avg(CAST(labelled AS INTEGER)) AS paired, "
            "sum(n_chars) / 2000.0 / count(*) AS granularity FROM d GROUP BY source) ")


@query(_PROFILE + "SELECT family, 'empty_field' AS finding, CAST(0 AS INTEGER) AS severity FROM p WHERE filled < 0.5 UNION ALL SELECT family, 'coverage_drop', 1 FROM p WHERE before - after > 0.2 "
       "UNION ALL SELECT family, 'one_id', 2 FROM p WHERE n_ids <= 1 AND n_rows > 10 UNION ALL SELECT family, 'not_expanded', 3 FROM p WHERE NOT expanded UNION ALL SELECT family, 'pairing', 4 FROM p WHERE paired < 0.5 "
       "UNION ALL SELECT family, 'granularity', 5 FROM p WHERE NOT granularity BETWEEN 0.67 AND 1.5")
def provenance_findings(spark, d):
    """All six checks over profiles of sources; texts stand for ids, labels for the other arm."""
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    share = lambda c: F.avg(c.cast("int"))
    p = j.groupBy(F.col("source").alias("family")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("n_chars") > 15000, F.col("lang")).otherwise("x")).alias("n_ids"), share(F.length("text") >= 1000).alias("filled_share"),
        share(F.col("n_chars") >= 300).alias("coverage_before"), share(F.col("n_chars") >= 1500).alias("coverage_after"), (F.max("n_chars") >= 12000).alias("expanded"),
        share(F.col("labelled").isNotNull()).alias("paired_share"), (F.sum("n_chars") / 2000.0 / F.count(F.lit(1))).alias("granularity"))
    return audit.provenance_findings(p)


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def resume_pending(spark, d):
    e = table(spark, d, "events")
    return resume.pending(e, e.where("event_type = 'purchase' AND value > 90"), ["user_id"]).select("event_id", "user_id")


@query("WITH a AS (SELECT l_orderkey AS question, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT o_orderkey AS question, CAST(4 - coalesce(n, 0) AS BIGINT) AS lacking FROM orders LEFT JOIN a ON o_orderkey = question WHERE 4 - coalesce(n, 0) > 0")
def missing_runs(spark, d):
    """Orders as questions that want four answers; returned lines are stub answers, which do not count."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"))
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.concat(F.when(F.col("l_returnflag") == "R", "STUB:").otherwise("ok:"), F.col("l_linestatus")).alias("answer"))
    return verdicts.missing_runs(q, a, "question", 4)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_state_per_key(spark, d):
    return selection.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


_YEARS = list(range(1992, 1999))


@query("SELECT o_orderpriority AS class, " + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in _YEARS) + ", count(*) AS total FROM orders GROUP BY 1")
def class_by_period_matrix(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.year("o_orderdate").alias("y"))
    p = o.groupBy("class").agg(*(F.count_if(F.col("y") == y).alias(f"y{y}") for y in _YEARS), F.count(F.lit(1)).alias("total"))
    return p


@query("WITH g AS (SELECT event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) SELECT event_type, count(*) FILTER (WHERE gap < 60000000) AS n_tight FROM g GROUP BY event_type")
def run_gap_check(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    g = lagged(e, ["event_type"], ["ts", "event_id"], "us", "before")
    return g.groupBy("event_type").agg(F.count_if(F.col("us") - F.col("before") < 60_000_000).alias("n_tight"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def streaming_resume(spark, d):
    at = shared_dir(spark, "stream")
    schema = table(spark, d, "events").schema
    return resume.run_available(spark, d, schema, f"{at}/out", f"{at}/log", ["event_id"], file_glob="*.parquet", source_glob="events.parquet*")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_difference(spark, d):
    return audit.missing_from(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT c_name AS name, 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, 's', s_acctbal FROM supplier")
def bag_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT doc_id, source FROM documents WHERE upper(source) IN (SELECT upper(source) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def semi_join_case_insensitive(spark, d):
    docs = table(spark, d, "documents")
    keys = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").select(F.lower("source").alias("k")).distinct()
    return docs.withColumn("k", F.lower("source")).join(keys, "k", "left_semi").select("doc_id", "source")


@query("WITH n AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower('us.' || p_type || '.' || replace(p_name, ' ', '-') || ':v1'), '[.\\-:_ ]'), lambda x: length(x) > 2 AND x <> 'us')) AS t FROM part), "
       "q AS (SELECT DISTINCT p_name || ' (' || p_type || ')' AS quota, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part WHERE p_size <= 3), "
       "x AS (SELECT p_partkey, quota, len(list_intersect(t, w)) AS c FROM n, q) SELECT p_partkey, quota, CAST(c AS INTEGER) AS common FROM x WHERE c >= 2 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, quota) = 1")
def best_match_lookup(spark, d):
    """Names built like model ids against quota names: the one with most words in common, two at the least."""
    p = table(spark, d, "part")
    names = p.select("p_partkey", F.concat(F.lit("us."), "p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":v1")).alias("id"))
    quotas = p.where("p_size <= 3").select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("quota")).distinct()
    return audit.best_name(names, quotas, "p_partkey", "id", "quota")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def referential_closure(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("WITH s AS (SELECT l_suppkey AS k, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 1 END AS ok, l_suppkey % 11 AS h FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT k AS path, CASE WHEN ok = 0 THEN 'FALTA' ELSE 'MUDOU' END AS state FROM s WHERE ok = 0 OR h = 0")
def manifest_verify(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path")).distinct()
    found = s.where("path % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 11 == 0, "changed").otherwise("same"))
    return audit.verify_manifest(s.withColumn("sha256", F.lit("same")), found)


@query()
def file_manifest(spark, d):
    return audit.manifest(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "n_lines", "sha256")


@query("WITH f AS (SELECT CASE WHEN n_chars > 8000 THEN source ELSE lang || '/' || source || '/' || doc_id END AS path, n_chars, length(text) - length(replace(text, chr(10), '')) AS n FROM documents) "
       "SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS top, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS n_lines FROM f GROUP BY 1")
def package_summary(spark, d):
    path = F.when(F.col("n_chars") > 8000, F.col("source")).otherwise(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")))
    files = table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("bytes"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))
    return audit.by_top_folder(files)


_NAMES = "(WITH e AS (SELECT event_id, event_type || '/' || user_id || CASE WHEN value > 95 THEN '.pem' WHEN value > 90 THEN '/.env.local' WHEN value > 85 THEN '/usuarios.json' ELSE '.txt' END AS path FROM events) SELECT * FROM e)"


@query(f"SELECT event_id, path FROM {_NAMES} WHERE regexp_matches(split_part(path, '/', -1), '(?i)(\\.pem|\\.key|\\.p12|\\.pfx|id_rsa|id_ed25519|\\.env.*|usuarios\\.json|\\.netrc|credentials)$')")
def forbidden_files(spark, d):
    v = F.col("value")
    tail = F.when(v > 95, ".pem").when(v > 90, "/.env.local").when(v > 85, "/usuarios.json").otherwise(".txt")
    e = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit("/"), "user_id", tail).alias("path"))
    return audit.forbidden_files(e, "path")


@query("WITH i AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'sft/bloco_' || l_linenumber || '/' || l_suppkey || '/train.jsonl' ELSE 'cpt/' || l_suppkey || '/train.jsonl' END AS path, l_quantity AS n FROM lineitem) "
       "SELECT regexp_extract(path, '^sft/bloco_([^/]*)/', 1) AS block, CAST(sum(n) AS DOUBLE) AS n FROM i WHERE regexp_matches(path, '^sft/bloco_') GROUP BY 1")
def block_sizes(spark, d):
    li = table(spark, d, "lineitem")
    path = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("sft/bloco_"), "l_linenumber", F.lit("/"), "l_suppkey", F.lit("/train.jsonl"))).otherwise(F.concat(F.lit("cpt/"), "l_suppkey", F.lit("/train.jsonl")))
    return audit.block_sizes(li.select(path.alias("path"), F.col("l_quantity").alias("lines")), "path", "lines").groupBy("block").agg(F.sum("n").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT l_suppkey, l_quantity AS n, l_partkey AS part FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber, l_partkey DESC) = 1")
def best_candidate(spark, d):
    """Parts as candidate texts of a supplier, quantity as their number of articles."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return readers.best_candidate(li, "l_suppkey", "part", "n", "position")


@query("WITH c AS (SELECT CAST(l_linenumber AS INTEGER) AS n FROM lineitem) SELECT n, CASE WHEN n >= 0.8 * 7 THEN 'ok' WHEN n > 1 THEN 'partial' ELSE 'failed' END AS state, count(*) AS n_rows FROM c GROUP BY ALL")
def coverage_states(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n"))
    state = readers.coverage_state(F.when(F.col("n") > 1, F.col("n")).otherwise(0), F.lit(7))
    return li.groupBy("n", state.alias("state")).agg(F.count(F.lit(1)).alias("n_rows"))


_TITLES = "t AS (SELECT p_partkey, ' ' || p_name || ' ' AS title, p_size FROM part), k AS (SELECT trim(title) AS title, max(CASE WHEN length(trim(title)) > 11 THEN 'formal' ELSE 'merito' END) AS kind FROM t WHERE p_size <= 2 GROUP BY 1) "


@query(f"WITH {_TITLES} SELECT p_partkey, kind FROM t JOIN k ON trim(t.title) = k.title")
def title_classes(spark, d):
    return _titles(spark, d)[0].select("p_partkey", "kind")


@query(f"WITH {_TITLES} SELECT trim(title) AS title, count(*) AS n FROM t WHERE trim(title) NOT IN (SELECT title FROM k) GROUP BY 1")
def titles_without_class(spark, d):
    return _titles(spark, d)[1]


def _titles(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), "p_size")
    kind = F.when(F.length(F.trim("title")) > 11, "formal").otherwise("merito")
    return audit.unmatched_titles(p, audit.modal_classes(p.where("p_size <= 2").withColumn("kind", kind), "title", "kind"), "title", "kind")


_LEVELS = "c AS (SELECT DISTINCT event_type AS class FROM events), y AS (SELECT unnest(range(2010, 2027))::INTEGER AS year)"


@query(f"WITH {_LEVELS}, s AS (SELECT DISTINCT event_type AS class, CAST(2010 + user_id % 17 AS INTEGER) AS year FROM events WHERE value > 60) SELECT class, year, make_date(year, 1, 1) AS first, make_date(year, 12, 31) AS last FROM c, y WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.class = c.class AND s.year = y.year)")
def pending_cells(spark, d):
    e = table(spark, d, "events")
    state = e.where("value > 60").select(F.col("event_type").alias("class"), (2010 + F.col("user_id") % 17).cast("int").alias("year")).distinct()
    years = spark.range(2010, 2027).select(F.col("id").cast("int").alias("year"))
    return verdicts.pending_cells(e.select(F.col("event_type").alias("class")).distinct(), years, state)
