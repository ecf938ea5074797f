"""Selection queries: budgets, quotas, samples, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import selection
from corvane.plans.base import Registry, r6, table

query = Registry()


@query("WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY sha256('42|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) SELECT doc_id, CAST(running AS BIGINT) AS running FROM s WHERE running <= 500000")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", selection.shuffle_key(42, "doc_id").alias("h"))
    return selection.budget_prefix(docs, ["h", "doc_id"], "n_chars", 500_000).select("doc_id", "running")


@query("WITH s AS (SELECT lang, source, sum(n_chars) AS s FROM documents GROUP BY ALL), m AS (SELECT lang, min(s) AS least FROM s GROUP BY lang) SELECT lang, CAST(least AS BIGINT) AS least, round(least * 1e6 / sum(least) OVER (), 4) AS quota FROM m")
def group_quota_scaled(spark, d):
    q = selection.scaled_quotas(table(spark, d, "documents"), "lang", "source", "n_chars", 1e6)
    return q.select("lang", "least", F.round("quota", 4).alias("quota"))


@query("WITH l AS (SELECT lang, list_transform(list(struct_pack(doc_id, n_chars) ORDER BY doc_id), lambda x: {'c': CAST(x.n_chars AS DOUBLE), 'id': x.doc_id, 'room': 100000.0::DOUBLE, 'kept': CAST([] AS BIGINT[])}) AS l FROM documents GROUP BY lang), "
       "f AS (SELECT lang, list_reduce(list_prepend({'c': 0::DOUBLE, 'id': 0::BIGINT, 'room': 100000.0::DOUBLE, 'kept': CAST([] AS BIGINT[])}, l), lambda a, x: CASE WHEN x.c <= a.room THEN {'c': a.c, 'id': a.id, 'room': a.room - x.c, 'kept': list_append(a.kept, x.id)} ELSE a END) AS f FROM l) "
       "SELECT k.doc_id, k.lang, n_chars FROM (SELECT lang, unnest(f.kept) AS doc_id FROM f) k JOIN documents d ON d.doc_id = k.doc_id AND d.lang = k.lang")
def quota_fill_greedy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return selection.quota_fill(docs, "lang", ["doc_id"], "n_chars", F.lit(100_000.0))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id)) <= 20")
def stratified_hash_sample(spark, d):
    return selection.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("WITH p AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25) SELECT doc_id, source FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id)) <= 5")
def stratified_first_candidates(spark, d):
    return selection.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, first=25)


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5")
def topn_per_topic(spark, d):
    return selection.first_n(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"], 5)


_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b}))"
_DIVERSE = ("f AS (SELECT {by}, vec_id, embedding::DOUBLE[] AS e FROM {src} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY vec_id) <= 5), "
            "l AS (SELECT {by}, list_transform(list(struct_pack(vec_id, e) ORDER BY vec_id), lambda x: {{'id': [x.vec_id], 'e': [x.e]}}) AS l FROM f GROUP BY ALL), "
            "g AS (SELECT {by}, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a.e, lambda y: " + _COS.format(a="y", b="x.e[1]") + " >= 0.85)) = 0 THEN {{'id': list_concat(a.id, x.id), 'e': list_concat(a.e, x.e)}} ELSE a END) AS k FROM l) ")


@query("WITH " + _DIVERSE.format(by="label", src="embeddings") + "SELECT unnest(k.id) AS vec_id, label FROM g")
def greedy_diverse_selection(spark, d):
    return selection.greedy_diverse(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5, 0.85).select("vec_id", "label")


@query("WITH t AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic FROM embeddings) SELECT vec_id, topic FROM t QUALIFY topic = -1 OR row_number() OVER (PARTITION BY topic ORDER BY vec_id) <= 3")
def outliers_kept_whole(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"))
    return selection.with_outliers(selection.first_n(t, ["topic"], ["vec_id"], 3), t, "topic")


@query("WITH f AS (SELECT vec_id, label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5) SELECT a.vec_id AS v1, b.vec_id AS v2, "
       "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cos FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id")
def within_topic_cosine(spark, d):
    f = selection.first_n(table(spark, d, "embeddings"), ["label"], ["vec_id"], 5)
    a = f.select("label", F.col("vec_id").alias("v1"), F.col("embedding").alias("e1"))
    b = f.select("label", F.col("vec_id").alias("v2"), F.col("embedding").alias("e2"))
    return a.join(b, "label").where("v1 < v2").select("v1", "v2", F.round(selection.cosine(F.col("e1"), F.col("e2")), 5).alias("cos"))


@query("WITH t AS (SELECT vec_id, embedding, vec_id % 2 AS archive, label FROM embeddings), " + _DIVERSE.format(by="archive, label", src="t") + "SELECT unnest(k.id) AS vec_id, archive, label FROM g")
def archive_topics(spark, d):
    """Each archive has topics of its own: the selection goes by (archive, topic)."""
    e = table(spark, d, "embeddings").withColumn("archive", F.col("vec_id") % 2).withColumn("topic", F.struct("archive", "label"))
    return selection.greedy_diverse(e, "topic", "vec_id", "embedding", 5, 0.85).select("vec_id", "archive", "label")


_TERMS = "regexp_extract_all(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[\\p{L}\\p{N}_]{2,}')"


@query(f"WITH w AS (SELECT doc_id, {_TERMS} AS w FROM documents), e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), "
       "tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), "
       "k AS (SELECT term, df FROM df, n WHERE df >= 5 AND df <= 0.35 * n ORDER BY total DESC, term LIMIT 60000), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN k USING (term), n) "
       "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def tfidf_weights(spark, d):
    return selection.tfidf(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "term", r6("weight").alias("weight"))


@query()
def kmeans_topics(spark, d):
    return selection.kmeans_topics(table(spark, d, "embeddings"), "embedding", 10).select("vec_id", "topic")


@query()
def lsa_components(spark, d):
    return selection.lsa(table(spark, d, "embeddings"), "embedding", 8).select("vec_id", "components")


@query()
def lsa_topics(spark, d):
    """Terms weighted, projected on leading components, scaled to length one and grouped: topics of whole documents."""
    return selection.topics(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", method="lsa", k=20, components=16, features=400).select("doc_id", "topic")


@query("SELECT vec_id, label AS topic FROM embeddings")
def given_topics(spark, d):
    """Topics from a model outside, as a column of the table."""
    return selection.topics(table(spark, d, "embeddings"), "vec_id", "embedding", method="given", given="label").select("vec_id", "topic")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def dedup_keep_longest(spark, d):
    return selection.keep_longest(table(spark, d, "documents").select("source", "text", "doc_id"), "source", "text", "doc_id").select("doc_id", "source")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return g.where("n > 1")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def top_k(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(12)


@query("SELECT doc_id FROM documents WHERE n_chars > 300 ORDER BY (lang = 'en') DESC, (source = 'src1') DESC, n_chars DESC, doc_id LIMIT 50")
def multi_key_sort_limit(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 300")
    return docs.orderBy((F.col("lang") == "en").desc(), (F.col("source") == "src1").desc(), F.desc("n_chars"), "doc_id").limit(50).select("doc_id")


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10) SELECT l_orderkey, l_linenumber FROM c ORDER BY sha256('7|' || l_orderkey || '|' || l_linenumber) LIMIT 1")
def seeded_pick(spark, d):
    """The first (question, criterion) of a seeded order that passes the filter: what drawing again until one passes gives."""
    c = table(spark, d, "lineitem").where("l_quantity >= 10").select("l_orderkey", "l_linenumber").distinct()
    return selection.seeded_pick(c, ["l_orderkey", "l_linenumber"], 7)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS m FROM supplier ORDER BY m DESC NULLS LAST, s_suppkey LIMIT 30")
def null_last_sort(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("m"))
    return s.orderBy(F.desc_nulls_last("m"), "s_suppkey").limit(30)
