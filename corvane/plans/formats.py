"""Round trips of whole tables through the formats that readers and sinks know, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.base import Registry, table
from corvane.sources import readers, sinks
from corvane.tables import shared_dir

query = Registry()
#: Bytes of text that the answer files of one part hold, all languages together.
OBJECT_BYTES = 16_000_000
_DOCS = "SELECT doc_id, md5(text) AS digest, lang, source FROM documents"


def _marked(df):
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "source")


@query(_DOCS)
def jsonl_scan(spark, d):
    """JSON lines with two bad lines among them, which the reader drops."""
    at = shared_dir(spark, "jsonl")
    sinks.jsonl(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), at)
    spark.createDataFrame([("not json",), ("{\"doc_id\": ",)], "value string").coalesce(1).write.mode("append").text(at)
    return _marked(readers.jsonl(spark, at, "doc_id long, text string, lang string, source string"))


@query("SELECT count(*) AS n_good, CAST(2 AS BIGINT) AS n_bad FROM documents")
def jsonl_bad_lines(spark, d):
    """Bad lines kept beside the rows, and a missing path as an empty table."""
    at = shared_dir(spark, "jsonl")
    sinks.jsonl(table(spark, d, "documents").select("doc_id", "text"), at)
    spark.createDataFrame([("not json",), ("[1, 2",)], "value string").coalesce(1).write.mode("append").text(at)
    rows = readers.jsonl(spark, at, "doc_id long, text string", bad="keep").unionByName(readers.jsonl(spark, f"{at}-none", "doc_id long, text string", bad="keep"))
    return rows.agg(F.count("doc_id").alias("n_good"), F.count("_raw").alias("n_bad"))


@query(_DOCS)
def csv_scan(spark, d):
    """CSV with a header, line breaks inside cells and cells of any length."""
    at = shared_dir(spark, "csv")
    table(spark, d, "documents").select("doc_id", "text", "lang", "source").write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(at)
    rows = readers.csv(spark, at, "doc_id long, text string, lang string, source string")
    return _marked(rows.withColumn("text", F.coalesce("text", F.lit(""))))


@query("SELECT lang || '_' || doc_id AS question, CAST(r AS INTEGER) AS run, CASE WHEN r = 1 THEN md5(text) ELSE source END AS answer FROM documents, (VALUES (1), (2)) AS r(r)")
def json_object_answers(spark, d):
    """One JSON object a file: questions with lists of answers, read as (question, run, answer). A language has as many files as keep each in bounds."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "source")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(held // OBJECT_BYTES + 1))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "lang", "doc_id"), F.array("text", "source"))))
    folder = shared_dir(spark, "objects")
    docs.groupBy("lang", part.alias("part")).agg(F.to_json(entries).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    a = readers.answers(spark, folder)
    return a.select("question", "run", F.when(F.col("run") == 1, F.md5(F.col("answer").cast("binary"))).otherwise(F.col("answer")).alias("answer"))


@query("SELECT CAST(page_id AS INTEGER) AS number, 'Informativo n. ' || page_id || ' de ' || left(url, 20) AS title, url FROM pages")
def atom_feed(spark, d):
    at = shared_dir(spark, "atom")
    entry = F.struct(F.concat(F.lit("Informativo n. "), "page_id", F.lit(" de "), F.substring("url", 1, 20)).alias("title"), F.struct(F.col("url").alias("_href")).alias("link"))
    table(spark, d, "pages").select(entry.alias("e")).select("e.*").write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(at)
    return readers.atom(spark, at)


@query("SELECT event_type AS kind, 's' || CAST(user_id % 4 AS INTEGER) AS seed, event_id FROM events")
def path_columns(spark, d):
    """A folder tree of JSON lines; two columns come from the paths alone."""
    at = shared_dir(spark, "paths")
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 4).cast("int").alias("seed"), "event_id")
    e.write.partitionBy("event_type", "seed").json(at)
    rows = readers.by_file_name(spark, at, "event_id long", r"event_type=(\w+)/seed=(\d+)/", ["kind", "seed"])
    return rows.withColumn("seed", F.concat(F.lit("s"), "seed"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS date, event_type AS title FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'")
def paged_search(spark, d):
    """A date range of a paged search, pushed to the source; hits that come twice are taken once."""
    at = shared_dir(spark, "search")
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("title"), "props")
    sinks.jsonl(e.withColumnRenamed("props", "body"), at)
    sinks.jsonl(e.where("event_type = 'click'").withColumnRenamed("props", "body"), at, mode="append")
    return readers.search(spark, at, since="2024-01-05", until="2024-01-20").select("id", "date", "title")


@query("SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS date FROM events ORDER BY date DESC, id LIMIT 25")
def newest_hits(spark, d):
    at = shared_dir(spark, "search")
    sinks.jsonl(table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("t").alias("title"), F.lit("b").alias("body")), at)
    return readers.search(spark, at, limit=25).select("id", "date")


@query("SELECT page_id FROM pages WHERE page_id % 3 > 0 AND length(html) >= 800")
def valid_downloads(spark, d):
    """Downloads that begin with the PDF mark and have text enough."""
    p = table(spark, d, "pages").withColumn("content", F.concat(F.when(F.col("page_id") % 3 > 0, F.lit("%PDF-1.7")).otherwise(F.lit("<html>")), "html").cast("binary"))
    return p.where(readers.valid_download(F.col("content"), F.col("html"), 800)).select("page_id")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE md5(reverse(url)) END AS content, page_id % 4 = 0 AS failed FROM pages")
def seeded_fetch(spark, d):
    """Addresses fetched by an injected call; a failing one leaves its error in its row."""
    def fetch(url: str) -> str:
        if url.startswith("0"):
            raise OSError("gone")
        return url[2:][::-1]

    seeds = table(spark, d, "pages").select("page_id", F.concat((F.col("page_id") % 4).cast("string"), F.lit(" "), "url").alias("u"))
    got = readers.seeded(spark, seeds, "u", fetch)
    return seeds.join(got.distinct(), F.col("u") == got["url"]).select("page_id", F.md5(F.col("content").cast("binary")).alias("content"), F.col("error").isNotNull().alias("failed"))


@query("SELECT 'nation.parquet' AS name UNION ALL SELECT 'region.parquet'")
def resolved_files(spark, d):
    """Files of a folder that match a glob and a filter on their size and name."""
    found = readers.resolve(spark, d, "*n.parquet", "bytes > 0 AND NOT path LIKE '%lineitem%'")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upserted_states(spark, d):
    """Half of the events as the old table, half as new rows: the latest of each key stays."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return sinks.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("SELECT event_id, value FROM events")
def appended_once(spark, d):
    """Rows appended twice over: the second time only those whose keys are not there."""
    at = shared_dir(spark, "appended")
    e = table(spark, d, "events").select("event_id", "value")
    sinks.append_new(e.where("event_id % 3 = 0"), None, ["event_id"], at)
    sinks.append_new(e, spark.read.parquet(at), ["event_id"], at)
    return spark.read.parquet(at)


@query("SELECT event_type, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY event_type")
def state_file(spark, d):
    """A small state written as JSON and read again, nulls kept."""
    at = shared_dir(spark, "state")
    sinks.state(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("error")), at)
    return readers.jsonl(spark, at, "event_type string, n long, error string")
