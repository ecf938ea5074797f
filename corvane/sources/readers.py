"""Readers: JSON lines, JSON objects, CSV, Parquet, HTML, Atom, binary files, and a paged search API."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from corvane.session import ship


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) names something in its store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "drop") -> DataFrame:
    """JSON lines; bad lines are dropped, or kept in ``_raw`` (``bad="keep"``). A missing path is an empty table."""
    shape = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    full = T.StructType([*shape.fields, T.StructField("_raw", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full if bad == "keep" else shape)
    if bad == "keep":
        return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").json(path)
    return spark.read.schema(shape).option("mode", "DROPMALFORMED").json(path)


def json_object(spark: SparkSession, path: str, kind: str = "map<string,array<string>>") -> DataFrame:
    """Files of one JSON object each, as rows (file, key, value)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", kind).alias("m"))
    return whole.select("file", F.explode("m").alias("key", "value"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(file, question, run from 1, answer) of answer files."""
    return json_object(spark, path).select("file", F.col("key").alias("question"), F.posexplode("value").alias("run", "answer")).withColumn("run", F.col("run") + 1)


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header, quoted line breaks and cells of any length."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    return (reader.schema(schema) if schema else reader).csv(path)


def by_file_name(spark: SparkSession, path: str, schema: str, pattern: str, names: list[str]) -> DataFrame:
    """JSON lines of a glob or a folder tree, with columns taken from each file's path by the groups of a pattern."""
    files = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("_path", F.url_decode(F.col("_metadata.file_path")))
    for k, name in enumerate(names, 1):
        files = files.withColumn(name, F.nullif(F.regexp_extract("_path", pattern, k), F.lit("")))
    return files.drop("_path")


def resolve(spark: SparkSession, path: str, pattern: str = "*", keep: str = "true") -> DataFrame:
    """(path, bytes, content) of the files below a folder whose names match a glob and that pass a filter given as SQL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), "content").where(keep)


def valid_download(content: Column, text: Column, least: int = 800) -> Column:
    """Whether bytes begin with the PDF mark and their text is long enough."""
    return F.coalesce((F.substring(content, 1, 4) == F.lit(b"%PDF")) & (F.length(text) >= least), F.lit(False))


def convert_frame(spark: SparkSession, load, out: str, chunk: int = 10_000) -> None:
    """Write a frame that ``load()`` gives on the driver as Parquet, a slice at a time: the one safe way in for pickled frames.

    Unpickling runs what a file says, so it is left to a caller who trusts the file, and never done on executors.
    """
    frame = load()
    for at in range(0, max(len(frame), 1), chunk):
        spark.createDataFrame(frame.iloc[at:at + chunk]).write.mode("append").parquet(out)


def pdf_like(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Binary files that begin with the PDF mark and are long enough; text extraction is left to ``extract``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where((F.substring("content", 1, 4) == F.lit(b"%PDF")) & (F.length("content") >= least))


def extract(files: DataFrame, extractor) -> DataFrame:
    """(path, text) by an injected ``extractor(bytes) -> str``, batch by batch."""
    import pandas as pd

    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "text": [extractor(bytes(b)) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def atom(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, url) of the entries of an Atom feed, highest number first."""
    feed = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>").load(path)
    number = F.regexp_extract("title", r"n\. (\d+)", 1).try_cast("int")
    return feed.select(number.alias("number"), "title", F.col("link._href").alias("url")).where("number IS NOT NULL").orderBy(F.desc("number"))


#: Bytes of a hit as pages are counted, and bytes that a task reads at least, since each costs a worker's start.
HIT_BYTES, LEAST_BYTES = 200, 16_000_000


class SearchSource(DataSource):
    """A paged search API, replayed from a folder of JSON lines (hits with ``id``, ISO ``date``, ``title`` and ``body``).

    Filters on ``date`` are pushed to the reader, as a service would take them. A partition of the scan is a range of a file's bytes, about
    ``pagesPerTask`` pages of ``pageSize`` hits long and ``LEAST_BYTES`` at least: no task reads what lies before its range.
    """

    @classmethod
    def name(cls) -> str:
        return "corvane_search"

    def schema(self) -> str:
        return "id string, date string, title string, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SearchReader(self.options["path"], int(self.options.get("pageSize", 10)), int(self.options.get("pagesPerTask", 100)))


class _SearchReader(DataSourceReader):
    def __init__(self, path: str, size: int, per_task: int):
        self.path, self.step, self.low, self.high = path, max(size * per_task * HIT_BYTES, LEAST_BYTES), "", "\uffff"

    @staticmethod
    def _files(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo)) and f.attribute == ("date",):
                if not isinstance(f, LessThanOrEqual):
                    self.low = max(self.low, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.high = min(self.high, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._files(self.path)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.is_file and info.base_name.endswith(".json"):
                found += [InputPartition((info.path, at, at + self.step)) for at in range(0, info.size, self.step)]
        return found or [InputPartition((None, 0, 0))]

    def read(self, partition: InputPartition):
        import io

        path, first, last = partition.value
        if path is None:
            return
        system, _ = self._files(self.path)
        with system.open_input_file(path) as raw:
            src = io.BufferedReader(raw, 1 << 20)
            if first:  # a line belongs to the range that holds its first byte
                src.seek(first - 1)
                src.readline()
            while src.tell() < last and (line := src.readline()):
                hit = json.loads(line) if line.strip() else {}
                if hit and self.low <= (hit.get("date") or "") <= self.high:
                    yield hit.get("id"), hit.get("date"), hit.get("title"), hit.get("body")


def search(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, limit: int | None = None, page_size: int = 10) -> DataFrame:
    """Hits of a date range, one of each id, newest first; at most ``limit`` if given."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    hits = spark.read.format("corvane_search").option("path", path).option("pageSize", page_size).load()
    if since is not None:
        hits = hits.where(F.col("date") >= since)
    if until is not None:
        hits = hits.where(F.col("date") <= until)
    if limit is None:
        return hits.dropDuplicates(["id"])
    return hits.dropDuplicates(["id"]).orderBy(F.desc("date"), "id").limit(limit)


def seeded(spark: SparkSession, seeds: DataFrame, url: str, fetch: Callable[[str], str], limit: int | None = None) -> DataFrame:
    """(url, content, error) of seeded addresses by an injected ``fetch(url) -> str``; an error leaves the content null."""
    import pandas as pd

    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for address in pdf["url"]:
                try:
                    rows.append((address, fetch(address), None))
                except Exception as e:  # noqa: BLE001 - the row records it
                    rows.append((address, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    some = seeds.select(F.col(url).alias("url"))
    return (some if limit is None else some.orderBy("url").limit(limit)).mapInPandas(run, "url string, content string, error string")


def best_candidate(candidates: DataFrame, key: str, text: str, n: str, position: str) -> DataFrame:
    """Of several fetched texts, the one with most articles; of equal ones the first."""
    best = F.max(F.struct(F.col(n).alias("n"), (-F.col(position)).alias("p"), F.col(text).alias("t")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, F.col("b.t").alias(text), F.col("b.n").alias(n))


def coverage_state(found, known):
    """ok from 80 % of the known articles on, partial above none, else failed."""
    return F.when(found >= 0.8 * known, "ok").when(found > 0, "partial").otherwise("failed")
