"""Resumable incremental processing: files that came since the last run, appended once per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key has no finished row."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_available(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, keys: Sequence[str],
                  process: Callable[[DataFrame], DataFrame] = lambda df: df, file_glob: str = "*", source_glob: str = "") -> DataFrame:
    """Process the files not yet seen, append rows with new keys, and give the whole output.

    The checkpoint remembers files; a batch that runs twice after a failure finds its keys done. ``source_glob`` narrows the source to
    some of its entries, files or folders.
    """
    from corvane.sources.readers import exists

    def each(batch: DataFrame, _: int) -> None:
        rows = process(batch).dropDuplicates(list(keys))
        if exists(spark, f"{out}/*.parquet"):
            rows = pending(rows, spark.read.parquet(out), keys)
        rows.write.mode("append").parquet(out)

    where = f"{source.rstrip('/')}/{source_glob}" if source_glob else source
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("recursiveFileLookup", "true").parquet(where)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
