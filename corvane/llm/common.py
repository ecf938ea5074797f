"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.session import ship
from corvane.tables import materialize as _materialize
from corvane.tables import shared_dir as _shared_dir


#: Bytes of an Arrow batch that goes to a worker, where the session has not set its own: texts are long, and either side holds
#: a batch more than once.
BATCH_BYTES, _DEFAULT_BYTES = "8m", 64 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _ready(spark: SparkSession) -> None:
    """Code for the workers that come next, and batches of a size that fits them."""
    ship(spark)
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(_DEFAULT_BYTES):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share."""
    _ready(spark)
    return _shared_dir(spark, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the written files, not a new computation.
    """
    _ready(df.sparkSession)
    return _materialize(df, label)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as the cluster has cores, where a small input has fewer.

    Inputs with enough partitions pass without a shuffle. The workers that come next get this package's code.
    """
    _ready(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def local_path(uri: str) -> str | None:
    """The path behind a ``file:`` address or a plain path; None for another store."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri if "://" not in uri else None
