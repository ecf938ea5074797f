"""Tables in the folder that all machines share, and column names that are free."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column (of any case) has it."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder of this machine is set once, if the executors are on this machine too; on
    a cluster the absence is an error, since no executor would see another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it is planned once, and a lost executor costs a read."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table up to which it is sent to every executor.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if its cells hold ``limit`` bytes at most; else it is joined as Spark sees fit."""
    cells = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    held = df.agg(F.sum(cells)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def ranged(df: DataFrame, order: Sequence[str], amount: str, label: str) -> tuple[DataFrame, str, str]:
    """The rows in ranges of an order, each with its range's number and the sum of ``amount`` over all ranges before.

    The ranges are written once, so that rows and sums cannot come from two plans with different borders. The sums are one
    row a range. Gives the table and the names of both new columns.
    """
    part, base, total = fresh(df.columns, "range", "before", "total")
    rows = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), label)
    sums = rows.groupBy(part).agg(F.sum(amount).alias(total))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, F.coalesce(F.sum(total).over(upto), F.lit(0)).alias(base))
    return rows.join(F.broadcast(sums), part), part, base


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 1 within ``by``, in ``order``: as a window gives, but a large group spreads over ranges.

    Rows are ranged by (by, order); counts a range and group give each its first number. A window then runs within a range.
    """
    part, n, base = fresh([*df.columns, out], "range", "n", "before")
    rows = materialize(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = rows.groupBy(*by, part).agg(F.count(F.lit(1)).alias(n))
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, part, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(base))
    names = fresh([*df.columns, out, part, base], *(f"by_{c}" for c in by))
    first = first.withColumnsRenamed(dict(zip(by, names))).withColumnRenamed(part, part + "_")
    on = rows[part] == first[part + "_"]
    for c, m in zip(by, names):
        on = on & rows[c].eqNullSafe(first[m])
    inner = Window.partitionBy(part, *by).orderBy(*order)
    return rows.join(first, on).withColumn(out, F.col(base) + F.row_number().over(inner)).drop(part, base, part + "_", *names)


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """The value of the row before within ``by``, in ``order``: as a window gives, but a large group spreads over ranges.

    The first row of a group in a range takes the last value of the group's nearest range before.
    """
    part, last, prior = fresh([*df.columns, out], "range", "last", "prior")
    rows = materialize(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "lagged")
    ends = rows.groupBy(*by, part).agg(F.max_by(column, F.struct(*order)).alias(last))
    ends = ends.withColumn(prior, F.lag(last).over(Window.partitionBy(*by).orderBy(part)))
    names = fresh([*df.columns, out, part, last, prior], *(f"by_{c}" for c in by))
    ends = ends.select(F.col(part).alias(part + "_"), prior, *(F.col(c).alias(m) for c, m in zip(by, names)))
    on = rows[part] == ends[part + "_"]
    for c, m in zip(by, names):
        on = on & rows[c].eqNullSafe(ends[m])
    inner = Window.partitionBy(part, *by).orderBy(*order)
    first = F.row_number().over(inner) == 1
    return rows.join(ends, on).withColumn(out, F.when(first, F.col(prior)).otherwise(F.lag(column).over(inner))).drop(part, part + "_", prior, *names)
