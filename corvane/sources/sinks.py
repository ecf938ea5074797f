"""Writers: JSON lines, idempotent appends, upserts and rendered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.audit import ensure_none
from corvane.tables import fresh


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, done: DataFrame | None, keys: Sequence[str], path: str) -> None:
    """Append the rows whose keys are not done yet."""
    rows = df if done is None else df.join(done.select(*keys).distinct(), list(keys), "left_anti")
    rows.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Both tables with the latest row of each key."""
    (rank,) = fresh(old.columns, "rank")
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return old.unionByName(new).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def state(df: DataFrame, path: str) -> None:
    """A small result (a state, a manifest or a report) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def nested(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """One row an outer key, with a map from inner keys to values: a nested table of latest states."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string"), F.col(value)))))
    return df.where(F.col(inner).isNotNull()).groupBy(outer).agg(pairs.alias("states"))


def package(files: DataFrame, out: str, stored: DataFrame | None = None) -> int:
    """A local ``tar.gz`` of files (``path``, ``content``), one after the other; gives their number.

    With a manifest (``path``), an error if a file of it is not there. An archive is written by the driver, a file at a time.
    """
    import io
    import tarfile

    if stored is not None:
        ensure_none(stored.select("path").join(files.select("path"), "path", "left_anti"), "files missing")
    n = 0
    with tarfile.open(out, "w:gz") as archive:
        for row in files.select("path", "content").orderBy("path").toLocalIterator():
            info = tarfile.TarInfo(row.path.split("://", 1)[-1].lstrip("/"))
            info.size = len(row.content)
            archive.addfile(info, io.BytesIO(bytes(row.content)))
            n += 1
    return n


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (a report; longer tables are refused, not cut)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table is small")
    cell = lambda v: "—" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def html_table(df: DataFrame, label: str, values: Sequence[str], most: int = 1000) -> str:
    """A small result as an HTML table; the best value of each row is set in bold."""
    rows = df.select(label, *values, F.greatest(*values).alias("__best") if len(values) > 1 else F.col(values[0]).alias("__best")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table is small")

    def cell(v, best) -> str:
        text = "—" if v is None else f"{v:.1f}"
        return f"<td><b>{text}</b></td>" if v is not None and v == best else f"<td>{text}</td>"

    body = "".join(f"<tr><th>{r[0]}</th>{''.join(cell(r[v], r['__best']) for v in values)}</tr>" for r in rows)
    return f"<table><tr><th>{label}</th>{''.join(f'<th>{v}</th>' for v in values)}</tr>{body}</table>"
