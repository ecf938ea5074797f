"""SimHash near duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks. Two that differ in three bits or fewer agree in at least three blocks,
so they meet under one of the 20 choices of three blocks (32 bits or so). Distinct fingerprints are dealt by (choice,
bits), sorted, and each run of equal bits is searched in place: a run yields a spanning forest of its links, never all
pairs. A long run is cut by the same argument once more: of the bits in which it varies, cut into four fields, two linked
fingerprints agree in at least one. Runs that a sample shows to be very long are cut so before they are dealt, over tasks.
Components of the forest edges: every node points to its smallest neighbour, pointers are doubled until all point to roots,
and what links two roots goes on to the next round. A chain of any length takes rounds in the logarithm of its length.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows of equal text or ``doc_id`` are
all kept; a null ``doc_id`` links but never names a component (a component of nulls alone is null); an empty table gives
no rows; a text of any length is one fingerprint. ``deduplicate`` passes columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import materialize, shared_dir, spread
from corvane.llm.store import ArrayStore
from corvane.tables import fresh

SHINGLE = 3
SEED = 42
MAX_BITS = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Runs beyond this are cut by further bits before they are searched; no case is lost.
DIRECT_RUN = 2_000
#: Runs of about this length or more, by a sample of so many fingerprints, are cut before they are dealt.
LONG_RUN, SAMPLE = 50_000, 200_000
#: Edges that a task holds before it contracts and emits them.
FLUSH_EDGES = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    lasts = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    pairs = zip(starts[:n].tolist(), lasts.tolist())
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _with_fingerprint(column: int, name: str, mark: Callable[[str | None], int] = fingerprint):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([_signed(mark(t.as_py())) for t in batch.column(column)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, name])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64 bits), written once in the shared folder."""
    texts = spread(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")))
    marked = texts.mapInArrow(_with_fingerprint(0, "fp"), "text string, doc_id long, fp long")
    return materialize(marked.select("doc_id", "fp"), "fingerprints")


def _masks(widths: Sequence[int] = WIDTHS, most: int = MAX_BITS) -> list[int]:
    """Choices of blocks: of two fingerprints that differ in ``most`` bits or fewer, one choice sees no difference."""
    at, blocks = 64, []
    for width in widths:
        at -= width
        blocks.append(((1 << width) - 1) << at)
    return [_signed(sum(c)) for c in combinations(blocks, len(widths) - most)]


class _Forest:
    """Union-find over fingerprints, for edges met in one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in list(self.parent) if self.find(x) != x]
        return [self.find(x) for x in nodes], nodes


def _fields(bits: list[int], most: int = MAX_BITS) -> list[int]:
    """Masks that together hold all the bits: of two values that differ in ``most`` of them or fewer, one mask sees no difference."""
    return [sum(1 << b for b in part) for part in (bits[k::most + 1] for k in range(most + 1))]


def near_groups(marks: np.ndarray, bounds: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions, by run (``bounds`` has the starts and the end), of marks that have another within ``most`` bits in their run.

    Two such marks of a run meet in a group. A run beyond ``LONG_RUN`` is cut by fields of the bits in which it varies, as long
    as that at least halves it.
    """
    long = np.flatnonzero(np.diff(bounds) > LONG_RUN)
    for k in long.tolist():
        yield from _cut_group(marks, np.arange(bounds[k], bounds[k + 1]), most)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    runs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = _near_rows(marks, np.where(np.isin(runs, long), 0, ends), most)
    if len(near):
        yield from np.split(near, np.flatnonzero(np.diff(runs[near])) + 1)


def _near_rows(marks: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Positions with another of the same run (up to ``ends``) within ``most`` bits; all runs are compared at one distance at a time."""
    near, at, step = np.zeros(len(marks), dtype=bool), np.flatnonzero(np.arange(1, len(marks) + 1) < ends), 1
    while len(at):
        found = at[np.bitwise_count(marks[at] ^ marks[at + step]) <= most]
        near[found] = near[found + step] = True
        step += 1
        at = at[at + step < ends[at]]
    return np.flatnonzero(near)


def _cut_group(marks: np.ndarray, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    varying = int(np.bitwise_or.reduce(marks[at] ^ marks[at[0]]))
    for mask in _fields([b for b in range(64) if varying >> b & 1], most):
        keys = marks[at] & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        for part in np.split(at[order], np.flatnonzero(np.diff(keys[order])) + 1):
            if LONG_RUN < len(part) <= len(at) // 2:
                yield from _cut_group(marks, part, most)
            elif len(part) > 1:
                near = part[_near_rows(marks[part], np.full(len(part), len(part)), most)]
                if len(near):
                    yield near


def link_run(run: np.ndarray, forest: _Forest) -> None:
    """Union all fingerprints of a run (unsigned, distinct) that reach each other by links within the run."""
    if len(run) > DIRECT_RUN:
        varying = int(np.bitwise_or.reduce(run ^ run[0]))
        bits = [b for b in range(64) if varying >> b & 1]
        if len(bits) > MAX_BITS:
            for mask in _fields(bits):
                keys = run & np.uint64(mask)
                order = np.argsort(keys)
                cuts = np.flatnonzero(np.diff(keys[order])) + 1
                for part in np.split(run[order], cuts):
                    if len(part) > 1:
                        link_run(part, forest)
            return
    rest = run
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= MAX_BITS
            if near.any():
                hits = rest[near]
                rest = rest[~near]
                a = _signed(int(node))
                for b in hits.tolist():
                    forest.union(a, _signed(b))
                frontier.extend(hits)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each run of equal (choice, bits) in a sorted partition."""
    forest, held, last = _Forest(), [], None

    def emit() -> pa.RecordBatch:
        roots, nodes = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    def close() -> None:
        run = np.unique(np.concatenate(held))
        if len(run) == 2:
            if int(run[0] ^ run[1]).bit_count() <= MAX_BITS:
                forest.union(*(_signed(int(x)) for x in run))
        elif len(run) > 2:
            link_run(run, forest)

    for batch in batches:
        if not batch.num_rows:
            continue
        choice = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1
        edges = np.concatenate([[0], cuts, [len(fp)]])
        sizes = np.diff(edges)
        for k in range(len(sizes)):
            first, final = k == 0, k == len(sizes) - 1
            if not first and not final and sizes[k] == 1:
                continue
            lo, hi = int(edges[k]), int(edges[k + 1])
            name = (int(choice[lo]), int(bits[lo]))
            if name != last:
                if held:
                    close()
                held, last = [], name
            held.append(fp[lo:hi])
        if len(forest.parent) >= FLUSH_EDGES:
            yield emit()
            forest.parent.clear()
    if held:
        close()
    yield emit()


def links(unique: DataFrame) -> DataFrame:
    """Edges (``a`` < ``b``) that connect all fingerprints with links between them; ``unique`` holds distinct ``fp``."""
    masks = _masks()
    place = lambda i, m: F.struct(F.lit(i).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
    rows = unique.select(F.explode(F.array(*(place(i, m) for i, m in enumerate(masks)))).alias("x"), "fp").select("x.c", "x.k", "fp")
    total = unique.count()
    if total >= LONG_RUN:
        # Where runs are long only steers how they are dealt, so a sample of them will do. Its size bounds the list.
        share = min(1.0, SAMPLE / total)
        some = rows if share == 1.0 else unique.sample(share, seed=1).select(F.explode(F.array(*(place(i, m) for i, m in enumerate(masks)))).alias("x")).select("x.*")
        long = materialize(some.groupBy("c", "k").count().where(F.col("count") >= max(20.0, LONG_RUN * share)).select("c", "k", F.lit(True).alias("long")), "long-runs")
        if long.limit(1).count():
            finer = [[_signed((m & 0xFFFFFFFFFFFFFFFF) | f) for f in _fields([b for b in range(64) if not m >> b & 1])] for m in masks]
            cut = F.element_at(F.array(*(F.array(*(place(len(masks) + (MAX_BITS + 1) * i + j, m) for j, m in enumerate(ms))) for i, ms in enumerate(finer))), F.col("c") + 1)
            marked = rows.join(F.broadcast(long), ["c", "k"], "left")  # at most 20 * SAMPLE / 20 rows
            rows = marked.select(F.explode(F.when(F.col("long"), cut).otherwise(F.array(F.struct("c", "k")))).alias("x"), "fp").select("x.c", "x.k", "fp")
    return rows.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that has an edge (``a``, ``b``)."""
    edges = materialize(edges, "edges")
    total: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("other"))
        step = materialize(least.select("node", F.least("node", "other").alias("root")), "step")
        while True:  # double the pointers until each points to a root
            up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(step.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            step = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if total is None:
            total = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = materialize(total.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(marks: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """For each distinct ``fp``: ``root`` (names its component) and ``component_id`` (its smallest ``doc_id``)."""
    unique = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    roots = components(link(unique))
    named = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    marks = fingerprints(docs)
    joined = marks.join(classes(marks).select("fp", "component_id"), "fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, one of each component: that of the smallest ``doc_id``; of several such rows, that of the smallest content hash.

    Needs ``doc_id`` and ``text``; other columns pass through.
    """
    (name,) = fresh(docs.columns, "fp")
    marked = numbered_rows(spread(docs).mapInArrow(_with_fingerprint(docs.columns.index("text"), name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])), docs, [name])
    return one_of_each(marked, docs.columns, name, links)


def numbered_rows(marked: DataFrame, docs: DataFrame, marks: list[str]) -> DataFrame:
    """``marked`` written once, with a number and a content hash (of the columns of ``docs``) for each row."""
    number, content = fresh(marked.columns, "row", "content")
    cells = [F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c) for c, f in zip(docs.columns, docs.schema.fields)]
    return materialize(marked.withColumns({number: F.monotonically_increasing_id(), content: F.xxhash64(*cells)}), "marked")


def _store_kept(uri: str):
    """Write the numbers of kept rows, one file a part of the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, last, n = ArrayStore(uri), [], None, 0

        def close() -> int:
            rows = np.sort(np.concatenate(held))
            store.write_all(f"kept-{last}", {"rows": rows})
            return len(rows)

        for batch in batches:
            parts, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts[a] != last:
                    n += close() if held else 0
                    held, last = [], int(parts[a])
                held.append(rows[a:b])
        n += close() if held else 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _keep(uri: str, files: dict[str, int], number: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ArrayStore(uri, files)
        for batch in batches:
            rows = batch.column(number).to_numpy(zero_copy_only=False)
            kept = np.zeros(len(rows), dtype=bool)
            for part in np.unique(rows >> 33).tolist():
                have = store.read_all(f"kept-{part}")
                if have is not None and len(have["rows"]):
                    mine = rows >> 33 == part
                    at = np.minimum(np.searchsorted(have["rows"], rows[mine]), len(have["rows"]) - 1)
                    kept[mine] = have["rows"][at] == rows[mine]
            yield pa.RecordBatch.from_arrays(batch.columns[:columns], names=batch.schema.names[:columns]).filter(pa.array(kept))
        store.close()

    return run


def one_of_each(marked: DataFrame, columns: list[str], name: str, link: Callable[[DataFrame], DataFrame], done: Callable[[], None] = lambda: None) -> DataFrame:
    """``deduplicate`` for any mark of texts: ``marked`` holds ``columns``, the mark in ``name``, and the columns of ``numbered_rows``.

    Texts are not shuffled: which rows stay is written in one small file a part, and a filter reads the file of its part. ``link``
    gives edges between the distinct marks; ``done`` is called when they are no longer needed.
    """
    number, content = marked.columns[-2:]
    marks = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("fp"), F.col(number).alias("row"), F.col(content).alias("content"))
    found = marks.join(classes(marks, link), "fp")
    done()
    # A component without a single id has a null name, which only rows without an id equal.
    order = F.struct((~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"), "content", "row")
    heads = found.groupBy("root").agg(F.min(order).alias("h")).select(F.col("h.row").alias("row"))
    uri = shared_dir(marked.sparkSession, "kept")
    parts = heads.select(F.shiftright("row", 33).cast("int").alias("part"), "row")
    parts.repartition("part").sortWithinPartitions("part").mapInArrow(_store_kept(uri), "n long").agg(F.sum("n")).collect()
    keep = _keep(uri, ArrayStore(uri).sizes(), marked.columns.index(number), len(columns))
    return marked.mapInArrow(keep, marked.select(*columns).schema)
