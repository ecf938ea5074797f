"""SimHash near duplicates with an exact check of word shingles after it, as the pipeline's stage asks.

A text is the set of its distinct runs of ``SHINGLE`` words (one run of all words if it has fewer). Two are linked if their
Jaccard similarity is ``SIMILARITY`` (a fraction) or more. Each set has a fingerprint of ``simhash``. Of two that differ in
``RADIUS`` bits or fewer, two of the eight blocks agree, so they meet under one of the 28 choices of two blocks; those within
the radius are compared by their whole sets, which lie as array files in the shared folder, so a link is never an estimate.

Similarity 0.8 bounds no number of bits (some ten of 64 differ, at times over twenty), so a second search finds what lies beyond
the radius: ``BANDS`` bands of ``ROWS`` minima, which a pair at 0.8 misses with probability below 10^-6, and the same exact check.
It starts from the links of the first and compares only what these leave apart. A run of candidates is searched in place and yields a spanning forest, never all
pairs; components are those of ``simhash``.

Words are ASCII-lowered bytes between ASCII white space, as in ``simhash``; shingles of a pair are told apart by 48-bit and sets by 64-bit
hashes.

Defined results: null, empty and blank texts are one set, equal to each other alone; the rest is as in ``simhash``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import simhash
from corvane.llm.common import materialize, shared_dir, spread
from corvane.llm.store import ArrayStore
from corvane.tables import fresh

SHINGLE = 5
SIMILARITY = (4, 5)
WIDTHS, RADIUS = (8,) * 8, 6
BANDS, ROWS = 36, 5
#: Fingerprints that a task compares at a time, beside those of a longer run.
HELD_MARKS = 100_000
#: Values that a task writes to one file, and that a searching task holds of the sets it has read.
FILE_VALUES = 1_000_000
HELD_VALUES = 4_000_000

_KEYS = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 48-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = max(1, len(words) - SHINGLE + 1)
    lasts = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), lasts.tolist())), dtype=np.uint64, count=n) >> np.uint64(16))


def name(values: np.ndarray) -> int:
    """The name of a set as an unsigned number."""
    return xxhash.xxh64_intdigest(values.tobytes())


def mark(values: np.ndarray) -> int:
    """The fingerprint of a set as an unsigned number; its values are spread over 64 bits first."""
    x = values * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return simhash.majority(x ^ (x >> np.uint64(31)))


def bands(values: np.ndarray) -> list[int]:
    """One signed number a band, equal where all minima of the band are; none for an empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, ((values[None, at:at + 1024] ^ _KEYS[0][:, None]) * _KEYS[1][:, None]).min(axis=1), out=least)
    return [simhash._signed(xxhash.xxh64_intdigest(row.tobytes())) for row in least.reshape(BANDS, ROWS)]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _marked(uri: str, column: int, names: list[str]):
    """Each row with the name of its text's set; where the set is new to the task, with its size, place, fingerprint and bands, and it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _files(uri)
        system.create_dir(root, recursive=True)
        placed: set[int] = set()
        held: list[np.ndarray] = []
        part, size = TaskContext.get().taskAttemptId() << 20, 0  # a name of this attempt alone

        def write() -> None:
            with system.open_output_stream(f"{root}/{part}") as out:
                for values in held:
                    out.write(pack(values))

        for batch in batches:
            rows = []
            for text in batch.column(column):
                values = shingles(text.as_py())
                fp = simhash._signed(name(values))
                if fp in placed:
                    rows.append((fp, None, None, None, None, None))
                    continue
                if len(placed) > 200_000:
                    placed.clear()
                placed.add(fp)
                rows.append((fp, len(values), part, size, simhash._signed(mark(values)), bands(values)))
                held.append(values)
                size += len(values)
                if size >= FILE_VALUES:
                    write()
                    held, part, size = [], part + 1, 0
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])
        if held:
            write()

    return run


def pack(values: np.ndarray) -> bytes:
    """Sorted values of 48 bits in six bytes each."""
    return (values >> np.uint64(16)).astype("<u4").tobytes() + (values & np.uint64(0xFFFF)).astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)


class _Sets:
    """Sets read from the shared folder, a bounded number of values held."""

    def __init__(self, uri: str):
        self.system, self.root = _files(uri)
        self._held: OrderedDict[int, np.ndarray] = OrderedDict()
        self._values = 0

    def __call__(self, row: tuple[int, int, int, int]) -> np.ndarray:
        fp, n, part, at = row
        if fp in self._held:
            self._held.move_to_end(fp)
            return self._held[fp]
        with self.system.open_input_file(f"{self.root}/{part}") as file:
            data = file.read_at(6 * n, 6 * at)
        if len(data) != 6 * n:
            raise FileNotFoundError(f"{self.root}/{part} is cut")
        got = unpack(data)
        self._held[fp] = got
        self._values += n
        while self._values > HELD_VALUES and len(self._held) > 1:
            self._values -= len(self._held.popitem(last=False)[1])
        return got


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of the others shares with the first."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    return np.add.reduceat((one[at] == joined).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def link_run(run: list[tuple[int, int, int, int]], sets, forest: simhash._Forest, marks: np.ndarray | None = None) -> None:
    """Union all sets of a run (name, size, place) that reach each other by links within the run; with marks, by links within the radius."""
    num, den = SIMILARITY
    rest = np.arange(len(run))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            node = run[at]
            near = rest if marks is None else rest[np.bitwise_count(marks[rest] ^ marks[at]) <= RADIUS]
            root, linked, tried = forest.find(node[0]), [], []
            for k in near.tolist():
                if forest.find(run[k][0]) == root:
                    linked.append(k)
                elif den * min(run[k][1], node[1]) >= num * max(run[k][1], node[1]):
                    tried.append(k)
            while tried:
                some, size = [], 0
                while tried and (not some or size + run[tried[-1]][1] <= FILE_VALUES):
                    size += run[tried[-1]][1]
                    some.append(tried.pop())
                shared = _common(sets(node), [sets(run[k]) for k in some])
                linked += [k for k, n in zip(some, shared.tolist()) if (num + den) * n >= num * (run[k][1] + node[1])]
            for k in linked:
                forest.union(node[0], run[k][0])
            if linked:
                rest = rest[~np.isin(rest, linked)]
                frontier += linked


def _indexed(uri: str, shards: int):
    """Write size and place of the sets of each shard of names; give their bands, one band after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(4)  # the bands
                keys = flat.flatten().to_numpy(zero_copy_only=False)
                sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
                parts.append([*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), sizes, keys])
        if not parts:
            return
        fp, n, part, at, sizes, keys = (np.concatenate(c) for c in zip(*parts))
        starts = np.cumsum(sizes) - sizes
        _, first = np.unique(fp, return_index=True)
        first = first[np.argsort(fp[first].view(np.uint64))]
        store = ArrayStore(uri)
        shard = fp[first] % shards
        for k in np.unique(shard).tolist():
            some = first[shard == k]
            store.write_all(f"place-{k}", {"fp": fp[some].view(np.uint64), "n": n[some], "part": part[some], "at": at[some]})
        some = first[sizes[first] == BANDS]
        rows = keys[starts[some][:, None] + np.arange(BANDS)] if len(some) else np.zeros((0, BANDS), dtype=np.int64)
        for band in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), band, dtype=np.int32)), pa.array(np.ascontiguousarray(rows[:, band])), pa.array(fp[some])], names=["band", "key", "fp"])

    return run


def _joined(uri: str, shards: int):
    """Write the edges found so far, by shard of their greater names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches if batch.num_rows]
        n = 0
        if parts:
            low, high = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(high)
            low, high, n = low[order], high[order], len(high)
            shard = high % shards
            store = ArrayStore(uri)
            for k in np.unique(shard).tolist():
                store.write_all(f"edge-{k}", {"low": low[shard == k], "high": high[shard == k]})
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


class _Places:
    """Size and place of sets by name, and the edges of the first search once these are written."""

    def __init__(self, uri: str, files: dict[str, int], shards: int):
        self.store, self.shards = ArrayStore(uri, files), shards

    def __call__(self, names: np.ndarray) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        shard = names % self.shards
        for k in np.unique(shard).tolist():
            have, some = self.store.read_all(f"place-{k}"), names[shard == k]
            at = np.searchsorted(have["fp"], some.view(np.uint64))
            out += zip(some.tolist(), *(have[c][at].tolist() for c in ("n", "part", "at")))
        return sorted(out)

    def join(self, names: np.ndarray, forest: simhash._Forest) -> None:
        """Union the sets along the edges that lead from them to smaller names."""
        shard = names % self.shards
        for k in np.unique(shard).tolist():
            have, some = self.store.read_all(f"edge-{k}"), names[shard == k]
            if have is not None:
                first, last = (np.searchsorted(have["high"], some, side) for side in ("left", "right"))
                for fp, a, b in zip(some.tolist(), first.tolist(), last.tolist()):
                    for low in have["low"][a:b].tolist():
                        forest.union(low, fp)


def _near_links(uri: str, places: str, files: dict[str, int], shards: int):
    """Edges of each run of equal (choice, bits of the choice) in a sorted partition: sets that are linked within the radius."""
    masks = np.array(simhash._masks(WIDTHS, RADIUS), dtype=np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sets, place = simhash._Forest(), _Sets(uri), _Places(places, files, shards)
        choice, marks, names = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            roots, nodes = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

        def search(final: bool) -> None:
            """Search the runs that are whole; the last one may go on."""
            nonlocal choice, marks, names, held, size
            choice, marks, names = (np.concatenate(c) for c in zip((choice, marks, names), *held))
            keys = marks & masks[choice]
            bounds = np.array([0, *(np.flatnonzero((np.diff(choice) != 0) | (keys[1:] != keys[:-1])) + 1), len(names)])
            if not final:
                bounds = bounds[:-1]
            done = bounds[-1]
            for group in simhash.near_groups(marks[:done], bounds, RADIUS):
                some, first = np.unique(names[group], return_index=True)
                if len(some) > 1:
                    link_run(place(some), sets, forest, marks[group[first]])
            choice, marks, names, held = choice[done:], marks[done:], names[done:], []
            size = 0

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > max(HELD_MARKS, len(names)):
                search(False)
            if len(forest.parent) >= simhash.FLUSH_EDGES:
                yield emit()
                forest.parent.clear()
        search(True)
        yield emit()

    return run


def _links(uri: str, places: str, files: dict[str, int], shards: int):
    """Edges of each run of equal (band, key) in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sets, place, held, last = simhash._Forest(), _Sets(uri), _Places(places, files, shards), [], None

        def emit() -> pa.RecordBatch:
            roots, nodes = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

        def close() -> None:
            names = np.unique(np.concatenate(held))
            if len(names) > 1:
                place.join(names, forest)
                if len({forest.find(x) for x in names.tolist()}) > 1:
                    link_run(place(names), sets, forest)

        for batch in batches:
            if not batch.num_rows:
                continue
            band, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero((np.diff(band) != 0) | (np.diff(key) != 0)) + 1).tolist(), len(fp)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b - a == 1 and 0 < k < len(cuts) - 2:
                    continue  # a run of one within the batch
                name = int(band[a]), int(key[a])
                if name != last:
                    if held:
                        close()
                    held, last = [], name
                held.append(fp[a:b])
            if len(forest.parent) >= simhash.FLUSH_EDGES:
                yield emit()
                forest.parent.clear()
        if held:
            close()
        yield emit()

    return run


def near_links(marked: DataFrame, search) -> DataFrame:
    """Edges that ``search`` finds in ``marked`` (``mark``, ``fp``), dealt by choices of two blocks of their fingerprints."""
    masks = F.array(*map(F.lit, simhash._masks(WIDTHS, RADIUS)))
    rows = marked.select(F.explode(F.sequence(F.lit(0), F.size(masks) - 1)).alias("choice"), "mark", "fp")
    key = F.col("mark").bitwiseAND(F.element_at(masks, F.col("choice") + 1))
    return rows.repartition("choice", key).sortWithinPartitions("choice", key).mapInArrow(search, "a long, b long").distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, one of each component of links, chosen as ``simhash.deduplicate`` does.

    The rows are written once beside their marks. The sets go when the links between them are found.
    """
    spark, uri = docs.sparkSession, shared_dir(docs.sparkSession, "shingles")
    names = fresh(docs.columns, "fp", "n", "part", "at", "mark", "bands")
    kinds = [T.LongType()] * 5 + [T.ArrayType(T.LongType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    rows = spread(docs).mapInArrow(_marked(uri, docs.columns.index("text"), names), schema)
    marked = simhash.numbered_rows(rows, docs, names)
    new = marked.select(*(F.col(c).alias(n) for c, n in zip(names, ("fp", "n", "part", "at", "mark", "bands")))).where("bands IS NOT NULL")
    shards, places = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_dir(spark, "places")

    def links(_: DataFrame) -> DataFrame:
        shard = lambda c: F.pmod(c, F.lit(shards)).cast("int")
        dealt = new.drop("mark").repartitionById(shards, shard("fp"))
        rows = materialize(dealt.mapInArrow(_indexed(places, shards), "band int, key long, fp long"), "bands")
        near = materialize(near_links(new.where("n > 0").select("mark", "fp"), _near_links(uri, places, ArrayStore(places).sizes(), shards)), "near")
        near.repartitionById(shards, shard("b")).mapInArrow(_joined(places, shards), "n long").agg(F.sum("n")).collect()
        files = ArrayStore(places).sizes()
        rest = rows.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(_links(uri, places, files, shards), "a long, b long")
        return near.unionAll(rest).distinct()

    def drop_sets() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return simhash.one_of_each(marked, docs.columns, names[0], links, drop_sets)
