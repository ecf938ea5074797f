"""Token ids as wavelet matrices: one succinct, compressed file a shard.

A shard holds the ids of whole documents, in ascending ``doc_id`` order. Its bit-planes, from the highest bit down, are
stable partitions of the sequence, compressed in blocks of ``BLOCK`` bytes beside the count of ones before each; with rank and
select on the planes a token can be read, counted or found by unpacking one block a plane, not the shard. ``encode`` writes shards as rows of a Parquet table (one binary cell is one shard file: the
committer makes it atomic, and any store that Spark writes will do), and ``decode`` reads them back.

Defined results: a null text is an empty text (the end id alone); null ``doc_id`` sorts first; rows with equal ``doc_id``
are all kept, ordered by text; an empty table gives no shards. A shard is closed after the document that brings it to
``SHARD_TOKENS``, so a longer document has a shard of its own. Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shared_dir
from corvane.llm.tokens import END_ID, default_tokenizer_path, encoder

SHARD_TOKENS = 1_000_000
MAGIC = b"WVM2"
#: Bytes of a plane that are compressed together, and between stored ranks.
BLOCK = 8192
#: Unpacked blocks that a reader holds.
HELD_BLOCKS = 64


class Plane:
    """A plane's bits in compressed blocks, and the ones before each."""

    def __init__(self, n: int, blocks: list[bytes], ranks: np.ndarray):
        self.n, self.blocks, self.ranks = n, blocks, ranks
        self._held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.unpacked = 0

    @classmethod
    def build(cls, mask: np.ndarray) -> Plane:
        packed = np.packbits(mask)
        parts = [packed[at:at + BLOCK] for at in range(0, len(packed), BLOCK)]
        ones = [int(np.bitwise_count(p).sum()) for p in parts]
        return cls(len(mask), [zstandard.compress(p.tobytes(), 1) for p in parts], np.cumsum([0, *ones], dtype=np.int64))

    def block(self, k: int) -> np.ndarray:
        got = self._held.get(k)
        if got is None:
            got = self._held[k] = np.frombuffer(zstandard.decompress(self.blocks[k]), dtype=np.uint8)
            self.unpacked += 1
            if len(self._held) > HELD_BLOCKS:
                self._held.popitem(last=False)
        return got

    def bit(self, i: int) -> int:
        return int(self.block(i // (8 * BLOCK))[i // 8 % BLOCK] >> (7 - i % 8) & 1)

    def rank(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        k, inside = divmod(i, 8 * BLOCK)
        ones = int(self.ranks[k])
        if inside:
            part = self.block(k)
            ones += int(np.bitwise_count(part[:inside // 8]).sum())
            ones += int(part[inside // 8] >> (8 - inside % 8)).bit_count() if inside % 8 else 0
        return ones

    def select(self, k: int, bit: int) -> int:
        """Position of the ``k``-th (from 0) bit of a kind: its block by the stored ranks, its place within by the block's bits."""
        ends = np.minimum(np.arange(1, len(self.ranks)) * 8 * BLOCK, self.n)
        before = self.ranks[1:] if bit else ends - self.ranks[1:]
        at = int(np.searchsorted(before, k, side="right"))
        first = at * 8 * BLOCK
        bits = np.unpackbits(self.block(at), count=min(8 * BLOCK, self.n - first))
        seen = int(self.ranks[at]) if bit else first - int(self.ranks[at])
        return first + int(np.flatnonzero(bits == bit)[k - seen])

    def mask(self) -> np.ndarray:
        whole = b"".join(zstandard.decompress(b) for b in self.blocks)
        return np.unpackbits(np.frombuffer(whole, dtype=np.uint8), count=self.n).view(bool)


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned integers, with access, rank, count and select."""

    def __init__(self, n: int, bits: int, planes: list[Plane]):
        self.n, self.bits, self.planes = n, bits, planes
        self.zeros = [n - int(p.ranks[-1]) for p in planes]

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        n = len(values)
        bits = max(1, int(values.max()).bit_length()) if n else 1
        planes = []
        seq = np.ascontiguousarray(values)
        for b in range(bits - 1, -1, -1):
            mask = (seq & seq.dtype.type(1 << b)) != 0
            planes.append(Plane.build(mask))
            # Taking by places is much faster than by masks.
            low, split = np.flatnonzero(~mask), np.empty_like(seq)
            np.take(seq, low, out=split[:len(low)])
            np.take(seq, np.flatnonzero(mask), out=split[len(low):])
            seq = split
        return cls(n, bits, planes)

    def to_bytes(self) -> bytes:
        """Header, then for each plane its ranks, the sizes of its blocks, and the blocks."""
        out = [MAGIC, struct.pack("<QHI", self.n, self.bits, len(self.planes[0].blocks))]
        for plane in self.planes:
            out += [plane.ranks.astype("<u8").tobytes(), np.array([len(b) for b in plane.blocks], dtype="<u4").tobytes(), *plane.blocks]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """A reader over a shard's bytes; blocks are unpacked when they are asked for."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits, blocks = struct.unpack_from("<QHI", data, 4)
        at, planes, view = 18, [], memoryview(data)
        for _ in range(bits):
            ranks = np.frombuffer(data, dtype="<u8", count=blocks + 1, offset=at).astype(np.int64)
            at += 8 * (blocks + 1)
            sizes = np.frombuffer(data, dtype="<u4", count=blocks, offset=at).tolist()
            at += 4 * blocks
            parts = []
            for size in sizes:
                parts.append(view[at:at + size])
                at += size
            planes.append(Plane(n, parts, ranks))
        return cls(n, bits, planes)

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self.planes[level].rank(i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The value at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self.planes[level].bit(i)
            value = value << 1 | bit
            i = self._down(level, i, bit)
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = value >> (self.bits - 1 - level) & 1
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` in positions ``lo`` to ``hi`` (exclusive)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, value: int) -> list[int]:
        """All positions of ``value``, ascending, by select up the planes."""
        a, b = self._range(value, 0, self.n)
        found = []
        for at in range(a, b):
            i = at
            for level in range(self.bits - 1, -1, -1):
                bit = value >> (self.bits - 1 - level) & 1
                i = self.planes[level].select(i - self.zeros[level] if bit else i, bit)
            found.append(i)
        return sorted(found)

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest bit."""
        seq = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint64)
        for level in range(self.bits - 1, -1, -1):
            mask = self.planes[level].mask()
            up = np.empty_like(seq)
            zeros = self.zeros[level]
            seq[zeros:] |= seq.dtype.type(1 << (self.bits - 1 - level))
            up[np.flatnonzero(~mask)] = seq[:zeros]
            up[np.flatnonzero(mask)] = seq[zeros:]
            seq = up
        return seq


SHARD_SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(path, end_id)
        ids, arrays, size, shard = [], [], 0, 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(arrays))
            row = [[part], [shard], [size], [ids], [[len(a) for a in arrays]], [matrix.to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "shard", "n_tokens", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = words.encode(text.as_py())
                ids.append(doc_id)
                arrays.append(got)
                size += len(got)
                if size >= shard_tokens:
                    yield close()
                    ids, arrays, size, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    return run


def encode(docs: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = END_ID,
           shard_tokens: int = SHARD_TOKENS) -> None:
    """Write ``docs(doc_id, text)`` as wavelet shards below ``out``; one shuffle, by range of ``doc_id``.

    There are as many range partitions as the session's shuffle setting has, or the input has, whichever is more; sorting
    within partitions spills if it must.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    path = tokenizer_path or default_tokenizer_path()
    ranged.mapInArrow(_shards(path, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(out)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for k in range(batch.num_rows):
            seq = WaveletMatrix.from_bytes(rows["payload"][k]).decode().astype("<u4")
            lengths = np.array(rows["lengths"][k], dtype=np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            view = memoryview(seq).cast("B")
            crcs = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            size = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_ids"][k], pa.int64()), pa.array(starts + rows["base"][k]), pa.array(lengths),
                 pa.array(crcs, pa.int64()), pa.array([rows["part"][k]] * size, pa.int32()),
                 pa.array([rows["shard"][k]] * size, pa.int32())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"])


def shard_bases(shards: DataFrame) -> DataFrame:
    """The ids before each shard: sums over parts first, then within each part, so no window holds all shards."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner_base"))
    joined = inner.join(parts, "part")
    return joined.select("part", "shard", (F.col("part_base") + F.col("inner_base")).alias("base"))


def decode(spark, out: str) -> DataFrame:
    """One row a document, read back from the shards below ``out``: its first position, length and checksum of ids."""
    shards = spark.read.parquet(out)
    bases = shard_bases(shards.select("part", "shard", "n_tokens"))
    full = shards.select("part", "shard", "doc_ids", "lengths", "payload").join(bases, ["part", "shard"])
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int"
    picked = full.select("part", "shard", "doc_ids", "lengths", "payload", "base")
    return picked.mapInArrow(_unpack, fields)


def roundtrip(docs: DataFrame, **options) -> DataFrame:
    out = shared_dir(docs.sparkSession, "wavelet")
    encode(docs, out, **options)
    return decode(docs.sparkSession, out)
