"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is 13 consecutive words of a
benchmark item (an item of fewer words is one window). A shard is a run of documents of some ``SHARD_WORDS`` words: all their
words, over the shard's own vocabulary, each distinct text once and closed by a sentinel of its own, are indexed. Suffixes are
sorted by prefix doubling of what is still tied; their Burrows-Wheeler string lies in a wavelet matrix of bit planes with
counts a machine word, and every ``SAMPLE``-th suffix position is kept. All windows are searched backward at once by ranks,
occurrences are located by walks to the next sampled one, and overlapping spans of a document are merged.

The benchmark is read by the driver in blocks of at most ``BLOCK_BYTES`` of text, one at a time, and each block's windows are
written to the shared folder. A worker builds a shard's index once and searches block after block from those files, so a larger
benchmark costs time, and memory neither on the driver nor on a worker.

Defined results: null and empty texts have no words, no hits, and are not contaminated; equal rows are each searched; an
empty benchmark hits nothing; null items are skipped, and a null ``item_id`` counts as the text ``null``; an empty table gives no
rows; a text longer than a shard is a shard of its own. Columns of any name pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import shared_dir, spread
from corvane.llm.store import ArrayStore
from corvane.tables import fresh

WINDOW = 13
BLOCK_BYTES = 16_000_000
#: Words that a shard holds, but for a single longer text.
SHARD_WORDS = 1_000_000
SAMPLE = 32
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Windows:
    """The distinct windows of some benchmark items as rows of vocabulary ids, and the items of each."""

    def __init__(self, vocabulary: list[bytes], items: list[str], rows: np.ndarray, lengths: np.ndarray, owner_ends: np.ndarray, owners: np.ndarray):
        self.vocabulary, self.items = vocabulary, items
        self.rows, self.lengths, self.owner_ends, self.owners = rows, lengths, owner_ends, owners

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], width: int = WINDOW) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[at:at + width]), set()).add(k)
        rows = np.zeros((len(found), width), dtype=np.int32)  # right-aligned
        for i, w in enumerate(found):
            rows[i, width - len(w):] = w
        return cls(list(vocabulary), [name for name, _ in items], rows, np.array([len(w) for w in found], dtype=np.int64),
                   np.cumsum([len(v) for v in found.values()], dtype=np.int64), np.array([k for v in found.values() for k in sorted(v)], dtype=np.int64))

    def write(self, store: ArrayStore, name: str) -> None:
        flat = lambda parts: np.frombuffer(b"\n".join(parts), dtype=np.uint8)  # noqa: E731 - neither words nor coded names hold a line feed
        names = flat([n.encode("utf-8", "replace").replace(b"%", b"%25").replace(b"\n", b"%0A") for n in self.items])
        store.write_all(name, {"vocabulary": flat(self.vocabulary), "items": names, "rows": self.rows.ravel(), "lengths": self.lengths,
                               "owner_ends": self.owner_ends, "owners": self.owners})

    @classmethod
    def read(cls, store: ArrayStore, name: str, width: int = WINDOW) -> Windows:
        a = store.read_all(name)
        split = lambda b: b.tobytes().split(b"\n") if len(b) else []
        names = [n.replace(b"%0A", b"\n").replace(b"%25", b"%").decode("utf-8") for n in (a["items"].tobytes().split(b"\n"))]
        return cls(split(a["vocabulary"]), names, a["rows"].reshape(-1, width), a["lengths"], a["owner_ends"], a["owners"])


class BitPlane:
    """Bits with the count of ones before each machine word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-self.n // 64) * 64 + 64, dtype=bool)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)
        self.zeros = self.n - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of the suffix at each place; each 0 is a sentinel that sorts by its place.

    Prefix doubling: places are ordered by their first symbols, then only those still tied by twice as many.
    """
    n = len(symbols)
    zero = symbols == 0
    n_zero = int(zero.sum())
    counts = np.bincount(symbols, minlength=1)
    counts[0] = 0
    rank = (n_zero + np.cumsum(counts) - counts)[symbols]
    rank[zero] = np.arange(n_zero)
    open_ = np.flatnonzero(~zero & (counts[symbols] > 1))
    h = 1
    while len(open_):
        key = rank[open_] * np.int64(n + 1) + rank[open_ + h]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = key // np.int64(n + 1)
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(open_))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[open_] = group + first_of_key - first_of_group
        last = np.concatenate([new_key[1:], [True]])
        open_ = open_[~(new_key & last)]
        h *= 2
    return rank


class FMIndex:
    """Index of a sequence of texts: ``symbols`` with a 0 after each text; each 0 sorts by its place."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        rank = suffix_ranks(symbols)
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        self.levels = max(1, int(symbols.max()).bit_length()) if n else 1
        self.planes: list[BitPlane] = []
        row = np.concatenate([symbols[-1:], symbols[:-1]])[order].astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.planes.append(BitPlane(bit))
            row = np.concatenate([row[~bit], row[bit]])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.levels))])
        starts = np.concatenate([[True], symbols[:-1] == 0]) if n else np.zeros(0, dtype=bool)
        sampled = (order % SAMPLE == 0) | starts[order]
        self.marked, self.samples = BitPlane(sampled), order[sampled].astype(np.int32 if n < 1 << 31 else np.int64)

    def _bottom(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place, by descent with its own start."""
        for k, plane in enumerate(self.planes):
            one = (symbol >> (self.levels - 1 - k) & 1) == 1
            ones = plane.rank(at)
            at = np.where(one, plane.zeros + ones, at - ones)
            ones = plane.rank(base)
            base = np.where(one, plane.zeros + ones, base - ones)
        return at - base

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (symbols right-aligned, 0 before them) that occur, with the range of suffixes of each."""
        alive = np.arange(len(rows))
        lo, hi = np.zeros(len(alive), dtype=np.int64), np.full(len(alive), self.n, dtype=np.int64)
        for k in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[alive, k].astype(np.int64)
            live = symbol > 0
            if k == rows.shape[1] - 1:  # all suffixes stand before the last word: its own range
                new_lo, new_hi = self.before[symbol], self.before[symbol + 1]
            else:
                base = np.zeros(len(alive), dtype=np.int64)
                new_lo = np.where(live, self.before[symbol] + self._bottom(symbol, lo, base), lo)
                new_hi = np.where(live, self.before[symbol] + self._bottom(symbol, hi, base), hi)
            keep = new_lo < new_hi
            alive, lo, hi = alive[keep], new_lo[keep], new_hi[keep]
        return alive, lo, hi

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out = np.full(len(suffixes), -1, dtype=np.int64)
        waiting, at, steps = np.arange(len(suffixes)), suffixes.copy(), 0
        while len(waiting):
            done = self.marked.get(at) == 1
            out[waiting[done]] = self.samples[self.marked.rank(at[done])] + steps
            waiting, at, steps = waiting[~done], at[~done], steps + 1
            symbol, place, base = np.zeros(len(at), dtype=np.int64), at, np.zeros(len(at), dtype=np.int64)
            for plane in self.planes:
                bit = plane.get(place)
                symbol = symbol << 1 | bit
                ones = plane.rank(place)
                place = np.where(bit == 1, plane.zeros + ones, place - ones)
                ones = plane.rank(base)
                base = np.where(bit == 1, plane.zeros + ones, base - ones)
            at = self.before[symbol] + place - base
        return out


class _Ids(dict):
    """Words by numbers from 1, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Shard:
    """The index of some texts, each distinct one once, and where its words stand."""

    def __init__(self, texts: list[list[bytes]]):
        self.vocabulary = _Ids()
        first: dict[tuple, int] = {}
        self.copies: list[list[int]] = []
        parts = []
        for k, words in enumerate(texts):
            if not words:
                continue
            name = hash(tuple(words)), len(words)
            at = first.get(name)
            if at is not None and texts[self.copies[at][0]] == words:
                self.copies[at].append(k)
                continue
            first[name] = len(self.copies)
            self.copies.append([k])
            parts += [np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int64, count=len(words)), np.zeros(1, dtype=np.int64)]
        symbols = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(p) for p in parts[::2]], dtype=np.int64) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.index = FMIndex(symbols)

    def search(self, windows: Windows) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
        """For each text with hits: its spans (flat, in words), those of full windows alone, and its items."""
        if not self.index.n or not len(windows.rows):
            return
        ids = np.array([0, *map(lambda w: self.vocabulary.get(w, 0), windows.vocabulary)], dtype=np.int64)
        rows = ids[windows.rows]
        whole = np.flatnonzero(((rows > 0) == (windows.rows > 0)).all(axis=1))
        which, lo, hi = self.index.search(rows[whole])
        if not len(which):
            return
        times = hi - lo
        suffix = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        where, window = self.index.locate(suffix), np.repeat(whole[which], times)
        text = np.searchsorted(self.starts, where, side="right") - 1
        order = np.argsort(text, kind="stable")
        where, window, text = where[order], window[order], text[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
        owner_starts = np.concatenate([[0], windows.owner_ends[:-1]])
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            at, w = where[a:b] - self.starts[text[a]], window[a:b]
            ends = at + windows.lengths[w]
            full = windows.lengths[w] >= WINDOW
            items = {windows.items[o] for x in np.unique(w).tolist() for o in windows.owners[owner_starts[x]:windows.owner_ends[x]].tolist()}
            found = merge(np.stack([at, ends], axis=1).ravel().tolist()), merge(np.stack([at[full], ends[full]], axis=1).ravel().tolist()), sorted(items)
            for k in self.copies[int(text[a])]:
                yield k, *found


def merge(spans: list[int]) -> list[int]:
    """Union of flat (start, end) pairs."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def search_shard(texts: list[list[bytes]], blocks: Iterator[Windows]) -> tuple[list[list[int]], list[list[int]], list[list[str]]]:
    """For each text, a list of words: its spans, those of full windows, and its items, over all blocks."""
    spans, full, items = ([[] for _ in texts] for _ in range(3))
    shard = Shard(texts)
    for windows in blocks:
        for k, a, b, c in shard.search(windows):
            spans[k] = merge(spans[k] + a) if spans[k] else a
            full[k] = merge(full[k] + b) if full[k] else b
            items[k] = items[k] + c
    return spans, full, items


STATE = ("n_words", "spans", "full_spans", "items")


def _search(uri: str, files: dict[str, int], names: list[str], state: list[str], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = ArrayStore(uri, files), []

        def blocks() -> Iterator[Windows]:
            for name in names:
                if len(names) > 1 or not held:
                    held[:] = [Windows.read(store, name)]
                yield held[0]

        for batch in batches:
            texts, start, size = [], 0, 0
            for k, text in enumerate(batch.column(column)):
                texts.append(words_of(text.as_py()))
                size += len(texts[-1])
                if size >= SHARD_WORDS or k == batch.num_rows - 1:
                    part = batch.slice(start, len(texts))
                    spans, full, items = search_shard(texts, blocks())
                    ints = pa.list_(pa.int64())
                    new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, ints), pa.array(full, ints), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *state])
                    texts, start, size = [], k + 1, 0
        store.close()

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items, in lists of at most ``limit`` bytes of text (one item may be longer)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row.text or "") > limit:
            yield block
            block, size = [], 0
        block.append(("null" if row.item_id is None else row.item_id, row.text))
        size += 4 * len(row.text or "")
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, then=None, schema_then: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, whose names are given too: words, hit spans, those of full windows, items with hits.

    ``then``, a function of batches with these columns, is applied in the same worker after the search.
    """
    uri = shared_dir(docs.sparkSession, "windows")
    store, names = ArrayStore(uri), []
    for k, block in enumerate(blocks(benchmark)):
        names.append(f"block-{k}")
        Windows.of(block).write(store, names[-1])
    state = fresh(docs.columns, *STATE)
    extra = [T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(state, extra))])
    find = _search(uri, store.sizes(), names, state, docs.columns.index("text"))
    if then is None:
        return spread(docs).mapInArrow(find, schema), state
    return spread(docs).mapInArrow(lambda batches: then(find(batches)), schema_then), state


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: its words, hit words, items, and whether at least one word in ``SHARE`` is hit."""
    found, (words, spans, _, items) = search(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    n_hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda t, x: x - t)
    names = F.array_sort(F.array_distinct(F.col(items)))
    out = found.select("doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), names.alias("names"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what lies between them."""
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[at:places[a][0]])
        at = places[b - 1][1]
    out.append(data[at:])
    return b"".join(out).decode("utf-8")


def _cut(column: int, n_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, full = (batch.column(k).to_pylist() for k in range(batch.num_columns - 4, batch.num_columns - 1))
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            use = [s if h and SHARE * h >= w else f for w, h, s, f in zip(n, hit, spans, full)]
            if not any(use):
                yield pa.RecordBatch.from_arrays(batch.columns[:-4], names=batch.schema.names[:-4])
                continue
            cols = list(batch.columns[:-4])
            texts = cols[column].to_pylist()
            new = [cut_words(t, s) if s else t for t, s in zip(texts, use)]
            keep = pa.array([not s or bool(words_of(t)) for t, s in zip(new, use)])
            cols[column] = pa.array(new, cols[column].type)
            if n_chars is not None:
                counts = cols[n_chars].to_pylist()
                cols[n_chars] = pa.array([len(t) if s else c for t, s, c in zip(new, use, counts)], cols[n_chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-4]).filter(keep)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages.

    Spans of full windows are cut from every document, those of shorter items only where the document is contaminated;
    a document that has no word left goes. Texts without such spans stay as they are. ``n_chars`` follows the text; ``text`` must be
    a string column.
    """
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return search(docs, benchmark, _cut(docs.columns.index("text"), n_chars), docs.schema)[0]
