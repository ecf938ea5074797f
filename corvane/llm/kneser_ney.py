"""Interpolated modified Kneser-Ney trigrams: counted in Spark, stored as sorted hash arrays, mapped by workers to score.

Tokens are the words of a lower-cased (A-Z) text and one end; two marks stand before the first. A word is its 64-bit XXH64;
words that share a hash would share counts.

    p(w | u v) = max(c(uvw) - D3, 0) / c(uv) + g3(uv) * p(w | v)
    p(w | v)   = max(a(vw) - D2, 0) / a(v) + g2(v) * p(w)
    p(w)       = max(t(w) - D1, 0) / T + g1 / (V + 1)

with c(uv) the sum of c(uvw) over w; a(vw) the number of words u before vw (for v the mark before a text, the number of texts
that begin with w) and a(v) its sum over w; t(w) the number of words v before w, T their sum, V the number of words and the
end seen in training. Discounts are those for counts of 1, 2 and 3 or more, from the counts of counts of each order; g are the
shares set free. An unseen context passes the lower order through.

How it runs. Tasks count trigrams in numpy and deal them by their middle word, in one compressed block a task and shard: words
of a table of common ones take two bytes, others their hash. So a shard holds all of a word's left and right neighbours and
yields all orders at once. A common middle word is spread over shards by its left neighbour, and a common pair by its right
one; their sums meet in a second, small shuffle. The table and the lists of common words and pairs come from a sample of the
texts (``SAMPLE_TEXTS``); they steer bytes and places, never counts. Each shard is one file in the shared folder. Keys are kept
as 32 bits below the bits that name their place (shard, and bucket of ``BUCKET`` keys on average), so an n-gram that was never
seen is taken for another with a probability of some 10^-8, and n-grams of one count need no count at all.

Defined results: a null or empty text is its end alone; a null ``doc_id`` counts as the empty text for the fold; equal
rows count and are scored each; with no training text every word is unknown and p(w) is 1 / (V + 1); a text of any length is
one row of tokens, held at 8 bytes a token. Columns besides ``doc_id`` and ``text`` are not looked at. A missing or cut model
file is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shared_dir, spread
from corvane.llm.store import ArrayStore

BEGIN, END = 1, 2
#: Ids from here on are words; those between are no tokens.
FIRST_WORD = 8
FOLDS, HELD_OUT = 7, 2
#: Tokens that a task holds before it counts or looks up.
CHUNK = 1_000_000
CACHE_WORDS = 250_000
#: Texts of the sample that the table of common words is made of, and its size.
SAMPLE_TEXTS = 20_000
CODES = 400_000
ESCAPE = (1 << 24) - 1
#: Share of a mean shard from which on a common word or pair is spread.
SPREAD_FROM = 1.0
#: Keys to a bucket of a stored table, on average at most.
BUCKET = 16
_U8 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U8(31))
    x *= _U8(0x9E3779B97F4A7C15)
    x ^= x >> _U8(29)
    return x


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) + b)


class _Numbers(dict):
    """Small numbers of words in order of appearance, from a base on."""

    def __init__(self):
        self.base, self.new = 2, []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.base + len(self.new)
        self.new.append(max(xxhash.xxh64_intdigest(word), FIRST_WORD))
        return n


class Vocabulary:
    """Words of a task by small numbers, with columns of facts about each; emptied between chunks when it is large."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.array([BEGIN, END], dtype=_U8)
        self.facts: dict[str, np.ndarray] = {}

    def tokens(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words and of its end."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        out = np.empty(len(words) + 1, dtype=np.int64)
        out[:-1] = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        out[-1] = 1
        return out

    def settle(self) -> None:
        """Give facts to the words that came since the last time."""
        new = self.numbers.new
        if new:
            self.ids = np.concatenate([self.ids, np.array(new, dtype=_U8)])
            self.numbers.base += len(new)
            new.clear()

    def fact(self, name: str, of) -> np.ndarray:
        """A column of facts, found by ``of(ids)`` for the words that have none yet."""
        have = self.facts.get(name)
        start = 0 if have is None else len(have)
        if start < len(self.ids):
            more = of(self.ids[start:])
            have = self.facts[name] = more if have is None else np.concatenate([have, more])
        return have


class Layout:
    """Where n-grams lie: numbers of shards, the table of common words, and the common words and pairs that are spread."""

    def __init__(self, shards: int, word_shards: int, common: np.ndarray, hot: np.ndarray, hot_bits: np.ndarray, pairs: np.ndarray, pair_bits: np.ndarray):
        """``common`` lists the commonest words first; ``hot`` and ``pairs`` ascend."""
        self.shards, self.word_shards, self.common = shards, word_shards, common
        self._ranks = np.argsort(common)
        self._names = common[self._ranks]
        self.hot, self.hot_masks = hot, (_U8(1) << hot_bits.astype(_U8)) - _U8(1)
        self.pairs, self.pair_masks = pairs, (_U8(1) << pair_bits.astype(_U8)) - _U8(1)

    @staticmethod
    def _place(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions of ids in an ascending array, -1 where absent."""
        if not len(keys):
            return np.full(len(ids), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return np.where(keys[at] == ids, at, -1)

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """For each word the bits of its left neighbour that it is spread by; 0 if it lies in one shard."""
        at = self._place(self.hot, ids)
        return np.where(at >= 0, self.hot_masks[at] if len(self.hot) else _U8(0), _U8(0)).astype(_U8)

    def code(self, ids: np.ndarray) -> np.ndarray:
        at = self._place(self._names, ids)
        return np.where(at >= 0, self._ranks[at] if len(self.common) else 0, ESCAPE).astype(np.uint32)

    def hot_pair(self, pair: np.ndarray) -> np.ndarray:
        return self._place(self.pairs, pair)

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, masks: np.ndarray, pair: np.ndarray) -> np.ndarray:
        salt = _mix(u) & masks
        some = np.flatnonzero(masks)
        if len(some) and len(self.pairs):
            at = self.hot_pair(pair[some])
            both = at >= 0
            rows = some[both]
            salt[rows] = (salt[rows] + (_mix(w[rows]) & self.pair_masks[at[both]])) | _U8(1 << 40)
        return self.word_place(v, salt)

    def word_place(self, v: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return (((_mix(_mix(v) + _U8(salt) if np.isscalar(salt) else _mix(v) + salt) >> _U8(32)) * _U8(self.shards)) >> _U8(32)).astype(np.int64)

    def word_shard(self, ids: np.ndarray) -> np.ndarray:
        return (((_mix(ids) >> _U8(32)) * _U8(self.word_shards)) >> _U8(32)).astype(np.int64)


# Compressed blocks of ids and counts.


def pack(ids: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]) -> bytes:
    """Columns of (codes, ids) and of counts as one compressed block."""
    parts = [struct.pack("<I", len(counts[0]) if counts else len(ids[0][0]))]
    for codes, values in ids:
        rare = values[codes == ESCAPE]
        parts += [struct.pack("<I", len(rare)), *((codes >> k & 255).astype(np.uint8).tobytes() for k in (0, 8, 16)), rare.astype("<u8").tobytes()]
    for n in counts:
        large = n[n >= 255]
        parts += [struct.pack("<I", len(large)), np.minimum(n, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unpack(blob: bytes, common: np.ndarray, n_ids: int, n_counts: int) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n_ids):
        (k,) = struct.unpack_from("<I", data, at)
        low, middle, high = (np.frombuffer(data, np.uint8, n, at + 4 + j * n).astype(np.int64) for j in range(3))
        codes = low | middle << 8 | high << 16
        rare = codes == ESCAPE
        ids = common[np.where(rare, 0, codes)] if len(common) else np.zeros(n, dtype=_U8)
        ids[rare] = np.frombuffer(data, "<u8", k, at + 4 + 3 * n)
        out.append(ids)
        at += 4 + 3 * n + 8 * k
    for _ in range(n_counts):
        (k,) = struct.unpack_from("<I", data, at)
        counts = np.frombuffer(data, np.uint8, n, at + 4).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", k, at + 4 + n)
        out.append(counts)
        at += 4 + n + 8 * k
    return out


# Stored tables.


def _bits(n: int) -> int:
    return max(0, (max(n, 1) - 1) // BUCKET).bit_length()


def table_arrays(name: str, keys: np.ndarray, columns: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The arrays of one table: starts of buckets, 32 bits of each key, and counts of one byte with those beyond it apart."""
    order = np.argsort(keys)
    keys, bits = keys[order], _bits(len(keys))
    bucket = (keys >> _U8(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    starts = np.zeros((1 << bits) + 1, dtype=np.int64)
    np.cumsum(np.bincount(bucket, minlength=1 << bits), out=starts[1:])
    out = {f"{name}.starts": starts.astype("<u4"), f"{name}.keys": ((keys << _U8(bits)) >> _U8(32)).astype("<u4")}
    for column, values in (columns or {}).items():
        values = values[order]
        large = np.flatnonzero(values >= 255)
        out |= {f"{name}.{column}": np.minimum(values, 255).astype(np.uint8), f"{name}.{column}.at": large.astype("<u4"), f"{name}.{column}.large": values[large].astype("<i8")}
    return out


def find(arrays: dict[str, np.ndarray], name: str, hashes: np.ndarray) -> np.ndarray:
    """Positions of hashes in a table, -1 for absent ones: a binary search in their buckets, for all at a time."""
    keys, starts = arrays[f"{name}.keys"], arrays[f"{name}.starts"]
    n = len(keys)
    if not n or not len(hashes):
        return np.full(len(hashes), -1, dtype=np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (hashes >> _U8(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
    want = ((hashes << _U8(bits)) >> _U8(32)).astype(np.uint32)
    low = starts[bucket].astype(np.int64)
    end = starts[bucket + 1].astype(np.int64)
    high = end.copy()
    for _ in range(int((high - low).max()).bit_length()):
        middle = (low + high) >> 1
        less = (keys[np.minimum(middle, n - 1)] < want) & (middle < high)
        low = np.where(less, middle + 1, low)
        high = np.where(less, high, middle)
    hit = (low < end) & (keys[np.minimum(low, n - 1)] == want)
    return np.where(hit, low, -1)


def values(arrays: dict[str, np.ndarray], name: str, column: str, at: np.ndarray) -> np.ndarray:
    """Counts at positions of a table."""
    got = arrays[f"{name}.{column}"][at].astype(np.int64)
    large = np.flatnonzero(got == 255)
    if len(large):
        got[large] = arrays[f"{name}.{column}.large"][np.searchsorted(arrays[f"{name}.{column}.at"], at[large])]
    return got


# Counting.


def _neighbours(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two tokens before, the token before, the tokens of some texts, and where each text begins; 0 is the mark before a text."""
    w = np.concatenate(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    firsts = np.cumsum(lengths) - lengths
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[firsts] = 0
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[firsts] = 0
    return u, v, w, firsts


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _count(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Vocabulary(), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            words.settle()
            u, v, w, _ = _neighbours(held)
            ids = words.ids
            masks = words.fact("mask", layout.mask)
            codes = words.fact("code", layout.code)
            # Rows go by shard, middle word and left word, the commonest first: this counts them and shrinks what is shuffled.
            rank = np.empty(len(ids), dtype=np.int64)
            rank[np.argsort(codes, kind="stable")] = np.arange(len(ids))
            if len(ids) >= 1 << 21:
                raise AssertionError("more words than a chunk may hold")
            order = np.argsort(rank[v] << 42 | rank[u] << 21 | rank[w])
            u, v, w = u[order], v[order], w[order]
            at = _runs(v, u, w)
            counts = np.diff(np.append(at, len(u)))
            u, v, w = u[at], v[at], w[at]
            shard = layout.shard(ids[u], ids[v], ids[w], masks[v], _pair_hash(ids[u], ids[v]))
            order = np.argsort(shard.astype(np.uint16) if layout.shards <= 65_536 else shard, kind="stable")
            u, v, w, counts, shard = u[order], v[order], w[order], counts[order], shard[order]
            cuts = np.append(_runs(shard), len(shard))
            for start in range(0, len(cuts) - 1, 256):
                blobs, names = [], []
                for a, b in zip(cuts[start:start + 256].tolist(), cuts[start + 1:start + 257].tolist()):
                    blobs.append(pack([(codes[x[a:b]], ids[x[a:b]]) for x in (v, u, w)], [counts[a:b]]))
                    names.append(int(shard[a]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "block"])

        for batch in batches:
            for text in batch.column(0):
                got = words.tokens(text.as_py())
                held.append(got)
                size += len(got)
                if size >= CHUNK:
                    yield from emit()
                    held, size = [], 0
                    if len(words.numbers) > CACHE_WORDS:
                        words.clear()
        if held:
            yield from emit()

    return run


#: Kinds of rows that shards give: sums of words, parts of the pairs of a spread word, sums of spread pairs, counts of counts.
WORDS, PAIRS, CONTEXTS, ORDER3, ORDER2 = range(5)
ROWS = "kind int, shard int, block binary"


def _counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


def _word_blocks(layout: Layout, ids: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Sums of words in one block a shard of words."""
    shard = layout.word_shard(ids)
    order = np.lexsort((ids, shard))
    ids, shard, columns = ids[order], shard[order], [c[order] for c in columns]
    cuts = np.append(_runs(shard), len(shard)) if len(shard) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield WORDS, int(shard[a]), pack([(layout.code(ids[a:b]), ids[a:b])], [c[a:b] for c in columns])


def _pair_sums(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of pairs with their counts: sums by left word (total, ones, twos, more) and pairs by right word, as rows of words."""
    names, place = np.unique(np.concatenate([v, w]), return_inverse=True)
    as_v, as_w, size = place[:len(v)], place[len(v):], len(names)
    columns = [np.bincount(as_v, weights=n, minlength=size)]
    columns += [np.bincount(as_v[some], minlength=size) for some in (n == 1, n == 2, n >= 3)]
    columns.append(np.bincount(as_w, minlength=size))
    return names, [c.astype(np.int64) for c in columns]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, shards, blocks = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], names=["kind", "shard", "block"])


def _in_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    some: list[tuple[int, int, bytes]] = []
    for row in rows:
        some.append(row)
        if len(some) >= 512:
            yield _rows(some)
            some = []
    if some:
        yield _rows(some)


def _by_shard(batches: Iterator[pa.RecordBatch], shard: int, block: int) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of each shard of a sorted partition."""
    held, last = [], None
    for batch in batches:
        for name, blob in zip(batch.column(shard).to_pylist(), batch.column(block)):
            if name != last and held:
                yield last, held
                held = []
            last = name
            held.append(blob.as_py())
    if held:
        yield last, held


def _store_shards(layout: Layout, uri: str):
    """Write the file of each shard; give sums of words, and what must meet sums of other shards."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        store = ArrayStore(uri)
        for shard, blobs in _by_shard(batches, 0, 1):
            v, u, w, n = (np.concatenate(c) for c in zip(*(unpack(b, layout.common, 3, 1) for b in blobs)))
            del blobs
            pair = _pair_hash(u, v)
            key = _mix(pair + w)
            order = np.argsort(key)
            at = _runs(key[order])
            n = np.add.reduceat(n[order], at)
            order = order[at]
            u, v, w, pair, key = u[order], v[order], w[order], pair[order], key[order]
            once = n == 1
            arrays = table_arrays("one", key[once]) | table_arrays("more", key[~once], {"n": n[~once]})
            yield ORDER3, 0, pack([], [_counts_of_counts(n)])
            masks = layout.mask(v)

            # Contexts of two words: those followed once need no row, since they are pairs that were seen.
            order = np.argsort(pair)
            at = _runs(pair[order])
            sums = [np.add.reduceat(x[order].astype(np.int64), at) for x in (n, once, n == 2, n >= 3)]
            name, first = pair[order[at]], order[at]
            split = layout.hot_pair(name) >= 0
            if split.any():
                yield CONTEXTS, 0, pack([(np.full(int(split.sum()), ESCAPE, dtype=np.uint32), name[split])], [c[split] for c in sums])
            kept = ~split & ((sums[0] >= 2) | (v[first] == BEGIN))
            arrays |= table_arrays("context", name[kept], {c: x[kept] for c, x in zip(("n", "n1", "n2", "n3"), sums)})
            del pair, name, first, sums

            # Pairs of a middle word and the word after it; those of a spread word are summed elsewhere.
            after = _pair_hash(v, w)
            order = np.argsort(after)
            at = _runs(after[order])
            adjusted = np.add.reduceat(np.where(v[order] == BEGIN, n[order], 1), at)
            first = order[at]
            pv, pw, spread_word = v[first], w[first], masks[first] > 0
            if spread_word.any():
                for a in range(0, int(spread_word.sum()), 1 << 16):
                    some = np.flatnonzero(spread_word)[a:a + (1 << 16)]
                    place = layout.word_place(after[first[some]])
                    near = np.argsort(place, kind="stable")
                    some, place = some[near], place[near]
                    cuts = np.append(_runs(place), len(place))
                    for b, c in zip(cuts.tolist(), cuts[1:].tolist()):
                        rows_ = some[b:c]
                        yield PAIRS, int(place[b]), pack([(layout.code(x[rows_]), x[rows_]) for x in (pv, pw)], [adjusted[rows_]])
            whole = ~spread_word
            single = whole & (adjusted == 1)
            several = whole & ~single
            names = after[first]
            arrays |= table_arrays("pair1", names[single]) | table_arrays("pairs", names[several], {"n": adjusted[several]})
            store.write_all(f"shard-{shard}", arrays)
            del arrays
            yield ORDER2, 0, pack([], [_counts_of_counts(adjusted[whole])])
            names, columns = _pair_sums(pv[whole], pw[whole], adjusted[whole])

            # Occurrences: each token but an end is in the middle once; ends are counted where they stand last.
            names_c, place = np.unique(np.concatenate([v, w[w == END]]), return_inverse=True)
            occurrences = np.bincount(place, weights=np.concatenate([n, n[w == END]]), minlength=len(names_c)).astype(np.int64)
            ids, place = np.unique(np.concatenate([names, names_c]), return_inverse=True)
            total = np.zeros((6, len(ids)), dtype=np.int64)
            for k, c in enumerate(columns):
                total[k + 1, place[:len(names)]] = c
            total[0, place[len(names):]] = occurrences
            yield from _word_blocks(layout, ids, list(total))

    return lambda batches: _in_batches(rows(batches))


def _store_spread(layout: Layout, uri: str):
    """Sum the pairs of spread words, write them, and give sums of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        store = ArrayStore(uri)
        for shard, blobs in _by_shard(batches, 0, 1):
            v, w, n = (np.concatenate(c) for c in zip(*(unpack(b, layout.common, 2, 1) for b in blobs)))
            name = _pair_hash(v, w)
            order = np.argsort(name)
            at = _runs(name[order])
            n = np.add.reduceat(n[order], at)
            first = order[at]
            store.write_all(f"spread-{shard}", table_arrays("pairs", name[first], {"n": n}))
            yield ORDER2, 0, pack([], [_counts_of_counts(n)])
            names, columns = _pair_sums(v[first], w[first], n)
            yield from _word_blocks(layout, names, [np.zeros(len(names), dtype=np.int64), *columns])

    return lambda batches: _in_batches(rows(batches))


STATS = ("count", "total", "n1", "n2", "n3", "t")
TOTALS = ("N", "T", "V", "t1", "t2", "t3", "t4")


def _store_words(layout: Layout, uri: str):
    """Sum and write each shard of words; give its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ArrayStore(uri)
        for shard, blobs in _by_shard(batches, 0, 1):
            ids, *columns = (np.concatenate(c) for c in zip(*(unpack(b, layout.common, 1, 6) for b in blobs)))
            order = np.argsort(ids, kind="stable")
            at = _runs(ids[order])
            ids = ids[order[at]]
            count, total, n1, n2, n3, t = sums = [np.add.reduceat(c[order], at) for c in columns]
            token = ids != BEGIN
            store.write_all(f"words-{shard}", {"ids": ids} | {k: c.astype("<i8" if c.max(initial=0) >> 31 else "<i4") for k, c in zip(STATS, sums)})
            got = [int(count[token].sum()), int(t.sum()), int((token & (count > 0)).sum()), *_counts_of_counts(t).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in got], names=list(TOTALS))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more; fixed ones where the counts of counts cannot give them."""
    found = []
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        d = k - (k + 1) * y * b / a if a else 0.5 * k
        found.append(min(max(d, 0.05), k - 0.05))
    return found[0], found[1], found[2]


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n > 0, n - np.where(n >= 3, d[2], np.where(n == 2, d[1], d[0])), 0.0)


class Scorer:
    """Looks texts up in the stored arrays."""

    def __init__(self, uri: str, layout: Layout, totals: dict[str, int], order3: list[int], order2: list[int], contexts: dict[str, np.ndarray], files: dict[str, int]):
        self.layout, self.totals, self.contexts = layout, totals, contexts
        self.store = ArrayStore(uri, files)
        self.d3, self.d2 = discounts(*order3), discounts(*order2)
        self.d1 = discounts(*(totals[k] for k in ("t1", "t2", "t3", "t4")))
        t = totals
        free = self.d1[0] * t["t1"] + self.d1[1] * t["t2"] + self.d1[2] * (t["types"] - t["t1"] - t["t2"])
        self.free1 = free / t["T"] if t["T"] else 1.0
        self.words = Vocabulary()

    def _grouped(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard.astype(np.uint16) if len(shard) and int(shard.max()) < 65_536 else shard, kind="stable")
        cuts = np.append(_runs(shard[order]), len(order)) if len(order) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            rows = order[a:b]
            yield int(shard[rows[0]]), rows

    def _word_facts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), len(STATS)), dtype=np.int64)
        for shard, rows in self._grouped(self.layout.word_shard(ids)):
            have = self.store.read_all(f"words-{shard}")
            if have is None:
                continue
            at = np.minimum(np.searchsorted(have["ids"], ids[rows]), len(have["ids"]) - 1)
            hit = have["ids"][at] == ids[rows]
            for k, name in enumerate(STATS):
                out[rows[hit], k] = have[name][at[hit]]
        return out

    def score(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text (numbers of this scorer's words): its known tokens, base score and model score."""
        t, layout, words = self.totals, self.layout, self.words
        words.settle()
        stats = words.fact("stats", self._word_facts)
        masks = words.fact("mask", layout.mask)
        ids = words.ids
        u, v, w, firsts = _neighbours(tokens)
        count, total2, m1, m2, m3, types = (stats[:, k].astype(np.float64) for k in range(6))
        p1 = self.free1 / (t["V"] + 1) + _less(types, self.d1) / max(t["T"], 1)
        free2 = np.where(total2 > 0, (self.d2[0] * m1 + self.d2[1] * m2 + self.d2[2] * m3) / np.maximum(total2, 1), 1.0)
        base = np.log10((count + 1) / (t["N"] + t["V"] + 1))

        iu, iv, iw = ids[u], ids[v], ids[w]
        pair, after = _pair_hash(iu, iv), _pair_hash(iv, iw)
        key, mask = _mix(pair + iw), masks[v]
        n = np.zeros(len(w), dtype=np.int64)
        adjusted = np.zeros(len(w), dtype=np.int64)
        context = np.zeros((4, len(w)), dtype=np.int64)
        for shard, rows in self._grouped(layout.shard(iu, iv, iw, mask, pair)):
            have = self.store.read_all(f"shard-{shard}")
            if have is None:
                continue
            n[rows] = find(have, "one", key[rows]) >= 0
            rest = rows[n[rows] == 0]
            at = find(have, "more", key[rest])
            n[rest[at >= 0]] = values(have, "more", "n", at[at >= 0])
            at = find(have, "context", pair[rows])
            hit = rows[at >= 0]
            for k, column in enumerate(("n", "n1", "n2", "n3")):
                context[k, hit] = values(have, "context", column, at[at >= 0])
            own = rows[mask[rows] == 0]
            adjusted[own] = find(have, "pair1", after[own]) >= 0
            rest = own[adjusted[own] == 0]
            at = find(have, "pairs", after[rest])
            adjusted[rest[at >= 0]] = values(have, "pairs", "n", at[at >= 0])
        apart = np.flatnonzero(mask)
        for shard, part in self._grouped(layout.word_place(after[apart])):
            have = self.store.read_all(f"spread-{shard}")
            if have is None:
                continue
            rows = apart[part]
            at = find(have, "pairs", after[rows])
            adjusted[rows[at >= 0]] = values(have, "pairs", "n", at[at >= 0])
        if len(layout.pairs):
            at = layout.hot_pair(pair[apart])
            rows, at = apart[at >= 0], at[at >= 0]
            for k in range(4):
                context[k, rows] = self.contexts["sums"][k, at]
        # A pair that was seen but has no row as a context was followed once. The pair before a token is the token's before.
        seen = np.zeros(len(w), dtype=bool)
        seen[1:] = adjusted[:-1] > 0
        seen[firsts] = False
        lone = (context[0] == 0) & seen
        context[0, lone] = context[1, lone] = 1

        p2 = _less(adjusted, self.d2) / np.maximum(total2[v], 1) + free2[v] * p1[w]
        free3 = np.where(context[0] > 0, (self.d3[0] * context[1] + self.d3[1] * context[2] + self.d3[2] * context[3]) / np.maximum(context[0], 1), 1.0)
        p = np.log10(_less(n, self.d3) / np.maximum(context[0], 1) + free3 * p2)
        known = np.add.reduceat((count[w] > 0).astype(np.int64), firsts)
        return known, np.add.reduceat(base[w], firsts), np.add.reduceat(p, firsts)


def _score(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            tokens, row, size = [], 0, 0
            texts = batch.column("text")
            for k in range(batch.num_rows):
                tokens.append(scorer.words.tokens(texts[k].as_py()))
                size += len(tokens[-1])
                if size >= CHUNK or k == batch.num_rows - 1:
                    known, base, score = scorer.score(tokens)
                    part = batch.slice(row, len(tokens))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("held_out"), pa.array([len(x) for x in tokens], pa.int64()), pa.array(known), pa.array([scorer.totals["N"]] * len(tokens), pa.int64()), pa.array(base), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    tokens, row, size = [], k + 1, 0
                    if len(scorer.words.numbers) > CACHE_WORDS:
                        scorer.words.clear()
        scorer.store.close()

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of pairs (kind 1) of sampled texts."""
    words = Vocabulary()
    tokens = [words.tokens(text.as_py()) for batch in batches for text in batch.column(0)]
    if not tokens:
        return
    words.settle()
    _, v, w, _ = _neighbours(tokens)
    ids = words.ids
    pair = np.sort(_pair_hash(ids[v], ids[w]))
    at = _runs(pair)
    n = np.diff(np.append(at, len(pair)))
    often = n >= 8
    middle = np.bincount(v, minlength=len(ids))
    kinds = np.concatenate([np.zeros(len(ids), dtype=np.int32), np.ones(int(often.sum()), dtype=np.int32)])
    names = np.concatenate([ids, pair[at][often]]).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names), pa.array(np.concatenate([middle, n[often]]))], names=["kind", "id", "n"])


def plan_layout(texts: DataFrame) -> Layout:
    """Shards, common words and spread words for ``texts(text)``, from a sample of it."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 2 * parts
    total = texts.count()
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    sample = texts if share == 1.0 else texts.sample(share, seed=1)
    counts = materialize(sample.mapInArrow(_common, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")), "common")
    seen = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    least = max(1.0, SPREAD_FROM * seen / shards)

    def top(kind: int, n: int, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts, the commonest first."""
        got = counts.where((F.col("kind") == kind) & (F.col("n") >= at_least)).orderBy(F.desc("n"), "id").limit(n).select("id", "n").toArrow()
        return got.column("id").to_numpy().view(_U8), got.column("n").to_numpy()

    def spread_over(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that fill a mean shard or more, ascending, and the bits that spread them."""
        ids, n = ids[n >= least], n[n >= least]
        order = np.argsort(ids)
        return ids[order], np.clip(np.ceil(np.log2(2 * n[order] / least)), 1, 20).astype(np.int64)

    ids, n = top(0, CODES, 2)
    return Layout(shards, parts, ids, *spread_over(ids, n), *spread_over(*top(1, 4 * shards, least)))


def train(texts: DataFrame):
    """Count and store a model of ``texts(text)``; gives a function that opens it for scoring."""
    texts = texts.select("text")
    uri, layout = shared_dir(texts.sparkSession, "kneser-ney"), plan_layout(texts)
    parts = layout.word_shards
    dealt = lambda df: df.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard")
    blocks = spread(texts).mapInArrow(_count(layout), "shard int, block binary")
    first = materialize(dealt(blocks).mapInArrow(_store_shards(layout, uri), ROWS), "sums")
    of = lambda df, kind: df.where(F.col("kind") == kind).select("shard", "block")
    second = materialize(dealt(of(first, PAIRS)).mapInArrow(_store_spread(layout, uri), ROWS), "sums")
    both = first.unionByName(second)
    totals = dealt(of(both, WORDS)).mapInArrow(_store_words(layout, uri), ", ".join(f"`{k}` long" for k in TOTALS))
    row = totals.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in TOTALS)).first().asDict()

    def summed(kind: int) -> list[int]:
        # A few numbers a shard, of which there are as many as shuffle partitions.
        return sum((unpack(r.block, layout.common, 0, 1)[0] for r in of(both, kind).toLocalIterator()), np.zeros(4, dtype=np.int64)).tolist()

    contexts = np.zeros((4, len(layout.pairs)), dtype=np.int64)
    for r in of(first, CONTEXTS).toLocalIterator():  # one row a shard, of spread pairs alone
        name, *sums = unpack(r.block, layout.common, 1, 4)
        np.add.at(contexts, (slice(None), layout.hot_pair(name)), np.stack(sums))
    # Words with a word before them: all tokens seen.
    row["types"] = row["V"]
    order3, order2, files = summed(ORDER3), summed(ORDER2), ArrayStore(uri).sizes()
    return lambda: Scorer(uri, layout, row, order3, order2, {"sums": contexts}, files)


def perplexity(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row a document: its fold, tokens, base score and model score (log10); trained on the other folds."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = (F.crc32(name.cast("binary")) % folds == held_out).alias("held_out")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, F.col("text").cast("string").alias("text"))
    make = train(marked.where(~F.col("held_out")))
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return spread(marked.select("doc_id", "held_out", "text")).mapInArrow(_score(make), fields)
