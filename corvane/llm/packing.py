"""Packing of documents into fixed-length training sequences by cutting-stock column generation.

A document of T tokens gives full pieces of ``seq_len`` tokens, each a sequence of its own, and a remainder. The
remainders' length histogram (at most ``seq_len - 1`` rows, whatever the input) goes to one task, where a linear program
over patterns is solved. Its columns are patterns of whole remainders, and cuts: a remainder longer than half a sequence may
count as a half and a rest, at a cost of ``CUT_COST`` sequences. From a plain first basis, a knapsack by dynamic programming
prices new patterns, and revised simplex steps take them in, until the cost is within ``TOLERANCE`` of a proven bound. Copies of
patterns and cuts are rounded down, and what is left over, fewer sequences than there are lengths, is packed largest first.
Where packing largest first wastes less than one sequence, or less than ``TOLERANCE``, no program is solved. Documents are ranked within their length (by part and place in it), and ranks map to cuts and pattern copies.

Defined results: a null text is an empty document (the end id alone); equal rows are packed apart; null ``doc_id`` stays
null; an empty table gives no pieces. A sequence is padded to ``seq_len`` unless its tokens number a power of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shared_dir, spread
from corvane.llm.store import ArrayStore
from corvane.llm.tokens import END_ID, WordEncoder, default_tokenizer_path, encoder

SEQ_LEN = 2048
#: The linear program is left when its cost is within this share of a lower bound.
TOLERANCE = 0.001
#: Sequences that a cut of one remainder costs in the linear program.
CUT_COST = 0.02
#: Simplex steps at most; any step leaves a whole plan, so this bounds time (some 10 ms a step with 2,000 lengths) and not what is packed.
MAX_PIVOTS = 3000
#: Items or cuts by the index of their length.
Column = dict[int, int]


def greedy_runs(lengths: np.ndarray, counts: np.ndarray, seq_len: int, whole: bool) -> list[tuple[np.ndarray, float]]:
    """Patterns with copies, largest lengths first; every run uses up at least one length.

    ``lengths`` ascend. With ``whole``, copies are integers; else they are the exact ratio that uses a length up.
    A pattern is a row of item counts, one for each length.
    """
    left = counts.astype(np.float64).copy()
    alive = [int(i) for i in np.flatnonzero(counts > 0)]
    runs = []
    while alive:
        pattern = np.zeros(len(lengths), dtype=np.int64)
        room, k = seq_len, len(alive) - 1
        while k >= 0 and room >= lengths[alive[0]]:
            k = min(k, int(np.searchsorted(lengths[alive], room, side="right")) - 1)
            if k < 0:
                break
            i = alive[k]
            fit = room // int(lengths[i])
            take = int(min(fit, left[i])) if whole else (fit if left[i] >= fit else max(1, int(left[i])))
            pattern[i] += take
            room -= take * int(lengths[i])
            k -= 1
        used = np.flatnonzero(pattern)
        ratios = left[used] / pattern[used]
        copies = float(np.floor(ratios.min())) if whole else float(ratios.min())
        left[used] -= copies * pattern[used]
        if not whole:
            left[used[ratios <= copies]] = 0.0
        gone = set(used[left[used] <= (0.5 if whole else 1e-9)].tolist())
        left[list(gone)] = 0.0
        alive = [i for i in alive if i not in gone]
        runs.append((pattern, copies))
    return runs


def knapsack(lengths: np.ndarray, duals: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room in a sequence the best worth of items in it (any number of each), and an item to take; -1: leave a place empty."""
    worth = duals > 1e-12
    items, values, back = lengths[worth], duals[worth], np.flatnonzero(worth)
    best, choice = np.zeros(seq_len + 1), np.full(seq_len + 1, -1, dtype=np.int64)
    upto = np.searchsorted(items, np.arange(seq_len + 1), side="right")
    for room in range(1, seq_len + 1):
        n = int(upto[room])
        best[room] = best[room - 1]
        if n:
            gains = best[room - items[:n]] + values[:n]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], back[k]
    return best, choice


def _pattern(lengths: np.ndarray, choice: np.ndarray, first: int, seq_len: int) -> Column:
    """The best filling of a sequence, with one item given first unless it is -1."""
    out: Column = {}
    room = seq_len
    if first >= 0:
        out[first] = 1
        room -= int(lengths[first])
    while room > 0:
        k = int(choice[room])
        if k < 0:
            room -= 1
            continue
        out[k] = out.get(k, 0) + 1
        room -= int(lengths[k])
    return out


class _Simplex:
    """Revised simplex over columns that come one by one; the first basis is plain, one pattern of one length for each length."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, seq_len: int):
        fit = seq_len // lengths
        # Needs are raised by a little at random, so no basic amount is zero and no step goes nowhere.
        more = (1e-6 + 1e-6 * np.random.default_rng(0).random(len(lengths))) * max(1.0, counts.sum() / len(counts))
        self.amounts = (counts + more) / fit
        self.inverse = np.diag(1.0 / fit)
        self.columns: list[Column] = [{i: int(k)} for i, k in enumerate(fit)]
        self.cost = np.ones(len(lengths))
        self.duals = self.cost @ self.inverse
        self.pivots = 0

    def enter(self, column: Column, cost: float) -> bool:
        """Take a column into the basis; False if nothing bounds it."""
        step = self.inverse[:, list(column)] @ np.array(list(column.values()), dtype=np.float64)
        rising = step > 1e-9
        ratios = np.where(rising, self.amounts / np.where(rising, step, 1.0), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            return False
        gain = cost - sum(self.duals[i] * n for i, n in column.items())
        np.maximum(self.amounts - ratios[out] * step, 0.0, out=self.amounts)
        self.amounts[out], self.cost[out], self.columns[out] = ratios[out], cost, column
        pivot = self.inverse[out] / step[out]
        self.duals = self.duals + gain * pivot
        step[out] = 0.0
        self.inverse -= step[:, None] * pivot
        self.inverse[out] = pivot
        self.pivots += 1
        if self.pivots % 500 == 0:
            self.duals = self.cost @ self.inverse
        return True


def column_generation(lengths: np.ndarray, counts: np.ndarray, seq_len: int, tolerance: float = TOLERANCE,
                      max_pivots: int = MAX_PIVOTS) -> tuple[list[tuple[Column, float]], float]:
    """Columns with fractional amounts that meet ``counts`` near the least cost, and a lower bound of that cost.

    A pattern holds items by index of their length, at a cost of one. A cut turns an item of more than half a sequence into a half
    and a rest, at ``CUT_COST``: 1 for the length that is cut and -1 for either part; all parts must be among ``lengths``. The greedy
    run's patterns and the best fillings found by the knapsack, some with one item given, form a pool; simplex steps take
    from the pool and the cuts until neither gains, then the knapsack prices again.
    """
    half, row = seq_len // 2, {int(n): i for i, n in enumerate(lengths)}
    heads = np.flatnonzero(lengths > half)
    tails = np.array([row[int(n) - half] for n in lengths[heads]], dtype=np.int64)
    solver = _Simplex(lengths, counts, seq_len)
    bound = float(lengths @ counts) / seq_len
    pool: dict[tuple, Column] = {}

    def add(column: Column) -> None:
        pool[tuple(sorted(column.items()))] = column

    for pattern, _ in greedy_runs(lengths, counts, seq_len, whole=False):
        add({int(i): int(pattern[i]) for i in np.flatnonzero(pattern)})
    while True:
        columns = list(pool.values())
        sizes = np.fromiter(map(len, columns), dtype=np.int64, count=len(columns))
        rows = np.fromiter((i for c in columns for i in c), dtype=np.int64, count=int(sizes.sum()))
        items = np.fromiter((n for c in columns for n in c.values()), dtype=np.float64, count=len(rows))
        starts = np.cumsum(sizes) - sizes
        for _ in range(400):
            duals = solver.duals
            worth = np.add.reduceat(duals[rows] * items, starts) - 1.0
            best = int(worth.argmax())
            gains = duals[heads] - duals[row[half]] - duals[tails] - CUT_COST if len(heads) else np.full(1, -1.0)
            cut = int(gains.argmax())
            if max(worth[best], gains[cut]) <= 1e-6 or solver.pivots >= max_pivots:
                break
            if gains[cut] > worth[best]:
                column: Column = {int(heads[cut]): 1, row[half]: -1}
                column[int(tails[cut])] = column.get(int(tails[cut]), 0) - 1
                entered = solver.enter(column, CUT_COST)
            else:
                entered = solver.enter(columns[best], 1.0)
            if not entered:
                break
        duals = np.maximum(solver.duals, 0.0)
        filled, choice = knapsack(lengths, duals, seq_len)
        cost = float(solver.cost @ solver.amounts)
        most = float((duals[heads] - duals[row[half]] - duals[tails]).max()) / CUT_COST if len(heads) else 0.0
        bound = max(bound, cost / max(1.0, float(filled[seq_len]), most))  # duals scaled down to where no column gains
        if cost <= bound * (1 + tolerance) or filled[seq_len] <= 1 + 1e-6 or solver.pivots >= max_pivots:
            return list(zip(solver.columns, solver.amounts.tolist())), bound
        given = duals + filled[seq_len - lengths]
        add(_pattern(lengths, choice, -1, seq_len))
        for i in np.argsort(-given)[:40].tolist():
            if given[i] > 1 + 1e-6:
                add(_pattern(lengths, choice, i, seq_len))


Plan = tuple[list[tuple[dict[int, int], int]], dict[int, int]]


def plan_cost(found: Plan) -> float:
    """Sequences, and cuts at ``CUT_COST``."""
    return sum(n for _, n in found[0]) + CUT_COST * sum(found[1].values())


def greedy_plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> Plan:
    """Largest first, without cuts."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k > 0), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    return [({int(lengths[i]): int(p[i]) for i in np.flatnonzero(p)}, int(c)) for p, c in greedy_runs(lengths, counts, seq_len, whole=True)], {}


def rounded(solved: list[tuple[Column, float]], lengths: np.ndarray, counts: np.ndarray, seq_len: int) -> Plan:
    """Whole copies of cuts and patterns, rounded down; the rest greedily, with what is over half a sequence cut if that is cheaper."""
    half, row, left, cut = seq_len // 2, {int(n): i for i, n in enumerate(lengths)}, counts.copy(), {}

    def cut_items(left: np.ndarray, cut: dict[int, int], i: int, n: int) -> None:
        if n > 0:
            cut[int(lengths[i])] = cut.get(int(lengths[i]), 0) + n
            left[i] -= n
            left[row[half]] += n
            left[row[int(lengths[i]) - half]] += n

    for column, amount in solved:
        if min(column.values()) < 0:
            i = next(i for i, n in column.items() if n > 0)
            cut_items(left, cut, i, int(min(np.floor(amount + 1e-9), left[i])))
    runs = []
    for column, amount in sorted(solved, key=lambda c: -c[1]):
        if min(column.values()) > 0:
            whole = int(min([np.floor(amount + 1e-9), *(left[i] // n for i, n in column.items())]))
            if whole > 0:
                for i, n in column.items():
                    left[i] -= whole * n
                runs.append(({int(lengths[i]): n for i, n in column.items()}, whole))
    ways = []
    for cutting in (False, True):
        rest, more = left.copy(), dict(cut)
        if cutting:
            for i in np.flatnonzero((lengths > half) & (rest > 0)):
                cut_items(rest, more, int(i), int(rest[i]))
        some = greedy_plan({int(lengths[i]): int(rest[i]) for i in np.flatnonzero(rest > 0)}, seq_len)[0]
        ways.append((runs + some, more))
    return min(ways, key=plan_cost)


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN, tolerance: float = TOLERANCE, max_pivots: int = MAX_PIVOTS) -> Plan:
    """Whole-number copies of patterns ``{length: items}``, and how many items of each length are cut in two.

    The patterns hold exactly the items of the histogram after the cuts. A greedy plan within the tolerance of the tokens' own
    bound, or of one sequence, is taken, and no program is solved; else the program's rounded plan, or the greedy one if cheaper.
    """
    half = seq_len // 2
    histogram = {n: k for n, k in histogram.items() if k > 0}
    if not histogram:
        return [], {}
    first = greedy_plan(histogram, seq_len)
    least = sum(n * k for n, k in histogram.items()) / seq_len
    if plan_cost(first) < max(least + 1, least * (1 + tolerance)):
        return first
    names = set(histogram) | {half} | {n - half for n in histogram if n > half}
    lengths = np.array(sorted(names), dtype=np.int64)
    counts = np.array([histogram.get(int(n), 0) for n in lengths], dtype=np.int64)
    solved, _ = column_generation(lengths, counts, seq_len, tolerance, max_pivots)
    return min(rounded(solved, lengths, counts, seq_len), first, key=plan_cost)


PIECES = ("part int, local_rank long, doc_id long, start long, length long, ids_crc32 long, head_crc32 long, tail_crc32 long, "
          "doc_tokens long, ids binary")


def _pieces(path: str, end_id: int, seq_len: int, with_ids: bool, cache_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = encoder(path, end_id) if cache_words is None else WordEncoder(path, end_id, cache_words)
        seen: dict[int, int] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py())
                wide = memoryview(ids.astype("<u4")).cast("B")
                for start in range(0, len(ids), seq_len):
                    length = min(seq_len, len(ids) - start)
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    crc = zlib.crc32(wide[4 * start:4 * (start + length)])
                    head = tail = None
                    if seq_len // 2 < length < seq_len:
                        head = zlib.crc32(wide[4 * start:4 * (start + seq_len // 2)])
                        tail = zlib.crc32(wide[4 * (start + seq_len // 2):4 * (start + length)])
                    kept = ids[start:start + length].tobytes() if with_ids else None
                    for col, value in zip(cols, (part, rank, doc_id, start, length, crc, head, tail, len(ids), kept)):
                        col.append(value)
            kinds = [pa.int32(), *[pa.int64()] * 8, pa.binary()]
            names = ["part", "local_rank", "doc_id", "start", "length", "ids_crc32", "head_crc32", "tail_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return run


def _slots(runs: list[tuple[dict[int, int], int]], seq_len: int) -> dict[str, np.ndarray]:
    """For each length, from which rank on a run of pattern copies takes how many items at which offset."""
    rows, ranks, sequence = [], {}, 0
    for pattern, copies in runs:
        fill = sum(n * k for n, k in pattern.items())
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            first = ranks.get(n, 0)
            rows.append((n, first, k, sequence, offset, fill if fill & (fill - 1) == 0 else seq_len))
            ranks[n] = first + k * copies
            offset += n * k
        sequence += copies
    rows.sort()
    names = ("length", "first", "items", "sequence", "offset", "padded")
    table = {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}
    table["key"] = (table["length"] << 48) | table["first"]
    return table


def _cut_table(cut: dict[int, int], natural: dict[int, int], seq_len: int) -> dict[str, np.ndarray]:
    """By length: items cut (the first in rank), and the ranks among halves and among rests at which they begin."""
    size, half = seq_len + 1, seq_len // 2
    out = {k: np.zeros(size, dtype=np.int64) for k in ("cut", "head_rank", "tail_rank")}
    halves = natural.get(half, 0)
    for n in sorted(cut):
        out["cut"][n], out["head_rank"][n], out["tail_rank"][n] = cut[n], halves, natural.get(n - half, 0)
        if n - half == half:
            raise AssertionError("a full piece is never cut")
        halves += cut[n]
    return out


def _store_bases(uri: str, seq_len: int):
    """Write for each part the rank that its first piece of each length has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, last, n = ArrayStore(uri), np.zeros(seq_len + 1, dtype=np.int64), None, 0
        for batch in batches:
            parts, lengths, bases = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for a, b in zip(*_cuts(parts)):
                if parts[a] != last:
                    if last is not None:
                        store.write_all(f"part-{last}", {"base": base})
                        n += 1
                    base, last = np.zeros(seq_len + 1, dtype=np.int64), int(parts[a])
                base[lengths[a:b]] = bases[a:b]
        if last is not None:
            store.write_all(f"part-{last}", {"base": base})
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _cuts(parts: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of runs of equal values."""
    if not len(parts):
        return [], []
    at = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist()]
    return at, [*at[1:], len(parts)]


def _assign(slots: dict[str, np.ndarray], cuts: dict[str, np.ndarray], seq_len: int, uri: str, files: dict[str, int]):
    half = seq_len // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ArrayStore(uri, files)
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "ids_crc32", "part", "local_rank")}
            col["rank"] = col["local_rank"].copy()
            for a, b in zip(*_cuts(col["part"])):
                col["rank"][a:b] += store.read_all(f"part-{int(col['part'][a])}")["base"][col["length"][a:b]]
            is_cut = col["rank"] < cuts["cut"][col["length"]]
            kept, both = np.flatnonzero(~is_cut), np.flatnonzero(is_cut)
            n, r = col["length"], col["rank"]
            rows = np.concatenate([kept, both, both])
            length = np.concatenate([n[kept], np.full(len(both), half), n[both] - half])
            rank = np.concatenate([r[kept] - cuts["cut"][n[kept]], cuts["head_rank"][n[both]] + r[both],
                                   cuts["tail_rank"][n[both]] + r[both]])
            # What is left of a length after its cuts comes first among its items, then the parts of others.
            rank[len(kept):] -= cuts["cut"][length[len(kept):]]
            start = np.concatenate([col["start"][kept], col["start"][both], col["start"][both] + half])
            crc = [col["ids_crc32"][kept]]
            if len(both):
                crc += [batch.column(c).take(pa.array(both)).to_numpy(zero_copy_only=False).astype(np.int64)
                        for c in ("head_crc32", "tail_crc32")]
            at = np.searchsorted(slots["key"], (length << 48) | rank, side="right") - 1
            inner, items = rank - slots["first"][at], slots["items"][at]
            take = pa.array(rows)
            ids = batch.column("ids").take(take)
            if ids.null_count < len(ids):
                whole = ids.to_pylist()
                k, c = len(kept), len(kept) + len(both)
                whole[k:c] = [b[:2 * half] for b in whole[k:c]]
                whole[c:] = [b[2 * half:] for b in whole[c:]]
                ids = pa.array(whole, pa.binary())
            new = {"doc_id": batch.column("doc_id").take(take), "start": pa.array(start), "length": pa.array(length),
                   "ids_crc32": pa.array(np.concatenate(crc)), "doc_tokens": batch.column("doc_tokens").take(take),
                   "sequence_id": pa.array(slots["sequence"][at] + inner // items),
                   "offset": pa.array(slots["offset"][at] + inner % items * length),
                   "sequence_length": pa.array(slots["padded"][at]), "ids": ids}
            yield pa.RecordBatch.from_arrays(list(new.values()), names=list(new))

    return run


def _planned(spark: SparkSession, histogram: dict[int, int], seq_len: int, tolerance: float):
    """``plan`` in one task of one row, whose linear algebra has one thread, so the driver stays free."""
    def run(frames):
        for pdf in frames:
            given = {int(n): int(c) for n, c in json.loads(pdf["plan"].iloc[0]).items()}
            yield pd.DataFrame({"plan": [json.dumps(plan(given, seq_len, tolerance))]})

    if not histogram:
        return [], {}
    row = spark.createDataFrame([(json.dumps(histogram),)], "plan string").coalesce(1)
    runs, cut = json.loads(row.mapInPandas(run, "plan string").first()[0])
    whole = lambda d: {int(n): int(c) for n, c in d.items()}
    return [(whole(p), int(c)) for p, c in runs], whole(cut)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer_path: str | None = None, end_id: int = END_ID,
         tolerance: float = TOLERANCE, with_ids: bool = False, cache_words: int | None = None) -> DataFrame:
    """One row a piece: its document, place and checksum, and the sequence and offset where it lies.

    ``cache_words`` gives each task a cache of its own, of so many words, instead of the worker's large one that lasts over
    tasks: for jobs whose other stages need the memory. ``with_ids`` fills ``ids`` with the piece's ids, 16 bits each, little-endian; else it is null.
    The texts are read once and not shuffled, and neither are the pieces: each reads the rank offsets of its part from a small file.
    """
    path = tokenizer_path or default_tokenizer_path()
    cut = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    pieces = materialize(cut.mapInArrow(_pieces(path, end_id, seq_len, with_ids, cache_words), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    uri = shared_dir(docs.sparkSession, "piece-bases")
    dealt = counts.select("part", "length", "base").repartition("part").sortWithinPartitions("part")
    dealt.mapInArrow(_store_bases(uri, seq_len), "n long").agg(F.sum("n")).collect()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(seq_len, 0)
    runs, cut = _planned(docs.sparkSession, histogram, seq_len, tolerance)
    cuts = _cut_table(cut, histogram, seq_len)
    if full:
        runs.append(({seq_len: 1}, full))
    fields = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "sequence_length long, ids binary")
    return pieces.mapInArrow(_assign(_slots(runs, seq_len), cuts, seq_len, uri, ArrayStore(uri).sizes()), fields)
