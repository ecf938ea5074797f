"""Secret scans: base patterns, and a character convolutional network over every other candidate in its context.

Base findings (``assign``, ``access``, ``hex``) always stay. A further candidate is every run of 12 or more key characters that
touches no base finding; the network sees it with the characters around it and may add a ``model`` span. A run longer than
``INSIDE`` is seen through windows that slide over it by half their width, and its score is the greatest. The network (numpy;
embedded characters, width-five filters, maxima, one logistic unit) is trained on labelled findings that a fixed seed generates,
or on findings given; its scores are calibrated on a held-out third by a logistic fit, and the threshold is the highest that
keeps ``RECALL`` of the held-out secrets, letters alone and long ones included.

Defined results: null and empty texts have no spans; spans count code points, end exclusive; repeated rows are each
scanned; an empty table gives no rows; a text of any length is scanned whole, candidates a bounded number at a time. Columns
besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import spread

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of longest runs only those of 16 or more pass, so shorter ones need no match
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, INSIDE, AFTER = 24, 44, 4
WIDTH = BEFORE + INSIDE + AFTER
#: Windows that the network sees at a time.
BATCH = 4096
RECALL = 0.98
FILTERS, EMBED, KERNEL = 24, 8, 5

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Character classes: letters of either case by themselves, digits, key marks, quotes and the like, space, others.
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CLASS[ord(_c)], _CLASS[ord(_c.upper())] = 1 + _i, 27 + _i
for _c in "0123456789":
    _CLASS[ord(_c)] = 53
for _i, _c in enumerate("+/_.=-:\"' @"):
    _CLASS[ord(_c)] = 54 + _i
N_CLASSES = 66
_OTHER, _PAD = 65, 0


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, order of kind, end) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of key characters that overlap no finding."""
    out, k = [], 0
    taken = sorted((a, b) for a, _, b in taken)
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start() and (k + 1 >= len(taken) or taken[k + 1][0] <= m.start()):
            k += 1
        if not any(a < m.end() and m.start() < b for a, b in taken[max(0, k - 3):k + 3]):
            out.append(m.span())
    return out


def classes_of(text: str) -> np.ndarray:
    """The classes of a text's characters, padded on either side."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.full(len(codes) + WIDTH + BEFORE, _PAD, dtype=np.uint8)
    row[BEFORE:BEFORE + len(codes)] = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _OTHER)
    return row


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: one, or for a longer run some that overlap by half, the last at its end."""
    if end - start <= INSIDE:
        return [start]
    return [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]


def windows(row: np.ndarray, start: int, end: int) -> np.ndarray:
    """A row of classes for each window: the characters before it, in the run, and after it."""
    starts = np.array(window_starts(start, end))
    out = row[starts[:, None] + np.arange(WIDTH)].astype(np.int64)
    size = np.minimum(end - starts, INSIDE)
    after = row[starts[:, None] + BEFORE + size[:, None] + np.arange(AFTER)]
    place = np.arange(WIDTH) - BEFORE
    out[(place >= size[:, None]) & (place < INSIDE)] = _PAD
    out[:, BEFORE + INSIDE:] = after
    return out


def labelled_findings(n: int = 8000, seed: int = 7) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Made findings: (text, start, end) and 1 for a secret. Half are secrets of common forms, half look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    syllables = "the on er an re in at ti th es ou ng ion ed ha le re que ment eau de la und ung sch lich ado mente".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    onsets = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl fr gl gr ph pl pr qu sc sh sl sm sp st str sw th tr tw wh".split() + [""] * 6
    vowels = "a e i o u a e i o ea ou ai ie oo ei au y".split()
    codas = "n r s t l d m ng nd nt st rs th sh ck ll ss ble ght".split() + [""] * 14

    def spoken(least: int) -> str:
        """A word as languages build them, of some length."""
        out = ""
        while len(out) < least:
            out += word() if rng.random() < 0.4 else "".join((onsets[rng.integers(len(onsets))], vowels[rng.integers(len(vowels))], codas[rng.integers(len(codas))]))
        return out

    upper, digits = _ALPHABET.upper(), "0123456789"
    mixed = _ALPHABET + upper + digits
    rows, labels = [], []
    for k in range(n):
        secret = k % 2 == 0
        before = " ".join(word() for _ in range(rng.integers(0, 5)))
        mail = 1.0
        if secret:
            size = int(rng.integers(20, 64))
            forms = ["ghp_" + pick(mixed, 36), "sk-" + pick(mixed, size), pick(mixed, size), base64.b64encode(rng.bytes(size)).decode(),
                     "xoxb-" + pick(digits, 12) + "-" + pick(mixed, 24), "eyJ" + pick(mixed, 17) + "." + pick(mixed + "_-", 30), pick(mixed + "+/", size),
                     pick(_ALPHABET + upper, size), pick(upper + "234567", int(rng.integers(16, 40))), pick(_ALPHABET, size),
                     pick(mixed, int(rng.integers(80, 200)))]
            run = forms[int(rng.integers(0, len(forms)))]
            before += [" key: ", " Bearer ", " ", " = '", '="', " auth ", "\n"][int(rng.integers(0, 7))]
        else:
            forms = [f"{word()}{word()}{rng.integers(0, 100):02d}.{word()}.example.com", f"{word()}-{word()}-{rng.integers(1, 3000)}-{word()}",
                     f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 99)}-{word()}.{word()}", f"{word()}/{word()}/{word()}{rng.integers(0, 9)}.html",
                     f"{word()}{word()}{word()}{rng.integers(0, 999)}", f"{rng.integers(1900, 2100)}-{rng.integers(1, 12):02d}-{rng.integers(1, 28):02d}T{rng.integers(0, 23):02d}.{word()}",
                     f"{word().upper()}_{word().upper()}_{rng.integers(0, 99)}_{word().upper()}", "".join(word() for _ in range(int(rng.integers(3, 8)))), "".join(word() for _ in range(4)).capitalize() + ".",
                     "/".join(word() for _ in range(int(rng.integers(3, 12)))), rng.choice(list("-=_.")) * int(rng.integers(12, 80)), pick(digits, int(rng.integers(12, 20))),
                     "".join(word() for _ in range(4)).upper(), f"{word()}.{word()}={word()}"]
            run = forms[int(rng.integers(0, len(forms)))]
            if rng.random() < 0.5:
                run = spoken(int(rng.integers(12, 22)))
                run = [run, run, run + ".", run.capitalize(), run.upper(), "-".join((run, spoken(4)))][int(rng.integers(0, 6))]
            before += [" ", " (", "@", "//", "\n", " ", ", "][int(rng.integers(0, 7))]
            mail = rng.random()
            if mail < 0.15:
                run = f"{word()}{word()}{word()}.{rng.integers(0, 100):02d}"
            elif mail < 0.3:
                before += f"{word()}.{rng.integers(0, 100):02d}@"
                run = f"mail{rng.integers(0, 10)}.{word()}.com"
        after = "@mail" if mail < 0.15 else [" ", ".", ",", '"', "\n"][int(rng.integers(0, 5))]
        text = before + run + after + word()
        rows.append((text, len(before), len(before) + len(run)))
        labels.append(float(secret))
    return rows, np.array(labels)


class CharNet:
    """Embedding, one convolution, maxima over places, one logistic unit; trained by gradient steps in numpy."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (N_CLASSES, EMBED))
        self.conv = rng.normal(0, 0.3, (KERNEL * EMBED, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.3, FILTERS)
        self.out_bias = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        seen = self.embed[x]
        places = WIDTH - KERNEL + 1
        cols = np.concatenate([seen[:, k:k + places] for k in range(KERNEL)], axis=2)
        act = cols @ self.conv + self.bias
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0]
        hidden = np.maximum(top, 0.0)
        return cols, at, top, hidden, hidden @ self.out + self.out_bias

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k:k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.05, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), 64):
                rows = order[k:k + 64]
                cols, at, top, hidden, z = self._forward(x[rows])
                g = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                gh = g[:, None] * self.out * (top > 0)
                self.out -= rate * 10 * (hidden.T @ g)
                self.out_bias -= rate * 10 * g.sum()
                picked = cols[np.arange(len(rows))[:, None], at]  # row, filter, its window
                gw = np.einsum("nf,nfd->df", gh, picked)
                ge = gh[:, :, None] * self.conv.T[None]
                self.conv -= rate * 10 * gw
                self.bias -= rate * 10 * gh.sum(axis=0)
                ge = ge.reshape(len(rows), FILTERS, KERNEL, EMBED)
                for d in range(KERNEL):
                    np.add.at(self.embed, np.take_along_axis(x[rows], at + d, axis=1), -rate * 10 * ge[:, :, d])

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Logistic fit of the raw scores of findings, then the highest threshold that keeps the recall."""
        n1 = float(y.sum())
        y01, y = y, np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))  # keeps separable scores finite
        a, b = 0.1, 0.0
        for _ in range(200):
            p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, np.array([((p - y) * z).sum(), (p - y).sum()])), -0.5, 0.5)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(a), float(b)
        good = np.sort(self.calibrated(z[y01 == 1]))
        self.threshold = float(good[int(np.floor((1 - recall) * len(good)))]) if len(good) else 1.1


@lru_cache(maxsize=1)
def trained() -> CharNet:
    rows, y = labelled_findings()
    return train(rows, y)


def train(rows: list[tuple[str, int, int]], y: np.ndarray) -> CharNet:
    """A calibrated network from labelled findings; every third is held out for calibration and threshold."""
    found = [windows(classes_of(text), a, b) for text, a, b in rows]
    sizes = np.array([len(f) for f in found])
    x, owner = np.concatenate(found), np.repeat(np.arange(len(rows)), sizes)
    held = np.arange(len(y)) // 2 % 3 == 2
    net = CharNet()
    net.fit(x[~held[owner]], y[owner[~held[owner]]])
    z = np.maximum.reduceat(net.raw(x), np.cumsum(sizes) - sizes)
    net.calibrate(z[held], y[held])
    return net


def model_findings(net: CharNet, texts: list[str], base: list[list[tuple[int, int, str]]]) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the candidates that the network takes for secrets."""
    held, spots, size = [], [], 0

    def judge() -> Iterator[tuple[int, int, int]]:
        counts = np.array([len(h) for h in held])
        z = np.maximum.reduceat(net.raw(np.concatenate(held)), np.cumsum(counts) - counts)
        for spot, p in zip(spots, net.calibrated(z)):
            if p >= net.threshold:
                yield spot

    for k, text in enumerate(texts):
        spans = candidates(text, base[k])
        row = classes_of(text) if spans else None
        for a, b in spans:
            held.append(windows(row, a, b))
            spots.append((k, a, b))
            size += len(held[-1])
            if size >= BATCH:
                yield from judge()
                held, spots, size = [], [], 0
    if held:
        yield from judge()


def _scan(net: CharNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            base = [base_findings(t) for t in texts]
            found = [list(b) for b in base]
            for k, a, b in model_findings(net, texts, base):
                found[k].append((a, 3, b))
            name = lambda rows: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in rows)
            counts = [[sum(f[1] == kind for f in b) for b in base] for kind in range(3)]
            cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(name(b).encode()).hexdigest() for b in base]), pa.array([name(sorted(f)) for f in found])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """One row a document: counts and digest of its base findings, and all spans. Texts are read once, not shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return spread(texts).mapInArrow(_scan(net or trained()), fields)
