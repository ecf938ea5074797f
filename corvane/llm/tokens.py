"""Token ids of whole texts, by a public tokenizer file, with a cache of word cores.

The tokenizer file used here drops white space, never forms a token across it, lower-cases, and closes the last token of
each letter run with ``</w>``. So the ids of a text are the ids of its words, one after the other, and those of a word that
ends in a letter or digit and plain punctuation are the ids of either part. Each worker process keeps the ids of cores it
has met, across its tasks; new letter runs are encoded many to a library call and told apart by their closing tokens.
Texts that spell a special token are encoded word by word as they are.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np

END_ID = 1
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Plain ASCII punctuation that may be cut from a word's end.
TAIL = b".,;:!?*$%#&"
#: Words in the table that is looked at first.
HOT_WORDS = 6000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class WordEncoder:
    """Encodes texts to ``uint16`` arrays, the end id included.

    ``max_cores`` bounds the cache; when it is full it is emptied, so memory does not follow the vocabulary.
    """

    def __init__(self, path: str, end_id: int = END_ID, max_cores: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 65536:
            raise ValueError("ids beyond 16 bits: this encoder keeps ids in 16 bits")
        self.closes = np.zeros(65536, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.closes[i] = token.endswith("</w>")
        self.end = np.array([end_id], dtype="<u2").tobytes()
        self.cores: dict[bytes, bytes] = {}
        self.max_cores = max_cores
        self.hot: dict[bytes, bytes] = {}
        self.seen: Counter[bytes] = Counter()
        self.to_see = 300_000

    @staticmethod
    def _cut(word: bytes) -> bytes:
        """The word without its plain punctuation, where the core ends in a letter or digit; else the whole word."""
        core = word.rstrip(TAIL)
        if core is word or not core:
            return word
        last = core[-1]
        if last < 128:
            return core if 97 <= last <= 122 or 48 <= last <= 57 else word
        return core if core.decode("utf-8").lower()[-1].isalpha() else word

    def _each(self, cores: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in cores], add_special_tokens=False)
        for word, enc in zip(cores, found):
            self.cores[word] = np.array(enc.ids, dtype="<u2").tobytes()

    def _learn(self, cores: list[bytes]) -> None:
        """Encode cores that are not in the cache."""
        runs, rest = [], []
        for word in cores:
            text = word.decode("utf-8")
            if word.isalpha() or text.isalpha() and text.lower().isalpha():
                runs.append((word, text))
            else:
                rest.append(word)
        chunks = [runs[at:at + 100] for at in range(0, len(runs), 100)]
        for start in range(0, len(chunks), 200):
            some = chunks[start:start + 200]
            found = self.tokenizer.encode_batch_fast([" ".join(t for _, t in c) for c in some], add_special_tokens=False)
            for chunk, enc in zip(some, found):
                ids = np.array(enc.ids, dtype="<u2")
                ends = (2 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
                if len(ends) != len(chunk) or ends[-1] != 2 * len(ids):
                    rest += [w for w, _ in chunk]
                    continue
                data, a = ids.tobytes(), 0
                for (word, _), b in zip(chunk, ends):
                    self.cores[word] = data[a:b]
                    a = b
        for at in range(0, len(rest), 20_000):
            self._each(rest[at:at + 20_000])

    def _warm(self, words: list[bytes]) -> None:
        """Fill the small table of the most common words, once enough words were seen; it stays in the CPU's cache."""
        self.seen.update(words)
        self.to_see -= len(words)
        if self.to_see <= 0:
            known = self.cores
            self.hot = {w: known[w] for w, _ in self.seen.most_common(HOT_WORDS) if w in known}
            self.seen.clear()

    def _block(self, words: list[bytes]) -> bytes:
        known = self.cores
        common = list(map(self.hot.get, words))
        rest = [w for w, ids in zip(words, common) if ids is None]
        found = list(map(known.get, rest))
        if None in found:
            new = {w for w, ids in zip(rest, found) if ids is None}
            if len(known) + 2 * len(new) > self.max_cores:
                known.clear()
            cut = {w: self._cut(w) for w in new}
            parts = {*cut.values(), *(w[len(c):] for w, c in cut.items() if len(c) < len(w))}
            self._learn([c for c in parts if c not in known])
            for w, c in cut.items():
                if len(c) < len(w):
                    known[w] = known[c] + known[w[len(c):]]
            found = [known[w] if ids is None else ids for w, ids in zip(rest, found)]
        if self.to_see > 0:
            self._warm(words)
        if len(rest) == len(words):
            return b"".join(found)
        more = iter(found)
        return b"".join([next(more) if ids is None else ids for ids in common])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text and the end id; a null text is empty. Lone surrogates become question marks."""
        data = (text or "").encode("utf-8", "replace")
        if b"<|" in data:
            raw = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in data.split()], add_special_tokens=False)
            return np.array([i for enc in raw for i in enc.ids] + list(np.frombuffer(self.end, "<u2")), dtype="<u2")
        words = data.lower().split()
        parts = [self._block(words[at:at + 20_000]) for at in range(0, len(words), 20_000)]
        return np.frombuffer(b"".join([*parts, self.end]), dtype="<u2")


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """This process's encoder for a file: its caches last over tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]
