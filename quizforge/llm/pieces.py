"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once in a worker.

Both vocabularies cut a text into pieces (words, digits, marks, spaces) and encode each piece for itself, so a
text's ids are its pieces' ids in order. The cuts are found for a whole chunk of texts with numpy, and the
library encodes only pieces that a worker has not seen yet. Seen pieces are known by their bytes, and their memory
is bounded in number and bytes. Texts with a
character beyond U+00FF or with "<|" (a special token may follow) go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from quizforge.llm.common import span_ids  # noqa: E402

SPACE, LETTER, DIGIT, OTHER = range(4)


def _kind(c: str) -> int:
    major = unicodedata.category(c)[0]
    return LETTER if major == "L" else DIGIT if major == "N" else SPACE if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else OTHER


_KIND = np.array([_kind(chr(v)) for v in range(256)], np.uint8)
_LOWER = np.array([ord(chr(v).lower()) for v in range(256)], np.uint8)
#: The signs by which byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {v: 0x100 + k for k, v in enumerate(v for v in range(256) if v not in _PLAIN)}
#: What may follow an apostrophe as a piece of its own.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


def _contractions(data: np.ndarray, kind: np.ndarray, opens: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that open a contraction, and its length; ``inner``: no text starts here."""
    at = np.flatnonzero((data == 0x27) & opens)
    size = np.zeros(len(at), np.int64)
    get = lambda k: np.where((at + k < len(data)) & inner[np.minimum(at + k, len(data) - 1)], data[np.minimum(at + k, len(data) - 1)], 0)
    one, two = get(1), get(2)
    two = np.where(one == 0, 0, two)
    for a, b in _LONG:
        size[(one == ord(a)) & (two == ord(b))] = 2
    size[np.isin(one, np.frombuffer(_SHORT.encode(), np.uint8))] = 1
    return at[size > 0], size[size > 0]


def cut_byte_level(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 bytes, starts and ends of the pieces that a byte-level vocabulary sees."""
    n = len(data)
    kind = _KIND[data]
    inner = np.ones(n, bool)
    inner[offsets[:-1][offsets[:-1] < n]] = False
    start = ~inner
    start[1:] |= kind[1:] != kind[:-1]
    # A space before a word, number or mark belongs to it; any other white space there stands alone.
    word = np.flatnonzero(start & inner & (kind != SPACE))
    word = word[kind[word - 1] == SPACE]
    start[word - 1] = True
    start[word[data[word - 1] == 0x20]] = False
    at, size = _contractions(data, kind, start & (kind == OTHER), inner)
    start[at + 1] = False
    after = at + size + 1
    start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.concatenate((starts[1:], [n])) if n else starts


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased Latin-1 bytes, starts and ends of the pieces of the word-end vocabulary; white space drops."""
    n = len(data)
    data = _LOWER[data]
    kind = _KIND[data]
    inner = np.ones(n, bool)
    inner[offsets[:-1][offsets[:-1] < n]] = False
    start = ~inner | (kind == DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    at, size = _contractions(data, kind, start & (kind == OTHER), inner)
    start[at + 1] = False
    after = at + size + 1
    start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.concatenate((starts[1:], [n])) if n else starts
    real = kind[starts] != SPACE
    return data, starts[real], ends[real]


class PieceEncoder:
    """Ids of texts; ``cut`` finds the pieces of this vocabulary."""

    def __init__(self, path: str, cut, most: int = 500_000, most_bytes: int = 16_000_000) -> None:
        self.library, self.cut, self.most, self.most_bytes = Tokenizer.from_file(path), cut, most, most_bytes
        self.model = self.library.model
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        #: For each entry the place of its first id and the number of its ids.
        self.first = [np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)]
        self.ids, self.used = np.zeros(1 << 14, np.int32), 0

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(p.decode("latin-1").encode().decode("latin-1").translate(_BYTE_SIGNS))] for p in pieces]
        flat = np.fromiter((x for ids in found for x in ids), np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        size = np.fromiter(map(len, found), np.int64, len(found))
        n = len(self.known)
        while n + len(found) > len(self.first[0]):
            self.first = [np.concatenate((x, np.zeros_like(x))) for x in self.first]
        self.first[0][n : n + len(found)] = self.used + np.cumsum(size) - size
        self.first[1][n : n + len(found)] = size
        self.known.update(zip(pieces, range(n, n + len(found)), strict=True))
        self.used += len(flat)
        self.size += sum(map(len, pieces))

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece, after learning the new ones."""
        if not len(starts):
            return starts
        number, some = span_ids(data, starts, ends)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        if len(self.known) + len(pieces) > self.most or self.size > self.most_bytes:
            self.clear()
        missing = [p for p in pieces if p not in self.known]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[number]

    def _split(self, texts: list[str]) -> tuple[list[int], list[bytes], list[int]]:
        plain, raw, whole = [], [], []
        for i, t in enumerate(texts):
            try:
                one = t.encode("latin-1")
            except UnicodeEncodeError:
                one = None
            if one is None or b"<|" in one:
                whole.append(i)
            else:
                plain.append(i)
                raw.append(one)
        return plain, raw, whole

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        plain, raw, whole = self._split(texts)
        out = np.zeros(len(texts), np.int64)
        for i in whole:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        if raw:
            offsets = np.cumsum([0, *map(len, raw)])
            data, starts, ends = self.cut(np.frombuffer(b"".join(raw), np.uint8), offsets)
            entry = self._lookup(data, starts, ends)
            size = self.first[1][entry]
            total = np.concatenate(([0], np.cumsum(size)))
            at = np.searchsorted(starts, offsets)
            out[plain] = total[at[1:]] - total[at[:-1]]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain, raw, whole = self._split(texts)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        if raw:
            offsets = np.cumsum([0, *map(len, raw)])
            data, starts, ends = self.cut(np.frombuffer(b"".join(raw), np.uint8), offsets)
            entry = self._lookup(data, starts, ends)
            size = self.first[1][entry]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(self.first[0][entry] - total[:-1], size) + np.arange(total[-1])]
            at = total[np.searchsorted(starts, offsets)]
            for k, i in enumerate(plain):
                out[i] = ids[at[k] : at[k + 1]]
        return out


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, cut) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    key = (path, cut.__name__)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, cut)
    return _encoders[key]
