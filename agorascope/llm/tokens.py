"""Token ids of whole texts by the tokenizers library, with a cache of pieces per Python worker.

Both vocabularies split a text before they merge, and never merge across the start of white
space or from a letter to the punctuation after it, so a text may be cut there and its pieces
encoded one by one: the ids are those of the whole text. Natural text repeats its pieces, and a
look-up is far cheaper than the merges. Cuts, hashes and look-ups are vector operations on the bytes
of a batch; each piece found is compared with the cached one byte by byte, and a text with a piece
that only has the same hash is encoded whole. The cache is bounded: beyond CACHE bytes it starts anew.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import public_tokenizers

from agorascope.llm import arrowwords

END = 2
CACHE = 96 << 20  # bytes of pieces, ids and keys kept per worker

_SPACE, _LETTER, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,;:!?#$%&*|")] = _MARK
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before these places is white space of more than one byte."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    other = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return two | general | other


def cuts(data: np.ndarray, bounds: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pieces of texts, which lie in ``data`` between ``bounds``: with the white
    space before them, or (``spaces`` False) without any."""
    kind = _KIND[data]
    space = kind == _SPACE
    before = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)[: len(kind)]
    cut = (before == _LETTER) & (kind == _MARK)
    heads = np.zeros(len(data) + 1, bool)
    heads[bounds] = True
    heads = heads[:-1]
    if not spaces:
        cut |= ~space & ((before == _SPACE) | heads)
        last = ~space
        last[:-1] &= space[1:] | cut[1:]
        return np.flatnonzero(cut), np.flatnonzero(last) + 1
    cut |= space & (before != _SPACE)
    begin = np.flatnonzero(cut)
    # white space that goes on from a wider character is not cut
    begin = begin[space[begin] & (begin > 0) & (data[np.maximum(begin - 1, 0)] >= 0x80)]
    cut[begin[_wide_space(data, begin)]] = False
    cut |= heads
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], len(data))[: len(begin)]


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial of each piece's bytes, from running sums over about ``step`` bytes."""
    out = np.zeros(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        low = int(begin[at])
        to = max(at + 1, int(np.searchsorted(begin, low + step)))
        stop = int(end[to - 1])
        up, down = arrowwords._power(stop - low + 1)
        sums = np.zeros(stop - low + 1, np.uint64)
        np.cumsum((data[low:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - low], out=sums[1:])
        out[at:to] = (sums[end[at:to] - low] - sums[begin[at:to] - low]) * down[begin[at:to] - low]
        at = to
    return arrowwords.mix(out)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i] to first[i] + size[i] of all i, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


class Encoder:
    """Ids of batches of texts. ``spaces`` False: the vocabulary ignores white space."""

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by key
        # by code: a piece's ids and bytes, and where they are
        self.flat, self.start, self.size = _Column(np.uint32), _Column(np.int64), _Column(np.int32)
        self.raw, self.raw_start, self.raw_size = _Column(np.uint8), _Column(np.int64), _Column(np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _add(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        ids, sizes = self._ids([data[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist())])
        codes = np.arange(self.start.used, self.start.used + len(begin), dtype=np.int32)
        self.start.add(self.flat.used + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.flat.add(ids)
        lengths = end - begin
        self.raw_start.add(self.raw.used + np.cumsum(lengths) - lengths)
        self.raw_size.add(lengths)
        self.raw.add(data[_ranges(begin, lengths)])
        return codes

    def _known(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The codes of the pieces' hashes; new ones are encoded."""
        distinct, at, inverse = np.unique(_hashes(data, begin, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        codes = np.full(len(distinct), -1, np.int32)
        inside = np.flatnonzero(place < len(self.keys))
        inside = inside[self.keys[place[inside]] == distinct[inside]]
        codes[inside] = self.codes[place[inside]]
        new = np.flatnonzero(codes < 0)
        if len(new):
            codes[new] = self._add(data, begin[at[new]], end[at[new]])
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.codes = np.insert(self.codes, place[new], codes[new])
        return codes[inverse]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        if 4 * self.flat.used + self.raw.used + 36 * self.start.used > CACHE:
            self.clear()
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begin, end = cuts(data, bounds, self.spaces)
        codes, lengths = self._known(data, begin, end), end - begin
        sizes = self.size.data[codes].astype(np.int64)
        ids = self.flat.data[_ranges(self.start.data[codes], sizes)]
        first = np.searchsorted(begin, bounds)  # each text's first piece
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
        other = self.raw_size.data[codes] != lengths
        alike = np.flatnonzero(~other)
        lengths = lengths[alike]
        same = data[_ranges(begin[alike], lengths)] == self.raw.data[_ranges(self.raw_start.data[codes[alike]], lengths)]
        if not same.all():
            other[alike] = ~np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)
        if other.any():
            return self._whole(texts, ids, counts, set((np.searchsorted(first, np.flatnonzero(other), "right") - 1).tolist()))
        return ids, counts

    def _whole(self, texts: list[str], ids: np.ndarray, counts: np.ndarray, wrong: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same with the ``wrong`` texts, whose pieces share a hash with others, encoded whole."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in wrong:
            parts[i] = self._ids([texts[i]])[0]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def encoder(path: str, spaces: bool) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    key = path, spaces
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, spaces)
    return _encoders[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


def encode_column(column, path: str, spaces: bool, end: int = END, step: int = 1 << 20):
    """For an Arrow string column: (first row, ids, counts) of runs of rows of about ``step``
    characters, with the end id, so that memory follows ``step`` and the longest text."""
    tool, texts, first, size = encoder(path, spaces), [], 0, 0
    for row, text in enumerate(column.to_pylist()):
        texts.append(text or "")
        size += len(texts[-1])
        if size >= step:
            yield first, *with_end(*tool.encode(texts), end)
            texts, first, size = [], row + 1, 0
    if texts:
        yield first, *with_end(*tool.encode(texts), end)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
