"""Vectorised word arrays: words of a whole Arrow text column as NumPy offsets and 64-bit hashes.

A word is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``. In UTF-8 these separators are single
bytes, so the work is done on bytes. A word's hash chains a bit mixer over its eight-byte lanes and its length; a
window's hash chains the same mixer over the hashes of its halves, quarters and so on. No step is linear in what it
hashes, so that texts with a regular structure (repeats, Thue-Morse words) don't meet by construction. A second seed
gives an independent hash of the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SEED, _LANE, _NEXT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once, which bounds the temporary arrays (a longer document is hashed alone).
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one.
LANE_BYTES = 64
#: The low 0 to 8 bytes of a lane.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit (the 64-bit finaliser published with SplitMix)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(batches, column: str, size: int = 2 * SLICE_BYTES):
    """The batches in slices of at most ``size`` bytes of text (a longer document is a slice of its own)."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def count_words(data: np.ndarray, offsets: np.ndarray) -> int:
    """Words of the texts that ``offsets`` (one more than texts) bound in ``data``."""
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return 0
    word = ~_SPACE[data[low:high]]
    first = np.unique(offsets[:-1][offsets[:-1] < high]) - low
    inner = first[first > 0]
    return int(word[0]) + int(np.count_nonzero(word[1:] & ~word[:-1])) + int(np.count_nonzero(word[inner] & word[inner - 1]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words ``data[starts:ends]``."""
    size = ends - starts
    h = mix(size.astype(_U) * _U(_LANE) + _U((_SEED * (2 * seed + 1)) % (1 << 64)))
    if not len(starts):
        return h
    lanes = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left, at = np.arange(len(starts)), 0
    left = left[size <= LANE_BYTES]
    while len(left):
        rest = size[left] - 8 * at
        lane = lanes[starts[left] + 8 * at] & _LOW[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ lane) * _U(_LANE) + _U(_NEXT))
        left, at = left[rest > 8], at + 1
    for i in np.flatnonzero(size > LANE_BYTES):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence, from those of its two parts."""
    return mix((mix(left + _U(_NEXT)) ^ right) * _U(_LANE) + _U(_SEED))


class Words:
    """The words of some texts: byte ``starts`` and ``ends``, ``first`` word of each text (one more at the end), ``hash``."""

    def __init__(self, texts: pa.Array, seed: int = 0):
        self.data, self.offsets = text_bytes(texts)
        self.seed = seed
        n, parts, at = len(self.offsets) - 1, [], 0
        while at < n:
            to = int(np.searchsorted(self.offsets, self.offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(n, max(to, at + 1))
            parts.append(self._slice(at, to))
            at = to
        self.starts, self.ends, self.hash = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, _U)))
        self.first = np.searchsorted(self.starts, self.offsets)

    def _slice(self, at: int, to: int):
        low, high = int(self.offsets[at]), int(self.offsets[to])
        data = self.data[low:high]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        space = _SPACE[data]
        edges = self.offsets[at : to + 1] - low
        before, after = np.empty_like(space), np.empty_like(space)
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        before[edges[:-1][edges[:-1] < len(data)]] = True
        after[edges[1:][edges[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        return starts + low, ends + low, word_hashes(data, starts, ends, self.seed)

    def reseeded(self, seed: int) -> Words:
        """The same words under another hash."""
        out = object.__new__(Words)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("data", "offsets", "starts", "ends", "first")}, seed=seed)
        out.hash = word_hashes(self.data, self.starts, self.ends, seed)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of every ``size``-word window that lies within one text."""
        ends = np.repeat(self.first[1:], self.counts())
        starts = np.flatnonzero(np.arange(len(self.hash)) + size <= ends)
        return starts, self.window_hash(starts, size)

    def window_hash(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size``-word windows at ``starts``, joined from runs of 1, 2, 4, ... words."""
        out, at, run, span = None, 0, self.hash, 1
        while True:
            if size & span:
                part = run[starts + at]
                out, at = part if out is None else _joined(out, part), at + span
            if 2 * span > size:
                break
            run, span = _joined(run[: len(run) - span], run[span:]), 2 * span
        return mix(out ^ _U((size * _LANE) % (1 << 64)))
