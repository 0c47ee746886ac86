"""Words, shingles and hashes of many texts at once, as numpy arrays over one UTF-8 buffer.

A word is a run of bytes outside ASCII white space (0x20, 0x09-0x0D), which equals
``[^\\x20\\x09-\\x0D]+`` on the decoded text. A null text counts as empty. All hashes are
64-bit functions of the bytes alone, the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 2 << 20


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 of the splitmix64 rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_MOD = 1 << 64
_BASE = 0x5851F42D4C957F2D
_BYTE = splitmix(256, 11)
_PLACE = splitmix(64, 23) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and everything of ASCII but letters and digits is a blank.
LETTERS = LOWER.copy()
LETTERS[[x for x in range(128) if not chr(x).isalnum()]] = 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * U64(pow(base, done, _MOD))
            done += k
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = (_geometric(_BASE, size), _geometric(pow(_BASE, -1, _MOD), size))
    return _powers[size]


class TextBlock:
    """raw: bytes of all texts; buf: the same put through `table`, if given; off: where each text starts and ends; start, end, doc: of each word."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        arr = texts.cast(pa.large_string()).fill_null("")
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        self.n = len(arr)
        bufs = arr.buffers()
        off = np.frombuffer(bufs[1], np.int64, count=arr.offset + self.n + 1)[arr.offset :] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and self.n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.raw = raw
        self.buf = raw if table is None else table[raw]
        word = ~SPACE[self.buf]
        size = len(self.buf)
        first = np.zeros(size + 1, bool)
        first[self.off] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:size]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:size]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.words_at = np.searchsorted(self.start, self.off)
        self.n_words = np.diff(self.words_at)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        up, down = powers(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.buf) + 1, U64)
                np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=self._sums[1:])
            return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8")

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a byte property over each text."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (those across texts included; the caller drops them)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:m] * _PLACE[0]
        for j in range(1, k):
            out = out + words[j : j + m] * _PLACE[j]
    return mix(out + U64(k))


def shingle_sets(block: TextBlock, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the distinct k-word shingles of each text, sorted by both.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    words = block.word_hash()
    h = window_hash(words, k)
    inside = block.doc[: len(h)] == block.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    docs, h = block.doc[: len(h)][inside], h[inside]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < k))
    if len(short):
        more = np.zeros(len(short), U64)
        at, n = block.words_at[short], block.n_words[short]
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                has = n > j
                more[has] += words[at[has] + j] * _PLACE[j]
            more = mix(more + n.astype(U64))
        docs, h = np.concatenate([docs, short]), np.concatenate([h, more])
    order = np.lexsort((h, docs))
    docs, h = docs[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (h[1:] != h[:-1])
    return docs[new], h[new]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, with the end appended."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", table: np.ndarray | None = None, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, TextBlock]]:
    """Slices of the batches with at most about `limit` bytes of text each (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(column).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(arr.buffers()[1], np.int64, count=arr.offset + len(arr) + 1)[arr.offset :]
        at = 0
        while at < len(arr):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), TextBlock(arr.slice(at, to - at), table)
            at = to
