"""Words of Arrow text columns as numpy arrays: no Python object per word.

A word is a maximal run of bytes outside `[\\x20\\x09-\\x0D]`; UTF-8 never uses
those bytes inside a character, so byte and character views agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Odd multiplier of the polynomial hash, and bytes hashed in one go.
_P, _SEGMENT = 0x9E3779B97F4A7C15, 1 << 20
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each value."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.concatenate([[_U(1)], np.full(_SEGMENT, _P, _U)])
        down = np.concatenate([[_U(1)], np.full(_SEGMENT, inverse, _U)])
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list = []


@dataclass
class Words:
    """data: the texts' bytes; start, end, doc: of each word; count: words per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    def first(self) -> np.ndarray:
        """Index of each text's first word, and one past the last word."""
        return np.concatenate([[0], np.cumsum(self.count)])


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the bounds of each."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows of about `most` bytes of text (one row at least)."""
    _, at = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), texts.slice(i, j - i)
        i = j


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = raw(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(len(texts), np.int64))
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = at[:-1][at[:-1] < n]
    first[begins] = inside[begins]
    begins = begins[begins > 0]
    last[begins - 1] = inside[begins - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at[1:], start, "right")
    return Words(data, start, end, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not _POWERS:
        _POWERS.extend(_powers())
    up, down = _POWERS
    out = np.empty(len(w.start), _U)
    i, n = 0, len(w.start)
    while i < n:
        base = w.start[i]
        j = int(np.searchsorted(w.end, base + _SEGMENT, "right"))
        if j == i:  # one word longer than a segment
            out[i] = int.from_bytes(hashlib.blake2b(w.data[base : w.end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        s, e = w.start[i:j] - base, w.end[i:j] - base
        with np.errstate(over="ignore"):
            total = np.empty(e[-1] + 1, _U)
            total[0] = 0
            np.cumsum(_TABLE[w.data[base : base + e[-1]]] * up[: e[-1]], out=total[1:])
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values (len - size + 1 of them)."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, size):
            out *= _U(0xA24BAED4963EE407)
            out += h[k : k + m]
        return mix(out)


def shingles(w: Words, h: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `size` words; of the
    whole sequence if it has fewer; empty without words."""
    at, all_runs, out = w.first(), runs(h, size), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(runs(h[a:b], b - a) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out
