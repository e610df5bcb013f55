"""Several numpy arrays and byte strings as one compressed blob, so that what
travels between executors is few packed rows instead of many small ones."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import zstandard

_KINDS = ("|u1", "<i4", "<u4", "<i8", "<u8")


def pack(parts: Sequence[np.ndarray | bytes], level: int = 3) -> bytes:
    """Arrays of the kinds above (others become signed 64-bit) or byte strings.
    Arrays are stored in byte planes, which compress better."""
    out = []
    for x in parts:
        a = np.frombuffer(x, np.uint8) if isinstance(x, (bytes, bytearray, memoryview)) else np.ascontiguousarray(x)
        kind = a.dtype.newbyteorder("<").str if a.dtype.itemsize > 1 else a.dtype.str
        if kind not in _KINDS:
            a, kind = a.astype("<i8"), "<i8"
        size = a.dtype.itemsize
        body = a.view(np.uint8).reshape(-1, size).T.tobytes() if size > 1 else a.tobytes()
        out += [struct.pack("<BQ", _KINDS.index(kind), len(a)), body]
    return zstandard.ZstdCompressor(level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        at += 9
        kind = np.dtype(_KINDS[kind])
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        out.append(raw if kind.itemsize == 1 else np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out
