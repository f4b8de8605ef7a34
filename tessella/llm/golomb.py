"""Golomb coding of sorted fingerprints, with quotients and remainders in streams of their own, so that NumPy decodes whole lists."""

from __future__ import annotations

import numpy as np


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct integers in [0, span) as gaps in a Golomb code, whose parameter is the power of two below the mean gap.

    Layout: count (4 bytes), bits of a remainder (1), the remainders, then the quotients in unary.
    """
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, (max(1, span // len(values))).bit_length() - 1)
    bits = np.empty((len(gaps), k), np.uint8)
    for j in range(k):
        bits[:, j] = (gaps >> (k - 1 - j)) & 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return len(values).to_bytes(4, "little") + bytes([k]) + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    n, k = int.from_bytes(data[:4], "little"), data[4]
    size = (n * k + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 5))[: n * k].reshape(n, k)
    rest = np.zeros(n, np.int64)
    for j in range(k):
        rest = rest << 1 | bits[:, j]
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=5 + size)))
    return np.cumsum(((np.diff(ends, prepend=-1) - 1) << k | rest) + 1) - 1
