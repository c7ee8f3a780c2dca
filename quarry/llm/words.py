"""Word kernels over Arrow text: places and 64-bit hashes of the words of many texts at once.

A word is a run of bytes other than white space (space, tab, LF, VT, FF, CR). Its hash is a polynomial in its bytes
modulo 2 ** 64, taken from one running sum over all texts, then mixed; so the cost per byte is a few array operations.
"""

from __future__ import annotations

import numpy as np

#: White space of the word contracts.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
#: Odd multipliers by place in a gram.
PLACE = _random.integers(0, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    a = (a ^ a >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    a = (a ^ a >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ a >> np.uint64(32)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 .. n-1 modulo 2 ** 64, and their inverses."""
    if len(_powers[0]) < n:
        room = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(room, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words(at: np.ndarray, data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[at[i]:at[i + 1]]: word starts and ends (bytes from at[0]), hashes, and each text's first word (n + 1)."""
    bounds = at - at[0]
    b = data[at[0] : at[-1]]
    if not len(b):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    ink = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], ink])
    starts = np.flatnonzero(ink & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(ink & (~np.append(ink[1:], False) | edge[1:])) + 1
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[b] if fold else b] * up[:-1], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, h, np.searchsorted(starts, bounds)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive items, by first item (len(h) - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * PLACE[0]
    for k in range(1, size):
        out = out + h[k : k + n] * PLACE[k]
    return mix(out)


def shingle_sets(at: np.ndarray, data: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `size` make one shingle, none make none."""
    _, _, h, first = words(at, data, fold=True)
    g = grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            short = (h[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
