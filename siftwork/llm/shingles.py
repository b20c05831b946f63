"""Sets of hashed five-word shingles of whole texts, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

K = 5
#: Bytes of text that are worked on together, unless one text alone is longer.
CHUNK = 1 << 21
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_P = 0x5851F42D4C957F2D
_STEP = [pow(_P, 64 * i, 1 << 64) for i in range(2)]
_COEF = mix(np.arange(101, 101 + K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers below n of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(p)
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    w = np.empty(len(data) + 2, bool)
    w[0] = w[-1] = False
    w[1:-1] = _IS_WORD[data]
    edge = np.flatnonzero(w[1:] != w[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=c[1:])
        return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _some(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    starts, ends = words_of(data)
    h = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    last = np.append(first[1:], len(starts))
    with np.errstate(over="ignore"):
        n = len(h) - K + 1
        s = mix(sum(h[i : i + n] * _COEF[i] for i in range(K))) if n > 0 else np.empty(0, np.uint64)
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= K:
                u = np.sort(s[a : b - K + 1])
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                out.append(u[keep])
            elif b > a:
                out.append(mix(np.array([sum(int(x) * int(c) for x, c in zip(h[a:b], _COEF, strict=False)) + b - a & _M], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: all runs of K words, or all words where there are fewer."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t or b"") > CHUNK:
            out += _some(part)
            part, size = [], 0
        part.append(t or b"")
        size += len(t or b"")
    return out + (_some(part) if part else [])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
