"""Arithmetic in the field of the prime 2**61 - 1, on numpy arrays of uint64."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_61, _31, _30, _1 = np.uint64(61), np.uint64(31), np.uint64(30), np.uint64(1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b; products are taken in halves of 31 and 30 bits, so nothing leaves 64 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = al * bh + ah * bl
    return _fold(ah * bh * np.uint64(2) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _fold(a + b)


def inv(a: int) -> int:
    return pow(int(a), P - 2, P)


def segment_products(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of the rows of ``values`` (n x m) within each segment; ``starts`` are the segments' first rows."""
    sizes = np.diff(np.append(starts, len(values)))
    out = values[starts].copy()
    for r in range(1, int(sizes.max(initial=1))):
        live = np.flatnonzero(sizes > r)
        out[live] = mul(out[live], values[starts[live] + r])
    return out


def horner(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Polynomials (one row of coefficients each, lowest first) at one x each."""
    out = np.zeros(len(x), np.uint64)
    for k in range(coefficients.shape[1] - 1, -1, -1):
        out = add(mul(out, x), coefficients[:, k])
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """A solution of a x = b; free unknowns are 0, None if there is none."""
    m = np.concatenate([a, b[:, None]], axis=1).astype(np.uint64)
    n, pivots, row = a.shape[1], [], 0
    for col in range(n):
        hit = np.flatnonzero(m[row:, col])
        if not len(hit):
            continue
        if hit[0]:
            m[[row, row + hit[0]]] = m[[row + hit[0], row]]
        m[row] = mul(m[row], np.uint64(inv(m[row, col])))
        rest = np.flatnonzero(m[:, col])
        rest = rest[rest != row]
        m[rest] = sub(m[rest], mul(m[rest, col][:, None], m[row][None, :]))
        pivots.append(col)
        row += 1
        if row == len(m):
            break
    if np.any(m[row:, n]):
        return None
    x = np.zeros(n, np.uint64)
    x[pivots] = m[: len(pivots), n]
    return x


def poly_divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, q, lead = a[:], [0] * max(1, len(a) - len(b) + 1), inv(b[-1])
    for k in range(len(a) - len(b), -1, -1):
        q[k] = f = a[k + len(b) - 1] * lead % P
        if f:
            for i, c in enumerate(b):
                a[k + i] = (a[k + i] - f * c) % P
    return q, trim(a[: len(b) - 1])


def trim(a: list[int]) -> list[int]:
    while a and a[-1] == 0:
        a.pop()
    return a


def monic_gcd(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, poly_divmod(a, b)[1]
    lead = inv(a[-1])
    return [c * lead % P for c in a]
