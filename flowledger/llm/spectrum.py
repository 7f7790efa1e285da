"""Exact eigenvalues and high-precision eigenvectors of a symmetric integer matrix without negative eigenvalues.

The characteristic polynomial is found modulo primes, by reduction to Hessenberg form, and put together by
Chinese remainders. All its roots are real, so by Descartes' rule the sign changes of the polynomial moved by t count
exactly the roots above t, with their multiplicity; halving intervals by that count isolates the roots and narrows
them to any precision. Eigenvectors span the null space of the matrix less the root: inverse iteration on
fixed-point integers with complete pivoting, as many vectors at once as the root is multiple.

All functions here take one small matrix; the work per prime and per root is handed to tasks by ``whitening``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Bits of a root below the largest root's first bit; roots that agree in half of them count as one.
ROOT_BITS = 256
#: Bits behind the point of the null-space arithmetic.
POINT_BITS = 2 * ROOT_BITS
# These witnesses decide primality below 3.3e24 (Miller-Rabin).
_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)


def is_prime(n: int) -> bool:
    if n < 2 or any(n % w == 0 for w in _WITNESSES):
        return n in _WITNESSES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for w in _WITNESSES:
        x = pow(w, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(limit: int) -> Iterator[int]:
    """Primes under ``limit``, falling."""
    return (n for n in range(limit - 1, 1, -1) if is_prime(n))


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial is larger: Maclaurin's inequality on eigenvalues that add up to the trace."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max((math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)), default=1)


def moduli(bound: int, bits: int = 31) -> list[int]:
    """Primes whose product exceeds twice the bound, so that signed values are determined."""
    out, product = [], 1
    for p in primes_below(1 << bits):
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo p, zero below the first subdiagonal."""
    a = matrix.copy()
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1][None, :] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor[None, :] % p).sum(axis=1)) % p
    return a


def characteristic_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo the prime p, that of x^0 first."""
    h = hessenberg(np.array([[x % p for x in row] for row in matrix], dtype=np.int64).reshape(len(matrix), -1), p)
    d = len(h)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weight, chain = np.zeros(k + 1, np.int64), 1
        weight[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            weight[i] = int(h[i, k]) * chain % p
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weight[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d].tolist()


def remainders_joined(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The signed integers that have the given residues (one list per prime), by Garner's rule."""
    values, product = [0] * len(residues[0]), 1
    for row, p in zip(residues, primes, strict=True):
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, row, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def roots_above(poly: list[int], t: int, bits: int) -> int:
    """Roots above t / 2^bits of a polynomial that has only real roots, with multiplicity."""
    d = len(poly) - 1
    # With x = y / 2^bits all is integer; then y moves by t, by repeated Horner steps.
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value_sign(poly: list[int], t: int, bits: int) -> int:
    """Sign of the polynomial at t / 2^bits."""
    value, scale = 0, 0
    for v in reversed(poly):
        value = value * t + (v << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], many: int, bits: int = ROOT_BITS) -> tuple[list[tuple[int, int]], int]:
    """The clusters (root, multiplicity) that hold the ``many`` largest positive roots, falling, as integers over 2^shift; and shift.

    Zero roots are left out. Roots that agree in half of the bits are one cluster.
    """
    while poly and poly[0] == 0:
        poly = poly[1:]
    d = len(poly) - 1
    if d < 1:
        return [], 0
    top = -poly[d - 1]  # the sum of the roots, none negative
    shift = max(0, bits - top.bit_length())
    first = min(top.bit_length() + shift, bits) // 2  # at this width a cluster is no longer split
    high = top << shift
    found: list[tuple[int, int]] = []
    spans = [(0, high + 1, roots_above(poly, 0, shift), 0)]  # (low, high], roots above low, roots above high
    while spans and sum(m for _, m in found) < many:
        low, top_, above, beyond = spans.pop()
        inside = above - beyond
        if not inside:
            continue
        if inside == 1 or top_ - low <= 1 << first:
            found.append((_narrowed(poly, low, top_, above, shift), inside))
            continue
        mid = (low + top_) // 2
        at_mid = roots_above(poly, mid, shift)
        spans += [(low, mid, above, at_mid), (mid, top_, at_mid, beyond)]
    return found, shift


def _narrowed(poly: list[int], low: int, high: int, above: int, shift: int) -> int:
    """The largest root in (low, high], rounded up to an integer over 2^shift; ``above`` roots lie above low."""
    single = above - roots_above(poly, high, shift) == 1
    beyond = _value_sign(poly, high, shift) if single else 0
    if single and beyond == 0:
        return high
    more = roots_above(poly, high, shift)
    while high - low > 1:
        mid = (low + high) // 2
        # A simple root changes the sign between mid and high; a cluster is counted.
        inside = (_value_sign(poly, mid, shift) != beyond) if single else roots_above(poly, mid, shift) > more
        low, high = (mid, high) if inside else (low, mid)
    return high


def null_vectors(matrix: list[list[int]], root: int, shift: int, many: int, steps: int = 2) -> list[list[float]]:
    """Orthonormal vectors spanning the eigenspace of a root of the given multiplicity, by inverse iteration."""
    d, one = len(matrix), 1 << POINT_BITS
    scale = max(1, max(abs(x) for row in matrix for x in row))
    point = POINT_BITS + scale.bit_length()
    # Entries over the scale, with POINT_BITS bits behind the point.
    a = np.array([[(x << point) for x in row] for row in matrix], dtype=object).reshape(d, d)
    for i in range(d):
        a[i, i] -= (root << point) >> shift
    a = a >> scale.bit_length()
    rows, columns = np.arange(d), np.arange(d)
    for k in range(d):
        rest = np.abs(a[k:, k:])
        at = int(rest.argmax())
        i, j = k + at // (d - k), k + at % (d - k)
        a[[k, i]], rows[[k, i]] = a[[i, k]], rows[[i, k]]
        a[:, [k, j]], columns[[k, j]] = a[:, [j, k]], columns[[j, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # the last bit, as rounding would have left it
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << POINT_BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]) >> POINT_BITS
    rng = np.random.default_rng(d)
    vectors = [np.array([int(x) << (POINT_BITS - 30) for x in rng.integers(-(1 << 30), 1 << 30, d)], dtype=object) for _ in range(many)]
    for _ in range(steps):
        vectors = _orthonormal([_solved(a, rows, columns, v) for v in vectors], one)
    return [[x / one for x in v] for v in vectors]


def _solved(lu: np.ndarray, rows: np.ndarray, columns: np.ndarray, right: np.ndarray) -> np.ndarray:
    d = len(lu)
    y = right[rows].copy()
    for k in range(d):
        y[k + 1 :] -= (lu[k + 1 :, k] * y[k]) >> POINT_BITS
    for k in range(d - 1, -1, -1):
        y[k] = (y[k] << POINT_BITS) // lu[k, k]
        y[:k] -= (lu[:k, k] * y[k]) >> POINT_BITS
    out = np.empty(d, dtype=object)
    out[columns] = y
    return out


def _orthonormal(vectors: list[np.ndarray], one: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        v = v.copy()
        for _ in range(2):
            size = max(1, max(abs(x) for x in v))
            v = np.array([(int(x) * one) // size for x in v], dtype=object)
            for u in out:
                v = v - (u * ((u * v).sum() >> POINT_BITS) >> POINT_BITS)
        norm = math.isqrt(int((v * v).sum()))
        out.append(np.array([(int(x) * one) // max(1, norm) for x in v], dtype=object))
    return out
