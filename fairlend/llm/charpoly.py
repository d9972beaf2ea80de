"""Characteristic polynomials of integer matrices, their real roots, and eigenvectors to many digits.

Whole numbers are Python's own, without a bound on their size; numpy holds
residues below 2^31, whose products fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext

import numpy as np

#: Binary places to which a root is isolated.
PLACES = 64
#: Decimal digits of the elimination beside those of the matrix's own entries.
DIGITS = 70
#: Rounds of inverse iteration; each multiplies the error by about 2**-PLACES over the gap to the next root.
ROUNDS = 3


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3,215,031,751."""
    if n < 8 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1):
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes from 2^31 downwards whose product has more than ``bits`` bits."""
    out, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def coefficient_bits(trace: int, d: int) -> int:
    """Bits that hold every coefficient, with its sign, for a matrix without negative eigenvalues.

    The k-th elementary symmetric sum of d such numbers is at most
    ``binomial(d, k) * (trace / d) ** k``; all of them add up to ``(1 + trace / d) ** d``.
    """
    return d * (trace // d + 2).bit_length() + 2


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``m`` modulo ``p`` with zeros below the first subdiagonal."""
    a = m % p
    d = len(a)
    for k in range(d - 2):
        rows = np.flatnonzero(a[k + 1:, k])
        if not len(rows):
            continue
        i = int(rows[0]) + k + 1
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        u = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * u % p).sum(axis=1)) % p
    return a


def charpoly_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo ``p``, lowest first; ``m`` holds residues."""
    h, d = hessenberg(m, p), len(m)
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weight, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (polys[:k] * weight[:, None] % p).sum(axis=0)) % p
    return polys[d]


def remaindered(primes: Sequence[int], residues: Sequence[int]) -> int:
    """The number of least magnitude with these residues (Garner's form of Chinese remaindering)."""
    value, product = 0, 1
    for p, r in zip(primes, residues):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value if 2 * value <= product else value - product


def roots_above(poly: Sequence[int], a: int) -> int:
    """How many roots, with multiplicity, exceed ``a``; all roots must be real.

    The Taylor shift's coefficients change sign once per positive root: for a
    polynomial with real roots only, Descartes' bound is attained.
    """
    c = list(poly)
    for k in range(len(c) - 1):
        carry = c[-1]
        for j in range(len(c) - 2, k - 1, -1):
            carry = c[j] = c[j] + carry * a
    signs = [x > 0 for x in c if x]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def scaled(poly: Sequence[int], places: int) -> list[int]:
    """The monic polynomial whose roots are ``2 ** places`` times those of ``poly``."""
    d = len(poly) - 1
    return [c << (places * (d - k)) for k, c in enumerate(poly)]


def isolate(poly: Sequence[int], k: int, top: int) -> tuple[int, int, int]:
    """(high, first, many): the k-th largest root (from 0) lies in (high - 1, high], with ``many`` roots in all.

    ``first`` of the roots exceed ``high``; no root exceeds ``top``, and none is negative.  Bisection by
    exact counts until one root is left, then by the sign of the value.
    """
    low, high, above_low, above_high = -1, top, len(poly) - 1, 0
    while high - low > 1:
        mid = (low + high) // 2
        if above_low - above_high == 1:
            value = 0
            for c in reversed(poly):
                value = value * mid + c
            # Monic: the value is positive exactly if an even number of roots is above.
            above = above_high if value == 0 or (value > 0) == (above_high % 2 == 0) else above_low
        else:
            above = roots_above(poly, mid)
        if above > k:
            low, above_low = mid, above
        else:
            high, above_high = mid, above
    return high, above_high, above_low - above_high


def _starts(d: int, many: int) -> Iterator[list[Decimal]]:
    """Fixed start vectors without a pattern that an eigenvector could be orthogonal to."""
    state = 20_231
    for _ in range(many):
        out = []
        for _ in range(d):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            out.append(Decimal((state >> 20) + 1))
        yield out


def null_space(matrix: Sequence[Sequence[int]], high: int, places: int, many: int) -> list[list[float]]:
    """Orthonormal vectors of the ``many`` eigenvalues just below ``high / 2 ** places``.

    Inverse iteration: one elimination with row pivots of the matrix less a
    shift just above the eigenvalues, in decimal arithmetic with more digits
    than the shift takes away.
    """
    d = len(matrix)
    size = len(str(max(1, max(abs(x) for row in matrix for x in row))))
    with localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = 2 * size + DIGITS, 10 ** 9, -10 ** 9
        shift = Decimal(high + 1) / Decimal(1 << places)
        a = [[Decimal(x) for x in row] for row in matrix]
        for i in range(d):
            a[i][i] -= shift
        order = list(range(d))
        for k in range(d):
            i = max(range(k, d), key=lambda r: abs(a[r][k]))
            a[k], a[i], order[k], order[i] = a[i], a[k], order[i], order[k]
            if not a[k][k]:  # a pivot that rounding took whole
                a[k][k] = Decimal(10) ** -(size + DIGITS)
            pivot, tail = a[k][k], a[k][k + 1:]
            for r in range(k + 1, d):
                row = a[r]
                if row[k]:
                    u = row[k] = row[k] / pivot
                    row[k + 1:] = [x - u * y for x, y in zip(row[k + 1:], tail)]
        vectors = list(_starts(d, many))
        for _ in range(ROUNDS):
            done: list[list[Decimal]] = []
            for v in vectors:
                y = [v[i] for i in order]
                for k in range(d):
                    y[k] -= sum((x * z for x, z in zip(a[k][:k], y)), Decimal(0))
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - sum((x * z for x, z in zip(a[k][k + 1:], y[k + 1:])), Decimal(0))) / a[k][k]
                for w in done:
                    along = sum((x * z for x, z in zip(w, y)), Decimal(0))
                    y = [z - along * x for x, z in zip(w, y)]
                norm = sum((z * z for z in y), Decimal(0)).sqrt()
                done.append([z / norm for z in y])
            vectors = done
        out = []
        for v in vectors:
            lead = max(v, key=abs)
            out.append([float(z if lead > 0 else -z) for z in v])
        return out
