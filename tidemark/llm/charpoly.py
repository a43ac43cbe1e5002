"""Exact spectrum of a small integer matrix: its characteristic polynomial modulo many primes,
put together by remainders; its roots in intervals of exact integers; eigenvectors by inverse
iteration in fixed point.

The matrix has the size of an embedding, never of the data. What is costly (one polynomial for
each prime, one factorisation for each root) is a function of its own, so that Spark can deal it
to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

#: Primes stay below this, so that a product of residues and a sum of two fit in 64 bits.
PRIME_TOP = 1 << 31
#: Bits after the point of a root and in the iteration for its eigenvectors.
GUARD_BITS = 256


def primes(bits: int) -> list[int]:
    """Enough of the primes below ``PRIME_TOP``, from above, for a product over 2**bits."""
    sieve = np.ones(1 << 16, bool)
    sieve[:2] = False
    for i in range(2, 256):
        if sieve[i]:
            sieve[i * i :: i] = False
    small = np.flatnonzero(sieve)
    out, have, n = [], 0.0, PRIME_TOP - 1
    while have <= bits + 1:
        if (n % small != 0).all():
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo p, constant term first, of det(t - matrix): the matrix is brought to
    Hessenberg form by similar row and column steps, whose leading minors give the polynomial."""
    h = np.array(matrix % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        # the columns' step undoes the rows' one: residues are halved to keep sums in 64 bits
        low, high = factor & 0xFFFF, factor >> 16
        at = h[:, m + 1 :]
        h[:, m] = (h[:, m] + ((at * high % p).sum(1) % p << 16) + (at * low % p).sum(1)) % p
    polys = [np.ones(1, np.int64)]
    for k in range(1, d + 1):
        nxt = np.zeros(k + 1, np.int64)
        nxt[1:] = polys[-1]
        nxt[:-1] = (nxt[:-1] - int(h[k - 1, k - 1]) * polys[-1] % p) % p
        run = 1
        for j in range(k - 1, 0, -1):
            run = run * int(h[j, j - 1]) % p
            if not run:
                break
            c = run * int(h[j - 1, k - 1]) % p
            nxt[:j] = (nxt[:j] - c * polys[j - 1] % p) % p
        polys.append(nxt)
    return [int(c) % p for c in polys[d]]


def remaindered(residues: Iterable[tuple[int, list[int]]]) -> list[int]:
    """The integers, smallest in absolute value, with the given residues for each prime."""
    whole, product = None, 1
    for p, values in residues:
        if whole is None:
            whole = list(values)
        else:
            inverse = pow(product, -1, p)
            whole = [w + product * ((v - w) * inverse % p) for w, v in zip(whole, values)]
        product *= p
    return [w - product if 2 * w > product else w for w in whole]


def bound_bits(matrix: np.ndarray) -> int:
    """Bits of the largest coefficient there can be: with eigenvalues of one sign the k-th is at
    most C(d, k) (trace / d)**k."""
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    mean = math.log2(max(trace, 1)) - math.log2(d)
    return math.ceil(max(math.log2(math.comb(d, k)) + k * max(mean, 0.0) for k in range(d + 1))) + 2


def _trim(f: list[int]) -> list[int]:
    while f and not f[-1]:
        f.pop()
    return f


def _gcd_mod(f: list[int], g: list[int], p: int) -> list[int]:
    """The monic greatest common divisor modulo p."""
    f, g = (_trim([c % p for c in x]) for x in (f, g))
    while g:
        lead = pow(g[-1], -1, p)
        while len(f) >= len(g):
            q, at = f[-1] * lead % p, len(f) - len(g)
            for i, c in enumerate(g):
                f[at + i] = (f[at + i] - q * c) % p
            _trim(f)
        f, g = g, f
    lead = pow(f[-1], -1, p)
    return [c * lead % p for c in f]


def _divided(f: list[int], g: list[int]) -> list[int] | None:
    """f / g for a monic g, or None if it leaves a rest."""
    f, out = list(f), [0] * (len(f) - len(g) + 1)
    for at in range(len(out) - 1, -1, -1):
        q = out[at] = f[at + len(g) - 1]
        if q:
            for i, c in enumerate(g):
                f[at + i] -= q * c
    return None if any(f) else out


def _derived(f: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(f)][1:]


def common_divisor(f: list[int]) -> list[int]:
    """gcd(f, f') of a monic integer f, from gcds modulo primes: those of the least degree are
    put together until the result divides both."""
    best, parts = len(f), []
    for p in primes(40 * max(c.bit_length() for c in f) + 4096):
        g = _gcd_mod(f, _derived(f), p)
        if len(g) == 1:
            return [1]
        if len(g) < best:
            best, parts = len(g), []
        if len(g) == best:
            parts.append((p, g))
            if len(parts) & (len(parts) - 1) == 0:
                whole = remaindered(parts)
                if _divided(f, whole) is not None and _divided(_derived(f), whole) is not None:
                    return whole
    raise ArithmeticError("no common divisor found")


def _shifted(f: list[int], a: int) -> list[int]:
    """f(t + a)."""
    f = list(f)
    for i in range(len(f) - 1):
        for j in range(len(f) - 2, i - 1, -1):
            f[j] += a * f[j + 1]
    return f


def _above(f: list[int], a: int) -> int:
    """How many roots lie above a. All roots are real, so the sign changes of f(t + a) tell
    their number and not just a bound."""
    signs = [c > 0 for c in _shifted(f, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(f: list[int], t: int) -> int:
    out = 0
    for c in reversed(f):
        out = out * t + c
    return out


def top_roots(poly: list[int], count: int, bits: int) -> Iterator[tuple[int, int]]:
    """The largest positive roots of a monic real-rooted polynomial in falling order, as
    (floor(root * 2**bits), multiplicity), until ``count`` roots with multiplicity are out."""
    # scaled by 2**bits, so that all ends of intervals are integers
    levels, f = [], poly
    while len(f) > 1:
        g = common_divisor(f)
        levels.append([c << bits * (len(f) - len(g) - i) for i, c in enumerate(_divided(f, g))])
        f = g
    if not levels:
        return
    free = levels[0]
    # no root is above the sum of all, none of which is negative
    stack, done = [(0, max(-free[-2], 1), _above(free, 0), 0)], 0
    while stack and done < count:
        low, high, over_low, over_high = stack.pop()
        if over_low == over_high:
            continue
        if over_low - over_high > 1 and high - low > 1:
            mid = (low + high) // 2
            over_mid = _above(free, mid)
            stack += [(low, mid, over_low, over_mid), (mid, high, over_mid, over_high)]
            continue
        # one root in (low, high]: halve by the sign alone
        sign = _value(free, high) > 0
        if _value(free, high) == 0:
            low = high
        while high - low > 1:
            mid = (low + high) // 2
            at = _value(free, mid)
            if at == 0:
                low = high = mid
            elif (at > 0) == sign:
                high = mid
            else:
                low = mid
        times = sum(1 for level in levels if _value(level, low) == 0 or (_value(level, low) > 0) != (_value(level, low + 1) > 0))
        yield low, max(times, 1)
        done += max(times, 1)


def eigenvectors(matrix: np.ndarray, root: int, times: int, bits: int) -> np.ndarray:
    """``times`` orthonormal eigenvectors, as rows of doubles, of the eigenvalue root / 2**bits:
    the null space of matrix - root by inverse iteration, in integers of ``bits`` + fraction bits."""
    d = len(matrix)
    a = np.array([[int(v) << bits for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= root
    order = list(range(d))
    lower = np.zeros((d, d), object)
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r, k]))
        if i != k:
            a[[i, k]], lower[[i, k]] = a[[k, i]], lower[[k, i]]
            order[i], order[k] = order[k], order[i]
        if a[k, k] == 0:
            a[k, k] = 1  # an exact root: the least shift there is
        for r in range(k + 1, d):
            if a[r, k]:
                lower[r, k] = f = (a[r, k] << bits) // a[k, k]
                a[r, k:] -= (f * a[k, k:]) >> bits
    found: list[np.ndarray] = []
    for number in range(times):
        v = np.array([1 + (i + 1) * (number + 1) * 37 % 101 << bits for i in range(d)], object)
        for _ in range(3):
            for other in found:
                v = v - (other * int((v * other).sum() >> bits) >> bits)
            v = v[order]
            for i in range(1, d):
                v[i] -= int((lower[i, :i] * v[:i]).sum()) >> bits
            for i in range(d - 1, -1, -1):
                v[i] = ((int(v[i]) << bits) - int((a[i, i + 1 :] * v[i + 1 :]).sum())) // int(a[i, i])
            over = max(max(abs(int(x)).bit_length() for x in v), 1) - bits
            v = np.array([int(x) >> over if over > 0 else int(x) << -over for x in v], object)
            for other in found:
                v = v - (other * int((v * other).sum() >> bits) >> bits)
            norm = math.isqrt(int((v * v).sum()))
            v = np.array([(int(x) << bits) // norm for x in v], object)
        found.append(v)
    out = np.array([[int(x) / (1 << bits) for x in v] for v in found])
    return out / np.sqrt((out * out).sum(1, keepdims=True))
