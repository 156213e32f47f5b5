"""Eigenpairs of a symmetric matrix in intervals, by contour integration (FEAST).

The integral of (z - A)^-1 Y over a circle around an interval is the projection of Y onto the
eigenvectors whose eigenvalues lie in it.  Gauss-Legendre points on the half circle stand for the integral: one
complex shifted solve each.  A Rayleigh-Ritz step on the projected vectors gives the pairs, and the projection is repeated
until they no longer improve.  Inertia counts, the signs of the pivots of A - s, say how many
eigenvalues lie above s: they cut the spectrum into intervals of few eigenvalues beforehand, and afterwards
they tell whether an interval has given all of its pairs.

The matrix is dims x dims, whatever the number of rows that it was summed from.
"""

from __future__ import annotations

import numpy as np

POINTS = 8  # of the half circle
WIDE = 8  # eigenvalues an interval should hold at most
REPEATS = 12
TOLERANCE = 1e-14  # of a residual, against the norm of the matrix


class Inertia:
    """Counts of eigenvalues above a shift: the signs of the pivots of A - shift, with A brought into three diagonals once."""

    def __init__(self, a: np.ndarray):
        a = np.array(a, float)
        n = len(a)
        for k in range(n - 2):
            x = a[k + 1:, k].copy()
            length = np.linalg.norm(x)
            if length == 0:
                continue
            x[0] += length if x[0] >= 0 else -length
            x /= np.linalg.norm(x)
            rest = a[k + 1:, k + 1:]
            turned = rest @ x
            turned -= (x @ turned) * x
            rest -= 2 * (np.outer(x, turned) + np.outer(turned, x))
            a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        self.main, self.beside = np.diag(a).tolist(), (np.diag(a, -1) ** 2).tolist()
        self.tiny = float(np.abs(a).max(initial=0)) * 1e-300 + 1e-300

    def above(self, shift: float) -> int:
        """How many eigenvalues are above ``shift``."""
        count, pivot = 0, 1.0
        for i, d in enumerate(self.main):
            pivot = d - shift - (self.beside[i - 1] / pivot if i else 0.0)
            if pivot == 0:
                pivot = -self.tiny
            count += pivot > 0
        return count


def intervals(counts: Inertia, low: float, high: float, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) from the top of (low, high) down, until ``wanted`` eigenvalues are covered.

    Parts with more than WIDE eigenvalues, or over several orders of magnitude, are cut, but not what is too narrow to be told apart.
    Equal eigenvalues stay together.
    """
    out, covered = [], 0
    open_parts = [(low, high, counts.above(low), counts.above(high))]
    while open_parts and covered < wanted:
        lo, hi, n_lo, n_hi = open_parts.pop()
        n = n_lo - n_hi
        if n <= 0:
            continue
        steep = 0 < 4 * lo < hi
        if not steep and (n <= WIDE or hi - lo <= 1e-11 * max(abs(low), abs(high))):
            out.append((lo, hi, n))
            covered += n
            continue
        cut = quiet_cut(counts, lo, hi, (np.sqrt(lo * hi) - lo) / (hi - lo) if steep else 0.5)
        n_cut = counts.above(cut)
        open_parts += [(lo, cut, n_lo, n_cut), (cut, hi, n_cut, n_hi)]  # the upper one is taken next
    return out


def quiet_cut(counts: Inertia, lo: float, hi: float, middle: float) -> float:
    """A place near the middle, given as a part of the width, with no eigenvalue close to it, so that no cluster is cut in two."""
    for times in (1.0, 0.9, 1.1, 0.8, 1.2, 0.7, 1.3, 0.6, 1.4):
        cut, room = lo + middle * times * (hi - lo), 0.02 * middle * (hi - lo)
        if counts.above(cut - room) == counts.above(cut + room):
            return cut
    return lo + middle * (hi - lo)


def project(a: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The contour integral over the circle around (low, high), applied to ``y``."""
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    out = np.zeros_like(y)
    for node, weight in zip(nodes, weights):
        turn = np.exp(1j * np.pi * (1 - node) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, y.astype(complex))
        out += weight / 2 * np.real(radius * turn * solved)
    return out


def inner_bounds(counts: Inertia, low: float, high: float) -> tuple[float, float]:
    """Where the eigenvalues of (low, high) begin and end, to a thousandth of its width, by inertia counts."""
    every, none = counts.above(low), counts.above(high)
    bottom, top, over, under = low, high, high, low
    for _ in range(10):
        cut = (bottom + over) / 2
        bottom, over = (cut, over) if counts.above(cut) == every else (bottom, cut)
        cut = (top + under) / 2
        top, under = (cut, under) if counts.above(cut) == none else (top, cut)
    return bottom, top


def pairs_in(a: np.ndarray, counts: Inertia, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenvalues of (low, high), falling, and their unit vectors; an error if some can't be found."""
    norm, dims = np.abs(a).sum(axis=0).max(), len(a)
    bottom, top = inner_bounds(counts, low, high)
    # The circle is drawn close around the eigenvalues and half-way to the ends of the interval, so that what lies beyond is damped.
    room = max(min(bottom - low, high - top) / 2, 0.05 * (top - bottom), 1e-9 * norm)
    held = counts.above(bottom - room) - counts.above(top + room)  # by the circle, with neighbours that are close
    y = np.random.default_rng(7).standard_normal((dims, min(dims, held + held // 2 + 3)))
    best = None
    for _ in range(REPEATS):
        q, _ = np.linalg.qr(project(a, y, bottom - room, top + room))
        values, turn = np.linalg.eigh(q.T @ a @ q)
        vectors = q @ turn
        away = np.linalg.norm(a @ vectors - vectors * values, axis=0)
        inside = np.flatnonzero((values > low) & (values <= high))
        if len(inside) > n:  # a vector that is no eigenvector may have its quotient here
            inside = inside[np.argsort(away[inside])[:n]]
        if len(inside) == n:
            worst = away[inside].max(initial=0)
            if best is None or worst < best[0]:
                best = worst, values[inside], vectors[:, inside]
            if worst <= TOLERANCE * norm:
                break
        y = vectors
    if best is None or best[0] > 1e-11 * norm:
        raise ArithmeticError(f"{n} eigenvalues lie between {low} and {high}, but they weren't all found")
    order = np.argsort(-best[1], kind="stable")
    return best[1][order], best[2][:, order]


def leading_pairs(a: np.ndarray, wanted: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above ``least``, falling, and their unit vectors in columns; fewer if there are fewer."""
    dims, counts = len(a), Inertia(a)
    top = float(np.abs(a).sum(axis=0).max(initial=0)) * 1.01 + 1e-300  # above every eigenvalue
    values, vectors = [], []
    for low, high, n in intervals(counts, least, top, wanted):
        own, directions = pairs_in(a, counts, low, high, n)
        values.append(own)
        vectors.append(directions)
    if not values:
        return np.empty(0), np.empty((dims, 0))
    e, v = np.concatenate(values)[:wanted], np.concatenate(vectors, axis=1)[:, :wanted]
    if len(e) != min(wanted, counts.above(least)):
        raise ArithmeticError("Inertia counts and eigenvalues don't agree")
    q, r = np.linalg.qr(v)  # vectors of different intervals are at right angles to rounding; this removes the rounding
    return e, q * np.sign(np.diag(r))
