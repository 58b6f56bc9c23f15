"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST), in numpy.

The matrix is as wide as the vectors it comes from, never as long as a table. Inertia, the number of
eigenvalues below a point, is read off the LDL' factors of the shifted matrix in tridiagonal form. It
cuts the axis into intervals of few eigenvalues each, at points in the widest gaps near the middle, and says
how many eigenpairs each interval must give. In an interval, quadrature over a circle of complex shifted
solves filters a random subspace, and Rayleigh-Ritz takes the eigenpairs from it; this is repeated until as
many have converged as the inertia asks for, with a larger subspace where that takes too long.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Eigenvalues of one interval, unless they are too close to be parted.
MOST = 8
NODES = 8
PASSES = 12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = -np.copysign(np.sqrt(x @ x), x[0])
        if not size:
            continue
        x[0] -= size
        x /= np.sqrt(x @ x)
        p = a[k + 1 :, k + 1 :] @ x
        p -= (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1, k] = size
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts the eigenvalues of a symmetric matrix below given points."""

    def __init__(self, a: np.ndarray):
        self.diagonal, self.off = tridiagonal(a)
        around = np.zeros(len(a))
        around[:-1] += abs(self.off)
        around[1:] += abs(self.off)
        self.low, self.high = float((self.diagonal - around).min()), float((self.diagonal + around).max())
        # Eigenvalues nearer than this can't be told apart.
        self.least = 4 * EPS * len(a) * max(abs(self.low), abs(self.high))

    def below(self, points: np.ndarray) -> np.ndarray:
        """For each point, the negative pivots of the LDL' factors of the matrix less the point."""
        points = np.asarray(points, float)
        count, pivot = np.zeros(points.shape, np.int64), np.ones_like(points)
        tiny = max(self.least, np.finfo(float).tiny) * EPS
        for k, d in enumerate(self.diagonal):
            pivot = d - points - (self.off[k - 1] ** 2 / pivot if k else 0.0)
            pivot = np.where(abs(pivot) < tiny, -tiny, pivot)
            count += pivot < 0
        return count

    def cut(self, low: float, high: float) -> float:
        """A point in the middle part of an interval that lies in a gap as wide as can be found."""
        points = low + (high - low) * np.linspace(0.3, 0.7, 33)
        for width in (high - low) * 0.5 ** np.arange(3, 40):
            free = self.below(points + width / 2) == self.below(points - width / 2)
            if free.any():
                return float(points[free][np.argmin(abs(points[free] - (low + high) / 2))])
        return (low + high) / 2

    def intervals(self, wanted: int) -> list[tuple[float, float, int]]:
        """(low, high, eigenvalues) that together hold at least the ``wanted`` largest ones above rounding."""
        n, high = len(self.diagonal), self.high + self.least
        low = max(self.least, self.low - self.least)
        if high <= low:
            return []
        wanted = min(wanted, n - int(self.below(low)))
        if wanted <= 0:
            return []
        # The lowest of them starts above a point with as few more as possible.
        top = high
        while n - int(self.below(low)) > wanted and top - low > self.least:
            middle = (low + top) / 2
            if n - int(self.below(middle)) >= wanted:
                low = middle
            else:
                top = middle
        out, todo = [], [(low, high)]
        while todo:
            a, b = todo.pop()
            held = int(self.below(b) - self.below(a))
            if held > MOST and b - a > 16 * self.least:
                middle = self.cut(a, b)
                todo += [(a, middle), (middle, b)]
            elif held:
                out.append((a, b, held))
        return sorted(out, reverse=True)


def ritz(a: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values and vectors of the matrix within a space."""
    basis, _ = np.linalg.qr(space)
    values, inner = np.linalg.eigh(basis.T @ a @ basis)
    return values, basis @ inner


def eigenpairs(a: np.ndarray, low: float, high: float, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``held`` eigenpairs in an interval, falling, as (values, vectors in columns)."""
    n, size = len(a), float(abs(a).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    around = radius * np.exp(-0.5j * np.pi * (at - 1))
    random = np.random.default_rng(held)
    many = min(n, held + max(held, 8))
    while True:
        space = random.standard_normal((n, many))
        for _ in range(PASSES):
            filtered = np.zeros_like(space)
            for w, z in zip(weight, around):
                filtered += (w / 2) * (z * np.linalg.solve((centre + z) * np.eye(n) - a, space)).real
            # With as many vectors as the matrix is wide there is nothing to filter out.
            values, space = ritz(a, filtered if many < n else space)
            rest = np.sqrt(((a @ space - space * values) ** 2).sum(axis=0))
            good = np.flatnonzero((values > low) & (values <= high) & (rest <= 64 * EPS * size))
            if len(good) == held:
                return values[good][::-1], space[:, good][:, ::-1]
            if many == n:
                # The interval's ends are as exact as the inertia, so its values are counted from the top.
                above = np.flatnonzero(values > high + 64 * EPS * size)
                last = n - len(above)
                return values[last - held : last][::-1], space[:, last - held : last][:, ::-1]
        many = min(n, 2 * many)
