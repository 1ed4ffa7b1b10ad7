"""Eigendecompositions of symmetric matrices that follow rank-one changes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo("float64").eps
STEPS = 60


def _secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots x of 1 + sum(w / (d - x)), one right of each ascending pole d, for w > 0.

    Returned as the pole that each root lies nearest to and its distance from there, so that
    differences to poles keep their digits. Both neighbouring poles are fitted at each step
    (value and slope); a step that leaves the root's bracket is replaced by its middle.
    """
    k = len(d)
    width = np.append(np.diff(d), w.sum())
    poles = d[None, :] - d[:, None]
    at_middle = 1 + (w / (poles - width[:, None] / 2)).sum(axis=1)
    right = at_middle < 0
    right[-1] = False
    origin = np.arange(k) + right
    shifted = d[None, :] - d[origin][:, None]
    low = np.where(right, -width / 2, 0.0)
    high = np.where(right, 0.0, np.where(at_middle < 0, width, width / 2))
    if at_middle[-1] < 0:
        low[-1] = width[-1] / 2
    tau = (low + high) / 2
    left = np.tril(np.ones((k, k), dtype=bool))
    rows = np.arange(k)
    after = np.minimum(rows + 1, k - 1)
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            gap = shifted - tau[:, None]
            part = w / gap
            slope = part / gap
            below, above = np.where(left, part, 0.0).sum(axis=1), np.where(left, 0.0, part).sum(axis=1)
            below_slope, above_slope = np.where(left, slope, 0.0).sum(axis=1), np.where(left, 0.0, slope).sum(axis=1)
            value = 1 + below + above
            low, high = np.where(value < 0, tau, low), np.where(value > 0, tau, high)
            near, far = gap[rows, rows], gap[rows, after]
            c = 1 + below - below_slope * near + np.where(rows < k - 1, above - above_slope * far, 0.0)
            s, t = below_slope * near**2, above_slope * far**2
            a, b = c * (near + far) + s + t, near * far * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = near[-1] + s[-1] / c[-1]
            moved = tau + step
            moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
            small = np.abs(value) <= EPS * k * (1 + np.abs(below) + np.abs(above))
            moved = np.where(small, tau, moved)
            done = small | (np.abs(moved - tau) <= EPS * np.abs(moved))
            tau = moved
            if done.all():
                break
    return origin, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, weight: float):
    """Eigenvalues (ascending) and eigenvectors of Q diag(values) Q' + weight * change change'.

    `values` ascend, `vectors` holds Q's columns, weight >= 0. Deflation: equal eigenvalues
    are reflected so that the change touches one of them only, and directions that it does
    not touch keep their pair; the secular equation is solved for the rest.
    """
    z = vectors.T @ change
    norm = float(np.sqrt(z @ z))
    if not weight * norm > 0:
        return values, vectors
    scale = max(float(np.abs(values).max()), weight * norm * norm)
    tiny = 8 * EPS * scale
    close = np.diff(values) <= tiny
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        edges = np.flatnonzero(np.diff(np.concatenate(([False], close, [False])).astype("i1")))
        for a, b in zip(edges[::2], edges[1::2] + 1):
            run = z[a:b]
            length = float(np.sqrt(run @ run))
            mirror = run.copy()
            mirror[-1] += length if mirror[-1] >= 0 else -length
            size = float(mirror @ mirror)
            if size > 0:
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror) * (2 / size)
                z[a : b - 1], z[b - 1] = 0.0, -length if run[-1] >= 0 else length
    active = weight * norm * np.abs(z) > tiny
    if not active.any():
        return values, vectors
    d, zs = values[active], z[active]
    origin, tau = _secular_roots(d, weight * zs * zs)
    k = len(d)
    gap = (d[None, :] - d[origin][:, None]) - tau[:, None]  # pole j minus root i
    # the change of which the computed roots are the exact ones: orthogonal vectors follow
    i, j = np.indices((k, k))
    other = np.where(i < j, d[:, None] - d[None, :], np.append(d[1:], d[-1])[:, None] - d[None, :])
    other[-1] = 1.0
    fitted = np.sqrt(np.abs(np.prod(-gap / other, axis=0))) * np.where(zs < 0, -1.0, 1.0)
    turn = fitted[:, None] / gap.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[active] = d[origin] + tau
    new_vectors[:, active] = vectors[:, active] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter (sum of centred squares) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, row: np.ndarray) -> None:
        """One more vector: a rank-one change along its distance from the mean so far."""
        away = row - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """All vectors of `other`: a rank-one change for each of its eigenpairs and one for the
        distance between the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        both = self.n + other.n
        away = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / both * other.n)
        self.mean = self.mean + away * (other.n / both)
        self.n = both
