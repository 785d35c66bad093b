"""Singular values and right vectors of a small matrix: Householder bidiagonals, dqds, twisted factors."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE = 1e-5
"""Squared singular values nearer than this, relatively, get their vectors together."""


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``w`` with ``r = u b w.T`` for some orthogonal ``u``."""
    n = r.shape[1]
    b = np.zeros((max(n, len(r)), n))  # rows of zeros change no product of columns
    b[: len(r)] = r
    w = np.eye(n)
    for k in range(n):
        v, beta = _reflector(b[k:, k])
        b[k:, k:] -= np.outer(beta * v, v @ b[k:, k:])
        if k < n - 2:
            v, beta = _reflector(b[k, k + 1 :])
            b[k:, k + 1 :] -= np.outer(b[k:, k + 1 :] @ v, beta * v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, beta * v)
    return np.diagonal(b).copy(), np.diagonal(b, 1).copy(), w


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``beta`` such that ``x - beta v (v.x)`` has only its first entry left."""
    scale = np.abs(x).max() if len(x) else 0.0
    v = np.array(x, float) if scale == 0 else x / scale
    length = np.sqrt(v @ v)
    if length == 0:
        return v, 0.0
    v[0] += np.copysign(length, v[0])
    return v, 2.0 / (v @ v)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal, falling; small ones as exact as large ones.

    Each sweep takes a shift off the squares and fails if it was above the least one;
    then half of it is tried, at last none, which never fails.
    """
    found: list[float] = []
    todo = [(np.square(np.asarray(diagonal, float)), np.square(np.asarray(upper, float)), 0.0)]
    while todo:
        q, e, taken = todo.pop()
        while len(q) > 1:
            cut = np.flatnonzero(e <= EPS * EPS * np.minimum(q[:-1], q[1:]))
            if len(cut):
                at = int(cut[-1]) + 1
                todo.append((q[:at], e[: at - 1], taken))
                q, e = q[at:], e[at:]
                continue
            if len(q) > 2 and q[0] < q[-1]:  # the small ones to the end, where shifts find them
                q, e = q[::-1].copy(), e[::-1].copy()
            if e[-1] <= EPS * EPS * (q[-1] + taken):
                found.append(q[-1] + taken)
                q, e = q[:-1], e[:-1]
                continue
            shift = _shift(q, e)
            while True:
                new = _sweep(q, e, shift)
                if new is not None:
                    break
                shift = shift / 2 if shift > EPS * q.min() else 0.0
            (q, e), taken = new, taken + shift
        if len(q):
            found.append(q[0] + taken)
    return np.sort(np.array(found))[::-1]


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A little less than the lesser eigenvalue of the last two rows."""
    above = e[-2] if len(q) > 2 else 0.0
    one, two, off = q[-2] + above, q[-1] + e[-1], q[-2] * e[-1]
    half, mid = (one - two) / 2, (one + two) / 2
    low = (q[-2] * q[-1] + above * two) / (mid + np.sqrt(half * half + off)) if mid > 0 else 0.0
    return max(0.0, min(low, q.min()) * (1 - 1e-9)) if np.isfinite(low) else 0.0


def _sweep(q: np.ndarray, e: np.ndarray, shift: float):
    """One differential quotient-difference step; None if the shift was too large."""
    n = len(q)
    out_q, out_e = np.empty(n), np.empty(n - 1)
    d = float(q[0]) - shift
    for i in range(n - 1):
        if d < 0:
            return None
        total = d + float(e[i])
        if total == 0:
            if shift:
                return None
            out_q[i], out_e[i], d = 0.0, 0.0, float(q[i + 1])
            continue
        ratio = float(q[i + 1]) / total
        out_q[i], out_e[i] = total, float(e[i]) * ratio
        d = d * ratio - shift
    if d < 0 or not np.isfinite(d):
        return None
    out_q[-1] = d
    return out_q, out_e


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal for each of ``squares``, as columns.

    The stationary and the progressive factorisation of ``b.T b - s`` meet where the twist is
    least, which gives the vector without a system to solve. Values too close for that
    share a subspace, in which solving steps and a small Rayleigh problem part them.
    """
    a, b = np.asarray(diagonal, float), np.asarray(upper, float)
    n, top = len(a), max(float(squares[0]), np.finfo(float).tiny)
    a = np.where(np.abs(a) < EPS * np.sqrt(top), EPS * np.sqrt(top), a)
    d, l = a * a, b / a[:-1]
    z = np.empty((n, len(squares)))
    at = 0
    while at < len(squares):
        to = at + 1
        while to < len(squares) and squares[to - 1] - squares[to] <= CLOSE * squares[to - 1]:
            to += 1
        z[:, at] = _twisted(d, l, float(squares[at]))
        if to - at > 1:
            z[:, at:to] = _together(a, b, squares[at:to], z[:, at])
        at = to
    return z


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> np.ndarray:
    n = len(d)
    tiny = np.finfo(float).tiny / EPS
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = d[i] + s[i] or tiny
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1] or tiny
        up[i] = d[i] * l[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    at = int(np.nanargmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _together(a, b, squares, first) -> np.ndarray:
    """Vectors of a close group: steps of inverse iteration on a subspace, then Rayleigh-Ritz."""
    n, k = len(a), len(squares)
    bi = np.diag(a) + np.diag(b, 1)
    t = bi.T @ bi
    shifted = t - (squares.mean() * (1 + 4 * EPS)) * np.eye(n)
    rng = np.random.default_rng(7)
    z = np.column_stack([first, rng.standard_normal((n, k - 1))])
    for _ in range(4):
        z, _ = np.linalg.qr(np.linalg.solve(shifted + EPS * squares[0] * np.eye(n), z))
    small = bi @ z
    values, turn = np.linalg.eigh(small.T @ small)
    return z @ turn[:, np.argsort(values)[::-1]]


def singular_directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and the right vectors as columns.

    The bidiagonal is cut where a superdiagonal entry is nothing beside its neighbours, so
    equal values of separate parts have separate vectors.
    """
    if not r.size:
        return np.empty(0), np.empty((r.shape[1], 0))
    a, b, w = bidiagonalise(r)
    n = len(a)
    size = max(np.abs(a).max(), np.abs(b).max() if n > 1 else 0.0)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * size) + 1).tolist(), n]
    values, vectors = [], []
    for low, high in zip(cuts[:-1], cuts[1:]):
        squares = dqds(a[low:high], b[low : high - 1])
        z = np.zeros((n, high - low))
        z[low:high] = right_vectors(a[low:high], b[low : high - 1], squares)
        values.append(squares)
        vectors.append(z)
    values, z = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")
    v = w @ z[:, order]
    return values[order], v / np.linalg.norm(v, axis=0)
