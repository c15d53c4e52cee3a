"""Singular values and right singular vectors of a small matrix, by bidiagonal qd arrays.

``bidiagonal`` reduces a square matrix by Householder reflections to an upper bidiagonal one. ``dqds`` finds
the squares of its singular values by differential quotient-difference sweeps with shifts, to high relative
accuracy, as they only add, multiply and divide positive numbers. ``twisted`` recovers a vector from the
factorisations of the shifted matrix from the top and from the bottom, joined where they meet best.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues that differ by less than this, relatively, have their vectors made orthogonal together.
CLUSTER = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and the right factor V, with r = U B V^T."""
    a = np.array(r, dtype=np.float64)
    n = a.shape[1]
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        w = x.copy()
        scale = np.abs(w).max(initial=0.0)
        if scale == 0 or not np.abs(w[1:]).max(initial=0.0):
            return None
        w /= scale
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = mirror(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < n:
            w = mirror(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step; the third list is d, positive throughout if the shift is below all eigenvalues."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for x, y in zip(e, q[1:]):
        top = d + x
        if top <= 0.0:
            return [], [], [-1.0]
        t = y / top
        new_q.append(top)
        new_e.append(x * t)
        d = d * t - shift
        ds.append(d)
    return [*new_q, d], new_e, ds


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B^T B, where B has the squares ``q`` on its diagonal and ``e`` beside it."""
    floor = 1e-40 * float(max(np.max(q, initial=0.0), np.max(e, initial=0.0)))
    stack, out = [([max(float(x), floor) for x in q], [float(x) for x in e], 0.0)], []
    while stack:
        q, e, sigma = stack.pop()
        for _ in range(100 * len(q) + 100):
            if len(q) == 1:
                out.append(q[0] + sigma)
                break
            small = [k for k, x in enumerate(e) if x <= EPS * EPS * (sigma + min(q[k], q[k + 1])) or x <= floor]
            if small:
                edges = [0, *(k + 1 for k in small), len(q)]
                stack += [(q[a:b], e[a : b - 1], sigma) for a, b in zip(edges, edges[1:])]
                break
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            plain = _sweep(q, e, 0.0)
            # the inverse's diagonal is 1 / d, so its trace bounds the smallest eigenvalue from below
            shift = 0.0 if min(plain[2]) <= 0 else (1 - 1e-10) / sum(1 / d for d in plain[2])
            if sigma + shift == sigma:
                q, e = [max(x, 0.0) for x in plain[0]], plain[1]
                continue
            step = _sweep(q, e, shift)
            while min(step[2]) < 0:
                shift = shift / 4 if shift > EPS * sigma else 0.0
                step = _sweep(q, e, shift)
            q, e, sigma = step[0], step[1], sigma + shift
        else:
            raise ArithmeticError("the qd sweeps do not converge")
    return np.sort(np.array(out))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of B^T B (diagonal ``a``, superdiagonal ``b`` of B) for an eigenvalue."""
    n, diagonal, low = len(a), a * a, b / a[:-1]
    tiny = EPS * EPS * float(diagonal.max())
    held = lambda x: x if abs(x) > tiny else tiny
    up, down = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, diagonal[-1] - value
    for k in range(n - 1):
        up[k] = diagonal[k] * low[k] / held(s[k] + diagonal[k])
        s[k + 1] = up[k] * low[k] * s[k] - value
    for k in range(n - 2, -1, -1):
        t = diagonal[k] / held(diagonal[k] * low[k] ** 2 + p[k + 1])
        down[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    gamma = np.abs(s + p + value)
    k = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _cluster(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors, as columns, of eigenvalues close to each other."""
    z = np.stack([twisted(a, b, x) for x in values], axis=1)
    if len(values) == 1:
        return z
    t = np.diag(a * a) + np.diag(np.append(0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    basis, left = np.linalg.qr(z)
    if np.abs(np.diag(left)).min() < 1e-8:  # vectors that came out alike
        basis = np.linalg.qr(z + 1e-3 * np.random.default_rng(0).standard_normal(z.shape))[0]
    for _ in range(4):
        inner, turn = np.linalg.eigh(basis.T @ t @ basis)
        basis = basis @ turn[:, ::-1]
        if np.linalg.norm(t @ basis - basis * inner[::-1]) <= 64 * EPS * np.abs(t).sum(1).max():
            break
        near = float(values.mean()) * (1 + 4 * EPS)
        basis = np.linalg.qr(np.linalg.solve(t - near * np.eye(len(t)), basis))[0]
    return basis


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of r^T r (all, if there are fewer), falling, and their unit vectors as columns.

    The entry of a vector that is largest by size is positive.
    """
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros(min(count, r.shape[1])), np.eye(r.shape[1])[:, :count]
    scale = 2.0 ** np.floor(np.log2(size))  # squares of the entries then neither overflow nor vanish
    a, b, v = bidiagonal(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * EPS * norm, EPS * EPS * norm, a)
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS * norm) + 1).tolist(), len(a)]
    found = []  # (eigenvalue, first row of its block, end of its block)
    for x, y in zip(edges, edges[1:]):
        found += [(value, x, y) for value in dqds(a[x:y] ** 2, b[x : y - 1] ** 2)]
    found.sort(key=lambda f: -f[0])
    wanted, columns, values = min(count, len(found)), [], []
    done: set[tuple[int, int]] = set()
    for k, (value, x, y) in enumerate(found[:wanted]):
        if (x, y, k) in done:
            continue
        own = [i for i, f in enumerate(found) if f[1:] == (x, y)]
        at = own.index(k)
        end = at + 1
        while end < len(own) and found[own[end - 1]][0] - found[own[end]][0] <= CLUSTER * found[own[end - 1]][0]:
            end += 1
        group = own[at:end]
        z = np.zeros((len(a), len(group)))
        z[x:y] = _cluster(a[x:y], b[x : y - 1], np.array([found[i][0] for i in group]))
        for i, column in zip(group, (v @ z).T):
            done.add((x, y, i))
            if i < wanted:
                columns.append(column * np.sign(column[np.argmax(np.abs(column))]))
                values.append(found[i][0])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale * scale, np.stack(columns, axis=1)[:, order]
