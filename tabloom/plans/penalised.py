"""More linear models from second moments alone: groups, fused weights, a concave penalty, equiangular paths, relevance, partial least squares.

No function here reads rows: each takes the Gram of one pass.
"""

from __future__ import annotations

import numpy as np

from .gram import Gram, Linear, _model

#: Sweeps or steps after which an iteration ends anyway.
ROUNDS = 20_000


def _soft(x, by):
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def sparse_group_lasso(g: Gram, alpha: float, l1_ratio: float = 0.5, group_size: int = 2, tolerance: float = 1e-11) -> Linear:
    """(1/2n) |e|^2 + alpha (r |w|_1 + (1 - r) sum over groups of sqrt(size) |w_group|), groups of neighbouring features, the last may be smaller.

    Descent by groups: inside a group proximal steps of the length its own second moments allow.
    """
    if group_size < 1 or not 0 <= l1_ratio <= 1:
        raise ValueError("group_size must be at least 1 and l1_ratio from 0 to 1")
    xx, xy, p = g.xx / g.n, g.xy / g.n, len(g.xy)
    groups = [np.arange(i, min(i + group_size, p)) for i in range(0, p, group_size)]
    steep = [float(np.linalg.eigvalsh(xx[np.ix_(b, b)])[-1]) for b in groups]
    w = np.zeros(p)
    for _ in range(ROUNDS):
        before = w.copy()
        for b, top in zip(groups, steep, strict=True):
            if top <= 0:
                continue
            # What the other groups leave to explain.
            rest = xy[b] - xx[b] @ w + xx[np.ix_(b, b)] @ w[b]
            own = xx[np.ix_(b, b)]
            for _ in range(1000):
                old = w[b]
                z = _soft(old + (rest - own @ old) / top, alpha * l1_ratio / top)
                size, by = np.linalg.norm(z), alpha * (1 - l1_ratio) * len(b) ** 0.5 / top
                w[b] = z * max(0.0, 1 - by / size) if size else 0.0
                if np.abs(w[b] - old).max() <= tolerance * (1e-300 + np.abs(w[b]).max()):
                    break
        if np.abs(w - before).max() <= tolerance * (1e-300 + np.abs(w).max()):
            break
    return _model(g, w)


def group_lasso(g: Gram, alpha: float, group_size: int = 2) -> Linear:
    return sparse_group_lasso(g, alpha, 0.0, group_size)


def fused_lasso(g: Gram, alpha: float, fusion: float, tolerance: float = 1e-11) -> Linear:
    """(1/2n) |e|^2 + alpha |w|_1 + fusion |differences of neighbouring weights|_1, by alternating directions.

    Weights and differences are copies that the splitting keeps equal to w and D w; entries that the copies hold at 0 or equal are so in the result.
    """
    xx, xy, p = g.xx / g.n, g.xy / g.n, len(g.xy)
    d = np.vstack([np.eye(p), np.diff(np.eye(p), axis=0)])
    limit = np.concatenate([np.full(p, alpha), np.full(p - 1, fusion)])
    pull = float(np.mean(np.diag(xx))) or 1.0
    inverse = np.linalg.inv(xx + pull * d.T @ d)
    z, u = np.zeros(2 * p - 1), np.zeros(2 * p - 1)
    for _ in range(ROUNDS):
        w = inverse @ (xy + pull * d.T @ (z - u))
        old, z = z, _soft(d @ w + u, limit / pull)
        u = u + d @ w - z
        if max(np.abs(d @ w - z).max(), np.abs(z - old).max()) <= tolerance * (1e-300 + np.abs(z).max()):
            break
    # Least squares over the pattern that the copies settled on: runs of equal weights, with their signs, zeros at 0.
    runs = np.concatenate([[0], np.cumsum(z[p:] != 0)]).astype(int)
    free = [r for r in range(runs[-1] + 1) if np.all(z[:p][runs == r] != 0)]
    if free:
        at = np.array([runs == r for r in free], float).T
        slope = alpha * np.sign(z[:p]) + fusion * (np.diff(np.eye(p), axis=0).T @ np.sign(z[p:]))
        exact = at @ np.linalg.lstsq(at.T @ xx @ at, at.T @ (xy - slope), rcond=None)[0]
        loss = lambda v: v @ xx @ v / 2 - v @ xy + alpha * np.abs(v).sum() + fusion * np.abs(np.diff(v)).sum()
        w = exact if loss(exact) <= loss(w) + 1e-12 * abs(loss(w)) else w
    elif not np.any(z[:p]):
        w = np.zeros(p)
    return _model(g, w)


def scad(g: Gram, alpha: float, gamma: float = 3.7, rounds: int = ROUNDS) -> Linear:
    """(1/2n) |e|^2 + the smoothly clipped penalty: alpha |w| up to alpha, flat beyond gamma alpha; coordinate descent from the lasso's side.

    Each coordinate takes the best of the minima of the three pieces, so that features of any scale are allowed.
    """
    if gamma <= 2:
        raise ValueError("gamma must be above 2")
    xx, xy = g.xx / g.n, g.xy / g.n
    w = np.zeros(len(xy))

    def penalty(x):
        if x <= alpha:
            return alpha * x
        return (2 * gamma * alpha * x - x * x - alpha**2) / (2 * (gamma - 1)) if x <= gamma * alpha else alpha**2 * (gamma + 1) / 2

    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            c, rho = xx[j, j], xy[j] - xx[j] @ w + xx[j, j] * w[j]
            if c <= 0:
                continue
            r, bend = abs(rho), c - 1 / (gamma - 1)
            found = [min(max(r - alpha, 0.0) / c, alpha), alpha, gamma * alpha, max(r / c, gamma * alpha)]
            if bend > 0:
                found.append(min(max((r - gamma * alpha / (gamma - 1)) / bend, alpha), gamma * alpha))
            w[j] = np.sign(rho) * min(found, key=lambda x: (c * x * x / 2 - r * x + penalty(x), x))
        if np.abs(w - before).max() <= 1e-12 * max(1.0, np.abs(w).max()):
            break
    return _model(g, w)


def equiangular_path(g: Gram, lasso: bool = False) -> list[tuple[float, np.ndarray]]:
    """(alpha, weights) at every turn: all chosen features keep the same covariance n alpha with the residual, no other has more.

    lasso: a feature whose weight reaches 0 leaves again, which makes the turns those of (1/2n) |e|^2 + alpha |w|_1. Features
    that depend linearly on chosen ones do not enter.
    """
    xx, xy, p = g.xx, g.xy, len(g.xy)
    w, chosen, barred = np.zeros(p), [], set()
    level = float(np.abs(xy).max(initial=0.0))
    out, dropped, first = [(level / g.n, w.copy())], None, level
    for _ in range(8 * p):
        if level <= 1e-12 * first:
            break
        c = xy - xx @ w
        rest = [j for j in range(p) if j not in chosen and j not in barred and j != dropped]
        entering = [j for j in rest if abs(c[j]) >= level * (1 - 1e-10)]
        for j in entering:
            trial = [*chosen, j]
            ratio = xx[np.ix_(trial, trial)]
            scale = np.sqrt(np.diag(ratio))
            if not scale.all() or np.linalg.cond(ratio / np.outer(scale, scale)) > 1e10:
                barred.add(j)
            else:
                chosen = trial
        if not chosen:
            break
        sign = np.sign(c[chosen])
        way = np.linalg.solve(xx[np.ix_(chosen, chosen)], sign)
        turn, step, leaving = xx[:, chosen] @ way, level, None
        for j in range(p):
            if j in chosen or j in barred:
                continue
            for a, b in ((level - c[j], 1 - turn[j]), (level + c[j], 1 + turn[j])):
                # The feature that has just left is at the level already and moves away from it.
                if b > 1e-12 and 1e-12 * first < a / b < step and not (j == dropped and a / b < 1e-9 * level):
                    step = a / b
        if lasso:
            for i, j in enumerate(chosen):
                if w[j] * way[i] < 0 and -w[j] / way[i] < step:
                    step, leaving = -w[j] / way[i], j
        w[chosen] += step * way
        level -= step
        dropped = leaving
        if leaving is not None:
            w[leaving] = 0.0
            chosen.remove(leaving)
        out.append((max(level, 0.0) / g.n, w.copy()))
    return out


def lars(g: Gram, size: int) -> Linear:
    """The equiangular path up to the turn where a further feature than size would enter."""
    fitting = [w for _, w in equiangular_path(g) if np.count_nonzero(w) <= size]
    return _model(g, fitting[-1])


def lasso_lars(g: Gram, alpha: float) -> Linear:
    """The lasso at alpha, from its piecewise linear path."""
    turns = equiangular_path(g, lasso=True)
    if alpha >= turns[0][0]:
        return _model(g, np.zeros(len(g.xy)))
    for (a, v), (b, w) in zip(turns, turns[1:], strict=False):
        if b <= alpha:
            return _model(g, w if a == b else v + (a - alpha) / (a - b) * (w - v))
    return _model(g, turns[-1][1])


def ard(g: Gram, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6, most: float = 1e4) -> Linear:
    """Evidence maximisation with a precision for each weight; weights whose precision passes ``most`` are 0 for good."""
    p, w = len(g.xy), np.zeros(len(g.xy))
    precision, noise, live = np.ones(p), g.n / max(g.yy, 1e-300), np.ones(p, bool)
    for _ in range(rounds):
        old, w = w, np.zeros(p)
        spread = np.linalg.inv(np.diag(precision[live]) + noise * g.xx[np.ix_(live, live)])
        w[live] = noise * spread @ g.xy[live]
        rss = max(g.yy - 2 * w @ g.xy + w @ g.xx @ w, 0.0)
        used = 1 - precision[live] * np.diag(spread)
        precision[live] = (used + 2 * prior) / (w[live] ** 2 + 2 * prior)
        noise = (g.n - used.sum() + 2 * prior) / (rss + 2 * prior)
        live = live & (precision < most)
        w[~live] = 0.0
        if not live.any() or np.abs(w - old).sum() < tolerance:
            break
    if live.any():
        # The weights that belong to the last precisions.
        w = np.zeros(p)
        w[live] = noise * np.linalg.solve(np.diag(precision[live]) + noise * g.xx[np.ix_(live, live)], g.xy[live])
    return _model(g, w)


def pls(g: Gram, k: int, scale: bool = True) -> Linear:
    """Regression on k partial-least-squares components (of standardised features): each the direction of greatest covariance with what is left of the label."""
    if not 1 <= k <= len(g.xy):
        raise ValueError(f"k must be from 1 to {len(g.xy)}")
    size = np.sqrt(np.diag(g.xx) / max(g.n - 1, 1)) if scale else np.ones(len(g.xy))
    size = np.where(size > 0, size, 1.0)
    xx, xy = g.xx / np.outer(size, size), g.xy / size
    ways, loads, shares = [], [], []
    for _ in range(k):
        norm = np.linalg.norm(xy)
        if norm <= 1e-12 * np.linalg.norm(g.xy / size):
            break
        way = xy / norm
        power = way @ xx @ way
        if power <= 0:
            break
        load, share = xx @ way / power, way @ xy / power
        xx, xy = xx - power * np.outer(load, load), xy - power * share * load
        ways.append(way), loads.append(load), shares.append(share)
    if not ways:
        return _model(g, np.zeros(len(g.xy)))
    w, p = np.array(ways).T, np.array(loads).T
    return _model(g, w @ np.linalg.solve(p.T @ w, np.array(shares)) / size)
