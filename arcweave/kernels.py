"""Graph kernels on arrays of one graph; numpy only, so that any worker can run them."""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass
class CSR:
    """Out-neighbours of vertex i: dst[start[i]:start[i + 1]], ascending, with their lengths."""

    start: np.ndarray
    dst: np.ndarray
    length: np.ndarray | None = None

    @staticmethod
    def of(n: int, src: np.ndarray, dst: np.ndarray, length: np.ndarray | None = None) -> CSR:
        order = np.lexsort((dst, src))
        return CSR(np.searchsorted(src[order], np.arange(n + 1)), dst[order].astype(np.int64), None if length is None else length[order].astype(float))

    @property
    def n(self) -> int:
        return len(self.start) - 1


def bfs(g: CSR, s: int):
    """dist, sigma, levels (arrays of vertices by distance) from s, level by level."""
    dist, sigma = np.full(g.n, -1, np.int64), np.zeros(g.n)
    dist[s], sigma[s] = 0, 1
    levels, front = [np.array([s])], np.array([s])
    while len(front):
        counts = g.start[front + 1] - g.start[front]
        total = counts.sum()
        if not total:
            break
        at = np.repeat(g.start[front] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        heads, from_ = g.dst[at], np.repeat(front, counts)
        new = dist[heads] < 0
        fresh = np.unique(heads[new])
        dist[fresh] = len(levels)
        on = dist[heads] == len(levels)
        np.add.at(sigma, heads[on], sigma[from_[on]])
        if len(fresh):
            levels.append(fresh)
        front = fresh
    return dist, sigma, levels


def dijkstra(g: CSR, s: int, tol: float = 1e-12):
    """dist (inf where none), sigma, order of settling; lengths are positive."""
    dist, sigma, done, order = np.full(g.n, np.inf), np.zeros(g.n), np.zeros(g.n, bool), []
    dist[s], sigma[s] = 0, 1
    heap = [(0.0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for e in range(g.start[v], g.start[v + 1]):
            w, x = int(g.dst[e]), d + g.length[e]
            if done[w]:
                continue
            if x < dist[w] - tol:
                dist[w], sigma[w] = x, sigma[v]
                heapq.heappush(heap, (x, w))
            elif abs(x - dist[w]) <= tol:
                sigma[w] += sigma[v]
    return dist, sigma, order


def paths_from(g: CSR, s: int):
    """(vertices in order of distance, their distances, their numbers of shortest paths)."""
    if g.length is None:
        dist, sigma, levels = bfs(g, s)
        v = np.concatenate(levels)
        return v, dist[v].astype(float), sigma[v]
    dist, sigma, order = dijkstra(g, s)
    v = np.array(order)
    return v, dist[v], sigma[v]


MODES = ("standard", "endpoints", "proximalsrc", "proximaltar", "proximalsum", "lengthscaled", "linearscaled", "stress", "load")


def accumulate(g: CSR, sources, mode: str) -> np.ndarray:
    """Score of each vertex, summed over sources: dependencies flow back along shortest paths."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    score = np.zeros(g.n)
    weight = g.length if g.length is not None else np.ones(len(g.dst))
    tail = np.repeat(np.arange(g.n), np.diff(g.start))
    for s in sources:
        order, d, sig = paths_from(g, int(s))
        dist, sigma = np.full(g.n, np.inf), np.zeros(g.n)
        dist[order], sigma[order] = d, sig
        with np.errstate(invalid="ignore"):
            on = np.abs(dist[tail] + weight - dist[g.dst]) <= 1e-12
        p, v = tail[on], g.dst[on]
        delta = np.ones(g.n) if mode == "load" else np.zeros(g.n)
        many = np.bincount(v, minlength=g.n)
        by = np.argsort(v, kind="stable")
        first = np.searchsorted(v[by], np.arange(g.n + 1))
        if mode == "endpoints":
            score[s] += len(order) - 1
        for x in order[::-1].tolist():
            before = p[by[first[x] : first[x + 1]]]
            r = sigma[before] / sigma[x]
            if mode == "load":
                np.add.at(delta, before, delta[x] / max(1, many[x]))
                score[x] += delta[x]
                continue
            if mode == "stress":
                delta[before] += 1 + delta[x]
            elif mode in ("lengthscaled", "linearscaled"):
                if x != s:
                    delta[before] += r * (1 / dist[x] + delta[x])
            elif mode != "proximalsrc":
                delta[before] += r * (1 + delta[x])
            far = before != s
            if mode in ("proximalsrc", "proximalsum"):
                score[before[far]] += r[far]
            if mode in ("proximaltar", "proximalsum") and not far.all():
                score[x] += delta[x]
            if x != s:
                if mode in ("standard", "lengthscaled"):
                    score[x] += delta[x]
                elif mode == "endpoints":
                    score[x] += delta[x] + 1
                elif mode == "linearscaled":
                    score[x] += dist[x] * delta[x]
                elif mode == "stress":
                    score[x] += sigma[x] * delta[x]
    return score


# Components ----------------------------------------------------------------------------


def first_labels(raw: np.ndarray) -> np.ndarray:
    """Labels renumbered in the order of their first vertex."""
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def reach(a: np.ndarray) -> np.ndarray:
    """Reflexive reachability of a boolean matrix, by squaring."""
    r = a | np.eye(len(a), dtype=bool)
    while True:
        two = (r.astype(np.float32) @ r.astype(np.float32)) > 0
        if (two == r).all():
            return r
        r = two


def weak_components(a: np.ndarray) -> np.ndarray:
    n, seen, label = len(a), np.full(len(a), -1), 0
    both = a | a.T
    for s in range(n):
        if seen[s] < 0:
            seen[s] = label
            queue = deque([s])
            while queue:
                for w in np.flatnonzero(both[queue.popleft()] & (seen < 0)):
                    seen[w] = label
                    queue.append(w)
            label += 1
    return seen


def strong_components(a: np.ndarray) -> np.ndarray:
    r = reach(a)
    both = r & r.T
    return first_labels(both.argmax(axis=1)) if len(a) else np.empty(0, int)


def component_labels(a: np.ndarray, connected: str) -> np.ndarray:
    if connected == "weak":
        return weak_components(a)
    if connected == "strong":
        return strong_components(a)
    r = reach(a)
    if connected == "recursive":  # tied both ways
        return weak_components(a & a.T)
    if connected == "unilateral":
        either = r | r.T
        label = np.full(len(a), -1)
        for v in range(len(a)):  # a vertex joins the first group all of whose members it reaches or is reached from
            for k in range(label.max(initial=-1) + 1):
                if either[v, label == k].all():
                    label[v] = k
                    break
            else:
                label[v] = label.max(initial=-1) + 1
        return label
    raise ValueError(f"unknown connection {connected}")


def biconnected(a: np.ndarray) -> tuple[list[list[int]], set[int]]:
    """Biconnected components (vertex lists) and articulation points of an undirected graph, without recursion."""
    n = len(a)
    near = [np.flatnonzero(a[i] & (np.arange(n) != i)).tolist() for i in range(n)]
    depth, low = [-1] * n, [0] * n
    comps, cuts, edges = [], set(), []
    for root in range(n):
        if depth[root] >= 0:
            continue
        depth[root] = low[root] = 0
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if depth[w] < 0:
                    edges.append((v, w))
                    depth[w] = low[w] = depth[v] + 1
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent and depth[w] < depth[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], depth[w])
            else:
                stack.pop()
                if parent < 0:
                    continue
                low[parent] = min(low[parent], low[v])
                if low[v] >= depth[parent]:
                    members: set[int] = set()
                    while True:
                        e = edges.pop()
                        members.update(e)
                        if e == (parent, v):
                            break
                    comps.append(sorted(members))
                    if parent != root:
                        cuts.add(parent)
                    else:
                        children += 1
                        if children > 1:
                            cuts.add(root)
    return comps, cuts


def core_numbers(out_w: np.ndarray, cmode: str) -> np.ndarray:
    """Peel the vertex of the least in, out or total value; its core is the running maximum."""
    w = out_w.copy()
    n = len(w)
    left, core, top = np.ones(n, bool), np.zeros(n), -np.inf
    for _ in range(n):
        stat = {"indegree": w.sum(0), "outdegree": w.sum(1), "freeman": w.sum(0) + w.sum(1) - w.diagonal()}[cmode]
        v = int(np.argmin(np.where(left, stat, np.inf)))
        top = max(top, stat[v])
        core[v], left[v] = top, False
        w[v], w[:, v] = 0, 0
    return core


# Flow ------------------------------------------------------------------------------------


def max_flow(capacity: np.ndarray, s: int, t: int) -> float:
    """Edmonds-Karp on a dense residual matrix."""
    if s == t:
        return float("inf")
    c, total = capacity.copy(), 0.0
    while True:
        parent = np.full(len(c), -1)
        parent[s] = s
        queue = deque([s])
        while queue and parent[t] < 0:
            v = queue.popleft()
            for w in np.flatnonzero((c[v] > 1e-12) & (parent < 0)):
                parent[w] = v
                queue.append(w)
        if parent[t] < 0:
            return total
        step, v = np.inf, t
        while v != s:
            step = min(step, c[parent[v], v])
            v = parent[v]
        v = t
        while v != s:
            c[parent[v], v] -= step
            c[v, parent[v]] += step
            v = parent[v]
        total += step


# Enumerations ------------------------------------------------------------------------------


def cliques_from(a: np.ndarray, rank: np.ndarray, seed: int) -> list[tuple[int, ...]]:
    """Maximal cliques whose first vertex in the given order is ``seed`` (pivoting on the largest degree)."""
    near = [set(np.flatnonzero(r).tolist()) for r in a]
    out: list[tuple[int, ...]] = []
    later = {w for w in near[seed] if rank[w] > rank[seed]}
    stack = [((seed,), later, near[seed] - later)]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(tuple(sorted(r)))
            continue
        pivot = max(p | x, key=lambda v: len(near[v] & p))
        for v in sorted(p - near[pivot]):
            stack.append(((*r, v), p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return out


def degeneracy_rank(a: np.ndarray) -> np.ndarray:
    d, left, rank = a.sum(1).astype(float), np.ones(len(a), bool), np.zeros(len(a), int)
    for i in range(len(a)):
        v = int(np.argmin(np.where(left, d, np.inf)))
        rank[v], left[v] = i, False
        d -= a[v]
    return rank


def simple_paths(a: np.ndarray, start: int, longest: int, directed: bool) -> list[tuple[int, ...]]:
    """Simple paths of 1 to ``longest`` ties from start; undirected ones once, from their smaller end."""
    near = [np.flatnonzero(r & (np.arange(len(a)) != i)).tolist() for i, r in enumerate(a)]
    out, stack = [], [(start,)]
    while stack:
        p = stack.pop()
        if len(p) > 1 and (directed or p[0] < p[-1]):
            out.append(p)
        if len(p) <= longest:
            stack += [(*p, w) for w in near[p[-1]] if w not in p]
    return out


def simple_cycles(a: np.ndarray, start: int, longest: int, directed: bool) -> list[tuple[int, ...]]:
    """Simple cycles of up to ``longest`` ties whose least vertex is start; undirected ones once."""
    near = [[w for w in np.flatnonzero(r).tolist() if w >= start] for r in a]
    out, stack = [], [(start,)]
    while stack:
        p = stack.pop()
        for w in near[p[-1]]:
            if w == start and len(p) >= (2 if directed else 3) and (directed or p[1] < p[-1]):
                out.append(p)
            elif w > start and w not in p and len(p) < longest:
                stack.append((*p, w))
    return out


def label_propagation(w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """In-order sweeps: a vertex takes the label with the greatest sum of max(w_ij, w_ji); ties to the smaller label."""
    n = len(w)
    both = np.maximum(w, w.T)
    np.fill_diagonal(both, 0)
    label = np.arange(n)
    for _ in range(rounds):
        moved = False
        for v in range(n):
            near = np.flatnonzero(both[v] > 0)
            if not len(near):
                continue
            total = np.bincount(label[near], both[v, near], n)
            best = int(np.argmax(total))
            if best != label[v]:
                label[v], moved = best, True
        if not moved:
            break
    return first_labels(label)
