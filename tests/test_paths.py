"""Geodesics, path centralities, components, cohesion, spectral measures."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from arcweave import kernels as K
from arcweave.graph import Graph
from arcweave.operators import connectivity as C
from arcweave.operators import paths as P
from arcweave.operators import spectral as S
from test_graph import random_matrix

PATH4 = [[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0]]
STAR = [[0, 1, 1, 1], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]


def vec(df, name):
    return [r[name] for r in df.orderBy("vid").collect()]


def shortest(a):
    """(distance, number of shortest paths) by enumeration of walks."""
    n = len(a)
    d, s, w = np.full((n, n), np.inf), np.zeros((n, n)), np.eye(n)
    for k in range(n):
        new = (w > 0) & np.isinf(d)
        d[new], s[new] = k, w[new]
        w = w @ a
    return d, s


@pytest.mark.parametrize("seed", range(6))
def test_paths_and_betweenness(spark, seed):
    m = random_matrix(seed, 8, 0.3)
    a = (m > 0).astype(float)
    g = Graph.from_matrix(spark, m.tolist())
    d, s = shortest(a)
    got = {(r["src"], r["dst"]): (r["dist"], r["sigma"]) for r in P.geodist(g).collect()}
    assert got == {(i, j): (d[i, j], s[i, j]) for i in range(8) for j in range(8) if np.isfinite(d[i, j])}
    weighted = {(r["src"], r["dst"]): r["dist"] for r in P.geodist(g, ignore_eval=False).collect()}
    f = np.where(m > 0, m, np.inf)
    np.fill_diagonal(f, 0)
    for k in range(8):
        f = np.minimum(f, f[:, [k]] + f[[k]])
    assert weighted == {(i, j): f[i, j] for i in range(8) for j in range(8) if np.isfinite(f[i, j])}

    def pairs(fn, ends=False):
        out = np.zeros(8)
        for x, y in itertools.permutations(range(8), 2):
            for v in range(8):
                if np.isfinite(d[x, y]) and d[x, v] + d[v, y] == d[x, y] and (ends or v not in (x, y)):
                    out[v] += fn(x, y, v, s[x, v] * s[v, y] / s[x, y])
        return out

    want = {
        "directed": pairs(lambda x, y, v, p: p),
        "endpoints": pairs(lambda x, y, v, p: p, True),
        "proximalsrc": pairs(lambda x, y, v, p: p * (d[v, y] == 1)),
        "proximaltar": pairs(lambda x, y, v, p: p * (d[x, v] == 1)),
        "lengthscaled": pairs(lambda x, y, v, p: p / d[x, y]),
        "linearscaled": pairs(lambda x, y, v, p: p * d[x, v] / d[x, y]),
    }
    want["proximalsum"] = want["proximalsrc"] + want["proximaltar"]
    for mode, x in want.items():
        assert vec(P.betweenness(g, mode), "betweenness") == pytest.approx(x.tolist()), mode
    assert vec(P.stresscent(g), "stress") == pytest.approx(pairs(lambda x, y, v, p: p * s[x, y]).tolist())
    assert sum(want["directed"]) == pytest.approx(sum(d[i, j] - 1 for i, j in itertools.permutations(range(8), 2) if np.isfinite(d[i, j])))


def test_known_values(spark):
    g = Graph.from_matrix(spark, PATH4, directed=False)
    assert vec(P.betweenness(g), "betweenness") == [0, 2, 2, 0]
    assert vec(P.closeness(g), "closeness") == pytest.approx([0.5, 0.75, 0.75, 0.5])
    assert P.average_path_length(g).first()[1] == pytest.approx(10 / 6)
    star = Graph.from_matrix(spark, STAR)
    assert S.centralization(star, "degree", cmode="outdegree") == pytest.approx(1)
    sym = Graph.from_matrix(spark, (np.array(STAR) + np.array(STAR).T).tolist(), directed=False)
    for measure in ("degree", "closeness", "betweenness", "stresscent"):
        assert S.centralization(sym, measure) == pytest.approx(1), measure
    p3 = Graph.from_matrix(spark, [[0, 1, 0], [1, 0, 1], [0, 1, 0]], directed=False)
    assert vec(S.evcent(p3), "evcent") == pytest.approx([0.5, math.sqrt(0.5), 0.5], abs=1e-6)
    assert vec(P.graphcent(g), "graphcent") == pytest.approx([1 / 3, 1 / 2, 1 / 2, 1 / 3])
    one = Graph.from_matrix(spark, [[0]])
    assert vec(P.graphcent(one), "graphcent") == [math.inf]
    assert vec(S.prestige(star, "domain"), "prestige") == [0, 1, 1, 1]
    load = vec(P.loadcent(Graph.from_matrix(spark, [[0, 1, 0], [0, 0, 1], [0, 0, 0]])), "load")
    assert load == [3, 4, 3]  # from each source its own unit and what it passes on, on the transpose


def test_negative_values_are_refused(spark):
    with pytest.raises(ValueError):
        P.geodist(Graph.from_matrix(spark, [[0, -1], [1, 0]]), ignore_eval=False).collect()
    with pytest.raises(ValueError):
        P.closeness(Graph.from_matrix(spark, PATH4), "nope")


def test_unreachable(spark):
    g = Graph.from_matrix(spark, [[0, 1, 0], [0, 0, 0], [0, 0, 0]])
    assert vec(P.closeness(g), "closeness") == [0, 0, 0]
    assert vec(P.closeness(g, "suminvdir"), "closeness") == [0.5, 0, 0]
    assert vec(P.gilschmidt(g), "gilschmidt") == [1, 0, 0]
    assert P.geodist(g, inf_replace=9).where("dist = 9").count() == 5
    assert {(r["src"], r["dst"]) for r in P.reachability(g).collect()} == {(0, 0), (1, 1), (2, 2), (0, 1)}
    preds = {(r["src"], r["dst"]): r["preds"] for r in P.geodist(Graph.from_matrix(spark, PATH4), predecessors=True).collect()}
    assert preds[0, 3] == [2] and preds[0, 0] == []


def test_single_source_by_joins(spark):
    m = random_matrix(2, 8, 0.3)
    g = Graph.from_matrix(spark, m.tolist())
    d, s = shortest((m > 0).astype(float))
    assert {r["vid"]: (r["dist"], r["sigma"]) for r in P.single_source(g, 0).collect()} == {j: (d[0, j], s[0, j]) for j in range(8) if np.isfinite(d[0, j])}


@pytest.mark.parametrize("kind", ["weak", "strong", "recursive"])
def test_components(spark, kind):
    for seed in range(4):
        m = random_matrix(seed, 9, 0.12)
        a = m > 0
        want = K.first_labels(K.component_labels(a, kind))
        assert vec(C.component_dist(Graph.from_matrix(spark, m.tolist()), kind), "label") == want.tolist()
        if kind == "strong":
            r = np.linalg.matrix_power(a + np.eye(9), 9) > 0
            assert all((want[i] == want[j]) == (r[i, j] and r[j, i]) for i in range(9) for j in range(9))


def test_krackhardt(spark):
    tree = Graph.from_matrix(spark, [[0, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0]])
    for fn in (C.connectedness, C.efficiency, C.lubness, lambda g: C.hierarchy(g, "krackhardt")):
        assert fn(tree).first()[1] == pytest.approx(1)
    two = Graph.from_matrix(spark, [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]])
    assert C.connectedness(two).first()[1] == pytest.approx(2 / 6)
    assert C.hierarchy(two, "krackhardt").first()[1] == 0
    v = Graph.from_matrix(spark, [[0, 0, 1], [0, 0, 1], [0, 0, 0]])
    assert C.lubness(v).first()[1] == pytest.approx(0)


def test_cohesion(spark):
    paw = np.array([[0, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 0, 1, 0]])
    g = Graph.from_matrix(spark, paw.tolist(), directed=False)
    assert [r["vid"] for r in C.cutpoints(g).collect()] == [2]
    assert vec(C.bicomponent_dist(g), "label") == [0, 0, 0, 1]
    assert vec(C.kcores(g, "indegree"), "core") == [2, 2, 2, 1]
    assert vec(C.kcores(g), "core") == [4, 4, 4, 2]
    assert {r["vid"]: r["core"] for r in C.kcores_peeled(g).collect()} == {0: 2, 1: 2, 2: 2, 3: 1}
    cl = C.clique_census(g)
    assert {tuple(r["members"]) for r in cl["list"].collect()} == {(0, 1, 2), (2, 3)}
    cyc = C.kcycle_census(g, 4)
    assert {r["size"]: r["count"] for r in cyc["aggregate"].collect()} == {3: 1}
    pth = C.kpath_census(g, 2)
    assert {r["size"]: r["count"] for r in pth["aggregate"].collect()} == {1: 4, 2: 5}
    assert C.is_connected(g).first()[1]
    big = C.component_largest(Graph.from_matrix(spark, [[0, 1, 0], [1, 0, 0], [0, 0, 0]]), result="graph")
    assert big.vertices.count() == 2 and big.edges.count() == 2


@pytest.mark.parametrize("seed", range(8))
def test_enumeration_kernels(seed):
    a = random_matrix(seed, 8, 0.45) > 0
    both = a & a.T
    rank = K.degeneracy_rank(both)
    got = sorted(c for v in range(8) for c in K.cliques_from(both, rank, v))
    full = [s for k in range(1, 9) for s in itertools.combinations(range(8), k) if all(both[i, j] for i, j in itertools.combinations(s, 2))]
    assert got == sorted(s for s in full if not any(set(s) < set(t) for t in full))
    comps, cuts = K.biconnected(a | a.T)
    u = a | a.T
    for v in range(8):
        rest = np.delete(np.delete(u, v, 0), v, 1)
        whole = K.weak_components(u)
        assert (v in cuts) == (len(set(K.weak_components(rest))) > len(set(whole)) - (not u[v].any()))
    cyc = {c for v in range(8) for c in K.simple_cycles(a, v, 4, True)}
    want = {p for k in (2, 3, 4) for p in itertools.permutations(range(8), k) if p[0] == min(p) and all(a[p[i], p[(i + 1) % k]] for i in range(k))}
    assert cyc == want


def test_flow(spark):
    m = [[0, 3, 2, 0], [0, 0, 1, 2], [0, 0, 0, 2], [0, 0, 0, 0]]
    g = Graph.from_matrix(spark, m)
    f = {(r["src"], r["dst"]): r["flow"] for r in C.maxflow(g).collect()}
    assert f[0, 3] == 4 and f[3, 0] == 0 and f[1, 1] == math.inf
    fb = {r["vid"]: r["flowbet"] for r in C.flowbet(Graph.from_matrix(spark, [[0, 1, 0], [0, 0, 1], [0, 0, 0]])).collect()}
    assert fb == {0: 0, 1: 1, 2: 0}


def test_label_propagation(spark):
    two = np.zeros((6, 6))
    two[:3, :3] = two[3:, 3:] = 1
    np.fill_diagonal(two, 0)
    assert vec(C.label_propagation(Graph.from_matrix(spark, two.tolist(), directed=False)), "label") == [0, 0, 0, 1, 1, 1]


def test_linear_systems(spark):
    m = random_matrix(1, 6, 0.5)
    g = Graph.from_matrix(spark, m.tolist())
    x = np.linalg.solve(np.eye(6) - 0.05 * m, m.sum(1))
    assert vec(S.bonpow(g, exponent=0.05), "bonpow") == pytest.approx((x * math.sqrt(6 / (x * x).sum())).tolist())
    ring = [[0, 1, 0, 1], [1, 0, 1, 0], [0, 1, 0, 1], [1, 0, 1, 0]]
    v = vec(S.infocent(Graph.from_matrix(spark, ring, directed=False)), "infocent")
    assert v == pytest.approx([v[0]] * 4) and v[0] > 0
    u = (random_matrix(4, 6, 0.6) > 0).astype(float)
    u = np.maximum(u, u.T)
    e = np.array(vec(S.evcent(Graph.from_matrix(spark, u.tolist(), directed=False)), "evcent"))
    assert u @ e == pytest.approx(np.linalg.eigvalsh(u)[-1] * e, abs=1e-6)
    j = {r["vid"]: r["evcent"] for r in S.evcent_joins(Graph.from_matrix(spark, u.tolist()), rounds=60, tol=1e-6).collect()}
    assert [j[i] for i in range(6)] == pytest.approx(e.tolist(), abs=1e-2)
