"""Moments and likelihoods against enumeration of all small graphs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from arcweave.graph import Graph
from arcweave.operators import biased, summaries

ARCS = [(i, j) for i in range(4) for j in range(4) if i != j]


@pytest.mark.parametrize("classes", ["aabb", "aaab", "abcc", "aaaa", "abcd"])
def test_brokerage_moments_by_enumeration(classes):
    d, size = 0.3, {c: classes.count(c) for c in sorted(set(classes))}
    triples = list(itertools.permutations(range(4), 3))
    moments = {role: np.zeros((5, 2)) for role in summaries.BROKER_ROLES}
    for bits in itertools.product((0, 1), repeat=12):
        on = {a for a, b in zip(ARCS, bits, strict=True) if b}
        p = d ** len(on) * (1 - d) ** (12 - len(on))
        live = [t for t in triples if (t[0], t[1]) in on and (t[1], t[2]) in on and (t[0], t[2]) not in on]
        for role in summaries.BROKER_ROLES:
            x = np.zeros(5)
            for i, j, k in live:
                if summaries._ROLE[role](classes[i], classes[j], classes[k]):
                    x[[j, 4]] += 1
            moments[role] += p * np.stack([x, x * x], 1)
    for role, m in moments.items():
        for v in range(5):
            mean, var = summaries.role_moments(size, role, d, classes[v] if v < 4 else None)
            assert mean == pytest.approx(m[v, 0]) and var == pytest.approx(m[v, 1] - m[v, 0] ** 2, abs=1e-12)


def test_triad_masses():
    p = biased.bn_ptriad(0.2, 0.3, 0.1, 0.25)
    assert p.sum() == pytest.approx(1) and (p >= 0).all()
    m0, a0, n0 = 0.25 * (0.2 + 0.8 * 0.25), 0.25 * 0.75 * 0.8, 0.75 * (1 - 0.25 * 0.8)
    free = dict(zip(biased.DIRECTED_TRIAD_CLASSES, p, strict=True))  # classes in which no dyad has a parent
    assert [free[k] for k in ("003", "012", "102", "021U", "021C", "111D", "030C")] == pytest.approx([n0**3, 6 * a0 * n0**2, 3 * m0 * n0**2, 3 * a0**2 * n0, 6 * a0**2 * n0, 6 * m0 * a0 * n0, 2 * a0**3])
    last, late = 1 - (1 - 0.7 * 0.75) * (1 + 0.8 * 0.7 * 0.9 * 0.75), 1 - 0.3 * (1 + 0.7 * 0.9)
    assert free["021D"] == pytest.approx(a0 * a0 * (last + 2 * n0 * late))  # its null dyad comes last, or before a parent's second tie


@pytest.mark.parametrize("null_trials", [False, True])
def test_triad_states_add_up(null_trials):
    k = np.array([[0, 0, 0], [1, 0, 2], [3, 1, 1]])
    total = sum(biased.triad_probabilities(s, k, 0.1, 0.4, 0.2, 0.3, null_trials=null_trials) for s in itertools.product(range(4), repeat=3))
    assert total == pytest.approx(np.ones(3))


def test_triad_likelihood_differs_from_the_dyads(spark):
    r = np.random.default_rng(5)
    g = Graph.from_matrix(spark, (r.random((9, 9)) < 0.35).astype(float).tolist())
    t = biased.bn_triples(g).toPandas()
    assert t["count"].sum() == 84
    raw = [0.1, -0.4, -1.0, 0.2]
    m = g.local()
    on = m.a.astype(int)
    shared = on.T @ on
    state = on + 2 * on.T
    p = biased.parameters(raw)
    brute = 0.0
    for i, j, k in itertools.combinations(range(9), 3):
        s = (state[i, j], state[j, k], state[i, k])
        brute -= np.log(biased.triad_probabilities(tuple(map(int, s)), np.array([[shared[i, j], shared[j, k], shared[i, k]]]), *p, null_trials=False)[0])
    assert biased.bn_nlpl_triad(raw, t) == pytest.approx(brute)
    # Estimates differ where there are biases (without any, both are the density).
    a = r.random((9, 9)) < 0.15
    a |= (r.random((9, 9)) < 0.5) & a.T
    a |= (r.random((9, 9)) < 0.3) & (a.astype(int).T @ a.astype(int) > 0)
    g = Graph.from_matrix(spark, a.astype(float).tolist())
    triad, dyad = biased.bn(g, "mple.triad"), biased.bn(g, "mple.dyad")
    assert max(abs(triad.coefficients[c] - dyad.coefficients[c]) for c in biased.NAMES) > 1e-3


def test_a_vertex_without_a_class_brokers(spark):
    from arcweave.operators.local import brokerage

    g = Graph.from_matrix(spark, [[0, 1, 0], [0, 0, 1], [0, 0, 0]])
    for rows in ([(2, "x")], [(0, None), (1, None), (2, "x")]):
        got = {r["vid"]: r.asDict() for r in brokerage(g, spark.createDataFrame(rows, "vid long, cl string")).collect()}
        assert got[1]["t"] == 1 and got[1]["b_io"] == 1
    cl = spark.createDataFrame([(2, "x")], "vid long, cl string")
    assert {r["role"]: r["count"] for r in summaries.global_brokerage(g, cl).collect()} == {"w_i": 0, "w_o": 0, "b_io": 1, "b_oi": 0, "b_o": 0, "t": 1}


@pytest.mark.parametrize("seed", range(2))
def test_strong_labels_agree_with_paths(spark, seed):
    from arcweave.operators.connectivity import component_dist, strong_labels

    r = np.random.default_rng(seed)
    g = Graph.from_matrix(spark, (r.random((14, 14)) < 0.11).astype(float).tolist())
    label = {x["vid"]: x["label"] for x in component_dist(g, "strong").collect()}
    root = {x["vid"]: x["root"] for x in strong_labels(g).collect()}
    assert root == {v: min(u for u in label if label[u] == label[v]) for v in label}


@pytest.mark.parametrize("directed", [True, False])
def test_triad_census_with_missing_ties(spark, directed):
    from arcweave.operators.local import triad_census

    r = np.random.default_rng(3)
    a = (r.random((9, 9)) < 0.4).astype(float)
    a[r.random((9, 9)) < 0.06] = np.nan
    if not directed:
        a = np.tril(a, -1) + np.tril(a, -1).T
    np.fill_diagonal(a, 0)
    want: dict = {}
    for t in itertools.combinations(range(9), 3):
        if any(np.isnan(a[i, j]) for i in t for j in t):
            continue
        on = {(x, y) for x, i in enumerate(t) for y, j in enumerate(t) if a[i, j] > 0}
        name = biased.triad_name(on) if directed else str(len(on) // 2)
        want[name] = want.get(name, 0) + 1
    got = {x["triad"]: x["count"] for x in triad_census(Graph.from_matrix(spark, a.tolist(), directed=directed)).collect()}
    # The empty class is what is left of all triples but those with a missing dyad.
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
