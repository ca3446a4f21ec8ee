"""Comparison, roles, random graphs, tests, regression, informants, biased nets, layouts, summaries, registry, streams."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcweave.graph import Graph, Local
from arcweave.operators import bayes as B
from arcweave.operators import biased as BN
from arcweave.operators import compare as CM
from arcweave.operators import layouts, local, nulls, roles, summaries
from arcweave.operators import random_graphs as R
from arcweave.operators import regression as L
from arcweave.plans import registry
from arcweave.streaming import edges as stream
from test_graph import cells, random_matrix

OFF = ~np.eye(6, dtype=bool)


@pytest.fixture(scope="module")
def pair(spark):
    a = random_matrix(1, 6, 0.4)
    p = np.random.default_rng(3).permutation(6)
    return a, a[np.ix_(p, p)], Graph.from_matrix(spark, [a.tolist(), a[np.ix_(p, p)].tolist()])


def test_comparison(pair):
    a, b, g = pair
    x, y = a[OFF], b[OFF]
    get = lambda df, c: {(r["g1"], r["g2"]): r[c] for r in df.collect()}
    assert get(CM.gcor(g), "gcor")[0, 1] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert get(CM.gcov(g), "gcov")[0, 1] == pytest.approx(np.cov(x, y)[0, 1])
    assert get(CM.hdist(g), "hdist")[0, 1] == pytest.approx(np.abs(x - y).sum())
    assert get(CM.gscor(g, method="exhaustive", reps=1), "gscor")[0, 1] == pytest.approx(1)
    assert get(CM.structdist(g, reps=4, freeze_time=200, prob_decay=0.95), "structdist")[0, 1] >= 0
    assert get(CM.structdist(g, method="exhaustive", reps=1), "structdist")[0, 1] == pytest.approx(0)
    m = {(r["src"], r["dst"]): r["value"] for r in CM.centralgraph(g, normalize=True).collect()}
    assert m == {(i, j): (a[i, j] + b[i, j]) / 2 for i in range(6) for j in range(6) if a[i, j] + b[i, j]}
    lab = g.vertices.sparkSession.createDataFrame([(0, 0), (1, 0)], "graph_id long, cluster int")
    assert len(cells(CM.gclust_centralgraph(lab, g))) == sum((a + b)[OFF] / 2 >= 0.5)
    assert CM.sdmat(g, output="condensed", method="hillclimb", reps=1).count() == 1


def test_relabelling():
    assert [CM.numperm(3, k) for k in range(6)] == [list(p) for p in itertools.permutations(range(3))]
    with pytest.raises(ValueError):
        CM.numperm(3, 6)
    a = random_matrix(2, 5, 0.5)
    b = a[np.ix_([4, 2, 0, 1, 3], [4, 2, 0, 1, 3])]
    f = lambda x, y: -float(np.abs(x - y).sum())
    assert CM.lab_optimize_exhaustive(a, b, f) == 0
    best = {m: CM.lab_optimize(a, b, f, method=m, seed=1) for m in ("anneal", "hillclimb", "mc")}
    assert all(v <= 0 for v in best.values()) and best["anneal"] == CM.lab_optimize_anneal(a, b, f, seed=1)
    assert CM.lab_optimize(a, b, f, exchange=[0, 1, 2, 3, 4], method="anneal") == f(a, b)
    assert math.isfinite(CM.lab_optimize_gumbel(a, b, f, draws=50))


def test_roles(spark):
    m = np.array([[0, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]], float)
    g = Graph.from_matrix(spark, m.tolist())
    d = {(r["i"], r["j"]): r["sedist"] for r in roles.sedist(g).collect()}
    assert d[1, 2] == 0 and d[0, 1] > 0 and d[1, 2] == d[2, 1]
    r = {(x["i"], x["j"]): x["redist"] for x in roles.redist(g).collect()}
    assert r[1, 2] == 0 and r[0, 3] > 0
    tree, vid = roles.equiv_clust(g)
    assert tree.cut(k=3)[1] == tree.cut(k=3)[2] and len(set(tree.cut(k=4))) == 4 and set(tree.cut(h=1e9)) == {1}
    cl = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "vid long, cl int")
    blocks = {(x["row"], x["col"]): x["value"] for x in roles.blockmodel(g, cl).collect()}
    assert blocks[0, 1] == 1 and blocks[1, 2] == 1 and math.isnan(blocks[0, 0]) and blocks[1, 1] == 0
    e = roles.blockmodel_expand([[0.0, 1.0], [0.0, 0.0]], [2, 3], spark)
    assert len(cells(e)) == 6
    assert "Graph 0" in summaries.print_blockmodel(roles.blockmodel(g, cl))
    assert "4 actors" in summaries.print_equiv_clust(tree)


@pytest.mark.parametrize("method", roles.LINKAGES)
def test_linkages(method):
    pts = np.array([0.0, 1.0, 5.0, 5.5, 20.0])
    d = np.abs(pts[:, None] - pts[None])
    t = roles.hclust(d, method)
    assert t.cut(k=3) == [1, 1, 2, 2, 3] and sorted(t.order) == list(range(5)) and t.height[0] == pytest.approx(0.5)


def test_random_graphs(spark):
    g = R.rgraph(spark, 40, 3, tprob=0.3, seed=5)
    assert 0.2 < len(cells(g)) / (3 * 40 * 39) < 0.4
    assert cells(g) == cells(R.rgraph(spark, 40, 3, tprob=0.3, seed=5)) != cells(R.rgraph(spark, 40, 3, tprob=0.3, seed=6))
    u = cells(R.rgraph(spark, 10, tprob=[[0.9] * 10] * 10, directed=False))
    assert all(u.get((k, j, i)) == x for (k, i, j), x in u.items())
    assert {r["count"] for r in R.rgnm(spark, 8, 11, 4).edges.groupBy("graph_id").count().collect()} == {11}
    c = local.dyad_census(R.rguman(spark, 8, 5, 9, 14, 3, method="exact")).collect()
    assert {(r["mut"], r["asym"], r["null"]) for r in c} == {(5, 9, 14)}
    mix = cells(R.rgnmix(spark, ["a", "a", "b", "b", "b"], {("a", "b"): 4}, method="exact"))
    assert len(mix) == 4 and all(i < 2 <= j for _, i, j in mix)
    w = R.rgws(spark, 10, 1, 2, 0.0)
    assert len(cells(w)) == 2 * (9 + 8)
    assert len(cells(R.rgws(spark, 10, 1, 2, 0.7, seed=3))) == 34
    before = local.dyad_census(g).orderBy("graph_id").collect()
    assert local.dyad_census(R.rewire_ud(g, 0.5)).orderBy("graph_id").collect() == before
    n = R.rgbn(spark, 8, 2, d=0.4, burn=300)
    assert 0 < len(cells(n)) < 112
    assert len(cells(R.rgraph(spark, 6, tielist=[0, 2.0]))) < 30
    with pytest.raises(ValueError):
        R.rgnm(spark, 3, 9)


def test_null_tests(spark, pair):
    a, _, _ = pair
    same = Graph.from_matrix(spark, [a.tolist(), a.tolist()])
    t = nulls.qaptest(same, reps=60, seed=1)
    assert t.observed == pytest.approx(1) and t.tails()[1] == 1 and t.reps.count() == 60
    assert [r["value"] for r in t.reps.orderBy("rep").collect()] == [r["value"] for r in nulls.qaptest(same, reps=60, seed=1).reps.orderBy("rep").collect()]
    assert nulls.cugtest(same, reps=20).reps.count() == 20
    for mode in ("size", "edges", "dyad.census"):
        assert nulls.cug_test(same, cmode=mode, reps=20).reps.count() == 20
    r = np.random.default_rng(0)
    d = nulls.draw_graph(a, "edges", True, r)
    assert (d != 0).sum() == (a != 0).sum()
    d = nulls.draw_graph(a, "dyad.census", True, r)
    assert ((d != 0) & (d.T != 0)).sum() == ((a != 0) & (a.T != 0)).sum()
    text = summaries.print_summary_null_test(t)
    assert "QAP" in text and "median" in text and summaries.plot_null_test(t).agg(F.sum("count")).first()[0] == 60


def test_regression(spark):
    r = np.random.default_rng(2)
    x1, x2 = r.random((10, 10)), r.random((10, 10))
    y = 1 + 2 * x1 - x2 + 0.01 * r.normal(size=(10, 10))
    gy, gx = Graph.from_matrix(spark, y.tolist()), Graph.from_matrix(spark, [x1.tolist(), x2.tolist()])
    off = ~np.eye(10, dtype=bool)
    d = np.stack([np.ones(90), x1.T[off], x2.T[off]], 1)
    want = np.linalg.lstsq(d, y.T[off], rcond=None)[0]
    f = L.netlm(gy, gx, reps=30)
    assert f.coefficients == pytest.approx(want) and f.extra["r2"] > 0.99 and f.p_ge[1] < 0.1
    c = L.netlm(gy, gx, nullhyp="classical")
    assert c.p_two[1] < 1e-6 and "F-statistic" in summaries.print_summary_fit(c)
    e = {(t["a"], t["b"]): t["value"] for t in L.normal_equations(gy, gx).collect()}
    assert e["x0", "y"] == pytest.approx((x1 * y)[off].sum()) and e["1", "1"] == 90
    with pytest.raises(ValueError):
        L.netlm(gy, Graph.from_matrix(spark, [x1.tolist(), x1.tolist()]), nullhyp="classical")
    b = (1 / (1 + np.exp(-(4 * x1 - 2))) > r.random((10, 10))).astype(float)
    g = L.netlogit(Graph.from_matrix(spark, b.tolist()), gx, nullhyp="classical")
    mu = g.extra["fitted"]
    assert d.T @ (b.T[off] - mu) == pytest.approx(np.zeros(3), abs=1e-6) and g.extra["null_deviance"] == pytest.approx(2 * 90 * math.log(2))
    cc = L.netcancor(gy, gx, reps=10)
    assert cc["cor"][0] == pytest.approx(np.corrcoef(d @ want, y.T[off])[0, 1])
    for null in ("qapy", "qapallx", "cugtie", "cuguman"):
        assert L.netlm(gy, gx, nullhyp=null, reps=4).coefficients == pytest.approx(want)


def test_autocorrelation(spark):
    n = 12
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 2))
    y = np.linalg.solve(np.eye(n) - 0.4 * w, x @ [1.0, -2.0] + 0.01 * r.normal(size=n))
    f = L.lnam(y, x, [w])
    assert f.rho1[0] == pytest.approx(0.4, abs=0.05) and f.beta == pytest.approx([1, -2], abs=0.05)
    assert len(L.coef_lnam(f)) == len(L.se_lnam(f)) == 3 and "sigma" in summaries.print_lnam(f)
    g = Graph.from_matrix(spark, (w > 0).astype(float).tolist())
    ys = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "vid long, y double")
    z = y - y.mean()
    m = {t["lag"]: t["nacf"] for t in L.nacf(g, ys, lag_max=2, kind="moran").collect()}
    assert m[1] == pytest.approx(n / (2 * n) * sum(z[i] * z[(i + s) % n] for i in range(n) for s in (1, -1)) / (z @ z))
    gy = {t["lag"]: t["nacf"] for t in L.nacf(g, ys, lag_max=1, kind="geary", demean=False).collect()}
    assert gy[1] > 0


def test_pstar(spark):
    a = (random_matrix(5, 8, 0.4) > 0).astype(float)
    g = Graph.from_matrix(spark, a.tolist())
    f = L.pstar(g, ["choice", "mutuality"])
    x = np.stack([np.ones(56), a.T[~np.eye(8, dtype=bool)]], 1)
    b, *_ = L._irls(a[~np.eye(8, dtype=bool)], x)
    assert f.coefficients == pytest.approx(b, abs=1e-6)
    assert L.eval_edgeperturbation(g, 0, 1, lambda m: float(m.w.sum())) == 1
    with pytest.raises(ValueError):
        L.pstar(g, ["nope"])


def test_informants(spark):
    r = np.random.default_rng(4)
    truth = (r.random((6, 6)) < 0.4).astype(float)
    np.fill_diagonal(truth, 0)
    seen = [np.where(r.random((6, 6)) < 0.1, 1 - truth, truth) for _ in range(6)]
    g = Graph.from_matrix(spark, [s.tolist() for s in seen])
    for method in B.CONSENSUS:
        c = {(x["src"], x["dst"]): x["value"] for x in B.consensus(g, method).collect()}
        assert all(0 < v <= 1 for v in c.values())
        if method in ("central.graph", "iterative.reweight", "romney.batchelder"):
            wrong = sum(((i, j) in c) != bool(truth[i, j]) for i, j in itertools.permutations(range(6), 2))
            assert wrong <= 3, method
    p = {(x["src"], x["dst"]): x["posterior"] for x in B.bbnam_fixed(g).collect()}
    k = sum(s[0, 1] for s in seen)
    l1, l0 = 0.75**k * 0.25 ** (6 - k), 0.25**k * 0.75 ** (6 - k)
    assert p[0, 1] == pytest.approx(l1 / (l1 + l0)) == pytest.approx(B.bbnam_probtie(g, 0, 1))
    for model in ("pooled", "actor"):
        d = B.bbnam(g, model, reps=2, draws=60, burntime=20)
        assert np.abs(d.net.mean(0) - truth)[~np.eye(6, dtype=bool)].mean() < 0.2 and d.em.shape == (60, 1 if model == "pooled" else 6)
        assert "mean net" in summaries.print_bbnam(d)
    x = np.stack(seen)
    assert B.bbnam_jntlik(g, truth, 0.1, 0.1) == pytest.approx(sum(B.bbnam_jntlik_slice(s, np.where(np.eye(6, dtype=bool), np.nan, x), truth, 0.1, 0.1) for s in range(6)))
    bf = B.bbnam_bf(g, reps=20)
    assert bf["log_bf"].shape == (3, 3) and "log Bayes" in summaries.print_summary_bayes_factor(bf)
    assert len(B.npostpred(d, lambda m: m.sum())) == 60
    ch = spark.createDataFrame(pd.DataFrame({"chain": np.repeat([0, 1], 50), "value": np.random.default_rng(0).normal(size=100)}))
    assert B.potscalered_mcmc(ch) == pytest.approx(1, abs=0.2)


def test_biased_nets(spark):
    a = (random_matrix(6, 9, 0.3) > 0).astype(float)
    g = Graph.from_matrix(spark, a.tolist())
    rows = BN._rows(BN.bn_dyad_stats(g))
    assert sum(m + x + n for _, m, x, n in rows) == 36
    parents = a.T @ a
    assert {(r["i"], r["j"]): r["parents"] for r in BN.bn_triad_stats(g).collect()} == {(i, j): parents[i, j] for i in range(9) for j in range(i + 1, 9) if parents[i, j]}
    for method in ("mple.dyad", "mple.edge", "mple.triad", "mtle"):
        f = BN.bn(g, method)
        assert all(0 <= v <= 1 for v in BN.coef_bn(f).values()) and math.isfinite(f.value)
    p = BN.bn_ptriad(0, 0, 0, 0.3)
    assert p.sum() == pytest.approx(1) and p[0] == pytest.approx(0.7**6) and p[-1] == pytest.approx(0.3**6)
    assert sum(BN.dyad_probabilities(2, 0.1, 0.2, 0.1, 0.3)[i] * (1, 2, 1)[i] for i in range(3)) == pytest.approx(1)
    assert summaries.plot_bn(f, local.triad_census(g)).count() == 16


def test_layouts_and_summaries(spark):
    g = Graph.from_matrix(spark, random_matrix(1, 6, 0.5).tolist())
    for mode in layouts.MODES:
        p = layouts.layout(g, mode, rounds=20).collect()
        assert len(p) == 6 and all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in p), mode
    assert {len(r) for r in layouts.layout(g, "spring", dim=3, rounds=5).collect()} == {4}
    assert layouts.gplot(g, "circle")["segments"].count() == len(cells(g)) and layouts.plot_sociomatrix(g).count() == 36
    q = summaries.quantile_summary(spark.createDataFrame([(float(x),) for x in range(5)] + [(math.nan,)], "value double")).first()
    assert tuple(q) == (0, 1, 2, 2, 3, 4)
    cl = spark.createDataFrame([(i, i % 2) for i in range(6)], "vid long, cl int")
    s = summaries.summary_brokerage(g, cl).collect()
    assert len(s) == 36 and "w_o" in summaries.print_summary_brokerage(g, cl)
    total = sum(r["expected"] for r in s if r["role"] != "t")
    assert total == pytest.approx(sum(r["expected"] for r in s if r["role"] == "t"))


def test_registry(spark):
    g = Graph.from_matrix(spark, random_matrix(1, 6, 0.5).tolist())
    for name in ("degree", "gden", "triadCensus", "geodist", "betweenness", "componentDist", "kcores", "qaptest", "cugTest", "netlm", "bnDyadStats", "equivClust", "rgws", "rewireUd", "labOptimizeMc", "makeStochastic", "interval_graph", "readDot", "writeDl", "logSum", "summaryQaptest", "printNetlm", "gplotLayout", "hasTie", "makeDenseGraph", "bbnamBf"):
        assert callable(registry.find(name)), name
    assert len(registry.find("gplot3dLayoutMds")(g).columns) == 4 and registry.find("gplotLayoutCircle")(g).count() == 6
    assert registry.find("gplotArrow")(g, "circle").count() == len(cells(g)) and registry.find("gplotLoop")(g, "circle").count() == 0
    assert registry.find("gplot3d")(g, "random")["segments"].count() == len(cells(g))
    assert registry.find("toNestedMatrix")([1, 2, 3, 4], 2, 2) == [[1, 2], [3, 4]] and registry.find("DIRECTED_TRIAD_CLASSES")[0] == "003"
    with pytest.raises(KeyError):
        registry.find("nope")
    client = registry.TaskClient(spark)
    assert client.run("gden", g, action=lambda d: d.first()["density"]).result(60) > 0
    client.terminate()


def test_streams(spark, tmp_path):
    rows = [(0, 1, 0), (1, 0, 5), (0, 1, 30), (2, 2, 40), (0, None, 50), (3, 1, 3700)]
    df = spark.createDataFrame(rows, "src long, dst long, s int").select("src", "dst", F.timestamp_seconds(F.col("s") + 1_700_000_000 - 1_700_000_000 % 3600).alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    for name, fn in (("edges", stream.edge_windows), ("degrees", stream.degree_windows), ("density", lambda s: stream.density_windows(s, 4))):
        q = fn(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    got = {(r["src"], r["dst"], r["start"].hour if False else i): r["weight"] for i, r in enumerate(spark.sql("select * from edges order by start, src, dst").collect())}
    assert [v for v in got.values()] == [2, 1, 1]
    assert {r["vid"]: r["degree"] for r in spark.sql("select vid, sum(degree) as degree from degrees group by vid").collect()} == {0: 3, 1: 4, 3: 1}
    assert sorted(r["density"] for r in spark.sql("select * from density").collect()) == pytest.approx([1 / 12, 3 / 12])


def test_local_arrays():
    m = Local.from_array([[5, None, math.nan], [math.inf, 0, 1], [0, 0, 0]])
    assert m.a.sum() == 1 and m.na.sum() == 1 and m.w[0, 0] == 0
    with pytest.raises(ValueError):
        Local.from_array([[1, 2]])
