"""The graph model, preparation, formats, local counts: closed forms and brute force on small graphs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave import graph as gr
from arcweave.functions import stats
from arcweave.graph import Graph
from arcweave.operators import local, prep
from arcweave.operators.biased import triad_name
from arcweave.sources import formats

NAN = float("nan")


def random_matrix(seed: int, n: int = 7, p: float = 0.35, top: int = 4) -> np.ndarray:
    r = np.random.default_rng(seed)
    m = (r.random((n, n)) < p) * r.integers(1, top, (n, n)).astype(float)
    np.fill_diagonal(m, 0)
    return m


@pytest.fixture(scope="module")
def stack(spark):
    ms = [random_matrix(s) for s in range(12)]
    return ms, Graph.from_matrix(spark, [m.tolist() for m in ms])


def by_graph(df, value):
    return {r["graph_id"]: r[value] for r in df.collect()}


def cells(g):
    return {(r["graph_id"], r["src"], r["dst"]): (NAN if r["missing"] else r["weight"]) for r in g.edges.collect()}


def test_construction(spark):
    g = Graph.from_matrix(spark, [[5, None, NAN], [float("inf"), 0, 2.5], [-1, True, 0]])
    assert {k[1:] for k in cells(g)} == {(0, 2), (1, 2), (2, 0), (2, 1)}
    assert g.is_missing_tie(0, 2) and g.has_tie(2, 0) and g.tie_weight(1, 2) == 2.5 and g.tie_weight(0, 1) == 0
    assert [r["dst"] for r in g.neighbors(2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        Graph.from_matrix(spark, [[0, 1]])
    assert gr.is_graph(g) and not gr.is_graph(3)
    assert g.to_matrix() == [[0, 0, 0], [0, 0, 1], [1, 1, 0]]


def test_edge_lists_keep_the_last(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 0), (2, 1, 7.0, 1), (1, 2, NAN, 2), (3, 3, 1.0, 3)], "tail int, head int, value double, pos int")
    d = cells(Graph.from_edge_list(e, index_base=1))
    assert d[0, 1, 0] == 7.0 and math.isnan(d[0, 0, 1]) and len(d) == 2
    u = cells(Graph.from_edge_list(e, index_base=1, directed=False, order=5))
    assert math.isnan(u[0, 0, 1]) and math.isnan(u[0, 1, 0])
    with pytest.raises(ValueError):
        Graph.from_edge_list(e.withColumn("tail", F.lit(-1)))


def test_order_guard(spark):
    was = gr.set_max_graph_order(2)
    try:
        with pytest.raises(ValueError):
            Graph.from_matrix(spark, random_matrix(0).tolist()).local()
    finally:
        gr.set_max_graph_order(was)


def test_symmetrize(spark):
    m = [[0, 2, NAN, 0], [5, 0, 1, 0], [0, NAN, 0, 3], [0, 0, NAN, 0]]
    g = Graph.from_matrix(spark, m)
    weak, strong = cells(prep.symmetrize(g, "weak")), cells(prep.symmetrize(g, "strong"))
    assert weak[0, 0, 1] == weak[0, 1, 0] == weak[0, 2, 3] == 1 and weak[0, 1, 2] == 1 and math.isnan(weak[0, 0, 2])
    assert strong[0, 0, 1] == 1 and math.isnan(strong[0, 1, 2]) and math.isnan(strong[0, 2, 3]) and (0, 0, 2) not in strong
    assert cells(prep.symmetrize(g, "lower"))[0, 0, 1] == 5 and cells(prep.symmetrize(g, "upper"))[0, 1, 0] == 2
    assert cells(prep.symmetrize(g, "weak", keep_values=True))[0, 0, 1] == 5


def test_edge_list_symmetrize(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0), (1, 0, 2.0, 1), (2, 0, 3.0, 2), (1, 1, 9.0, 3)], "src long, dst long, weight double, pos int")
    weak = prep.symmetrize_edge_list(e, "weak").orderBy("part", "pos").collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in weak] == [(0, 1, 1), (2, 0, 3), (1, 0, 1), (0, 2, 3), (1, 1, 9)]
    assert [(r["src"], r["dst"]) for r in prep.symmetrize_edge_list(e, "strong").orderBy("part", "pos").collect()] == [(1, 0), (0, 1), (1, 1)]


def test_degree_and_density(stack):
    ms, g = stack
    for mode, fn in (("indegree", lambda m: m.sum(0)), ("outdegree", lambda m: m.sum(1)), ("freeman", lambda m: m.sum(0) + m.sum(1))):
        got = {(r["graph_id"], r["vid"]): r["degree"] for r in local.degree(g, mode).collect()}
        assert got == {(k, i): x for k, m in enumerate(ms) for i, x in enumerate(fn(m))}
    assert by_graph(local.gden(g), "density") == {k: pytest.approx(m.sum() / 42) for k, m in enumerate(ms)}
    assert by_graph(local.nties(g), "nties") == dict.fromkeys(range(12), 42.0)


def test_density_edges(spark):
    assert math.isnan(local.gden(Graph.from_matrix(spark, [[0]])).first()["density"])
    assert local.gden(Graph.from_matrix(spark, [[0, 1, NAN], [0, 0, 0], [0, 0, 0]])).first()["density"] == pytest.approx(1 / 5)
    assert local.gden(Graph.from_matrix(spark, [[1, 1], [0, 0]], loops=True)).first()["density"] == 0.5
    assert local.gden(Graph.from_matrix(spark, [[0, 0, 1], [0, 0, 0], [0, 0, 0]], directed=False)).first()["density"] == pytest.approx(1 / 6)
    assert local.degree(Graph.from_matrix(spark, [[3, 1], [0, 0]], loops=True)).where("vid = 0").first()["degree"] == 4


def test_dyads(stack, spark):
    ms, g = stack
    c = {r["graph_id"]: (r["mut"], r["asym"], r["null"]) for r in local.dyad_census(g).collect()}
    for k, m in enumerate(ms):
        a = m > 0
        mut = (a & a.T).sum() // 2
        asym = (a ^ a.T).sum() // 2
        assert c[k] == (mut, asym, 21 - mut - asym)
    r = by_graph(local.grecip(g, "correlation"), "reciprocity")
    off = ~np.eye(7, dtype=bool)
    assert r == {k: pytest.approx(np.corrcoef(m[off], m.T[off])[0, 1]) for k, m in enumerate(ms)}
    miss = Graph.from_matrix(spark, [[0, NAN, 1], [1, 0, 0], [1, 0, 0]])
    x = local.dyad_census(miss).first()
    assert (x["mut"], x["asym"], x["null"], x["missing"]) == (1, 0, 1, 1)


def brute_census(m):
    out = dict.fromkeys(local.DIRECTED_TRIAD_CLASSES, 0)
    for t in itertools.combinations(range(len(m)), 3):
        if not any(np.isnan(m[i, j]) for i, j in itertools.permutations(t, 2)):
            out[triad_name({(t.index(i), t.index(j)) for i, j in itertools.permutations(t, 2) if m[i, j]})] += 1
    return out


def test_triads(stack, spark):
    ms, g = stack
    ms = list(ms)
    got = {}
    for r in local.triad_census(g).collect():
        got.setdefault(r["graph_id"], {})[r["triad"]] = r["count"]
    assert got == {k: brute_census(m) for k, m in enumerate(ms)}
    holes = ms[3].copy()
    holes[0, 1] = holes[4, 2] = NAN
    g2 = Graph.from_matrix(spark, holes.tolist())
    assert {r["triad"]: r["count"] for r in local.triad_census(g2).collect()} == brute_census(holes)
    flat = Graph.from_matrix(spark, [[0, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 0, 1, 0]], directed=False)
    assert {r["triad"]: r["count"] for r in local.triad_census(flat).collect()} == {"0": 0, "1": 1, "2": 2, "3": 1}
    assert local.triad_classify(Graph.from_matrix(spark, [[0, 1, 1], [0, 0, 1], [0, 0, 0]]), (0, 1, 2)) == "030T"
    assert local.triad_classify(Graph.from_matrix(spark, [[0, NAN, 1], [0, 0, 1], [0, 0, 0]]), (0, 1, 2)) is None


def brute_trans(m):
    a, n = m > 0, len(m)
    weak = paths = strong = rank = 0
    for i, j, k in itertools.permutations(range(n), 3):
        two = a[i, j] and a[j, k]
        paths += two
        weak += two and a[i, k]
        rank += two and m[i, k] >= min(m[i, j], m[j, k])
        strong += two == a[i, k]
    t = n * (n - 1) * (n - 2)
    return {"weak": weak / paths if paths else 1, "weakcensus": weak, "strong": strong / t, "strongcensus": strong, "rank": rank / paths if paths else 1}


def test_transitivity(stack):
    ms, g = stack
    for measure in ("weak", "weakcensus", "strong", "strongcensus", "rank"):
        assert by_graph(local.gtrans(g, measure), "transitivity") == {k: pytest.approx(brute_trans(m)[measure]) for k, m in enumerate(ms)}
    c = by_graph(local.gtrans(g, "correlation"), "transitivity")
    off = ~np.eye(7, dtype=bool)
    assert c == {k: pytest.approx(np.corrcoef(m[off], (m @ m)[off])[0, 1]) for k, m in enumerate(ms)}


def test_brokerage_and_simmelian(stack, spark):
    ms, g = stack
    cl = [0, 0, 1, 1, 2, None, None]
    got = {(r["graph_id"], r["vid"]): [r[c] for c in ("w_i", "w_o", "b_io", "b_oi", "b_o", "t")] for r in local.brokerage(g, spark.createDataFrame(list(enumerate(cl)), "vid long, cl int")).collect()}
    for k, m in enumerate(ms):
        want = np.zeros((7, 6), int)
        for i, j, x in itertools.permutations(range(7), 3):
            if m[i, j] and m[j, x] and not m[i, x]:
                a, b, c = cl[i], cl[j], cl[x]
                role = 0 if a == b == c else 1 if a == c else 2 if a == b else 3 if b == c else 4
                want[j, role] += 1
                want[j, 5] += 1
        assert all(got[k, v] == want[v].tolist() for v in range(7))
        mutual = (m > 0) & (m.T > 0)
        two = mutual.astype(int) @ mutual
        sim = {(r["src"], r["dst"]): r["value"] for r in local.simmelian(g, dichotomize=False).where(F.col("graph_id") == k).collect()}
        assert sim == {(i, j): two[i, j] for i in range(7) for j in range(7) if i != j and mutual[i, j] and two[i, j]}


def test_preparation(spark):
    m = random_matrix(3, 5)
    g = Graph.from_matrix(spark, m.tolist())
    assert cells(prep.gt(g)) == {(0, j, i): x for (_, i, j), x in cells(g).items()}
    assert prep.add_isolates(g, 2).vertices.count() == 7
    v = [r["value"] for r in prep.gvectorize(g).orderBy("pos").collect()]
    assert np.array_equal(np.array(v).reshape(5, 5).T, np.where(np.eye(5, dtype=bool), NAN, m), equal_nan=True)
    assert len(prep.gvectorize(g, censor_as_na=False).collect()) == 20
    full = Graph.from_matrix(spark, (m + 1).tolist(), loops=True)
    s = cells(prep.make_stochastic(full, "rowcol", tol=1e-6))
    rows, cols = np.zeros(5), np.zeros(5)
    for (_, i, j), x in s.items():
        rows[i] += x
        cols[j] += x
    assert rows == pytest.approx(1, abs=1e-5) and cols == pytest.approx(1, abs=1e-5)
    css = prep.sr2css(g)
    assert {k for k, x in cells(css).items() if not math.isnan(x)} == {(i, i, j) for i in range(5) for j in range(5) if m[i, j]}
    d = prep.event2dichot(g, "rank", thresh=3)
    top = sorted(m[~np.eye(5, dtype=bool)], reverse=True)[:3]
    assert sorted((g.tie_weight(i, j) for _, i, j in cells(d)), reverse=True) == top
    with pytest.raises(ValueError):
        prep.event2dichot(g, "nope")


def test_ego_and_apply(spark):
    m = [[0, 1, 0, -1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    g = Graph.from_matrix(spark, m)
    e = prep.ego_extract(g, ego=[0], neighborhood="out").collect()
    assert {(r["src"], r["dst"]) for r in e} == {(0, 1)}
    st = spark.createDataFrame([(i, float(i * 10)) for i in range(4)], "vid long, value double")
    assert {r["vid"]: r["value"] for r in prep.gapply(g, "both", st, "sum").collect()} == {0: 30.0, 1: 20.0, 2: 10.0, 3: 0.0}
    assert {r["vid"]: r["value"] for r in prep.gapply(g, "row", st, lambda x: x.max()).collect()} == {0: 10.0, 1: 20.0, 2: 0.0, 3: None}
    assert {r["vid"]: r["value"] for r in prep.gapply(g, "row", st, "sum", distance=2).collect()}[1] == 20.0
    two = Graph.from_matrix(spark, [m, [[0, 1], [1, 0]]])
    assert prep.gliop(two, lambda x: float(x.edges.count()), "-", 0, 1) == 2.0


def test_intervals(spark):
    s = spark.createDataFrame([(0, 1.0, 4.0), (1, 3.0, 6.0), (2, 4.0, 4.0), (3, 9.0, 12.0)], "idx long, onset double, terminus double")
    for width in (None, 2.0):
        got = {(r["src"], r["dst"]): r["value"] for r in prep.interval_graph(s, "overlap", width=width).collect()}
        assert got == {(0, 1): 1.0, (1, 0): 1.0, (0, 2): 0.0, (2, 0): 0.0, (1, 2): 0.0, (2, 1): 0.0}
    assert prep.interval_graph(s, "jntfrac").where("src = 0 and dst = 1").first()["value"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        prep.interval_graph(s.withColumn("terminus", F.lit(0.0)))


def test_formats(spark, tmp_path):
    (tmp_path / "a.dot").write_text('digraph g { // c\n a -> "b" -> c [w=1];\n /* x -> y */ d; c -> a }')
    g, labels = formats.read_dot(spark, str(tmp_path / "a.dot"))
    names = {r["vid"]: r["name"] for r in labels.collect()}
    assert [names[i] for i in range(4)] == ["a", "b", "c", "d"]
    assert {(names[i], names[j]) for _, i, j in cells(g)} == {("a", "b"), ("b", "c"), ("c", "a")}
    m = [[0, 1.5, 0], [0, 0, NAN], [2, 0, 0]]
    g = Graph.from_matrix(spark, [m, np.eye(3).tolist()], loops=True)
    text = formats.write_nos(g)
    again = formats.parse_nos(spark, text)
    assert {k: (v if v == v else None) for k, v in cells(again).items()} == {k: (v if v == v else None) for k, v in cells(g).items()}
    assert formats.write_dl(g) == "dl n = 3, nm = 2\nformat = edgelist1\ndata:\n3 1 2\n1 2 1.5\n!\n1 1 1\n2 2 1\n3 3 1\n"


def test_stats(spark):
    r = spark.range(1).select(*[stats.fdiv(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 4.0)])]).first()
    assert math.isnan(r[0]) and r[1] == math.inf and r[2] == -math.inf and r[3] == 0.25
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.log_sum([]) is None and stats.log_sum([1000, 1000]) == pytest.approx(1000 + math.log(2))
    x = stats.log_sub([1, 2, 0], [2, 2, -1])
    assert math.isnan(x[0]) and x[1] == -math.inf and x[2] == pytest.approx(math.log(1 - math.exp(-1)))
    assert stats.rng(3, 4).random() == stats.rng(3, 4).random() != stats.rng(3, 5).random()


def test_a_stack_is_derived_once(spark):
    """All graphs of a stack as arrays: the edges are read once, the order guard holds for each, graphs without ties stay."""
    seen = spark.sparkContext.accumulator(0)

    def read(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    ms = [[[0, 1, 2], [3, 0, NAN], [0, 4, 0]], [[0] * 3] * 3, [[0, 5], [0, 0]]]
    g = Graph.from_matrix(spark, ms)
    rows = g.edges.count()
    once = Graph(g.vertices, g.edges.mapInPandas(read, g.edges.schema), g.directed, g.loops, g.threshold)
    stack = once.locals()
    assert seen.value == rows
    assert [m.values().tolist() for m in stack][1:] == ms[1:] and np.array_equal(stack[0].values(), np.array(ms[0]), equal_nan=True)
    assert all(np.array_equal(a, b) for i, m in enumerate(stack) for a, b in ((m.vid, g.local(i).vid), (m.a, g.local(i).a), (m.na, g.local(i).na)))
    was = gr.set_max_graph_order(2)
    try:
        with pytest.raises(ValueError, match="order over the limit of 2"):
            g.locals()
    finally:
        gr.set_max_graph_order(was)
