"""Graph comparison: covariance, correlation, Hamming distance, central graphs, and the search
for the best relabelling within exchange classes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fdiv, rng
from ..graph import Graph, Local


def _pair_sums(g: Graph, other: Graph | None, g1, g2) -> DataFrame:
    """g1, g2, n, sx, sy, sxx, syy, sxy, dist: sums over the cells known in both graphs (of undirected ones, below
    the diagonal), dist of absolute differences. Only stored cells are joined; all others are zeros, and counted.

    The graphs of a pair are of one order, on the same vertices."""
    other = other or g

    def side(of: Graph, name: str, value: str, ids) -> tuple[DataFrame, DataFrame]:
        e = of.edges if of.directed else of.edges.where("src >= dst")
        e = e.select(F.col("graph_id").alias(name), "src", "dst", F.when(~F.col("missing"), F.col("weight")).alias(value))
        o = of.orders.withColumnsRenamed({"graph_id": name, "n": "order"})
        if ids is not None:
            e, o = e.where(F.col(name).isin(ids)), o.where(F.col(name).isin(ids))
        x = F.col(value)
        s = e.groupBy(name).agg(*[F.sum(v).alias(value + k) for k, v in (("1", x), ("2", x * x), ("a", F.abs(x)))], F.sum(x.isNull().cast("long")).alias(value + "m"))
        return e, o.join(s, name, "left").fillna(0)

    a, sa = side(g, "g1", "x", g1)
    b, sb = side(other, "g2", "y", g2)
    x, y = F.col("x"), F.col("y")
    known = x.isNotNull() & y.isNotNull()
    only = {"cx": F.when(y.isNull(), x), "cxx": F.when(y.isNull(), x * x), "cxa": F.when(y.isNull(), F.abs(x)), "cy": F.when(x.isNull(), y), "cyy": F.when(x.isNull(), y * y), "cya": F.when(x.isNull(), F.abs(y))}
    met = a.join(b, ["src", "dst"]).groupBy("g1", "g2").agg(
        F.sum(F.when(known, x * y)).alias("sxy"), F.sum(F.when(known, F.abs(x) + F.abs(y) - F.abs(x - y))).alias("shared"),
        F.sum((x.isNull() & y.isNull()).cast("long")).alias("mm"), *[F.sum(v).alias(k) for k, v in only.items()],
    )
    pairs = sa.crossJoin(sb.drop("order")).join(met, ["g1", "g2"], "left").fillna(0)  # a row a pair of graphs
    cells = F.col("order") * (F.col("order") - 1) / (1 if g.directed else 2) + (F.col("order") if g.loops else 0)
    c = F.col
    return pairs.select(
        "g1", "g2", (cells - c("xm") - c("ym") + c("mm")).alias("n"), (c("x1") - c("cx")).alias("sx"), (c("y1") - c("cy")).alias("sy"), (c("x2") - c("cxx")).alias("sxx"), (c("y2") - c("cyy")).alias("syy"),
        "sxy", (c("xa") - c("cxa") + c("ya") - c("cya") - c("shared")).alias("dist"),
    )


def gcov(g: Graph, other: Graph | None = None, *, g1=None, g2=None) -> DataFrame:
    """g1, g2, gcov: sample covariance over cells known in both."""
    s = _pair_sums(g, other, g1, g2)
    n = F.col("n")
    return s.select("g1", "g2", F.when(n > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.when(n > 1, n)) / F.when(n > 1, n - 1)).alias("gcov"))


def gcor(g: Graph, other: Graph | None = None, *, g1=None, g2=None) -> DataFrame:
    """g1, g2, gcor: Pearson correlation; NaN where one does not vary."""
    s = _pair_sums(g, other, g1, g2)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    return s.select("g1", "g2", fdiv(n * F.col("sxy") - sx * sy, F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))).alias("gcor"))


def hdist(g: Graph, other: Graph | None = None, *, g1=None, g2=None, normalize: bool = False) -> DataFrame:
    """g1, g2, hdist: sum of absolute differences over the cells, over the possible ties if normalized."""
    s = _pair_sums(g, other, g1, g2).select("g1", "g2", F.col("dist").alias("d"))
    if normalize:
        from .local import nties

        s = s.join(nties(g).select(F.col("graph_id").alias("g1"), "nties"), "g1").withColumn("d", fdiv("d", "nties"))
    return s.select("g1", "g2", F.col("d").alias("hdist"))


def centralgraph(g: Graph, *, normalize: bool = False) -> DataFrame:
    """src, dst, value: 1 where the mean of the stack's cells is .5 or more, or the mean itself; zero cells left out.

    Aggregates the sparse edges; cells without a row count as zeros through the number of graphs."""
    count = g.vertices.select("graph_id").distinct().count()
    e = g.edges.groupBy("src", "dst").agg(F.sum(F.when(~F.col("missing"), F.col("weight"))).alias("s"), F.sum(F.col("missing").cast("long")).alias("m"))
    mean = fdiv(F.coalesce("s", F.lit(0.0)), F.lit(count) - F.col("m"))
    if normalize or count == 1:
        return e.select("src", "dst", mean.alias("value")).where("value <> 0")
    return e.where((mean >= 0.5) & ~F.isnan(mean)).select("src", "dst", F.lit(1.0).alias("value"))


def gclust_centralgraph(labels: DataFrame, g: Graph, *, normalize: bool = False) -> Graph:
    """A central graph per cluster. labels: graph_id, cluster."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("k"))
    e = g.known.join(labels, "graph_id").groupBy("cluster", "src", "dst").agg(F.sum("weight").alias("s")).join(size, "cluster").select(F.col("cluster").cast("long").alias("graph_id"), "src", "dst", fdiv("s", "k").alias("mean"))
    if not normalize:
        e = e.where("mean >= 0.5").withColumn("mean", F.lit(1.0))
    v = g.vertices.join(labels, "graph_id").select(F.col("cluster").cast("long").alias("graph_id"), "vid").distinct()
    return replace(g, vertices=v, edges=e.select("graph_id", "src", "dst", F.col("mean").alias("weight"), F.lit(False).alias("missing")))


def gclust_boxstats(labels: DataFrame, measures: DataFrame) -> DataFrame:
    """cluster, min, q1, median, q3, max. labels: graph_id, cluster; measures: graph_id, value."""
    q = lambda p: F.percentile("value", p)
    return labels.join(measures, "graph_id").groupBy("cluster").agg(F.min("value").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("value").alias("max"))


# Relabelling ------------------------------------------------------------------------------


def numperm(n: int, k: int) -> list[int]:
    """The k-th permutation of n items, in lexicographic order (k from 0)."""
    total = math.factorial(n)
    if not 0 <= k < total:
        raise ValueError("permutation number out of range")
    items, out = list(range(n)), []
    for i in range(n, 0, -1):
        total //= i
        j, k = divmod(k, total)
        out.append(items.pop(j))
    return out


def _classes(exchange, n: int) -> list[np.ndarray]:
    labels = np.zeros(n, int) if exchange is None else np.asarray(exchange)
    return [np.flatnonzero(labels == x) for x in dict.fromkeys(labels.tolist())]


def _arrange(groups: list[np.ndarray], orders) -> np.ndarray:
    p = np.empty(sum(map(len, groups)), int)
    for at, o in zip(groups, orders, strict=True):
        p[at] = at[list(o)]
    return p


def _score(d1: np.ndarray, d2: np.ndarray, p: np.ndarray, fun: Callable) -> float:
    return float(fun(d1, d2[np.ix_(p, p)]))


def _climb(d1, d2, fun, groups, p) -> tuple[float, np.ndarray]:
    best = _score(d1, d2, p, fun)
    while True:
        top, swap = best, None
        for at in groups:
            for i, j in itertools.combinations(at.tolist(), 2):
                q = p.copy()
                q[i], q[j] = q[j], q[i]
                if (x := _score(d1, d2, q, fun)) > top + 1e-12:
                    top, swap = x, q
        if swap is None:
            return best, p
        best, p = top, swap


def _anneal(d1, d2, fun, groups, r, *, prob_init=1.0, prob_decay=0.99, freeze_time=1000) -> tuple[float, np.ndarray]:
    p = _arrange(groups, [r.permutation(len(x)) for x in groups])
    now = best = _score(d1, d2, p, fun)
    keep, prob = p.copy(), prob_init
    live = [x for x in groups if len(x) > 1]
    for _ in range(freeze_time if live else 0):
        at = live[r.integers(len(live))]
        i, j = r.choice(at, 2, replace=False)
        q = p.copy()
        q[i], q[j] = q[j], q[i]
        x = _score(d1, d2, q, fun)
        if x > now or r.random() < prob:
            p, now = q, x
            if x > best:
                best, keep = x, q.copy()
        prob *= prob_decay
    x, p = _climb(d1, d2, fun, groups, keep)
    return max(best, x), p


def _gumbel(draws: np.ndarray, estimator: str = "median") -> float:
    """Location of the largest value by an extreme-value fit to the draws."""
    if draws.std() == 0:
        return float(draws[0])
    b = draws.std() * math.sqrt(6) / math.pi
    for _ in range(200):
        w = np.exp(-(draws - draws.min()) / b)
        new = draws.mean() - (draws * w).sum() / w.sum()
        if abs(new - b) < 1e-10 or new <= 0:
            break
        b = new
    a = -b * math.log(np.exp(-(draws - draws.min()) / b).mean()) + draws.min()
    n = len(draws)
    return float(a + b * math.log(n)) if estimator == "mode" else float(a + b * math.log(n) - b * math.log(math.log(2))) if estimator == "median" else float(a + b * (math.log(n) + 0.5772156649015329))


def lab_optimize(d1, d2, fun: Callable, *, method: str = "anneal", exchange=None, maximize: bool = True, seed: int = 0, draws: int = 1000, estimator: str = "median", **options) -> float:
    """Best value of fun(d1, relabelled d2) over relabellings within exchange classes."""
    d1, d2 = np.asarray(d1, float), np.asarray(d2, float)
    sign = 1 if maximize else -1
    f = lambda a, b: sign * fun(a, b)
    groups = _classes(exchange, len(d1))
    if all(len(x) < 2 for x in groups):
        return sign * f(d1, d2)
    r = rng(seed)
    if method == "exhaustive":
        best = max(_score(d1, d2, _arrange(groups, o), f) for o in itertools.product(*(itertools.permutations(range(len(x))) for x in groups)))
    elif method == "hillclimb":
        best = _climb(d1, d2, f, groups, np.arange(len(d1)))[0]
    elif method == "anneal":
        best = _anneal(d1, d2, f, groups, r, **options)[0]
    elif method in ("mc", "gumbel"):
        x = np.array([_score(d1, d2, _arrange(groups, [r.permutation(len(k)) for k in groups]), f) for _ in range(draws)])
        best = float(x.max()) if method == "mc" else _gumbel(x, estimator)
    else:
        raise ValueError(f"unknown method {method}")
    return sign * best


def lab_optimize_exhaustive(d1, d2, fun, **kw) -> float:
    return lab_optimize(d1, d2, fun, method="exhaustive", **kw)


def lab_optimize_hillclimb(d1, d2, fun, **kw) -> float:
    return lab_optimize(d1, d2, fun, method="hillclimb", **kw)


def lab_optimize_anneal(d1, d2, fun, **kw) -> float:
    return lab_optimize(d1, d2, fun, method="anneal", **kw)


def lab_optimize_mc(d1, d2, fun, **kw) -> float:
    return lab_optimize(d1, d2, fun, method="mc", **kw)


def lab_optimize_gumbel(d1, d2, fun, **kw) -> float:
    return lab_optimize(d1, d2, fun, method="gumbel", **{"draws": 500, **kw})


def _vector(m: np.ndarray, directed: bool, diag: bool) -> np.ndarray:
    keep = np.ones(m.shape, bool) if directed else np.tril(np.ones(m.shape, bool))
    if not diag:
        keep &= ~np.eye(len(m), dtype=bool)
    return m[keep]


def _statistic(kind: str, directed: bool, diag: bool) -> Callable:
    def cov(a, b):
        x, y = _vector(a, directed, diag), _vector(b, directed, diag)
        ok = ~np.isnan(x) & ~np.isnan(y)
        return float(np.cov(x[ok], y[ok])[0, 1]) if ok.sum() > 1 else math.nan

    def cor(a, b):
        x, y = _vector(a, directed, diag), _vector(b, directed, diag)
        ok = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[ok] - x[ok].mean(), y[ok] - y[ok].mean()
        s = math.sqrt((x * x).sum() * (y * y).sum())
        return float((x * y).sum() / s) if s else math.nan

    def dist(a, b):
        d = np.abs(a - b)
        if not diag:
            d = d[~np.eye(len(a), dtype=bool)]
        return float(np.nansum(d)) / (1 if directed else 2)

    return {"cov": cov, "cor": cor, "dist": dist}[kind]


def _searched(g: Graph, kind: str, name: str, *, method: str, exchange, reps: int, seed: int, maximize: bool, g1=None, g2=None, **options) -> DataFrame:
    """Rows are graph pairs and restarts; the best restart of each pair is kept."""
    spark = g.vertices.sparkSession
    ids = [r[0] for r in g.vertices.select("graph_id").distinct().orderBy("graph_id").collect()]
    shared = spark.sparkContext.broadcast({i: m.values() for i, m in zip(ids, g.locals(), strict=True)})
    stat = _statistic(kind, g.directed, g.loops)
    pairs = [(a, b, r) for a in (g1 or ids) for b in (g2 or ids) for r in range(reps)]
    rows = spark.createDataFrame(pairs, "g1 long, g2 long, rep long").repartition(max(1, min(len(pairs), spark.sparkContext.defaultParallelism * 4)), "g1", "g2", "rep")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["x"] = [lab_optimize(shared.value[a], shared.value[b], stat, method=method, exchange=exchange, maximize=maximize, seed=hash((seed, a, b, r)) & 0xFFFFFFFF, **options) for a, b, r in zip(p["g1"], p["g2"], p["rep"], strict=True)]
            yield p

    return rows.mapInPandas(run, "g1 long, g2 long, rep long, x double").groupBy("g1", "g2").agg((F.max if maximize else F.min)("x").alias(name))


def gscov(g: Graph, *, method: str = "anneal", exchange=None, reps: int = 5, seed: int = 0, **kw) -> DataFrame:
    return _searched(g, "cov", "gscov", method=method, exchange=exchange, reps=reps, seed=seed, maximize=True, **kw)


def gscor(g: Graph, *, method: str = "anneal", exchange=None, reps: int = 5, seed: int = 0, **kw) -> DataFrame:
    return _searched(g, "cor", "gscor", method=method, exchange=exchange, reps=reps, seed=seed, maximize=True, **kw)


def structdist(g: Graph, *, method: str = "anneal", exchange=None, reps: int = 5, seed: int = 0, normalize: bool = False, **kw) -> DataFrame:
    d = _searched(g, "dist", "structdist", method=method, exchange=exchange, reps=reps, seed=seed, maximize=False, **kw)
    if not normalize:
        return d
    from .local import nties

    return d.join(nties(g).select(F.col("graph_id").alias("g1"), "nties"), "g1").select("g1", "g2", fdiv("structdist", "nties").alias("structdist"))


def sdmat(g: Graph, *, output: str = "matrix", **kw) -> DataFrame:
    """All-pairs structural distance; condensed keeps each unordered pair once."""
    d = structdist(g, **kw)
    return d.where("g1 < g2") if output == "condensed" else d


def perturb(g: Local, i: int, j: int, fn: Callable[[Local], float]) -> float:
    """fn with the tie i, j less fn without it (both directions of an undirected graph)."""
    out = []
    for x in (1.0, 0.0):
        w = g.w.copy()
        w[i, j] = x
        if not g.directed:
            w[j, i] = x
        out.append(fn(Local(g.vid, w, (np.abs(w) > 0) & ~g.na, g.na, g.directed, g.loops)))
    return out[0] - out[1]
