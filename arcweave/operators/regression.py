"""Network regression, canonical correlation, autocorrelation, p* and linear network autocorrelation models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fdiv, normal_two_sided, rng, t_two_sided
from ..graph import Graph, Local
from ..kernels import CSR, accumulate, paths_from, reach, weak_components
from .compare import perturb
from .nulls import draw_graph, shuffled


def _column(m: np.ndarray, directed: bool, diag: bool) -> np.ndarray:
    """Column-major vector of the used cells."""
    keep = np.ones(m.shape, bool) if directed else np.tril(np.ones(m.shape, bool))
    if not diag:
        keep &= ~np.eye(len(m), dtype=bool)
    return m.T[keep.T]


def _solve(xtx: np.ndarray) -> np.ndarray:
    if np.linalg.matrix_rank(xtx) < len(xtx):
        raise ValueError("predictors are collinear")
    return np.linalg.inv(xtx)


@dataclass
class Fit:
    """coefficients, standard errors, statistics, tail probabilities of a network regression."""

    names: list[str]
    coefficients: np.ndarray
    se: np.ndarray
    statistic: np.ndarray
    p_le: np.ndarray
    p_ge: np.ndarray
    p_two: np.ndarray
    extra: dict = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        rows = list(zip(self.names, *(map(float, x) for x in (self.coefficients, self.se, self.statistic, self.p_le, self.p_ge, self.p_two)), strict=True))
        return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, p_le double, p_ge double, p_two double")


def _ols(y: np.ndarray, x: np.ndarray):
    inverse = _solve(x.T @ x)
    b = inverse @ x.T @ y
    r = y - x @ b
    df = len(y) - x.shape[1]
    s2 = (r @ r) / df if df > 0 else math.nan
    se = np.sqrt(s2 * inverse.diagonal())
    return b, se, r, s2, df


def _irls(y: np.ndarray, x: np.ndarray, maxit: int = 25):
    b = np.zeros(x.shape[1])
    was = np.inf
    for _ in range(maxit):
        eta = np.clip(x @ b, -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        w = np.maximum(mu * (1 - mu), 1e-12)
        inverse = _solve((x * w[:, None]).T @ x)
        b = inverse @ (x.T @ (w * eta + y - mu))
        eta = np.clip(x @ b, -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        dev = -2 * float((y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum())
        if abs(dev - was) < 1e-9 * (abs(dev) + 0.1):
            break
        was = dev
    mu = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return b, np.sqrt(_solve((x * (mu * (1 - mu))[:, None]).T @ x).diagonal()), mu, dev


NULLS = ("qap", "qapspp", "qapy", "qapx", "qapallx", "cugtie", "cugden", "cuguman", "classical")


def _design(ys: np.ndarray, xs: list[np.ndarray], intercept: bool, directed: bool, diag: bool):
    y = _column(ys, directed, diag)
    x = np.stack(([np.ones(len(y))] if intercept else []) + [_column(m, directed, diag) for m in xs], 1)
    ok = ~np.isnan(y) & ~np.isnan(x).any(1)
    return y[ok], x[ok]


def normal_equations(y: Graph, x: Graph) -> DataFrame:
    """Cross-products of y and the graphs of x over all cells, by one join and one aggregate: the terms
    (a, b, value) of X'X and X'y ('y' and 'x<k>' name the graphs, '1' the intercept)."""
    cells = y.grid.where("not missing").select("src", "dst", F.struct(F.lit("y").alias("k"), F.col("weight").alias("v")).alias("t"))
    xs = x.grid.where("not missing").select("src", "dst", F.struct(F.concat(F.lit("x"), F.col("graph_id").cast("string")).alias("k"), F.col("weight").alias("v")).alias("t"))
    one = y.pairs.select("src", "dst", F.struct(F.lit("1").alias("k"), F.lit(1.0).alias("v")).alias("t"))
    t = cells.unionByName(xs).unionByName(one)
    full = 2 + x.vertices.select("graph_id").distinct().count()
    rows = t.groupBy("src", "dst").agg(F.collect_list("t").alias("t")).where(F.size("t") == full)  # listwise complete; a row is one cell's few terms
    return rows.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("value"))


def _network_regression(y: Graph, x: Graph, *, fit: Callable, intercept: bool, nullhyp: str, statistic: str, reps: int, seed: int, diag: bool) -> tuple[Fit, np.ndarray, np.ndarray]:
    """The observed fit and its null distribution. Rows of the null are (predictor, replicate)."""
    if nullhyp not in NULLS:
        raise ValueError(f"unknown null hypothesis {nullhyp}")
    directed, spark = y.directed, y.vertices.sparkSession
    ym, xm = y.local().values(), [m.values() for m in x.locals()]
    yv, xv = _design(ym, xm, intercept, directed, diag)
    b, se = fit(yv, xv)[:2]
    stat = b / se if statistic == "t-value" else b
    names = (["(intercept)"] if intercept else []) + [f"x{i + 1}" for i in range(len(xm))]
    if nullhyp == "classical":
        return Fit(names, b, se, b / se, *(np.full(len(b), np.nan) for _ in range(3))), yv, xv
    if nullhyp in ("qap", "qapspp") and len(xm) == 1:
        nullhyp = "qapy"
    first = int(intercept)
    targets = list(range(len(xm))) if nullhyp in ("qap", "qapspp", "qapx") else [-1]

    def one(k: int, rep: int) -> list[float]:
        r = rng(seed, k + 1, rep)
        yy, xx = ym, list(xm)
        if nullhyp == "qapy":
            yy = shuffled(ym, r)
        elif nullhyp == "qapallx":
            xx = [shuffled(m, r) for m in xm]
        elif nullhyp == "qapx":
            xx[k] = shuffled(xm[k], r)
        elif nullhyp in ("cugtie", "cugden", "cuguman"):
            mode = {"cugtie": "edges", "cugden": "density", "cuguman": "dyad.census"}[nullhyp]
            xx = [draw_graph(m, mode, directed, r, valued=mode == "edges") for m in xm]
        else:  # double semi-partialling: permute the residuals of predictor k on the others
            others = [m for i, m in enumerate(xm) if i != k]
            keep = ~np.eye(len(ym), dtype=bool) | diag
            z = np.stack(([np.ones(keep.sum())] if intercept else []) + [m[keep] for m in others], 1)
            ok = ~np.isnan(z).any(1) & ~np.isnan(xm[k][keep])
            e = np.full(keep.sum(), np.nan)
            coef = np.linalg.lstsq(z[ok], xm[k][keep][ok], rcond=None)[0] if z.shape[1] else np.empty(0)
            e[ok] = xm[k][keep][ok] - (z[ok] @ coef if len(coef) else 0)
            residual = np.full(ym.shape, np.nan)
            residual[keep] = e
            xx[k] = shuffled(np.where(np.eye(len(ym), dtype=bool) & ~keep, 0, residual), r)
        try:
            b1, s1 = fit(*_design(yy, xx, intercept, directed, diag))[:2]
        except (ValueError, np.linalg.LinAlgError):
            return [math.nan] * (len(xm) + first)
        return (b1 / s1 if statistic == "t-value" else b1).tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"k": p["k"], "rep": p["rep"], "value": [one(int(k), int(i)) for k, i in zip(p["k"], p["rep"], strict=True)]})

    rows = spark.range(0, len(targets) * reps, 1, max(1, min(reps, spark.sparkContext.defaultParallelism * 2))).selectExpr(f"element_at(array({','.join(map(str, targets))}), cast(id div {reps} as int) + 1) as k", f"id % {reps} as rep")
    null = rows.mapInPandas(run, "k int, rep long, value array<double>").toPandas()
    values = {k: np.array(v["value"].tolist(), float) for k, v in null.groupby("k")}
    le, ge, two = np.full(len(b), np.nan), np.full(len(b), np.nan), np.full(len(b), np.nan)
    for i in range(len(b)):
        k = i - first
        d = values[-1][:, i] if -1 in values else values[k][:, i] if k >= 0 else np.concatenate([v[:, i] for v in values.values()])
        d = d[~np.isnan(d)]
        if len(d):
            le[i], ge[i], two[i] = (d <= stat[i]).mean(), (d >= stat[i]).mean(), (np.abs(d) >= abs(stat[i])).mean()
    return Fit(names, b, se, stat, le, ge, two, {"null": values}), yv, xv


def netlm(y: Graph, x: Graph, *, intercept: bool = True, nullhyp: str = "qap", test_statistic: str = "t-value", reps: int = 1000, seed: int = 0, diag: bool = False) -> Fit:
    """Ordinary least squares of one graph's cells on those of a stack. Collinear predictors are refused."""
    f, yv, xv = _network_regression(y, x, fit=_ols, intercept=intercept, nullhyp=nullhyp, statistic=test_statistic, reps=reps, seed=seed, diag=diag)
    b, se, r, s2, df = _ols(yv, xv)
    if nullhyp == "classical":
        f.p_two = np.array([t_two_sided(t, df) for t in f.statistic])
        f.p_le = np.where(f.statistic < 0, f.p_two / 2, 1 - f.p_two / 2)
        f.p_ge = 1 - f.p_le
    base = yv - yv.mean() if intercept else yv
    r2 = 1 - (r @ r) / (base @ base) if base @ base else math.nan
    p = xv.shape[1]
    f.extra |= {"r2": r2, "adj_r2": 1 - (1 - r2) * (len(yv) - int(intercept)) / df if df > 0 else math.nan, "sigma": math.sqrt(s2) if s2 == s2 else math.nan, "df": df, "n": len(yv), "f": (r2 / max(1, p - int(intercept))) / ((1 - r2) / df) if df > 0 and r2 < 1 else math.nan, "residuals": r}
    return f


def netlogit(y: Graph, x: Graph, *, intercept: bool = True, nullhyp: str = "qap", test_statistic: str = "t-value", reps: int = 1000, seed: int = 0, diag: bool = False, maxit: int = 25) -> Fit:
    """Logistic regression by reweighted least squares; the null deviance is 2 n ln 2 on n degrees."""
    fit = lambda a, b: _irls(a, b, maxit)
    f, yv, xv = _network_regression(y, x, fit=fit, intercept=intercept, nullhyp=nullhyp, statistic=test_statistic, reps=reps, seed=seed, diag=diag)
    b, se, mu, dev = _irls(yv, xv, maxit)
    n, p = xv.shape
    if nullhyp == "classical":
        f.p_two = np.array([t_two_sided(t, n - p) for t in f.statistic])
        f.p_le = np.where(f.statistic < 0, f.p_two / 2, 1 - f.p_two / 2)
        f.p_ge = 1 - f.p_le
    f.extra |= {"deviance": dev, "null_deviance": 2 * n * math.log(2), "df_null": n, "df_residual": n - p, "aic": dev + 2 * p, "bic": dev + math.log(n) * p, "fitted": mu}
    return f


def netcancor(y: Graph, x: Graph, *, nullhyp: str = "cugtie", reps: int = 1000, seed: int = 0, diag: bool = False) -> dict:
    """Canonical correlations of two sets of graphs, by whitening and singular values, and tail shares."""
    directed, spark = y.directed, y.vertices.sparkSession
    ym, xm = [m.values() for m in y.locals()], [m.values() for m in x.locals()]

    def stack(ms):
        return np.stack([_column(m, directed, diag) for m in ms], 1)

    def white(a):
        values, vectors = np.linalg.eigh(np.cov(a.T).reshape(a.shape[1], -1))
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T

    def fit(a, b):
        ok = ~np.isnan(a).any(1) & ~np.isnan(b).any(1)
        a, b = a[ok] - a[ok].mean(0), b[ok] - b[ok].mean(0)
        wa, wb = white(a), white(b)
        u, s, vt = np.linalg.svd(wa @ (a.T @ b / (len(a) - 1)) @ wb)
        k = min(a.shape[1], b.shape[1])
        return np.clip(s[:k], 0, 1), wa @ u[:, :k], wb @ vt.T[:, :k]

    cor, cx, cy = fit(stack(xm), stack(ym))
    mode = {"cugtie": "edges", "cugden": "density", "cuguman": "dyad.census"}.get(nullhyp)

    def run(parts):
        for p in parts:
            out = []
            for i in p["id"]:
                r = rng(seed, int(i))
                xx = [shuffled(m, r) for m in xm] if mode is None else [draw_graph(m, mode, directed, r, valued=mode == "edges") for m in xm]
                yy = ym if mode is None else [draw_graph(m, mode, directed, r, valued=mode == "edges") for m in ym]
                out.append(fit(stack(xx), stack(yy))[0].tolist())
            yield pd.DataFrame({"rep": p["id"], "value": out})

    null = np.array(spark.range(0, reps, 1, max(1, min(reps, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, "rep long, value array<double>").orderBy("rep").toPandas()["value"].tolist(), float).reshape(reps, len(cor))
    return {"cor": cor, "xcoef": cx, "ycoef": cy, "p_le": (null <= cor).mean(0) if reps else np.full(len(cor), np.nan), "p_ge": (null >= cor).mean(0) if reps else np.full(len(cor), np.nan), "null": null}


def nacf(g: Graph, y: DataFrame, *, lag_max: int | None = None, kind: str = "correlation", neighborhood_type: str = "in", partial: bool = True, demean: bool = True) -> DataFrame:
    """lag, nacf: covariance, correlation, moran or geary of y (vid, y) over pairs at each distance (up to it if not partial)."""
    from .paths import neighborhood

    n = g.orders.first()["n"]
    lag_max = n - 1 if lag_max is None else lag_max
    m = y.agg(F.avg("y").alias("mean"))
    z = y.crossJoin(F.broadcast(m)).select("vid", (F.col("y") - (F.col("mean") if demean or kind == "moran" else F.lit(0.0))).alias("z"), "y")  # one row
    s = z.agg(F.sum(F.col("z") * F.col("z")), F.sum((F.col("z") - 0) * F.col("z")), F.var_samp("y")).first()
    ss, var = float(s[0] or 0), s[2]
    p = neighborhood(g, max(1, lag_max), kind=neighborhood_type, partial=not partial, return_all=True)
    if partial:
        p = neighborhood(g, max(1, lag_max), kind=neighborhood_type, partial=False, return_all=True)
    j = p.join(z.select("vid", F.col("z").alias("a")), "vid").join(z.select(F.col("vid").alias("neighbor"), F.col("z").alias("b")), "neighbor")
    a = j.groupBy(F.col("order").alias("lag")).agg(F.count("*").alias("e"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum((F.col("a") - F.col("b")) ** 2).alias("dd"))
    spark = g.vertices.sparkSession
    lags = spark.range(0, lag_max + 1).select(F.col("id").cast("int").alias("lag"))
    e, v, total = F.col("e"), F.lit(float(var) if var is not None else math.nan), F.lit(ss)
    at0 = {"covariance": F.lit(ss / n), "correlation": fdiv(F.lit(ss / n), v), "moran": F.lit(1.0), "geary": F.lit(0.0)}[kind]
    at = {"covariance": fdiv("ab", e), "correlation": fdiv(fdiv("ab", e), v), "moran": fdiv(F.lit(n) * F.col("ab"), e * total), "geary": fdiv((n - 1) * F.col("dd"), 2 * e * total)}[kind]
    return lags.join(a, "lag", "left").select("lag", F.when(F.col("lag") == 0, at0).when(e.isNull(), 0.0).otherwise(at).alias("nacf"))


# p* ---------------------------------------------------------------------------------------


def _off(m: Local) -> np.ndarray:
    return m.a & ~np.eye(m.n, dtype=bool)


def _closed(m: Local) -> tuple[float, float, float]:
    """Closed two-paths, all two-paths, and triples with neither a two-path nor a tie."""
    a = _off(m)
    two = a.astype(float) @ a
    np.fill_diagonal(two, 0)
    off = ~np.eye(m.n, dtype=bool)
    return float((two * a).sum()), float(two.sum()), float(((m.n - 2) - two)[off & ~a].sum())


def _central(x: np.ndarray, most: float) -> float:
    return float((x.max() - x).sum() / most) if len(x) and most else 0.0


def _betweenness(m: Local) -> np.ndarray:
    i, j = np.nonzero(_off(m))
    return accumulate(CSR.of(m.n, i, j), range(m.n), "standard") / (1 if m.directed else 2)


def _closeness(m: Local) -> np.ndarray:
    i, j = np.nonzero(_off(m))
    csr = CSR.of(m.n, i, j)
    return np.array([(m.n - 1) / d.sum() if len(d) == m.n and m.n > 1 else 0.0 for d in (paths_from(csr, s)[1] for s in range(m.n))])


def _recip(m: Local) -> float:
    a = _off(m)
    i, j = np.triu_indices(m.n, 1)
    return float((a[i, j] == a[j, i]).mean()) if len(i) else math.nan


def _weak(m: Local) -> np.ndarray:
    return np.bincount(weak_components(_off(m)))


def _connected(m: Local) -> float:
    s = _weak(m)
    return float((s * (s - 1)).sum() / (m.n * (m.n - 1))) if m.n > 1 else 1.0


def _asymmetric(m: Local) -> float:
    a = _off(m)
    i, j = np.triu_indices(m.n, 1)
    return float((a[i, j] != a[j, i]).mean()) if len(i) else math.nan


def _efficient(m: Local) -> float:
    s = _weak(m)
    most = (s * (s - 1) - (s - 1)).sum()
    return float(1 - (m.w[_off(m)].sum() - (s - 1).sum()) / most) if most else math.nan


def _lub(m: Local) -> float:
    r, label = reach(m.a), weak_components(m.a)
    bad = most = 0
    for k in range(label.max(initial=-1) + 1):
        v = np.flatnonzero(label == k)
        if len(v) < 3:
            continue
        most += (len(v) - 1) * (len(v) - 2) / 2
        for x, i in enumerate(v):
            for j in v[x + 1 :]:
                bounds = np.flatnonzero(r[:, i] & r[:, j])
                bad += not any(r[bounds, b].all() for b in bounds)
    return 1 - bad / most if most else 1.0


#: Graph statistics whose change with a tie is a regressor; a vector gives one regressor a vertex.
EFFECTS: dict[str, Callable[[Local], float | np.ndarray]] = {
    "mutuality": lambda m: float((_off(m) & _off(m).T).sum() / 2),
    "density": lambda m: float(m.w[~np.eye(m.n, dtype=bool)].sum() / max(1, m.n * (m.n - 1))),
    "reciprocity": _recip,
    "stransitivity": lambda m: (lambda c: (c[0] + c[2]) / max(1, m.n * (m.n - 1) * (m.n - 2)))(_closed(m)),
    "wtransitivity": lambda m: (lambda c: c[0] / c[1] if c[1] else 1.0)(_closed(m)),
    "stranstri": lambda m: (lambda c: c[0] + c[2])(_closed(m)),
    "wtranstri": lambda m: _closed(m)[0],
    "outdegree": lambda m: m.w.sum(1),
    "indegree": lambda m: m.w.sum(0),
    "betweenness": _betweenness,
    "closeness": _closeness,
    "degcentralization": lambda m: _central(m.w.sum(0) + m.w.sum(1), (m.n - 1) * (2 * (m.n - 1) - 2)),
    "betcentralization": lambda m: _central(_betweenness(m), (m.n - 1) ** 2 * (m.n - 2) / (1 if m.directed else 2)),
    "clocentralization": lambda m: _central(_closeness(m), (m.n - 1) * (1 - 1 / m.n)),
    "connectedness": _connected,
    "hierarchy": _asymmetric,
    "lubness": _lub,
    "efficiency": _efficient,
}


def pstar(g: Graph, effects: list[str] | None = None, *, attr: dict[str, list] | None = None, memb: dict[str, list] | None = None) -> Fit:
    """Logistic pseudo-likelihood on change scores; p-values are normal. Rows are cells, spread over the cluster.

    effects: "choice" (a constant) and names in ``EFFECTS``; attr adds absolute differences, memb equality."""
    names = effects or ["choice", "mutuality", "wtranstri"]
    if bad := set(names) - set(EFFECTS) - {"choice"}:
        raise ValueError(f"unknown effects {sorted(bad)}")
    m = g.local()
    cells = [(i, j) for i in range(m.n) for j in range(m.n) if (i != j if g.directed else i > j)]
    spark = g.vertices.sparkSession
    rows = spark.createDataFrame(cells, "i int, j int").repartition(spark.sparkContext.defaultParallelism * 2, "i", "j")
    attr, memb = attr or {}, memb or {}

    def scores(i: int, j: int) -> list[float]:
        x = []
        for k in names:
            x += [1.0] if k == "choice" else np.atleast_1d(perturb(m, i, j, EFFECTS[k])).tolist()
        x += [abs(float(v[i]) - float(v[j])) for v in attr.values()]
        x += [float(v[i] == v[j]) for v in memb.values()]
        return [v if math.isfinite(v) else 0.0 for v in x]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = [(int(i), int(j)) for i, j in zip(p["i"], p["j"], strict=True) if not m.na[i, j]]
            yield pd.DataFrame({"y": [float(m.w[c] > 0) for c in at], "x": [scores(*c) for c in at]})

    d = rows.mapInPandas(run, "y double, x array<double>").toPandas()
    x, y = np.array(d["x"].tolist(), float), d["y"].to_numpy()
    labels = [z for k in names for z in ([f"{k}.{v}" for v in m.vid] if k in ("outdegree", "indegree", "betweenness", "closeness") else [k])] + list(attr) + list(memb)
    b, se, _, dev = _irls(y, x)
    z = b / se
    two = np.array([normal_two_sided(v) for v in z])
    return Fit(labels, b, se, z, np.where(z < 0, two / 2, 1 - two / 2), np.where(z < 0, 1 - two / 2, two / 2), two, {"deviance": dev, "n": len(y)})


def eval_edgeperturbation(g: Graph, i: int, j: int, fn: Callable[[Local], float]) -> float:
    return perturb(g.local(), i, j, fn)


# Linear network autocorrelation -----------------------------------------------------------


def nelder_mead(f: Callable, x0: np.ndarray, *, step: float = 0.1, tol: float = 1e-10, maxit: int = 4000) -> tuple[np.ndarray, float]:
    """Downhill simplex."""
    n = len(x0)
    s = [np.array(x0, float)] + [np.array(x0, float) + step * np.eye(n)[i] for i in range(n)]
    v = [f(x) for x in s]
    for _ in range(maxit):
        o = np.argsort(v, kind="stable")
        s, v = [s[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) <= tol * (abs(v[0]) + tol) and max(np.abs(x - s[0]).max() for x in s) < 1e-8:
            break
        c = np.mean(s[:-1], axis=0)
        r = c + (c - s[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - s[-1])
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < v[-1] else s[-1]) - c)
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s = [s[0]] + [s[0] + 0.5 * (x - s[0]) for x in s[1:]]
                v = [v[0]] + [f(x) for x in s[1:]]
    i = int(np.argmin(v))
    return s[i], v[i]


def _hessian(f: Callable, x: np.ndarray, relative: float = 1e-3) -> np.ndarray:
    """Second differences, with steps in proportion to the parameters."""
    n = len(x)
    h = relative * np.maximum(np.abs(x), 1e-3)
    if len(x):
        h[-1] = relative * abs(x[-1])  # a variance: stays positive
    e = np.diag(h)
    return np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h[i] * h[j]) for j in range(n)] for i in range(n)])


@dataclass
class Lnam:
    beta: np.ndarray
    rho1: np.ndarray
    rho2: np.ndarray
    sigma: float
    se: np.ndarray
    log_likelihood: float
    df: int
    residuals: np.ndarray
    sigma_se: float = math.nan

    @property
    def coefficients(self) -> np.ndarray:
        return np.concatenate([self.beta, self.rho1, self.rho2])


def lnam(y, x=None, w1: list[np.ndarray] | None = None, w2: list[np.ndarray] | None = None) -> Lnam:
    """y = rho1 W1 y + X beta + e, e = rho2 W2 e + nu: maximum likelihood, beta and sigma profiled out."""
    y = np.asarray(y, float)
    n = len(y)
    x = np.empty((n, 0)) if x is None else np.asarray(x, float).reshape(n, -1)
    w1, w2 = [np.asarray(w, float) for w in (w1 or [])], [np.asarray(w, float) for w in (w2 or [])]

    def parts(rho):
        a = np.eye(n) - sum((r * w for r, w in zip(rho[: len(w1)], w1, strict=True)), np.zeros((n, n)))
        b = np.eye(n) - sum((r * w for r, w in zip(rho[len(w1) :], w2, strict=True)), np.zeros((n, n)))
        z, bx = b @ a @ y, b @ x
        beta = np.linalg.lstsq(bx, z, rcond=None)[0] if x.shape[1] else np.empty(0)
        e = z - bx @ beta
        return a, b, beta, e, float(e @ e) / n

    def loss(rho):
        a, b, _, _, s2 = parts(rho)
        da, db = np.linalg.slogdet(a), np.linalg.slogdet(b)
        if da[0] <= 0 or db[0] <= 0 or s2 <= 0:
            return 1e10
        return n / 2 * math.log(2 * math.pi * s2) + n / 2 - da[1] - db[1]

    k = len(w1) + len(w2)
    rho, value = nelder_mead(loss, np.zeros(k)) if k else (np.empty(0), loss(np.empty(0)))
    a, b, beta, e, s2 = parts(rho)

    def full(t):
        p = x.shape[1]
        aa = np.eye(n) - sum((r * w for r, w in zip(t[p : p + len(w1)], w1, strict=True)), np.zeros((n, n)))
        bb = np.eye(n) - sum((r * w for r, w in zip(t[p + len(w1) : p + k], w2, strict=True)), np.zeros((n, n)))
        u = bb @ (aa @ y - x @ t[:p])
        return n / 2 * math.log(2 * math.pi * t[-1]) + float(u @ u) / (2 * t[-1]) - np.linalg.slogdet(aa)[1] - np.linalg.slogdet(bb)[1]

    theta = np.concatenate([beta, rho, [s2]])
    cov = np.linalg.pinv(_hessian(full, theta))
    se = np.sqrt(np.maximum(cov.diagonal(), 0))
    return Lnam(beta, rho[: len(w1)], rho[len(w1) :], math.sqrt(s2), se[:-1], -value, n - len(theta), a @ y - x @ beta, se[-1] ** 2 / (4 * s2))


def coef_lnam(fit: Lnam) -> np.ndarray:
    return fit.coefficients


def se_lnam(fit: Lnam) -> np.ndarray:
    return fit.se
