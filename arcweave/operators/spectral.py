"""Eigenvector, power, information centrality, prestige, and centralization."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fdiv
from ..graph import Graph, Local
from ..sources.shared import materialize
from .connectivity import _by_graph
from .paths import betweenness, closeness, geodist, gilschmidt, graphcent, loadcent, stresscent


def _leading(w: np.ndarray, tol: float = 1e-10, maxiter: int = 100_000) -> np.ndarray:
    """Leading eigenvector, unit length, largest entry positive: power method, else a dense solver."""
    n = len(w)
    if not n or not w.any():
        return np.full(n, np.nan)
    x = np.full(n, 1 / np.sqrt(n))
    for _ in range(min(maxiter, 5000)):
        y = w @ x
        size = np.linalg.norm(y)
        if size == 0:
            break
        y /= size
        if np.linalg.norm(y - x) < tol:
            x = y
            break
        x = y
    else:
        values, vectors = np.linalg.eigh(w) if np.array_equal(w, w.T) else np.linalg.eig(w)
        x = np.real(vectors[:, np.argmax(np.real(values))])
        x = x / np.linalg.norm(x)
    return x if x[np.argmax(np.abs(x))] >= 0 else -x


def evcent(g: Graph, *, ignore_eval: bool = False, rescale: bool = False, transpose: bool = False) -> DataFrame:
    """graph_id, vid, evcent; NaN in a graph without ties."""

    def fn(m: Local) -> pd.DataFrame:
        w = np.where(m.a, 1.0 if ignore_eval else m.w, 0.0)
        x = _leading(w.T if transpose else w)
        return pd.DataFrame({"vid": m.vid, "evcent": x / x.sum() if rescale else x})

    return _by_graph(g, "graph_id long, vid long, evcent double", fn)


def evcent_joins(g: Graph, *, rounds: int = 100, tol: float = 1e-8) -> DataFrame:
    """The power method by joins: for graphs beyond one process (one graph, values as they are)."""
    e = materialize(g.ties.select("src", "dst", "weight"))
    x = materialize(g.vertices.select("vid", F.lit(1.0).alias("x")))
    for _ in range(rounds):
        y = e.join(x, F.col("dst") == F.col("vid")).groupBy("src").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if not size:
            return x.withColumn("x", F.lit(float("nan"))).withColumnRenamed("x", "evcent")
        was, x = x, materialize(g.vertices.select("vid").join(y.withColumnRenamed("src", "vid"), "vid", "left").select("vid", (F.coalesce("y", F.lit(0.0)) / size).alias("x")))
        moved = x.join(was.withColumnRenamed("x", "was"), "vid").agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0]
        if moved is None or moved < tol:
            return x.withColumnRenamed("x", "evcent")
    raise RuntimeError(f"no fixed direction after {rounds} rounds")


def bonpow(g: Graph, *, exponent: float = 1.0, rescale: bool = False, tol: float = 1e-7) -> DataFrame:
    """(I - bW)^-1 W 1, scaled to a sum of squares of n."""

    def fn(m: Local) -> pd.DataFrame:
        a = np.eye(m.n) - exponent * m.w
        if np.linalg.matrix_rank(a, tol=tol) < m.n:
            raise ValueError("the power system is singular at this exponent")
        x = np.linalg.solve(a, m.w.sum(1))
        x = x * np.sqrt(m.n / (x * x).sum()) if (x * x).sum() else x
        return pd.DataFrame({"vid": m.vid, "bonpow": x / x.sum() if rescale else x})

    return _by_graph(g, "graph_id long, vid long, bonpow double", fn)


def infocent(g: Graph, cmode: str = "weak", *, rescale: bool = False) -> DataFrame:
    """Information centrality; isolates have 0 and are left out of the system."""

    def fn(m: Local) -> pd.DataFrame:
        w, a = m.w, m.a
        if not np.array_equal(w, w.T):
            pick = {"weak": np.maximum, "strong": np.minimum}.get(cmode)
            if pick is not None:
                a = (a | a.T) if cmode == "weak" else (a & a.T)
                w = np.where(a, 1.0, 0.0)
            else:
                tri = np.triu(w, 1) if cmode == "upper" else np.tril(w, -1)
                w = tri + tri.T
                a = w != 0
        on = (a & ~np.eye(m.n, dtype=bool)).any(1)
        x = np.zeros(m.n)
        if on.any():
            w, a, n = w[np.ix_(on, on)], a[np.ix_(on, on)], int(on.sum())
            s = np.where(a, 1 - w, 1.0)
            np.fill_diagonal(s, 1 + w.sum(1) - w.diagonal())
            c = np.linalg.inv(s)
            x[on] = 1 / (c.diagonal() + (np.trace(c) - 2 * c.sum(1)) / n)
        return pd.DataFrame({"vid": m.vid, "infocent": x / x.sum() if rescale else x})

    return _by_graph(g, "graph_id long, vid long, infocent double", fn)


PRESTIGE = ("indegree", "indegree.rownorm", "indegree.rowcolnorm", "eigenvector", "eigenvector.rownorm", "eigenvector.colnorm", "eigenvector.rowcolnorm", "domain", "domain.proximity")


def prestige(g: Graph, cmode: str = "indegree", *, rescale: bool = False) -> DataFrame:
    """graph_id, vid, prestige."""
    from .local import degree
    from .paths import _rescaled
    from .prep import make_stochastic

    if cmode not in PRESTIGE:
        raise ValueError(f"unknown mode {cmode}")
    base, _, norm = cmode.partition(".")
    if norm.endswith("norm"):
        g = make_stochastic(g, {"rownorm": "row", "colnorm": "col", "rowcolnorm": "rowcol"}[norm])
    if base == "indegree":
        d = degree(replace(g, directed=True), "indegree").withColumnRenamed("degree", "prestige")
    elif base == "eigenvector":
        d = evcent(g, transpose=True).withColumnRenamed("evcent", "prestige")
    else:
        s = geodist(g).groupBy("graph_id", F.col("dst").alias("vid")).agg(F.count("*").alias("r"), F.sum("dist").alias("far"))
        j = g.vertices.select("graph_id", "vid").join(s, ["graph_id", "vid"]).join(g.orders, "graph_id")
        r = F.col("r") - 1
        x = r.cast("double") if cmode == "domain" else F.when(r == 0, 0.0).otherwise(fdiv(r * r, F.col("far") * (F.col("n") - 1)))
        d = j.select("graph_id", "vid", x.alias("prestige"))
    return _rescaled(d.select("graph_id", "vid", "prestige"), "prestige", rescale)


# Centralization --------------------------------------------------------------------------


def _most_degree(g: Graph, n: int, cmode: str = "freeman", **_) -> float:
    d = int(g.loops)
    if not g.directed:
        return (n - 1) * (n - 2 + d)
    return (n - 1) * (2 * (n - 1) - 2 + d) if cmode == "freeman" else (n - 1) * (n - 1 + d)


def _most_closeness(g: Graph, n: int, cmode: str = "directed", **_) -> float:
    if not g.directed:
        cmode = {"directed": "undirected", "suminvdir": "suminvundir"}.get(cmode, cmode)
    return {"directed": (n - 1) * (1 - 1 / n), "undirected": (n - 2) * (n - 1) / (2 * n - 3) if n > 1 else 0, "suminvdir": (n - 1) ** 2, "suminvundir": n - 1 - n / 2, "gil-schmidt": (n - 1) if g.directed else (n - 2) / 2}[cmode]


def _most_paths(g: Graph, n: int, cmode: str = "directed", **_) -> float:
    return (n - 1) ** 2 * (n - 2) / (1 if g.directed and cmode != "undirected" else 2)


def _star(g: Graph, n: int) -> Graph:
    spark = g.vertices.sparkSession
    m = np.zeros((n, n))
    m[0, 1:] = 1
    return Graph.from_matrix(spark, (m if g.directed else m + m.T).tolist(), directed=g.directed, loops=g.loops)


def _from_star(measure: Callable, score: str):
    def most(g: Graph, n: int, **kw) -> float:
        x = [r[score] for r in measure(_star(g, n), **kw).collect()]
        return max(x) * len(x) - sum(x)

    return most


def _most_betweenness(g: Graph, n: int, cmode: str = "directed", **_) -> float:
    return _most_paths(g, n, cmode) if cmode in ("directed", "undirected") else _from_star(betweenness, "betweenness")(g, n, cmode=cmode)


def _most_infocent(g: Graph, n: int, **kw) -> float:
    m = np.zeros((n, n))
    m[0, 1] = m[1, 0] = 1
    x = [r["infocent"] for r in infocent(Graph.from_matrix(g.vertices.sparkSession, m.tolist(), directed=g.directed)).collect()]
    return max(x) * n - sum(x)


def _most_prestige(g: Graph, n: int, cmode: str = "indegree", **_) -> float:
    if cmode.startswith("indegree"):
        return _most_degree(replace(g, directed=g.directed), n, "indegree")
    if cmode.startswith("domain"):
        return (n - 1) ** 2
    return (n - 1) if g.directed else np.sqrt(2) / 2 * (n - 2)


def _measures():
    from .connectivity import flowbet
    from .local import degree

    return {
        "degree": (degree, "degree", _most_degree),
        "closeness": (closeness, "closeness", _most_closeness),
        "betweenness": (betweenness, "betweenness", _most_betweenness),
        "stresscent": (stresscent, "stress", _most_paths),
        "loadcent": (loadcent, "load", _most_paths),
        "graphcent": (graphcent, "graphcent", lambda g, n, **_: (n - 1) * (1 - 1 / n) if g.directed else (n - 1) / 2),
        "gilschmidt": (gilschmidt, "gilschmidt", lambda g, n, **_: (n - 1) if g.directed else (n - 2) / 2),
        "evcent": (evcent, "evcent", lambda g, n, **_: (n - 1) if g.directed else np.sqrt(2) / 2 * (n - 2)),
        "bonpow": (bonpow, "bonpow", lambda g, n, **_: np.sqrt(n) * (n - 1) if g.directed else (n - 2) * np.sqrt(n / 2)),
        "infocent": (infocent, "infocent", _most_infocent),
        "flowbet": (flowbet, "flowbet", lambda g, n, cmode="rawflow", **_: (n - 1) if cmode == "normflow" else (n - 1) ** 2 * (n - 2) / (1 if g.directed else 2)),
        "prestige": (prestige, "prestige", _most_prestige),
    }


def theoretical_max_deviation(g: Graph, measure: str, n: int, **options) -> float:
    return float(_measures()[measure][2](g, n, **options))


def centralization(g: Graph, measure: str | Callable[..., DataFrame], *, normalize: bool = True, score: str | None = None, most: float | None = None, **options) -> float:
    """Freeman's sum of max - score, over the theoretical maximum if normalized; a maximum of 0 gives 0."""
    if isinstance(measure, str):
        if measure not in _measures():
            raise ValueError(f"unknown measure {measure}")
        fn, score, _ = _measures()[measure]
    else:
        fn = measure
    n, top, total = fn(g, **options).agg(F.count("*"), F.max(score), F.sum(score)).first()
    dev = (top or 0.0) * n - (total or 0.0)
    if not normalize:
        return float(dev)
    most = most if most is not None else theoretical_max_deviation(g, measure, n, **options)
    return float(dev / most) if most else 0.0
