"""Permutation and conditional-uniform-graph tests. Rows are replicates; each has its own
generator from (seed, replicate), so that results do not depend on partitions or retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rng
from ..graph import Graph, Local


@dataclass
class NullTest:
    """observed, and the distribution (rep, value) under the null."""

    observed: float
    reps: DataFrame
    kind: str = ""

    def tails(self) -> tuple[float, float]:
        """Shares of replicates at least, and at most, the observed value."""
        r = self.reps.agg(F.avg((F.col("value") >= self.observed).cast("double")), F.avg((F.col("value") <= self.observed).cast("double"))).first()
        return tuple(float("nan") if x is None else float(x) for x in r)


def replicate(spark: SparkSession, reps: int, fn: Callable[[np.random.Generator], float], seed: int) -> DataFrame:
    """rep, value of fn with each replicate's generator, spread over the cluster."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"rep": p["id"], "value": [float(fn(rng(seed, int(i)))) for i in p["id"]]})

    return spark.range(0, reps, 1, max(1, min(reps, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, "rep long, value double")


def density(m: np.ndarray, directed: bool = True) -> float:
    n = len(m)
    off = m[~np.eye(n, dtype=bool)]
    return float(np.nansum(off) / max(1, (~np.isnan(off)).sum()))


def reciprocity(m: np.ndarray, directed: bool = True) -> float:
    a = m != 0
    i, j = np.triu_indices(len(a), 1)
    return float((a[i, j] == a[j, i]).mean()) if len(i) else float("nan")


def transitivity(m: np.ndarray, directed: bool = True) -> float:
    a = (m != 0) & ~np.eye(len(m), dtype=bool)
    two = a.astype(float) @ a
    np.fill_diagonal(two, 0)
    return float((two * a).sum() / two.sum()) if two.sum() else 1.0


def correlation(a: np.ndarray, b: np.ndarray, directed: bool = True) -> float:
    keep = ~np.eye(len(a), dtype=bool) if directed else np.tril(np.ones(a.shape, bool), -1)
    x, y = a[keep], b[keep]
    ok = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[ok] - x[ok].mean(), y[ok] - y[ok].mean()
    s = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / s) if s else float("nan")


def hamming(a: np.ndarray, b: np.ndarray, directed: bool = True) -> float:
    keep = ~np.eye(len(a), dtype=bool) if directed else np.tril(np.ones(a.shape, bool), -1)
    return float(np.nansum(np.abs(a - b)[keep]))


#: Statistics by name: of one graph, and of two.
ONE = {"gden": density, "grecip": reciprocity, "gtrans": transitivity}
TWO = {"gcor": correlation, "hdist": hamming}


def shuffled(m: np.ndarray, r: np.random.Generator) -> np.ndarray:
    p = r.permutation(len(m))
    return m[np.ix_(p, p)]


def _pair(g: Graph, g1: int, g2: int) -> tuple[Local, Local]:
    return g.local(g1), g.local(g2)


def qaptest(g: Graph, statistic: str | Callable = "gcor", *, g1: int = 0, g2: int = 1, reps: int = 1000, seed: int = 0) -> NullTest:
    """The statistic of two graphs against relabellings of the second."""
    fn = TWO[statistic] if isinstance(statistic, str) else statistic
    a, b = (m.values() for m in _pair(g, g1, g2))
    directed = g.directed
    return NullTest(fn(a, b, directed), replicate(g.vertices.sparkSession, reps, lambda r: fn(a, shuffled(b, r), directed), seed), "qap")


def draw_graph(like: np.ndarray, cmode: str, directed: bool, r: np.random.Generator, *, valued: bool = False) -> np.ndarray:
    """A conditional-uniform draw: given size, density, number of edges, or the dyad census."""
    n = len(like)
    cells = [(i, j) for i in range(n) for j in range(n) if (i != j if directed else i > j)]
    at = tuple(np.array(cells).T) if cells else (np.empty(0, int), np.empty(0, int))
    out = np.zeros((n, n))
    observed = np.nan_to_num(like)[at]
    if cmode in ("order", "size"):
        out[at] = r.choice(observed, len(observed)) if valued and len(observed) else (r.random(len(observed)) < 0.5)
    elif cmode == "density":
        out[at] = r.random(len(observed)) < (observed != 0).mean() if len(observed) else 0
    elif cmode in ("ties", "edges"):
        out[at] = r.permutation(observed if valued else (observed != 0).astype(float))
    elif cmode in ("dyad.census", "dyads"):
        if np.isnan(like[~np.eye(n, dtype=bool)]).any():
            raise ValueError("the dyad census is not defined with missing ties")
        i, j = np.tril_indices(n, -1)
        pairs = np.stack([like[i, j], like[j, i]], 1)
        pairs = pairs[r.permutation(len(pairs))]
        flip = r.random(len(pairs)) < 0.5
        pairs[flip] = pairs[flip][:, ::-1]
        if not valued:
            pairs = (pairs != 0).astype(float)
        out[i, j], out[j, i] = pairs[:, 0], pairs[:, 1]
    else:
        raise ValueError(f"unknown mode {cmode}")
    return out if directed else np.maximum(out, out.T)


def cugtest(g: Graph, statistic: str | Callable = "gcor", *, cmode: str = "density", g1: int = 0, g2: int = 1, reps: int = 1000, seed: int = 0) -> NullTest:
    """The statistic of two graphs against independent draws given density, ties or order."""
    fn = TWO[statistic] if isinstance(statistic, str) else statistic
    a, b = (m.values() for m in _pair(g, g1, g2))
    directed = g.directed
    return NullTest(fn(a, b, directed), replicate(g.vertices.sparkSession, reps, lambda r: fn(draw_graph(a, cmode, directed, r), draw_graph(b, cmode, directed, r), directed), seed), "cug")


def cug_test(g: Graph, statistic: str | Callable = "gtrans", *, cmode: str = "size", ignore_eval: bool = True, reps: int = 1000, seed: int = 0) -> NullTest:
    """One graph's statistic given size, the realized number of edges, or the dyad census."""
    fn = ONE[statistic] if isinstance(statistic, str) else statistic
    m = g.local()
    a = m.a.astype(float) if ignore_eval else m.values()
    directed = g.directed
    return NullTest(fn(a, directed), replicate(g.vertices.sparkSession, reps, lambda r: fn(draw_graph(a, cmode, directed, r, valued=not ignore_eval), directed), seed), cmode)
