"""Structural and regular equivalence, clustering, blockmodels."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fdiv, nan
from ..graph import Graph, Local


def _profiles(g: Graph) -> DataFrame:
    """actor, slot, x: each actor's row and column values in all graphs; null if missing or on the unused diagonal."""
    full = replace(g, loops=True).grid
    x = F.when(F.col("missing") | ((F.col("src") == F.col("dst")) if not g.loops else F.lit(False)), F.lit(None)).otherwise(F.col("weight"))
    row = full.select(F.col("src").alias("actor"), F.struct("graph_id", F.lit(0).alias("k"), F.col("dst").alias("o")).alias("slot"), x.alias("x"))
    col = full.select(F.col("dst").alias("actor"), F.struct("graph_id", F.lit(1).alias("k"), F.col("src").alias("o")).alias("slot"), x.alias("x"))
    return row.unionByName(col)


def sedist(g: Graph, method: str = "hamming", *, code_diss: bool = False) -> DataFrame:
    """i, j, sedist for i <> j: correlation, euclidean, hamming, gamma or exact over row and column profiles."""
    p = _profiles(g).where("x is not null")
    a, b = p.select(F.col("actor").alias("i"), "slot", "x"), p.select(F.col("actor").alias("j"), "slot", F.col("x").alias("y"))
    q = a.join(b, "slot").where("i <> j")
    x, y = F.col("x"), F.col("y")
    if method == "hamming":
        s = q.groupBy("i", "j").agg(F.sum(F.abs(x - y)).alias("v"))
    elif method == "euclidean":
        s = q.groupBy("i", "j").agg(F.sqrt(F.sum((x - y) * (x - y))).alias("v"))
    elif method == "exact":
        s = q.groupBy("i", "j").agg(F.sum((x != y).cast("double")).alias("v"))
    elif method == "gamma":
        s = q.groupBy("i", "j").agg(F.sum(F.when(x == y, 1.0).otherwise(-1.0)).alias("d"), F.count("*").alias("n")).select("i", "j", fdiv("d", "n").alias("v"))
    elif method == "correlation":
        s = q.groupBy("i", "j").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
        n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
        r = fdiv(n * F.col("sxy") - sx * sy, F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)))
        s = s.select("i", "j", F.when(F.isnan(r), 0.0).otherwise(r).alias("v"))
    else:
        raise ValueError(f"unknown method {method}")
    v = -F.col("v") if code_diss and method in ("correlation", "gamma") else F.col("v")
    return s.select("i", "j", v.cast("double").alias("sedist"))


def catrege(stack: list[np.ndarray], seed: list[int] | None = None) -> np.ndarray:
    """Rounds through which each pair stays together as classes are refined by the sets of alters' classes per tie code."""
    n = len(stack[0])
    code = np.zeros((n, n), np.int64)
    for k, m in enumerate(stack):
        code |= ((m != 0).astype(np.int64) << (2 * k)) | ((m.T != 0).astype(np.int64) << (2 * k + 1))
    label = np.zeros(n, int) if seed is None else np.asarray(seed)
    together = np.zeros((n, n))
    for step in range(1, n + 2):
        same = label[:, None] == label[None, :]
        together[same] = step
        sets = [(label[i], tuple(sorted({(int(code[i, j]), int(label[j])) for j in range(n) if j != i and code[i, j]}))) for i in range(n)]
        names: dict = {}
        new = np.array([names.setdefault(s, len(names)) for s in sets])
        if len(names) == len(set(label.tolist())):
            break
        label = new
    return together


def redist(g: Graph, *, seed: list[int] | None = None, code_diss: bool = True) -> DataFrame:
    """i, j, redist: regular-equivalence distance of binary ties; similarities if not ``code_diss``."""
    stack = g.locals()
    t = catrege([m.a for m in stack], seed)
    vid = stack[0].vid
    span = t.max() - t.min()
    v = ((t.max() - t) / span if span else np.zeros_like(t)) if code_diss else t
    rows = [(int(vid[i]), int(vid[j]), float(v[i, j])) for i in range(len(vid)) for j in range(len(vid)) if i != j]
    return g.vertices.sparkSession.createDataFrame(rows, "i long, j long, redist double")


LINKAGES = ("complete", "single", "average", "mcquitty", "weighted", "median", "centroid", "ward.D", "ward.D2")


@dataclass
class Dendrogram:
    """Merges (negative: leaves from 1; positive: earlier merges), heights, and leaves in order."""

    merge: list[tuple[int, int]]
    height: list[float]
    order: list[int]

    def cut(self, *, k: int | None = None, h: float | None = None) -> list[int]:
        """Class of each leaf, from 1 by first leaf."""
        n = len(self.order)
        steps = max(0, n - k) if k is not None else sum(x <= h for x in self.height)
        parent = list(range(n + len(self.merge)))
        for step, (a, b) in enumerate(self.merge[:steps]):
            for x in (a, b):
                parent[-x - 1 if x < 0 else n + x - 1] = n + step

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        names: dict[int, int] = {}
        return [names.setdefault(root(i), len(names) + 1) for i in range(n)]


def hclust(d: np.ndarray, method: str = "complete") -> Dendrogram:
    """Agglomeration by Lance and Williams' updates; the first least pair in active order merges."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method}")
    n = len(d)
    square = method in ("centroid", "median", "ward.D2")
    dist = {(i, j): float(d[i, j] ** 2 if square else d[i, j]) for i in range(n) for j in range(n) if i != j}
    active, size, leaves = list(range(n)), dict.fromkeys(range(n), 1), {i: [i] for i in range(n)}
    merge, height, ref = [], [], {i: -(i + 1) for i in range(n)}
    for step in range(n - 1):
        i, j = min(((a, b) for x, a in enumerate(active) for b in active[x + 1 :]), key=lambda p: dist[p])
        dij, ni, nj, new = dist[i, j], size[i], size[j], n + step
        for k in active:
            if k in (i, j):
                continue
            a, b, nk = dist[i, k], dist[j, k], size[k]
            if method == "complete":
                x = max(a, b)
            elif method == "single":
                x = min(a, b)
            elif method == "average":
                x = (ni * a + nj * b) / (ni + nj)
            elif method in ("mcquitty", "weighted"):
                x = (a + b) / 2
            elif method == "median":
                x = (a + b) / 2 - dij / 4
            elif method == "centroid":
                x = (ni * a + nj * b) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2
            else:
                x = ((ni + nk) * a + (nj + nk) * b - nk * dij) / (ni + nj + nk)
            dist[new, k] = dist[k, new] = x
        pair = sorted((ref[i], ref[j]), key=lambda r: (r > 0, abs(r)))
        merge.append((pair[0], pair[1]))
        height.append(math.sqrt(max(0.0, dij)) if square else dij)
        left, right = (i, j) if ref[i] == pair[0] else (j, i)
        leaves[new], size[new], ref[new] = leaves[left] + leaves[right], ni + nj, step + 1
        active = [x for x in active if x not in (i, j)] + [new]
    return Dendrogram(merge, height, leaves[active[0]] if active else [])


def equiv_clust(g: Graph, *, distance: DataFrame | None = None, method: str = "hamming", cluster_method: str = "complete", regular: bool = False) -> tuple[Dendrogram, list[int]]:
    """Dendrogram of the actors, and their ids in leaf numbering."""
    d = distance if distance is not None else (redist(g).withColumnRenamed("redist", "d") if regular else sedist(g, method, code_diss=True).withColumnRenamed("sedist", "d"))
    name = [c for c in d.columns if c not in ("i", "j")][0]
    vid = [r[0] for r in g.vertices.select("vid").distinct().orderBy("vid").collect()]
    at = {v: i for i, v in enumerate(vid)}
    m = np.zeros((len(vid), len(vid)))
    for i, j, x in d.select("i", "j", name).collect():
        m[at[i], at[j]] = x
    return hclust(m, cluster_method), vid


BLOCKS = ("density", "meanrowsum", "meancolsum", "sum", "median", "min", "max", "types")


def blockmodel(g: Graph, classes: DataFrame, block_content: str = "density") -> DataFrame:
    """graph_id, row, col, value per pair of classes (vid, cl): statistics of the block's known cells."""
    if block_content not in BLOCKS:
        raise ValueError(f"unknown content {block_content}")
    c = classes.select("vid", F.col("cl"))
    cells = g.grid.where("not missing").join(c.select(F.col("vid").alias("src"), F.col("cl").alias("row")), "src").join(c.select(F.col("vid").alias("dst"), F.col("cl").alias("col")), "dst")
    w, key = F.col("weight"), ["graph_id", "row", "col"]
    if block_content in ("meanrowsum", "meancolsum"):
        by = "src" if block_content == "meanrowsum" else "dst"
        s = cells.groupBy(*key, by).agg(F.sum(w).alias("s")).groupBy(*key).agg(F.avg("s").alias("value"))
    elif block_content == "types":
        rows = cells.groupBy(*key, "src").agg(F.max((w != 0).cast("int")).alias("any")).groupBy(*key).agg(F.min("any").alias("rr"))
        cols = cells.groupBy(*key, "dst").agg(F.max((w != 0).cast("int")).alias("any")).groupBy(*key).agg(F.min("any").alias("cr"))
        s = cells.groupBy(*key).agg(F.sum((w != 0).cast("long")).alias("ones"), F.count("*").alias("n")).join(rows, key).join(cols, key)
        name = F.when(F.col("ones") == 0, "null").when(F.col("ones") == F.col("n"), "complete").when((F.col("rr") == 1) & (F.col("cr") == 1), "1 covered").when(F.col("rr") == 1, "1 row-covered").when(F.col("cr") == 1, "1 col-covered").otherwise("other")
        return g.orders.select("graph_id").join(s, "graph_id").select(*key, name.alias("value"))
    else:
        agg = {"density": F.avg(w), "sum": F.sum(w), "median": F.percentile(w, 0.5), "min": F.min(w), "max": F.max(w)}[block_content]
        s = cells.groupBy(*key).agg(agg.cast("double").alias("value"))
    # A class alone with itself has no cell: its block is NaN.
    k = c.select("cl").distinct()
    grid = g.orders.select("graph_id").crossJoin(k.withColumnRenamed("cl", "row")).crossJoin(k.withColumnRenamed("cl", "col"))  # a row a block
    return grid.join(s, key, "left").select(*key, F.coalesce("value", nan()).alias("value"))


def blockmodel_expand(density: list[list[float]], sizes: list[int], spark, *, seed: int = 0, directed: bool = True, loops: bool = False) -> Graph:
    """A random graph with so many vertices a class and Bernoulli ties at the blocks' densities."""
    label = np.repeat(np.arange(len(sizes)), sizes)
    p = np.asarray(density, float)[np.ix_(label, label)]
    from .random_graphs import rgraph

    return rgraph(spark, len(label), tprob=p.tolist(), directed=directed, loops=loops, seed=seed)


def permuted(m: Local, order: list[int]) -> np.ndarray:
    return m.values()[np.ix_(order, order)]
