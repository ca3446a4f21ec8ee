"""Vertex positions as tables (vid, x, y [, z]); drawing is left to the caller."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rng
from ..graph import Graph, Local
from ..kernels import CSR, paths_from


def circle(g: Graph) -> DataFrame:
    """Evenly round the unit circle, by vertex id."""
    k = F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")) - 1
    a = 2 * math.pi * k / F.col("n")
    return g.vertices.select("graph_id", "vid").join(g.orders, "graph_id").select("graph_id", "vid", F.sin(a).alias("x"), F.cos(a).alias("y"))


def target(g: Graph, scores: DataFrame, *, radius: float = 1.0) -> DataFrame:
    """Round circles whose radius falls with a score (vid, value): the largest in the centre."""
    top = scores.agg(F.max("value").alias("top"), F.min("value").alias("low"))
    r = F.when(F.col("top") == F.col("low"), radius).otherwise(radius * (F.col("top") - F.col("value")) / F.when(F.col("top") != F.col("low"), F.col("top") - F.col("low")))
    c = circle(g)
    return c.join(scores.select("vid", "value"), "vid").crossJoin(F.broadcast(top)).select("graph_id", "vid", (F.col("x") * r).alias("x"), (F.col("y") * r).alias("y"))  # one row


def _distances(m: Local) -> np.ndarray:
    a = m.a | m.a.T
    i, j = np.nonzero(a & ~np.eye(m.n, dtype=bool))
    csr = CSR.of(m.n, i, j)
    d = np.full((m.n, m.n), float(m.n))
    for s in range(m.n):
        v, x, _ = paths_from(csr, s)
        d[s, v] = x
    return d


def classical_mds(d: np.ndarray, dim: int = 2) -> np.ndarray:
    n = len(d)
    c = np.eye(n) - 1 / max(n, 1)
    values, vectors = np.linalg.eigh(-0.5 * c @ (d**2) @ c)
    order = np.argsort(values)[::-1][:dim]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def _profile_distance(m: Local, kind: str) -> np.ndarray:
    w = np.concatenate([m.w, m.w.T], 1)
    return np.sqrt(((w[:, None] - w[None]) ** 2).sum(2)) if kind == "euclidean" else np.abs(w[:, None] - w[None]).sum(2)


def _force(m: Local, mode: str, dim: int, rounds: int, seed: int) -> np.ndarray:
    """One loop for all force layouts: ties pull, pairs push or springs draw to their path lengths."""
    r, n = rng(seed), m.n
    x = r.normal(size=(n, dim)) * n / 4
    a = (m.a | m.a.T) & ~np.eye(n, dtype=bool)
    want = _distances(m) if mode == "kamadakawai" else None
    heat = n / 10 + 1.0
    for step in range(rounds):
        diff = x[:, None] - x[None]
        dist = np.sqrt((diff**2).sum(2)) + 1e-9
        unit = diff / dist[:, :, None]
        if mode == "kamadakawai":
            force = -(unit * ((dist - want) / np.maximum(want, 1) ** 2)[:, :, None]).sum(1)
        elif mode in ("spring", "springrepulse"):
            force = -(unit * (a * (dist - 1))[:, :, None]).sum(1)
            if mode == "springrepulse":
                force += (unit / dist[:, :, None]).sum(1)
        else:
            force = (unit * (1 / dist)[:, :, None]).sum(1) - (unit * (a * dist**2 / n)[:, :, None]).sum(1)
        size = np.sqrt((force**2).sum(1)) + 1e-12
        x += force / size[:, None] * np.minimum(size, heat)[:, None]
        heat *= 0.99
    return x - x.mean(0)


MODES = ("adj", "circle", "circrand", "eigen", "fruchtermanreingold", "geodist", "hall", "kamadakawai", "mds", "princoord", "random", "rmds", "segeo", "seham", "spring", "springrepulse", "target")


def layout(g: Graph, mode: str = "fruchtermanreingold", *, dim: int = 2, seed: int = 0, rounds: int = 500) -> DataFrame:
    """vid and coordinates x, y [, z] of one graph."""
    if mode not in MODES:
        raise ValueError(f"unknown layout {mode}")
    if mode == "circle":
        return circle(g).drop("graph_id")
    if mode == "target":
        from .local import degree

        return target(g, degree(g).withColumnRenamed("degree", "value")).drop("graph_id")
    m = g.local()
    n, r = m.n, rng(seed)
    both = np.maximum(m.w, m.w.T)
    if mode == "random":
        x = r.uniform(-1, 1, (n, dim))
    elif mode == "circrand":
        x = r.normal(size=(n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif mode in ("mds", "adj"):
        x = classical_mds(_profile_distance(m, "euclidean") if mode == "mds" else both.max(initial=0) - both, dim)
    elif mode in ("geodist", "rmds"):
        x = classical_mds(_distances(m) if mode == "geodist" else _profile_distance(m, "euclidean"), dim)
    elif mode == "segeo":
        d = _distances(m)
        x = classical_mds(np.sqrt(((d[:, None] - d[None]) ** 2).sum(2)), dim)
    elif mode == "seham":
        x = classical_mds(_profile_distance(m, "hamming"), dim)
    elif mode == "princoord":
        w = np.concatenate([m.w, m.w.T], 1)
        with np.errstate(all="ignore"):
            c = np.nan_to_num(np.corrcoef(w)) if n > 1 else np.eye(n)
        values, vectors = np.linalg.eigh(c)
        x = vectors[:, np.argsort(-np.abs(values))[:dim]]
    elif mode == "eigen":
        values, vectors = np.linalg.eigh((m.w + m.w.T) / 2)
        x = vectors[:, np.argsort(-values)[:dim]]
    elif mode == "hall":
        values, vectors = np.linalg.eigh(np.diag(both.sum(1)) - both)
        x = vectors[:, np.argsort(values)[1 : dim + 1]]
    else:
        x = _force(m, mode, dim, rounds, seed)
    x = np.pad(x, ((0, 0), (0, max(0, dim - x.shape[1]))))
    rows = [(int(v), *map(float, c)) for v, c in zip(m.vid, x, strict=True)]
    return g.vertices.sparkSession.createDataFrame(rows, "vid long, " + ", ".join(f"{c} double" for c in "xyz"[:dim]))


def gplot(g: Graph, mode: str = "fruchtermanreingold", **kw) -> dict[str, DataFrame]:
    """What a node-link drawing needs: nodes (vid, x, y) and segments (src, dst, weight, x1, y1, x2, y2)."""
    p = layout(g, mode, **kw)
    e = g.ties.join(p.select(F.col("vid").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(p.select(F.col("vid").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    return {"nodes": p, "segments": e.select("src", "dst", "weight", "x1", "y1", "x2", "y2")}


def plot_sociomatrix(g: Graph) -> DataFrame:
    """row, col, value of all cells, for a matrix drawing."""
    from .prep import as_sociomatrix_sna

    return as_sociomatrix_sna(g).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))


def gplot_vertex(g: Graph, mode: str = "fruchtermanreingold", **kw) -> DataFrame:
    """vid and position of each vertex."""
    return gplot(g, mode, **kw)["nodes"]


def gplot_arrow(g: Graph, mode: str = "fruchtermanreingold", **kw) -> DataFrame:
    """Each tie but loops, from end to end, with whether it is answered (drawn curved)."""
    e = gplot(g, mode, **kw)["segments"].where("src <> dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("answered"))
    return e.join(back, ["src", "dst"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def gplot_loop(g: Graph, mode: str = "fruchtermanreingold", **kw) -> DataFrame:
    """Loops with the position of their vertex."""
    return gplot(g, mode, **kw)["segments"].where("src = dst").select(F.col("src").alias("vid"), "weight", F.col("x1").alias("x"), F.col("y1").alias("y"))


def gplot_target(g: Graph, scores: DataFrame, **kw) -> DataFrame:
    """Positions on circles by score (vid, value)."""
    return target(g, scores, **kw)


def gplot3d(g: Graph, mode: str = "fruchtermanreingold", **kw) -> dict[str, DataFrame]:
    """nodes (vid, x, y, z) and segments with both ends."""
    p = layout(g, mode, dim=3, **kw)
    ends = lambda v, k: p.select(F.col("vid").alias(v), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
    return {"nodes": p, "segments": g.ties.join(ends("src", 1), "src").join(ends("dst", 2), "dst").drop("graph_id")}


def gplot3d_arrow(g: Graph, mode: str = "fruchtermanreingold", **kw) -> DataFrame:
    return gplot3d(g, mode, **kw)["segments"].where("src <> dst")


def gplot3d_loop(g: Graph, mode: str = "fruchtermanreingold", **kw) -> DataFrame:
    return gplot3d(g, mode, **kw)["segments"].where("src = dst").select(F.col("src").alias("vid"), "weight", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"))
