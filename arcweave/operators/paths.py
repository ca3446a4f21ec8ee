"""Geodesics and what follows from them.

The path table (graph_id, src, dst, dist, sigma; finite pairs only) comes from one kernel:
blocks of sources are rows, each task traverses a broadcast adjacency whose size is checked;
beyond the limit single sources go by frontier joins. All else aggregates the table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fdiv, inf
from ..graph import Graph
from ..kernels import CSR, accumulate, paths_from
from ..sources.shared import materialize

BLOCK = 32
#: Ties a broadcast adjacency may have (16 bytes each).
MOST_TIES = 5_000_000


def _adjacency(g: Graph, ignore_eval: bool) -> dict[int, tuple[np.ndarray, CSR]]:
    """Per graph: vertex ids and adjacency. Size-checked, since it is broadcast."""
    t = materialize((g.ties.where("src <> dst") if not g.loops else g.ties).select("graph_id", "src", "dst", "weight"))  # derived once
    count = t.limit(MOST_TIES + 1).count()
    if count > MOST_TIES:
        raise ValueError(f"over {MOST_TIES} ties: use single_source")
    e = t.toPandas()
    out = {}
    for gid, v in g.vertices.select("graph_id", "vid").toPandas().groupby("graph_id"):
        vid = np.sort(v["vid"].to_numpy())
        x = e[e["graph_id"] == gid]
        length = None
        if not ignore_eval:
            if (x["weight"] < 0).any():
                raise ValueError("geodesics need values that are not negative")
            x = x[x["weight"] > 0]
            length = x["weight"].to_numpy()
        out[int(gid)] = (vid, CSR.of(len(vid), np.searchsorted(vid, x["src"].to_numpy()), np.searchsorted(vid, x["dst"].to_numpy()), length))
    return out


def _sources(g: Graph) -> DataFrame:
    """graph_id, block, vids: blocks of sources, spread over the cluster."""
    spark = g.vertices.sparkSession
    r = F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")) - 1
    b = g.vertices.select("graph_id", "vid", F.floor(r / BLOCK).alias("block")).groupBy("graph_id", "block").agg(F.sort_array(F.collect_list("vid")).alias("vids"))
    return b.repartition(max(4, spark.sparkContext.defaultParallelism * 2), "graph_id", "block")


def geodist(g: Graph, *, ignore_eval: bool = True, inf_replace: float | None = None, predecessors: bool = False) -> DataFrame:
    """graph_id, src, dst, dist, sigma [, preds]: all pairs that a path joins, each vertex with itself at 0.

    With ``inf_replace`` all pairs, the others at that distance with no path."""
    shared = g.vertices.sparkSession.sparkContext.broadcast(_adjacency(g, ignore_eval))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for gid, vids in zip(part["graph_id"], part["vids"], strict=True):
                vid, csr = shared.value[int(gid)]
                for s in vids:
                    v, d, sig = paths_from(csr, int(np.searchsorted(vid, s)))
                    out = pd.DataFrame({"graph_id": gid, "src": s, "dst": vid[v], "dist": d, "sigma": sig})
                    if predecessors:
                        dist = np.full(csr.n, np.inf)
                        dist[v] = d
                        tail = np.repeat(np.arange(csr.n), np.diff(csr.start))
                        step = csr.length if csr.length is not None else 1.0
                        with np.errstate(invalid="ignore"):
                            on = np.abs(dist[tail] + step - dist[csr.dst]) <= 1e-12
                        out["preds"] = [vid[tail[on & (csr.dst == x)]].tolist() for x in v]
                    yield out

    schema = "graph_id long, src long, dst long, dist double, sigma double" + (", preds array<long>" if predecessors else "")
    paths = _sources(g).mapInPandas(run, schema)
    if inf_replace is None:
        return paths
    all_pairs = replace(g, loops=True).pairs
    return all_pairs.join(paths, ["graph_id", "src", "dst"], "left").withColumn("dist", F.coalesce("dist", F.lit(float(inf_replace)))).withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))


def single_source(g: Graph, source: int, *, max_rounds: int = 10_000) -> DataFrame:
    """vid, dist, sigma from one vertex by frontier joins: for graphs beyond one process."""
    t = materialize(g.ties.select("src", "dst"))
    seen = front = materialize(g.vertices.where(F.col("vid") == source).select("vid", F.lit(0.0).alias("dist"), F.lit(1.0).alias("sigma")))
    for d in range(1, max_rounds):
        step = front.join(t, F.col("vid") == F.col("src")).groupBy("dst").agg(F.sum("sigma").alias("sigma")).withColumnRenamed("dst", "vid")
        front = materialize(step.join(seen, "vid", "left_anti").select("vid", F.lit(float(d)).alias("dist"), "sigma"))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError(f"paths go on after {max_rounds} rounds")
    return seen


def reach_within(g: Graph, distance: int) -> DataFrame:
    """src, dst at 1 to ``distance`` steps."""
    return geodist(g).where(F.col("dist").between(1, distance)).select("src", "dst")


def _paths(g: Graph, paths: DataFrame | None, ignore_eval: bool = True) -> DataFrame:
    return paths if paths is not None else geodist(g, ignore_eval=ignore_eval)


def average_path_length(g: Graph, *, inf_replace: float | None = None, paths: DataFrame | None = None) -> DataFrame:
    p = geodist(g, inf_replace=inf_replace) if inf_replace is not None else _paths(g, paths)
    m = p.where("dist > 0 and src <> dst").groupBy("graph_id").agg(F.avg("dist").alias("m"))
    return g.orders.join(m, "graph_id", "left").select("graph_id", F.coalesce("m", F.lit(0.0)).alias("average_path_length"))


def structure_statistics(g: Graph, *, paths: DataFrame | None = None) -> DataFrame:
    """graph_id, distance, share: of the n^2 pairs, those at most so far apart, for 0 to n - 1."""
    h = _paths(g, paths).groupBy("graph_id", F.ceil("dist").cast("long").alias("distance")).agg(F.count("*").alias("c"))
    grid = g.orders.select("graph_id", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("distance"))
    c = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("graph_id").orderBy("distance"))
    return grid.join(h, ["graph_id", "distance"], "left").select("graph_id", "distance", (c / (F.col("n") * F.col("n"))).alias("share"))


def reachability(g: Graph, *, paths: DataFrame | None = None) -> DataFrame:
    """graph_id, src, dst of all pairs that a path joins, each vertex with itself."""
    return _paths(g, paths).select("graph_id", "src", "dst")


def neighborhood(g: Graph, order: int, *, kind: str = "in", partial: bool = True, return_all: bool = False) -> DataFrame:
    """graph_id, vid, neighbor [, order]: at most ``order`` steps away (partial), or exactly so many."""
    signed = replace(g, edges=g.edges.where(~F.col("missing") & (F.col("weight") > g.threshold)))
    if kind == "total":
        e = signed.edges
        signed = replace(signed, edges=e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "missing")).dropDuplicates(["graph_id", "src", "dst"]))
    p = geodist(signed).where(F.col("dist").between(1, order))
    if kind == "in":
        p = p.select("graph_id", F.col("dst").alias("vid"), F.col("src").alias("neighbor"), "dist")
    else:
        p = p.select("graph_id", F.col("src").alias("vid"), F.col("dst").alias("neighbor"), "dist")
    if return_all:
        if not partial:
            return p.select("graph_id", "vid", "neighbor", F.col("dist").cast("int").alias("order"))
        return p.select("graph_id", "vid", "neighbor", F.explode(F.sequence(F.col("dist").cast("int"), F.lit(order))).alias("order"))
    return (p if partial else p.where(F.col("dist") == order)).select("graph_id", "vid", "neighbor")


def _undirected(g: Graph) -> Graph:
    """Geodesic symmetrization: the cell below the diagonal wins if it is a tie or missing, else that above."""
    e = g.edges.where("src <> dst").withColumn("low", F.col("src") > F.col("dst"))
    live = e.where(g.tie_mask | F.col("missing"))
    pick = F.row_number().over(Window.partitionBy("graph_id", F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("low")))
    one = live.withColumn("r", pick).where("r = 1").select("graph_id", "src", "dst", "weight", "missing")
    return replace(g, edges=one.unionByName(one.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "missing")), directed=False)


CLOSENESS = ("directed", "undirected", "suminvdir", "suminvundir", "gil-schmidt")


def closeness(g: Graph, cmode: str = "directed", *, ignore_eval: bool = True, rescale: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """graph_id, vid, closeness. A vertex that does not reach all others has 0 in the first two modes."""
    if cmode not in CLOSENESS:
        raise ValueError(f"unknown mode {cmode}")
    if paths is None:
        paths = geodist(_undirected(g) if cmode in ("undirected", "suminvundir") or not g.directed else g, ignore_eval=ignore_eval)
    s = paths.where("src <> dst").groupBy("graph_id", F.col("src").alias("vid")).agg(F.sum("dist").alias("total"), F.sum(1 / F.col("dist")).alias("inverse"), F.count("*").alias("reached"))
    j = g.vertices.select("graph_id", "vid").join(s, ["graph_id", "vid"], "left").join(g.orders, "graph_id")
    n, reached, inverse = F.col("n"), F.coalesce("reached", F.lit(0)), F.coalesce("inverse", F.lit(0.0))
    if cmode in ("directed", "undirected"):
        x = F.when(reached < n - 1, 0.0).otherwise(fdiv(n - 1, F.coalesce("total", F.lit(0.0))))
    elif cmode == "gil-schmidt":
        x = F.when(reached == 0, 0.0).otherwise(inverse / F.when(reached != 0, reached))
    else:
        x = fdiv(inverse, n - 1)
    return _rescaled(j.select("graph_id", "vid", x.alias("closeness")), "closeness", rescale)


def _rescaled(d: DataFrame, score: str, rescale: bool) -> DataFrame:
    if not rescale:
        return d
    total = d.groupBy("graph_id").agg(F.sum(score).alias("_total"))
    return d.join(total, "graph_id").withColumn(score, fdiv(score, "_total")).drop("_total")


def gilschmidt(g: Graph, *, normalize: bool = True, paths: DataFrame | None = None) -> DataFrame:
    s = _paths(g, paths).where("src <> dst").groupBy("graph_id", F.col("src").alias("vid")).agg(F.sum(1 / F.col("dist")).alias("s"), F.count("*").alias("c"))
    x = F.coalesce(F.col("s") / F.col("c") if normalize else F.col("s"), F.lit(0.0))
    return g.vertices.select("graph_id", "vid").join(s, ["graph_id", "vid"], "left").select("graph_id", "vid", x.alias("gilschmidt"))


def graphcent(g: Graph, *, ignore_eval: bool = True, rescale: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """1 / the largest distance; 0 if some vertex is not reached."""
    s = _paths(g, paths, ignore_eval).groupBy("graph_id", F.col("src").alias("vid")).agg(F.max("dist").alias("far"), F.count("*").alias("reached"))
    j = g.vertices.select("graph_id", "vid").join(s, ["graph_id", "vid"], "left").join(g.orders, "graph_id")
    x = F.when(F.col("reached") < F.col("n"), 0.0).when(F.col("far") == 0, inf()).otherwise(1 / F.when(F.col("far") != 0, F.col("far")))
    return _rescaled(j.select("graph_id", "vid", x.alias("graphcent")), "graphcent", rescale)


def _accumulated(g: Graph, mode: str, name: str, *, ignore_eval: bool, half: bool, rescale: bool) -> DataFrame:
    """Sources in blocks, one partial score vector a block, summed by vertex."""
    shared = g.vertices.sparkSession.sparkContext.broadcast(_adjacency(g, ignore_eval))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for gid, vids in zip(part["graph_id"], part["vids"], strict=True):
                vid, csr = shared.value[int(gid)]
                s = accumulate(csr, np.searchsorted(vid, np.asarray(vids)), mode)
                at = np.flatnonzero(s)
                yield pd.DataFrame({"graph_id": gid, "vid": vid[at], "x": s[at]})

    s = _sources(g).mapInPandas(run, "graph_id long, vid long, x double").groupBy("graph_id", "vid").agg(F.sum("x").alias("x"))
    x = F.coalesce("x", F.lit(0.0)) / (2 if half else 1)
    return _rescaled(g.vertices.select("graph_id", "vid").join(s, ["graph_id", "vid"], "left").select("graph_id", "vid", x.alias(name)), name, rescale)


BETWEENNESS = {"directed": "standard", "undirected": "standard", "endpoints": "endpoints", "proximalsrc": "proximalsrc", "proximaltar": "proximaltar", "proximalsum": "proximalsum", "lengthscaled": "lengthscaled", "linearscaled": "linearscaled"}


def betweenness(g: Graph, cmode: str = "directed", *, ignore_eval: bool = True, rescale: bool = False) -> DataFrame:
    if cmode not in BETWEENNESS:
        raise ValueError(f"unknown mode {cmode}")
    half = cmode == "undirected" or not g.directed
    return _accumulated(_undirected(g) if half else g, BETWEENNESS[cmode], "betweenness", ignore_eval=ignore_eval, half=half, rescale=rescale)


def stresscent(g: Graph, cmode: str = "directed", *, ignore_eval: bool = True, rescale: bool = False) -> DataFrame:
    half = cmode == "undirected" or not g.directed
    return _accumulated(_undirected(g) if half else g, "stress", "stress", ignore_eval=ignore_eval, half=half, rescale=rescale)


def loadcent(g: Graph, cmode: str = "directed", *, ignore_eval: bool = True, rescale: bool = False) -> DataFrame:
    from .prep import gt

    half = cmode == "undirected" or not g.directed
    return _accumulated(_undirected(g) if half else gt(g), "load", "load", ignore_eval=ignore_eval, half=False, rescale=rescale)
