"""Random graphs. Uniforms are hashes of (seed, graph, cell), so that results do not depend on
partitions; sequential samplers run one task a graph or chain with a counter-based generator."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import rng
from ..graph import Graph


def create_seeded_rng(seed) -> np.random.Generator:
    return rng(seed)


def uniform(seed: int, *keys: str):
    """Column in [0, 1): 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / float(1 << 53)


def _grid(spark: SparkSession, n: int, graphs: int, directed: bool, loops: bool) -> tuple[DataFrame, DataFrame]:
    """Vertices, and the cells that are drawn: ordered pairs, or src > dst when undirected."""
    v = spark.range(graphs).select(F.col("id").alias("graph_id")).crossJoin(spark.range(n).select(F.col("id").alias("vid")))
    c = spark.range(graphs * n).select(F.expr(f"id div {n}").alias("graph_id"), F.expr(f"id % {n}").alias("src")).select("graph_id", "src", F.explode(F.expr(f"sequence(0L, {max(0, n - 1)}L)")).alias("dst"))
    keep = F.lit(True) if directed else F.col("src") >= F.col("dst")
    if not loops:
        keep = keep & (F.col("src") != F.col("dst"))
    return v, c.where(keep) if n else c.where("false")


def _finish(v: DataFrame, e: DataFrame, directed: bool, loops: bool) -> Graph:
    e = e.select("graph_id", "src", "dst", (F.col("weight") if "weight" in e.columns else F.lit(1.0)).alias("weight"), F.lit(False).alias("missing"))
    if not directed:
        e = e.unionByName(e.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "missing"))
    return Graph(v, e, directed, loops)


def rgraph(spark: SparkSession, n: int, graphs: int = 1, *, tprob=0.5, directed: bool = True, loops: bool = False, tielist: list[float] | None = None, seed: int = 0) -> Graph:
    """Bernoulli ties: a probability, one a graph, or a matrix; or values drawn from a list with replacement."""
    v, c = _grid(spark, n, graphs, directed, loops)
    u = uniform(seed, "graph_id", "src", "dst")
    if tielist is not None:
        values = F.array(*[F.lit(float(x)) for x in tielist])
        e = c.withColumn("weight", F.element_at(values, (F.floor(u * len(tielist)) + 1).cast("int"))).where("weight <> 0")
        return _finish(v, e, directed, loops)
    if isinstance(tprob, (int, float)):
        p = F.lit(float(tprob))
    elif not hasattr(tprob[0], "__len__"):
        p = F.element_at(F.array(*[F.lit(float(x)) for x in tprob]), (F.col("graph_id") % len(tprob) + 1).cast("int"))
    else:
        m = np.asarray(tprob, float)
        flat = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "src long, dst long, p double")
        c, p = c.join(flat, ["src", "dst"]), F.col("p")
    return _finish(v, c.where(u < p), directed, loops)


def rgnm(spark: SparkSession, n: int, m: int, graphs: int = 1, *, directed: bool = True, loops: bool = False, seed: int = 0) -> Graph:
    """Uniform over graphs with exactly m edges: the m least hashes of each graph's cells."""
    v, c = _grid(spark, n, graphs, directed, loops)
    most = n * (n - 1) // (1 if directed else 2) + (n if loops else 0)
    if not 0 <= m <= most:
        raise ValueError(f"{m} edges do not fit; at most {most}")
    r = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.xxhash64(F.lit(seed), "graph_id", "src", "dst"), "src", "dst"))
    return _finish(v, c.withColumn("r", r).where(F.col("r") <= m), directed, loops)


def rguman(spark: SparkSession, n: int, mut, asym, null, graphs: int = 1, *, method: str = "probability", seed: int = 0) -> Graph:
    """Uniform given mutual, asymmetric and null dyads: their probabilities, or exact counts."""
    v, c = _grid(spark, n, graphs, False, False)
    side = uniform(seed + 1, "graph_id", "src", "dst")
    if method == "probability":
        total = mut + asym + null
        u = uniform(seed, "graph_id", "src", "dst") * total
        state = F.when(u < mut, 2).when(u < mut + asym, 1).otherwise(0)
    elif method == "exact":
        if mut + asym + null != n * (n - 1) // 2:
            raise ValueError("the counts must add up to all dyads")
        r = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.xxhash64(F.lit(seed), "graph_id", "src", "dst"), "src", "dst"))
        state = F.when(r <= mut, 2).when(r <= mut + asym, 1).otherwise(0)
    else:
        raise ValueError(f"unknown method {method}")
    d = c.withColumn("state", state).withColumn("side", side).where("state > 0")
    one = d.where("state = 2 or side < 0.5").select("graph_id", "src", "dst")
    two = d.where("state = 2 or side >= 0.5").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _finish(v, one.unionByName(two), True, False)


def rgnmix(spark: SparkSession, types: list, mix: dict, graphs: int = 1, *, method: str = "probability", directed: bool = True, loops: bool = False, seed: int = 0) -> Graph:
    """Ties by the pair of types: mix maps (type, type) to a probability, or to an exact count."""
    n = len(types)
    v, c = _grid(spark, n, graphs, directed, loops)
    t = spark.createDataFrame([(i, str(x)) for i, x in enumerate(types)], "vid long, type string")
    m = spark.createDataFrame([(str(a), str(b), float(x)) for (a, b), x in mix.items()], "ta string, tb string, p double")
    c = c.join(t.select(F.col("vid").alias("src"), F.col("type").alias("ta")), "src").join(t.select(F.col("vid").alias("dst"), F.col("type").alias("tb")), "dst").join(m, ["ta", "tb"])
    if method == "probability":
        e = c.where(uniform(seed, "graph_id", "src", "dst") < F.col("p"))
    else:
        r = F.row_number().over(Window.partitionBy("graph_id", "ta", "tb").orderBy(F.xxhash64(F.lit(seed), "graph_id", "src", "dst"), "src", "dst"))
        e = c.withColumn("r", r).where("r <= p")
    return _finish(v, e, directed, loops)


def _per_graph(g: Graph, fn) -> Graph:
    """One task a graph: fn(order, set of arcs) to arcs."""
    v = g.vertices.select("graph_id", F.col("vid").alias("src"), F.lit(-1).cast("long").alias("dst"))
    rows = v.unionByName(g.ties.select("graph_id", "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = int(pdf["graph_id"].iloc[0])
        vid = sorted(pdf.loc[pdf["dst"] < 0, "src"].astype(int))
        at = {x: i for i, x in enumerate(vid)}
        e = pdf[pdf["dst"] >= 0]
        a = np.zeros((len(vid), len(vid)), bool)
        a[e["src"].map(at).to_numpy(int), e["dst"].map(at).to_numpy(int)] = True
        i, j = np.nonzero(fn(a, gid))
        return pd.DataFrame({"graph_id": gid, "src": np.array(vid)[i], "dst": np.array(vid)[j], "weight": 1.0, "missing": False})

    return replace(g, edges=rows.groupBy("graph_id").applyInPandas(run, "graph_id long, src long, dst long, weight double, missing boolean"), threshold=0.0)


def rewire_ud(g: Graph, p: float, *, seed: int = 0) -> Graph:
    """Each dyad, with probability p, swaps its state with a dyad chosen uniformly."""

    def fn(a: np.ndarray, gid: int) -> np.ndarray:
        r, n = rng(seed, gid), len(a)
        pairs = [(i, j) for i in range(n) for j in range(i)]
        for i, j in pairs:
            if r.random() < p:
                k, m = pairs[r.integers(len(pairs))]
                a[i, j], a[k, m] = a[k, m], a[i, j]
                a[j, i], a[m, k] = a[m, k], a[j, i]
        return a

    return _per_graph(g, fn)


def rewire_ws(g: Graph, p: float, *, seed: int = 0) -> Graph:
    """Each tied dyad, with probability p, moves one end to a vertex that it has no dyad with."""

    def fn(a: np.ndarray, gid: int) -> np.ndarray:
        r, n = rng(seed, gid), len(a)
        for i, j in [(i, j) for i in range(n) for j in range(i) if a[i, j] or a[j, i]]:
            if r.random() < p:
                keep, drop = (i, j) if r.random() < 0.5 else (j, i)
                free = np.flatnonzero(~(a[keep] | a[:, keep]))
                free = free[free != keep]
                if len(free):
                    k = int(r.choice(free))
                    a[keep, k], a[k, keep] = a[keep, drop], a[drop, keep]
                    a[keep, drop] = a[drop, keep] = False
        return a

    return _per_graph(g, fn)


def rgws(spark: SparkSession, nv: int, dim: int, z: int, p: float, graphs: int = 1, *, seed: int = 0) -> Graph:
    """A lattice of nv^dim vertices, tied within Manhattan distance z, rewired with probability p."""
    n = nv**dim
    v, c = _grid(spark, n, graphs, False, False)
    coordinate = lambda x, k: F.expr(f"({x} div {nv**k}) % {nv}")
    apart = sum((F.abs(coordinate("src", k) - coordinate("dst", k)) for k in range(dim)), F.lit(0))
    lattice = _finish(v, c.where(apart <= z), False, False)
    return rewire_ws(lattice, p, seed=seed) if p else lattice


def _bias(parents: int, tied_back: bool, pi: float, sigma: float, rho: float, d: float) -> float:
    """P(tie): not failed by the base rate, the reciprocity bias, and the biases of shared parents (with double roles)."""
    stay = 1 - d
    if tied_back:
        stay *= (1 - pi) * (1 - rho) ** parents
    return 1 - stay * (1 - sigma) ** parents


def rgbn(spark: SparkSession, n: int, graphs: int = 1, *, pi: float = 0.0, sigma: float = 0.0, rho: float = 0.0, d: float = 0.5, burn: int | None = None, thin: int | None = None, seed: int = 0) -> Graph:
    """Biased nets by Gibbs sampling: rows are chains, one for each graph, each burnt in on its own."""
    sweeps = burn if burn is not None else 10 * n * n
    more = thin or 0
    v = spark.range(graphs).select(F.col("id").alias("graph_id")).crossJoin(spark.range(n).select(F.col("id").alias("vid")))

    def run(parts):
        for part in parts:
            for gid in part["id"]:
                r = rng(seed, int(gid))
                a = r.random((n, n)) < d
                np.fill_diagonal(a, False)
                for _ in range(sweeps + more if n > 1 else 0):
                    i, j = r.choice(n, 2, replace=False)
                    shared = int((a[:, i] & a[:, j]).sum())
                    a[i, j] = r.random() < _bias(shared, bool(a[j, i]), pi, sigma, rho, d)
                i, j = np.nonzero(a)
                yield pd.DataFrame({"graph_id": int(gid), "src": i, "dst": j, "weight": 1.0, "missing": False})

    chains = spark.range(graphs).repartition(max(1, min(graphs, spark.sparkContext.defaultParallelism * 2)), "id")
    return Graph(v, chains.mapInPandas(run, "graph_id long, src long, dst long, weight double, missing boolean"), True, False)
