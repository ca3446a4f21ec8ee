"""Components, cohesion, cores, cliques, paths and cycles, Krackhardt's indices, communities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.stats import fdiv
from ..graph import Graph, Local
from ..sources.shared import materialize
from .paths import MOST_TIES, geodist

KINDS = ("strong", "weak", "unilateral", "recursive")


def weak_labels(g: Graph, *, max_rounds: int = 100) -> DataFrame:
    """graph_id, vid, root (least vertex of the weak component), by alternating star contractions.

    Each round points a vertex's larger neighbours to its least one, then its smaller ones;
    rounds grow with the logarithm of the size, and only two counts reach the driver."""
    key = ["graph_id", "u"]
    e = materialize(g.ties.where("src <> dst").select("graph_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    was = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, key).where("v > u").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(low, key).where("v <> m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("graph_id", "u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return g.vertices.select("graph_id", "vid").join(e.withColumnRenamed("u", "vid"), ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("v", "vid").alias("root"))


def strong_labels(g: Graph, *, max_rounds: int = 100_000) -> DataFrame:
    """graph_id, vid, root (least vertex of the strong component), by joins: for graphs beyond one process.

    Every vertex takes the least vertex that reaches it, by forward steps; what also reaches that vertex
    backwards, among vertices of its colour, is its component. These leave, and the rest starts again; ties
    between colours leave too, as no component crosses them. Vertices without a tie in or out are their own."""
    t = materialize(g.ties.where("src <> dst").select("graph_id", "src", "dst"))
    found = []
    for _ in range(max_rounds):
        ends = t.select("graph_id", F.col("dst").alias("vid")).distinct().join(t.select("graph_id", F.col("src").alias("vid")).distinct(), ["graph_id", "vid"])
        trimmed = materialize(t.join(ends.withColumnRenamed("vid", "src"), ["graph_id", "src"], "left_semi").join(ends.withColumnRenamed("vid", "dst"), ["graph_id", "dst"], "left_semi"))
        if trimmed.isEmpty():
            break
        colour = materialize(trimmed.select("graph_id", F.col("src").alias("vid")).union(trimmed.select("graph_id", "dst")).distinct().withColumn("c", F.col("vid")))
        for _ in range(max_rounds):
            low = trimmed.join(colour.withColumnRenamed("vid", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("vid")).agg(F.min("c").alias("low"))
            after = materialize(colour.join(low, ["graph_id", "vid"], "left").select("graph_id", "vid", F.least("c", F.coalesce("low", "c")).alias("c"), (F.coalesce("low", "c") < F.col("c")).alias("moved")))
            colour = after.drop("moved")
            if after.where("moved").isEmpty():
                break
        inside = trimmed.join(colour.select("graph_id", F.col("vid").alias("src"), F.col("c").alias("a")), ["graph_id", "src"]).join(colour.select("graph_id", F.col("vid").alias("dst"), F.col("c").alias("b")), ["graph_id", "dst"]).where("a = b").select("graph_id", "src", "dst")
        inside = materialize(inside)
        reached = front = materialize(colour.where("vid = c").select("graph_id", "vid"))
        for _ in range(max_rounds):
            step = inside.join(front.withColumnRenamed("vid", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("src").alias("vid")).distinct()
            front = materialize(step.join(reached, ["graph_id", "vid"], "left_anti"))
            if front.isEmpty():
                break
            reached = reached.unionByName(front)
        found.append(materialize(colour.join(reached, ["graph_id", "vid"], "left_semi").withColumnRenamed("c", "root")))
        t = materialize(inside.join(reached.withColumnRenamed("vid", "src"), ["graph_id", "src"], "left_anti").join(reached.withColumnRenamed("vid", "dst"), ["graph_id", "dst"], "left_anti"))
    else:
        raise RuntimeError(f"components are left after {max_rounds} rounds")
    whole = g.vertices.select("graph_id", "vid")
    for part in found:
        whole = whole.join(part.withColumnRenamed("root", "r"), ["graph_id", "vid"], "left").select("graph_id", "vid", *([F.coalesce("root", "r").alias("root")] if "root" in whole.columns else [F.col("r").alias("root")]))
    return whole.select("graph_id", "vid", F.coalesce(*(["root"] if found else []), "vid").alias("root"))


def component_dist(g: Graph, connected: str = "strong") -> DataFrame:
    """graph_id, vid, label: labels from 0 by the first vertex of each component."""
    if connected not in KINDS:
        raise ValueError(f"unknown connection {connected}")
    if connected in ("weak", "recursive"):
        if connected == "recursive":
            t = g.ties.select("graph_id", "src", "dst")
            mutual = t.join(t.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), ["graph_id", "src", "dst"], "left_semi")
            g = replace(g, edges=mutual.withColumn("weight", F.lit(1.0)).withColumn("missing", F.lit(False)), threshold=0.0)
        roots = weak_labels(g)
    elif connected == "strong" and g.ties.limit(MOST_TIES + 1).count() > MOST_TIES:
        roots = strong_labels(g)
    elif connected == "strong":
        p = geodist(g).select("graph_id", "src", "dst")
        both = p.join(p.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), ["graph_id", "src", "dst"], "left_semi")
        roots = both.groupBy("graph_id", F.col("src").alias("vid")).agg(F.min("dst").alias("root"))
    else:
        return _by_graph(g, "graph_id long, vid long, label long", lambda m: pd.DataFrame({"vid": m.vid, "label": K.component_labels(m.a, "unilateral")}))
    # dense_rank over the roots of each graph: only the roots themselves are ranked.
    own = roots.select("graph_id", "root").distinct().withColumn("label", F.dense_rank().over(Window.partitionBy("graph_id").orderBy("root")).cast("long") - 1)
    return roots.join(own, ["graph_id", "root"]).select("graph_id", "vid", "label")


def _by_graph(g: Graph, schema: str, fn) -> DataFrame:
    """One task a graph: fn of its dense arrays, whose order is guarded."""
    like = replace(g, vertices=None, edges=None)
    v = g.vertices.select("graph_id", F.col("vid").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), F.lit(False).alias("missing"))
    rows = v.unionByName(g.edges.select("graph_id", "src", "dst", "weight", "missing"))
    from ..graph import _LIMIT

    limit = _LIMIT[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vid = sorted(pdf.loc[pdf["dst"].isna(), "src"].astype(int))
        if len(vid) > limit:
            raise ValueError(f"order over the limit of {limit}")
        out = fn(Local.of(vid, pdf[pdf["dst"].notna()].astype({"dst": int}), like))
        out.insert(0, "graph_id", pdf["graph_id"].iloc[0])
        return out

    return rows.groupBy("graph_id").applyInPandas(run, schema)


def components(g: Graph, connected: str | None = None) -> DataFrame:
    """graph_id, components: how many."""
    kind = connected or ("strong" if g.directed else "weak")
    return component_dist(g, kind).groupBy("graph_id").agg(F.countDistinct("label").alias("components"))


def is_connected(g: Graph, connected: str | None = None) -> DataFrame:
    return components(g, connected).select("graph_id", (F.col("components") <= 1).alias("connected"))


def component_sizes(g: Graph, connected: str = "strong") -> DataFrame:
    return component_dist(g, connected).groupBy("graph_id", "label").agg(F.count("*").alias("size"))


def component_size_by_vertex(g: Graph, connected: str = "strong") -> DataFrame:
    d = component_dist(g, connected)
    return d.join(d.groupBy("graph_id", "label").agg(F.count("*").alias("size")), ["graph_id", "label"]).select("graph_id", "vid", "size")


def component_largest(g: Graph, connected: str = "strong", *, result: str = "membership"):
    """membership: graph_id, vid, largest; graph: the subgraph that all largest components induce, relabelled."""
    s = component_size_by_vertex(g, connected)
    top = s.groupBy("graph_id").agg(F.max("size").alias("top"))
    m = s.join(top, "graph_id").select("graph_id", "vid", (F.col("size") == F.col("top")).alias("largest"))
    if result == "membership":
        return m
    kept = m.where("largest").withColumn("new", F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")).cast("long") - 1).select("graph_id", "vid", "new")
    e = g.edges.join(kept.select("graph_id", F.col("vid").alias("src"), F.col("new").alias("s")), ["graph_id", "src"]).join(kept.select("graph_id", F.col("vid").alias("dst"), F.col("new").alias("d")), ["graph_id", "dst"])
    return replace(g, vertices=kept.select("graph_id", F.col("new").alias("vid")), edges=e.select("graph_id", F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "missing"))


# Krackhardt's indices ------------------------------------------------------------------


def _weak_sizes(g: Graph) -> DataFrame:
    return component_sizes(g, "weak")


def connectedness(g: Graph) -> DataFrame:
    s = _weak_sizes(g).groupBy("graph_id").agg(F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("s"))
    n = F.col("n")
    return g.orders.join(s, "graph_id").select("graph_id", F.when(n <= 1, 1.0).otherwise(fdiv("s", n * (n - 1) / 2)).alias("connectedness"))


def efficiency(g: Graph) -> DataFrame:
    """1 - (sum of values - needed) / the most violations; values count, so that valued graphs can go far below 0."""
    k, loops = F.col("size"), int(g.loops)
    s = _weak_sizes(g).groupBy("graph_id").agg(F.sum(k - 1).alias("need"), F.sum(k * (k - 1 + loops) - (k - 1)).alias("most"))
    v = g.known.groupBy("graph_id").agg(F.sum("weight").alias("v"))
    return s.join(v, "graph_id", "left").select("graph_id", (1 - fdiv(F.coalesce("v", F.lit(0.0)) - F.col("need"), "most")).alias("efficiency"))


def hierarchy(g: Graph, measure: str = "reciprocity") -> DataFrame:
    """reciprocity: share of asymmetric dyads; krackhardt: 1 - mutual / tied dyads of the reachability graph."""
    from .local import dyad_census

    if measure == "reciprocity":
        c = dyad_census(g)
        return c.select("graph_id", fdiv("asym", F.col("mut") + F.col("asym") + F.col("null")).alias("hierarchy"))
    r = geodist(g).where("src <> dst").select("graph_id", "src", "dst", F.lit(1.0).alias("weight"), F.lit(False).alias("missing"))
    c = dyad_census(replace(g, edges=r, threshold=0.0))
    tied = F.col("mut") + F.col("asym")
    return c.select("graph_id", F.when(tied == 0, 1.0).otherwise(1 - fdiv("mut", tied)).alias("hierarchy"))


def lubness(g: Graph) -> DataFrame:
    """1 - violations / most violations, over weak components of more than two vertices: a pair violates if
    none of the vertices that reach both is reached by all the others that do."""
    r = geodist(g).select("graph_id", F.col("src").alias("k"), F.col("dst").alias("i"))
    labels = component_dist(g, "weak")
    sizes = labels.groupBy("graph_id", "label").agg(F.count("*").alias("size")).where("size > 2")
    inside = labels.join(sizes, ["graph_id", "label"])
    a, b = inside.select("graph_id", "label", F.col("vid").alias("i")), inside.select("graph_id", "label", F.col("vid").alias("j"))
    pairs = a.join(b, ["graph_id", "label"]).where("i < j").select("graph_id", "i", "j")
    above = pairs.join(r, ["graph_id", "i"]).join(r.select("graph_id", "k", F.col("i").alias("j")), ["graph_id", "k", "j"])  # k reaches both
    bounds = above.groupBy("graph_id", "i", "j").agg(F.count("*").alias("bounds"))
    reached = above.select("graph_id", "i", "j", F.col("k").alias("u")).join(above.select("graph_id", "i", "j", "k"), ["graph_id", "i", "j"]).join(r.select("graph_id", F.col("k").alias("u"), F.col("i").alias("k")), ["graph_id", "u", "k"], "left_semi")
    least = reached.groupBy("graph_id", "i", "j", "k").agg(F.count("*").alias("from")).join(bounds, ["graph_id", "i", "j"]).where("`from` = bounds").select("graph_id", "i", "j").distinct()
    bad = pairs.join(least, ["graph_id", "i", "j"], "left_anti").groupBy("graph_id").agg(F.count("*").alias("bad"))
    most = sizes.groupBy("graph_id").agg(F.sum((F.col("size") - 1) * (F.col("size") - 2) / 2).alias("most"))
    x = F.when(F.col("most").isNull(), 1.0).otherwise(1 - fdiv(F.coalesce("bad", F.lit(0)), "most"))
    return g.orders.select("graph_id").join(most, "graph_id", "left").join(bad, "graph_id", "left").select("graph_id", x.alias("lubness"))


# Cohesive subgroups --------------------------------------------------------------------


def cutpoints(g: Graph, connected: str = "strong") -> DataFrame:
    """graph_id, vid of the vertices whose removal adds a component."""

    def fn(m: Local) -> pd.DataFrame:
        if not m.directed or connected in ("weak", "recursive"):
            a = (m.a & m.a.T) if connected == "recursive" else (m.a | m.a.T)
            cut = sorted(K.biconnected(a)[1])
        else:
            whole = len(set(K.component_labels(m.a, connected).tolist()))
            cut = []
            for v in range(m.n):
                rest = np.delete(np.delete(m.a, v, 0), v, 1)
                if len(set(K.component_labels(rest, connected).tolist())) > whole:
                    cut.append(v)
        return pd.DataFrame({"vid": m.vid[cut].astype("int64")})

    return _by_graph(g, "graph_id long, vid long", fn)


def bicomponent_dist(g: Graph, symmetrize: str = "strong") -> DataFrame:
    """graph_id, vid, label: biconnected components, largest first; a shared vertex is in the first; null for none."""

    def fn(m: Local) -> pd.DataFrame:
        comps = K.biconnected((m.a & m.a.T) if symmetrize == "strong" else (m.a | m.a.T))[0]
        label: list[int | None] = [None] * m.n
        for k, c in enumerate(sorted(comps, key=lambda c: (-len(c), c))):
            for v in c:
                label[v] = k if label[v] is None else label[v]
        return pd.DataFrame({"vid": m.vid, "label": pd.array(label, dtype="Int64")})

    return _by_graph(g, "graph_id long, vid long, label long", fn)


def kcores(g: Graph, cmode: str = "freeman", *, ignore_eval: bool = False) -> DataFrame:
    """graph_id, vid, core. freeman adds in and out, so a symmetric graph has twice the usual number."""
    def fn(m: Local) -> pd.DataFrame:
        w = np.where(m.a, 1.0 if ignore_eval else m.w, 0.0)
        return pd.DataFrame({"vid": m.vid, "core": K.core_numbers(w, cmode)})

    return _by_graph(g, "graph_id long, vid long, core double", fn)


def kcores_peeled(g: Graph, cmode: str = "indegree", *, max_rounds: int = 100_000) -> DataFrame:
    """Core numbers by peeling with joins, a round for each layer: for large graphs of ties that count 1."""
    left = materialize(g.ties.where("src <> dst").select("graph_id", "src", "dst"))
    alive = materialize(g.vertices.select("graph_id", "vid"))
    done, k = None, 0
    for _ in range(max_rounds):
        ends = left.select("graph_id", F.col("dst" if cmode != "outdegree" else "src").alias("vid"))
        if cmode == "freeman":
            ends = ends.unionByName(left.select("graph_id", F.col("src").alias("vid")))
        d = alive.join(ends.groupBy("graph_id", "vid").agg(F.count("*").alias("d")), ["graph_id", "vid"], "left").fillna(0, ["d"])
        d = materialize(d)
        low = d.agg(F.min("d")).first()[0]
        if low is None:
            break
        k = max(k, low)
        gone = d.where(F.col("d") <= k).select("graph_id", "vid", F.lit(float(k)).alias("core"))
        done = gone if done is None else done.unionByName(gone)
        alive = d.where(F.col("d") > k).select("graph_id", "vid")
        left = materialize(left.join(alive.withColumnRenamed("vid", "src"), ["graph_id", "src"], "left_semi").join(alive.withColumnRenamed("vid", "dst"), ["graph_id", "dst"], "left_semi"))
    else:
        raise RuntimeError(f"layers go on after {max_rounds} rounds")
    return done if done is not None else alive.withColumn("core", F.lit(0.0))


def _seeded(g: Graph, schema: str, per_vertex, *, undirected: str | None = None) -> DataFrame:
    """Rows from each seed vertex, seeds spread over the cluster, the ties broadcast with their order guarded."""
    spark = g.vertices.sparkSession
    data = {}
    for gid, m in zip([r[0] for r in g.vertices.select("graph_id").distinct().orderBy("graph_id").collect()], g.locals(), strict=True):
        a = m.a & ~np.eye(m.n, dtype=bool)
        if undirected:
            a = (a & a.T) if undirected == "strong" else (a | a.T)
        data[int(gid)] = (m.vid, a, K.degeneracy_rank(a) if undirected == "strong" else None)
    shared = spark.sparkContext.broadcast(data)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for gid, v in zip(part["graph_id"], part["vid"], strict=True):
                vid, a, rank = shared.value[int(gid)]
                rows = per_vertex(a, rank, int(np.searchsorted(vid, v)))
                yield pd.DataFrame({"graph_id": np.full(len(rows), gid), "members": pd.Series([vid[list(r)] for r in rows], dtype=object)})

    seeds = g.vertices.select("graph_id", "vid").repartition(spark.sparkContext.defaultParallelism * 2, "graph_id", "vid")
    return seeds.mapInPandas(run, schema)


def _census(rows: DataFrame, *, name: str, edges: bool) -> dict[str, DataFrame]:
    """aggregate (size, count), by_vertex (size, vid, count), comembership (size, i, j, count), list."""
    size = F.size("members") - (1 if edges else 0)
    r = rows.select("graph_id", size.cast("long").alias("size"), "members").withColumn("k", F.monotonically_increasing_id())
    m = r.select("graph_id", "size", "k", F.explode("members").alias("vid"))
    pairs = r.select("graph_id", "size", F.explode("members").alias("i"), "members").select("graph_id", "size", "i", F.explode("members").alias("j"))
    return {
        "aggregate": r.groupBy("graph_id", "size").agg(F.count("*").alias("count")),
        "by_vertex": m.groupBy("graph_id", "size", "vid").agg(F.count("*").alias("count")),
        "comembership": pairs.groupBy("graph_id", "size", "i", "j").agg(F.count("*").alias("count")),
        "list": r.select("graph_id", "size", "members"),
    }


def clique_census(g: Graph) -> dict[str, DataFrame]:
    """Maximal cliques (of mutual ties in digraphs): by size, by vertex, shared membership, and the list."""
    rows = _seeded(g, "graph_id long, members array<long>", lambda a, rank, v: K.cliques_from(a, rank, v), undirected="strong")
    return _census(materialize(rows), name="clique", edges=False)


def kpath_census(g: Graph, maxlen: int | None = 3) -> dict[str, DataFrame]:
    """Simple paths up to ``maxlen`` ties; also dyad: (size, src, dst, count) by their ends."""
    directed = g.directed
    longest = maxlen if maxlen is not None else max(1, (g.orders.agg(F.max("n")).first()[0] or 1) - 1)
    rows = materialize(_seeded(g, "graph_id long, members array<long>", lambda a, _, v: K.simple_paths(a, v, longest, directed), undirected=None if directed else "weak"))
    out = _census(rows, name="path", edges=True)
    out["dyad"] = rows.select("graph_id", (F.size("members") - 1).cast("long").alias("size"), F.element_at("members", 1).alias("src"), F.element_at("members", -1).alias("dst")).groupBy("graph_id", "size", "src", "dst").agg(F.count("*").alias("count"))
    return out


def kcycle_census(g: Graph, maxlen: int = 3) -> dict[str, DataFrame]:
    directed = g.directed
    rows = _seeded(g, "graph_id long, members array<long>", lambda a, _, v: K.simple_cycles(a, v, maxlen, directed), undirected=None if directed else "weak")
    return _census(materialize(rows), name="cycle", edges=False)


def label_propagation(g: Graph, *, max_iterations: int = 50, ignore_eval: bool = False) -> DataFrame:
    """graph_id, vid, label. Sweeps are in order and each depends on the one before: one task a graph."""

    def fn(m: Local) -> pd.DataFrame:
        return pd.DataFrame({"vid": m.vid, "label": K.label_propagation(np.where(m.a, 1.0 if ignore_eval else m.w, 0.0), max_iterations)})

    return _by_graph(g, "graph_id long, vid long, label long", fn)


# Flow -----------------------------------------------------------------------------------


def _capacity(m: Local, ignore_eval: bool) -> np.ndarray:
    c = (m.w != 0).astype(float) if ignore_eval else np.maximum(0, m.w)
    c[m.na] = 0
    np.fill_diagonal(c, 0)
    return c


def maxflow(g: Graph, *, src: list[int] | None = None, sink: list[int] | None = None, ignore_eval: bool = False) -> DataFrame:
    """src, dst, flow: rows are pairs, spread over the cluster; infinite from a vertex to itself."""
    m = g.local()
    shared = g.vertices.sparkSession.sparkContext.broadcast((m.vid, _capacity(m, ignore_eval)))
    full = replace(g, loops=True)
    pairs = full.pairs.select("src", "dst")
    if src is not None:
        pairs = pairs.where(F.col("src").isin(src))
    if sink is not None:
        pairs = pairs.where(F.col("dst").isin(sink))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vid, c = shared.value
        for p in parts:
            p["flow"] = [K.max_flow(c, int(np.searchsorted(vid, s)), int(np.searchsorted(vid, t))) for s, t in zip(p["src"], p["dst"], strict=True)]
            yield p

    return pairs.repartition(g.vertices.sparkSession.sparkContext.defaultParallelism * 2, "src", "dst").mapInPandas(run, "src long, dst long, flow double")


def flowbet(g: Graph, cmode: str = "rawflow", *, ignore_eval: bool = False, rescale: bool = False) -> DataFrame:
    """vid, flowbet: per pair, how much of the flow is lost without each vertex."""
    if cmode not in ("rawflow", "normflow", "fracflow"):
        raise ValueError(f"unknown mode {cmode}")
    m = g.local()
    shared = g.vertices.sparkSession.sparkContext.broadcast((m.vid, _capacity(m, ignore_eval)))
    pairs = replace(g, loops=False).pairs.select("src", "dst")
    if not g.directed:
        pairs = pairs.where("src < dst")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vid, c = shared.value
        for p in parts:
            out = []
            for s, t in zip(np.searchsorted(vid, p["src"]), np.searchsorted(vid, p["dst"]), strict=True):
                whole = K.max_flow(c, s, t)
                for v in range(len(vid)):
                    if v not in (s, t):
                        d = c.copy()
                        d[v], d[:, v] = 0, 0
                        lost = whole - K.max_flow(d, s, t) if whole else 0.0
                        out.append((int(vid[v]), lost, whole, lost / whole if whole else 0.0))
            yield pd.DataFrame(out, columns=["vid", "lost", "whole", "share"])

    s = pairs.repartition(g.vertices.sparkSession.sparkContext.defaultParallelism * 2, "src", "dst").mapInPandas(run, "vid long, lost double, whole double, share double")
    s = s.groupBy("vid").agg(F.sum("lost").alias("lost"), F.sum("whole").alias("whole"), F.sum("share").alias("share"))
    x = {"rawflow": F.col("lost"), "normflow": F.when(F.col("whole") == 0, 0.0).otherwise(fdiv("lost", "whole")), "fracflow": F.col("share")}[cmode]
    d = g.vertices.select("graph_id", "vid").join(s.select("vid", x.alias("flowbet")), "vid", "left").fillna(0.0, ["flowbet"])
    from .paths import _rescaled

    return _rescaled(d, "flowbet", rescale).select("vid", "flowbet")
