"""Graph algebra and data preparation: projections, joins and windows over sparse edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fdiv, nan, rng
from ..graph import EDGE_SCHEMA, Graph

CELL = ["graph_id", "src", "dst"]


def _cells(g: Graph) -> DataFrame:
    return g.edges.select(*CELL, "weight", "missing")


def gt(g: Graph) -> Graph:
    """Transpose."""
    return replace(g, edges=_cells(g).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "missing"))


def symmetrize(g: Graph, rule: str = "weak", *, keep_values: bool = False) -> Graph:
    """weak (either), strong (both), upper or lower (that triangle's values on both sides).

    weak and strong give 0/1 with three-valued logic for missing cells; ``keep_values`` keeps
    the value that is larger in size, and a missing one stays missing."""
    e = _cells(g).where("missing or weight <> 0")
    if rule in ("upper", "lower"):
        half = e.where("src <= dst" if rule == "upper" else "src >= dst")
        back = half.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "missing")
        return replace(g, edges=half.unionByName(back), directed=False)
    if rule not in ("weak", "strong"):
        raise ValueError(f"unknown rule {rule}")
    back = e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"), F.col("missing").alias("m2"))
    j = e.join(back, CELL, "full")
    a = F.when(F.col("missing"), F.lit(None)).otherwise(F.col("missing").isNotNull())
    b = F.when(F.col("m2"), F.lit(None)).otherwise(F.col("m2").isNotNull())
    tie = (a | b) if rule == "weak" else (a & b)
    w, w2 = F.coalesce("weight", F.lit(0.0)), F.coalesce("w2", F.lit(0.0))
    value = F.when(F.abs(w) >= F.abs(w2), w).otherwise(w2) if keep_values else F.lit(1.0)
    out = j.select(*CELL, tie.alias("tie"), value.alias("weight")).where("tie is null or tie")
    return replace(g, edges=out.select(*CELL, F.when(F.col("tie"), F.col("weight")).otherwise(0.0).alias("weight"), F.col("tie").isNull().alias("missing")), directed=False)


def symmetrize_edge_list(edges: DataFrame, rule: str = "weak") -> DataFrame:
    """Edge lists with a position (pos): weak keeps the first edge of each unordered pair, strong
    the second and later ones, upper and lower a triangle; then reverses, then loops."""
    e = edges.select("src", "dst", "weight", "pos")
    off, loops = e.where("src <> dst"), e.where("src = dst")
    if rule in ("weak", "strong"):
        r = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("pos"))
        keep = off.withColumn("r", r).where("r = 1" if rule == "weak" else "r > 1").drop("r")
    else:
        keep = off.where("src < dst" if rule == "upper" else "src > dst")
    back = keep.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "pos")
    part = lambda d, k: d.withColumn("part", F.lit(k))
    return part(keep, 0).unionByName(part(back, 1)).unionByName(part(loops, 2))


def add_isolates(g: Graph, n: int) -> Graph:
    top = g.vertices.groupBy("graph_id").agg(F.max("vid").alias("top"))
    new = top.select("graph_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "top").select("graph_id", (F.col("top") + F.col("k")).alias("vid")) if n > 0 else top.select("graph_id", F.col("top").alias("vid")).limit(0)
    return replace(g, vertices=g.vertices.unionByName(new, allowMissingColumns=True))


def _set_cells(g: Graph, where: str, value: float) -> Graph:
    kept = _cells(g).where(f"not ({where})")
    v = g.vertices.select("graph_id", "vid")
    pairs = v.select("graph_id", F.col("vid").alias("src"), F.col("vid").alias("dst")) if where == "src = dst" else v.withColumnRenamed("vid", "src").join(v.withColumnRenamed("vid", "dst"), "graph_id").where(where)
    nan = value != value
    new = pairs.select(*CELL, F.lit(0.0 if nan else float(value)).alias("weight"), F.lit(nan).alias("missing"))
    return replace(g, edges=kept.unionByName(new) if value else kept, loops=g.loops or where == "src = dst")


def diag_remove(g: Graph, value: float = float("nan")) -> Graph:
    return _set_cells(g, "src = dst", value)


def upper_tri_remove(g: Graph, value: float = float("nan")) -> Graph:
    return _set_cells(g, "src < dst", value)


def lower_tri_remove(g: Graph, value: float = float("nan")) -> Graph:
    return _set_cells(g, "src > dst", value)


def as_edgelist_sna(g: Graph, *, as_digraph: bool = True, suppress_diag: bool = False) -> DataFrame:
    """Rows with an edge (missing ones too), pos in column-major order; undirected lists hold both directions."""
    e = _cells(g).where("missing or weight <> 0")
    if suppress_diag:
        e = e.where("src <> dst")
    if not as_digraph:
        e = e.where("src <= dst")
    return e.join(g.orders, "graph_id").select(*CELL, F.when(F.col("missing"), nan()).otherwise(F.col("weight")).alias("weight"), (F.col("dst") * F.col("n") + F.col("src")).alias("pos"))


def as_sociomatrix_sna(g: Graph) -> DataFrame:
    """All cells with their values (NaN: missing)."""
    full = replace(g, loops=True)
    return full.grid.select(*CELL, F.when(F.col("missing"), nan()).otherwise(F.col("weight")).alias("weight"))


def bipartite(table: DataFrame, rows: int, *, row: str = "row", col: str = "col", value: str = "value", cols: int | None = None) -> Graph:
    """A rectangular r x c table of (row, col, value) as a square graph of r + c vertices, both arcs present."""
    cols = cols if cols is not None else (table.agg(F.max(col)).first()[0] or -1) + 1
    e = table.select(F.col(row).cast("long").alias("src"), (F.col(col) + rows).cast("long").alias("dst"), F.col(value).cast("double").alias("weight"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    v = table.sparkSession.range(rows + cols).select(F.col("id").alias("vid"), (F.col("id") >= rows).cast("int").alias("part"))
    return Graph.from_tables(v, e, directed=False)


def is_edgelist_sna(edges: DataFrame, order: int) -> bool:
    if not {"src", "dst", "weight"} <= set(edges.columns):
        return False
    bad = "src is null or dst is null or weight is null or src < 0 or dst < 0 or src >= {0} or dst >= {0} or src <> floor(src) or dst <> floor(dst)".format(int(order))
    return edges.where(bad).limit(1).count() == 0


def ego_extract(g: Graph, *, ego: list[int] | None = None, neighborhood: str = "combined") -> DataFrame:
    """ego, src, dst, weight, missing: per ego the induced subgraph, relabelled with the ego 0 and its neighbours ascending."""
    t = g.known.where("weight > 0 and src <> dst")
    out, inn = t.select("graph_id", F.col("src").alias("ego"), F.col("dst").alias("vid")), t.select("graph_id", F.col("dst").alias("ego"), F.col("src").alias("vid"))
    alters = {"out": out, "in": inn, "combined": out.union(inn).distinct()}[neighborhood]
    egos = g.vertices.select("graph_id", F.col("vid").alias("ego"))
    if ego is not None:
        egos = egos.where(F.col("ego").isin(ego))
    m = egos.select("graph_id", "ego", F.col("ego").alias("vid")).union(alters.join(egos, ["graph_id", "ego"], "left_semi"))
    m = m.withColumn("label", F.row_number().over(Window.partitionBy("graph_id", "ego").orderBy(F.col("vid") != F.col("ego"), "vid")) - 1)
    a = m.select("graph_id", "ego", F.col("vid").alias("src"), F.col("label").alias("i"))
    b = m.select("graph_id", "ego", F.col("vid").alias("dst"), F.col("label").alias("j"))
    return _cells(g).join(a, ["graph_id", "src"]).join(b, ["graph_id", "ego", "dst"]).select("graph_id", "ego", F.col("i").alias("src"), F.col("j").alias("dst"), "weight", "missing")


def gvectorize(g: Graph, *, censor_as_na: bool = True) -> DataFrame:
    """graph_id, pos, value: cells in column-major order. The diagonal (without loops) and, undirected,
    the upper triangle are NaN, or left out if not ``censor_as_na``."""
    full = replace(g, loops=True).grid.join(g.orders, "graph_id")
    cut = F.lit(False)
    if not g.loops:
        cut = cut | (F.col("src") == F.col("dst"))
    if not g.directed:
        cut = cut | (F.col("src") < F.col("dst"))
    rows = full.select("graph_id", (F.col("dst") * F.col("n") + F.col("src")).alias("pos"), F.when(cut | F.col("missing"), nan()).otherwise(F.col("weight")).alias("value"), cut.alias("cut"))
    return (rows if censor_as_na else rows.where("not cut")).select("graph_id", "pos", "value")


def event2dichot(g: Graph, method: str = "quantile", *, thresh: float | list[float] = 0.5, leq: bool = False, rank_semantics: str = "cell") -> Graph:
    """Dichotomize values: quantile, mean, absolute or rank; over all cells, or by row (r...) or column (c...).

    rank_semantics: "cell" marks the cells of the largest values, up to the threshold; "order" is by the
    sorting permutation: place p (from the smallest value on) is marked if the p-th smallest value stood
    among the last places, fewer than the threshold from the end, column-major."""
    names = {"quantile": ("quantile", None), "rquantile": ("quantile", "src"), "cquantile": ("quantile", "dst"), "mean": ("mean", None), "rmean": ("mean", "src"), "cmean": ("mean", "dst"), "absolute": ("absolute", None), "rabsolute": ("absolute", "src"), "cabsolute": ("absolute", "dst"), "rank": ("rank", None), "rrank": ("rank", "src"), "crank": ("rank", "dst")}
    if method not in names:
        raise ValueError(f"unknown method {method}")
    kind, by = names[method]
    cells = replace(g, loops=True).grid
    keys = ["graph_id"] + ([by] if by else [])
    if kind == "rank" and rank_semantics == "order":
        own = Window.partitionBy(*keys)
        cells = cells.withColumn("at", F.row_number().over(own.orderBy("dst", "src"))).withColumn("of", F.count("*").over(own))
        by_value = cells.select(*keys, F.row_number().over(own.orderBy("missing", "weight", "at")).alias("at"), F.col("missing").alias("gone"), (F.col("of") - F.col("at") + 1 < thresh).alias("hit"))
        cells = cells.drop("missing").join(by_value, [*keys, "at"]).withColumnRenamed("gone", "missing")
    elif kind == "rank":
        # Largest first; missing cells last. Cells of rank up to the threshold are ties.
        r = F.row_number().over(Window.partitionBy(*keys).orderBy("missing", F.desc("weight"), "dst", "src"))
        cells = cells.withColumn("hit", r <= thresh)
    else:
        if kind == "absolute":
            cells = cells.withColumn("cut", F.lit(float(thresh)) if not isinstance(thresh, list) else F.element_at(F.array(*map(F.lit, map(float, thresh))), (F.col(by or "src") + 1).cast("int")))
        else:
            v = F.when(~F.col("missing"), F.col("weight"))
            stat = F.avg(v) if kind == "mean" else F.percentile(v, float(thresh))
            cells = cells.join(cells.groupBy(*keys).agg(stat.alias("cut")), keys)
        cells = cells.withColumn("hit", F.col("weight") > F.col("cut"))
    hit = ~F.col("hit") if leq else F.col("hit")
    out = cells.where(F.col("missing") | hit).select(*CELL, F.when(F.col("missing"), 0.0).otherwise(1.0).alias("weight"), "missing")
    return replace(g, edges=out if g.loops else out.where("src <> dst"))


def make_stochastic(g: Graph, mode: str = "row", *, tol: float = 0.005, maxiter: int = 1000, seed: int = 0) -> Graph:
    """Normalize by row, col, total, or rowcol (both by alternating scaling until within ``tol``)."""
    e = _cells(g).where("not missing")
    if mode in ("row", "col", "total"):
        keys = ["graph_id"] + {"row": ["src"], "col": ["dst"], "total": []}[mode]
        s = e.groupBy(*keys).agg(F.sum("weight").alias("s"))
        out = e.join(s, keys).select(*CELL, fdiv("weight", "s").alias("weight"), "missing")
        return replace(g, edges=out.where("not isnan(weight) and abs(weight) < double('inf')"))
    if mode != "rowcol":
        raise ValueError(f"unknown mode {mode}")

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        """One graph a task: Sinkhorn scaling of its sparse values."""
        w = pdf["weight"].to_numpy(float)
        for _ in range(maxiter):
            for key in ("src", "dst"):
                s = pdf[key].map(pd.Series(w).groupby(pdf[key].to_numpy()).sum()).to_numpy()
                w = np.where(s != 0, w / np.where(s != 0, s, 1), 0)
            if abs(pd.Series(w).groupby(pdf["src"].to_numpy()).sum() - 1).max() < tol:
                break
        return pdf.assign(weight=w)

    return replace(g, edges=e.groupBy("graph_id").applyInPandas(scale, EDGE_SCHEMA))


def sr2css(g: Graph) -> Graph:
    """A self-report graph as a stack with one slice a vertex: its own row; all other cells are missing."""
    n = g.vertices.select(F.col("vid").alias("slice"))
    cells = replace(g, loops=True).grid.crossJoin(F.broadcast(n))  # n^3 cells are the output itself
    out = cells.select(F.col("slice").alias("graph_id"), "src", "dst", F.when(F.col("src") == F.col("slice"), F.col("weight")).otherwise(0.0).alias("weight"), ((F.col("src") != F.col("slice")) | F.col("missing")).alias("missing"))
    v = g.vertices.select("vid").crossJoin(F.broadcast(n)).select(F.col("slice").alias("graph_id"), "vid")
    return replace(g, vertices=v, edges=out.where("missing or weight <> 0"), loops=True)


def interval_graph(spells: DataFrame, kind: str = "simple", *, diag: bool = False, width: float | None = None) -> DataFrame:
    """idx pairs of spells that overlap (closed intervals): graph_id, src, dst, value.

    simple 1; overlap its length; fracxy, fracyx its share of the first or second; jntfrac twice
    its length over both. The range join is an equi-join on time buckets of ``width``, else of the spells'
    mean length, or of so much that there are no more buckets than spells."""
    graph = "graph_id" if "graph_id" in spells.columns else None
    s = spells.select((F.col(graph) if graph else F.lit(0).cast("long")).alias("graph_id"), F.col("idx").alias("src"), F.col("onset").cast("double").alias("o1"), F.col("terminus").cast("double").alias("t1"))
    if s.where("o1 > t1 or isnan(o1) or isnan(t1) or o1 is null or t1 is null or abs(o1) = double('inf') or abs(t1) = double('inf')").limit(1).count():
        raise ValueError("spells must be finite and end no earlier than they begin")
    u = s.select("graph_id", F.col("src").alias("dst"), F.col("o1").alias("o2"), F.col("t1").alias("t2"))
    overlap = (F.col("o1") <= F.col("t2")) & (F.col("t1") >= F.col("o2"))
    if not width:
        first, last, mean, count = s.agg(F.min("o1"), F.max("t1"), F.avg(F.col("t1") - F.col("o1")), F.count("*")).first()
        width = max(mean, (last - first) / count) if count else None  # then a spell is in two buckets or so, and buckets are no more than spells
    if width:
        bucket = lambda o, t: F.explode(F.sequence(F.floor(F.col(o) / width), F.floor(F.col(t) / width)))
        j = s.withColumn("k", bucket("o1", "t1")).join(u.withColumn("k", bucket("o2", "t2")), ["graph_id", "k"]).where(overlap)
        j = j.where(F.col("k") == F.floor(F.greatest("o1", "o2") / width)).drop("k")  # each pair in one bucket
    else:
        j = s.join(u, "graph_id").where(overlap)
    if not diag:
        j = j.where("src <> dst")
    both = F.least("t1", "t2") - F.greatest("o1", "o2")
    one, two = F.col("t1") - F.col("o1"), F.col("t2") - F.col("o2")
    value = {"simple": F.lit(1.0), "overlap": both, "fracxy": fdiv(both, one), "fracyx": fdiv(both, two), "jntfrac": fdiv(2 * both, one + two)}[kind]
    return j.select("graph_id", "src", "dst", value.alias("value"))


def graph_composition(a: Graph, b: Graph) -> Graph:
    """Ties i, j with some k such that a has i, k and b has k, j."""
    x = a.known.where("weight <> 0").select("graph_id", "src", F.col("dst").alias("k"))
    y = b.known.where("weight <> 0").select("graph_id", F.col("src").alias("k"), "dst")
    e = x.join(y, ["graph_id", "k"]).select(*CELL).distinct()
    return replace(a, edges=e.select(*CELL, F.lit(1.0).alias("weight"), F.lit(False).alias("missing")), loops=True)


def gapply(g: Graph, margin: str, stats: DataFrame, fn: str | Callable, *, distance: int = 1) -> DataFrame:
    """vid, value: a function over the statistics of each vertex's neighbourhood.

    margin: row (out), col (in) or both. stats: vid, value. fn: sum, mean, min, max, count (built in),
    or a function of a numpy array, which runs by Arrow batches."""
    t = g.known.where(F.col("weight") > g.threshold).where("src <> dst")
    if distance > 1:
        from .paths import reach_within

        t = reach_within(replace(g, edges=t.withColumn("missing", F.lit(False))), distance)
    out, inn = t.select(F.col("src").alias("ego"), F.col("dst").alias("vid")), t.select(F.col("dst").alias("ego"), F.col("src").alias("vid"))
    near = {"row": out, "col": inn, "both": out.union(inn)}[margin].distinct()
    j = near.join(stats.select("vid", "value"), "vid")
    v = g.vertices.select(F.col("vid").alias("ego"))
    if isinstance(fn, str):
        built = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn]
        r = v.join(j.groupBy("ego").agg(built("value").cast("double").alias("value")), "ego", "left")
        return (r.fillna(0.0, ["value"]) if fn in ("sum", "count") else r).withColumnRenamed("ego", "vid")
    r = j.groupBy("ego").applyInPandas(lambda p: pd.DataFrame({"ego": p["ego"].iloc[:1], "value": [float(fn(p["value"].to_numpy()))]}), "ego long, value double")
    return v.join(r, "ego", "left").withColumnRenamed("ego", "vid")


def gliop(g: Graph, fn: Callable[[Graph], float], op: str | Callable, g1: int, g2: int) -> float:
    """A statistic of two members of a stack, combined by + - * / or a function."""
    one, two = (fn(replace(g, vertices=g.vertices.where(F.col("graph_id") == i), edges=g.edges.where(F.col("graph_id") == i))) for i in (g1, g2))
    if callable(op):
        return op(one, two)
    return {"+": one + two, "-": one - two, "*": one * two, "/": float(np.float64(one) / np.float64(two))}[op]


def rperm(labels: list, seed: int = 0) -> np.ndarray:
    """A random permutation that moves items only among those with one label."""
    labels = np.asarray(labels)
    out, r = np.arange(len(labels)), rng(seed)
    for x in dict.fromkeys(labels.tolist()):
        at = np.flatnonzero(labels == x)
        out[at] = r.permutation(at)
    return out


def rmperm(g: Graph, seed: int = 0) -> Graph:
    """A random relabelling of each graph: the rank of a hash of (seed, graph, vertex) is the new label."""
    h = F.xxhash64(F.lit(seed), "graph_id", "vid")
    new = g.vertices.select("graph_id", "vid", F.row_number().over(Window.partitionBy("graph_id").orderBy(h, "vid")).alias("r"), F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")).alias("p"))
    m = new.select("graph_id", F.col("vid").alias("old"), "r").join(new.select("graph_id", F.col("vid").alias("new"), F.col("p").alias("r")), ["graph_id", "r"]).drop("r")
    e = _cells(g).join(m.withColumnsRenamed({"old": "src", "new": "s"}), ["graph_id", "src"]).join(m.withColumnsRenamed({"old": "dst", "new": "d"}), ["graph_id", "dst"])
    return replace(g, edges=e.select("graph_id", F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "missing"))
