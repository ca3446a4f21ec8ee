"""Degrees, density, dyads, triads, reciprocity, transitivity, brokerage: joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fdiv, nan
from ..graph import Graph
from ..sources.shared import materialize

#: Fixed order of the sixteen directed triad classes.
DIRECTED_TRIAD_CLASSES = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def _vertices(g: Graph) -> DataFrame:
    return g.vertices.select("graph_id", "vid")


def degree(g: Graph, cmode: str = "freeman", *, ignore_eval: bool = False, nodes: list[int] | None = None, rescale: bool = False) -> DataFrame:
    """graph_id, vid, degree. freeman: in plus out; undirected graphs have one degree; a loop counts once."""
    if cmode not in ("freeman", "indegree", "outdegree"):
        raise ValueError(f"unknown mode {cmode}")
    if not g.directed:
        cmode = "indegree"
    e = (g.ties if ignore_eval else g.known).select("graph_id", "src", "dst", (F.lit(1.0) if ignore_eval else F.col("weight")).alias("x"))
    parts = []
    if cmode != "outdegree":
        parts.append(e.select("graph_id", F.col("dst").alias("vid"), "x"))
    if cmode != "indegree":
        out = e if cmode == "outdegree" else e.where("src <> dst")
        parts.append(out.select("graph_id", F.col("src").alias("vid"), "x"))
    ends = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    d = _vertices(g).join(ends.groupBy("graph_id", "vid").agg(F.sum("x").alias("x")), ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("x", F.lit(0.0)).alias("degree"))
    if rescale:
        total = d.groupBy("graph_id").agg(F.sum("degree").alias("total"))
        d = d.join(total, "graph_id").select("graph_id", "vid", fdiv("degree", "total").alias("degree"))
    return d.where(F.col("vid").isin(nodes)) if nodes is not None else d


def nties(g: Graph) -> DataFrame:
    """graph_id, nties: how many ties are possible."""
    n = F.col("n")
    x = n * (n - 1) if g.directed else n * (n - 1) / 2
    return g.orders.select("graph_id", (x + (n if g.loops else 0)).cast("double").alias("nties"))


def gden(g: Graph, *, ignore_eval: bool = False) -> DataFrame:
    """graph_id, density: sum of values over ordered pairs that are not missing."""
    value = F.when(g.tie_mask, 1.0).otherwise(0.0) if ignore_eval else F.when(F.col("missing"), 0.0).otherwise(F.col("weight"))
    s = g.edges.groupBy("graph_id").agg(F.sum(value).alias("s"), F.sum(F.col("missing").cast("long")).alias("m"))
    n = F.col("n")
    possible = n * n if g.loops else n * (n - 1)
    return g.orders.join(s, "graph_id", "left").select("graph_id", fdiv(F.coalesce("s", F.lit(0.0)), possible - F.coalesce("m", F.lit(0))).alias("density"))


def isolates(g: Graph) -> DataFrame:
    """graph_id, vid of the vertices without a tie in or out (a loop is none)."""
    t = g.ties.where("src <> dst")
    ends = t.select("graph_id", F.col("src").alias("vid")).union(t.select("graph_id", "dst"))
    return _vertices(g).join(ends, ["graph_id", "vid"], "left_anti")


def is_isolate(g: Graph, ego: int | list[int] | None = None) -> DataFrame:
    """graph_id, vid, isolate of some vertices; of all without ``ego``."""
    v = _vertices(g)
    if ego is not None:
        v = v.where(F.col("vid").isin([ego] if isinstance(ego, int) else list(ego)))
    iso = isolates(g).withColumn("isolate", F.lit(True))
    return v.join(iso, ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("isolate", F.lit(False)).alias("isolate"))


def _dyads(g: Graph) -> DataFrame:
    """graph_id, i < j, ij, ji (ties), missing: the pairs with any row."""
    e = g.edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), (F.col("src") < F.col("dst")).alias("up"), g.tie_mask.alias("tie"), "missing")
    return e.groupBy("graph_id", "i", "j").agg(F.max(F.col("up") & F.col("tie")).alias("ij"), F.max(~F.col("up") & F.col("tie")).alias("ji"), F.max("missing").alias("missing"))


def dyad_census(g: Graph) -> DataFrame:
    """graph_id, mut, asym, null, missing."""
    c = _dyads(g).groupBy("graph_id").agg(
        F.sum((~F.col("missing") & F.col("ij") & F.col("ji")).cast("long")).alias("mut"),
        F.sum((~F.col("missing") & (F.col("ij") != F.col("ji"))).cast("long")).alias("asym"),
        F.sum(F.col("missing").cast("long")).alias("missing"),
    )
    n = F.col("n")
    z = lambda c: F.coalesce(c, F.lit(0))
    null = (n * (n - 1) / 2).cast("long") - z("mut") - z("asym") - z("missing")
    return g.orders.join(c, "graph_id", "left").select("graph_id", z("mut").alias("mut"), z("asym").alias("asym"), null.alias("null"), z("missing").alias("missing"))


def mutuality(g: Graph) -> DataFrame:
    return dyad_census(g).select("graph_id", F.col("mut").alias("mutuality"))


def grecip(g: Graph, measure: str = "dyadic") -> DataFrame:
    """graph_id, reciprocity. dyadic, dyadic.nonnull, edgewise, edgewise.lrr or correlation."""
    m, a, n = (F.col(c).cast("double") for c in ("mut", "asym", "null"))
    forms = {
        "dyadic": lambda: fdiv(m + n, m + a + n),
        "dyadic.nonnull": lambda: fdiv(m, m + a),
        "edgewise": lambda: fdiv(2 * m, 2 * m + a),
        "edgewise.lrr": lambda: _ln(fdiv(m * (m + a + n), (m + a / 2) * (m + a / 2))),
    }
    if measure in forms:
        return dyad_census(g).select("graph_id", forms[measure]().alias("reciprocity"))
    if measure != "correlation":
        raise ValueError(f"unknown measure {measure}")
    # Pearson of w_ij with w_ji over ordered pairs i <> j, zeros included, pairs with a missing cell left out.
    e = g.edges.where("src <> dst")
    back = e.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"), F.col("missing").alias("back_missing"))
    j = e.join(back, ["graph_id", "src", "dst"], "full").select("graph_id", F.coalesce("weight", F.lit(0.0)).alias("x"), F.coalesce("back", F.lit(0.0)).alias("y"), (F.coalesce("missing", F.lit(False)) | F.coalesce("back_missing", F.lit(False))).alias("out"))
    s = j.groupBy("graph_id").agg(F.sum(F.col("out").cast("long")).alias("out"), *[F.sum(F.when(~F.col("out"), v)).alias(k) for k, v in (("sx", F.col("x")), ("sxx", F.col("x") ** 2), ("sxy", F.col("x") * F.col("y")))])
    c = F.col("n") * (F.col("n") - 1) - F.coalesce("out", F.lit(0))
    sx, sxx, sxy = (F.coalesce(k, F.lit(0.0)) for k in ("sx", "sxx", "sxy"))
    return g.orders.join(s, "graph_id", "left").select("graph_id", fdiv(c * sxy - sx * sx, c * sxx - sx * sx).alias("reciprocity"))


def _ln(x):
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(nan())


def triad_census(g: Graph) -> DataFrame:
    """graph_id, triad, count: the sixteen classes, or undirected 0 to 3 edges.

    Only triples with a tied or missing dyad are enumerated; the empty class is what is left
    of all triples. Triples with a missing dyad are in no class."""
    d = _dyads(g).withColumn("state", F.when(F.col("missing"), 9).when(F.col("ij") & F.col("ji"), 3).when(F.col("ij"), 1).when(F.col("ji"), 2).otherwise(0)).where("state > 0").select("graph_id", "i", "j", "state")
    d = materialize(d)  # derived once
    unknown = "?"
    kind = lambda c: F.when(F.col(c) == 9, unknown).when(F.col(c) == 3, "102" if g.directed else "1").when(F.col(c) > 0, "012" if g.directed else "1")
    flip = lambda c: F.when(F.col(c) == 1, 2).when(F.col(c) == 2, 1).otherwise(F.col(c))
    # Half-edges from each centre: triples with two or more live dyads come from pairs at a centre.
    half = d.select("graph_id", F.col("i").alias("c"), F.col("j").alias("o"), "state").union(d.select("graph_id", F.col("j"), F.col("i"), flip("state")))
    a, b = half.select("graph_id", "c", F.col("o").alias("p"), F.col("state").alias("cp")), half.select("graph_id", "c", F.col("o").alias("q"), F.col("state").alias("cq"))
    wedge = a.join(b, ["graph_id", "c"]).where("p < q")
    close = d.select("graph_id", F.col("i").alias("p"), F.col("j").alias("q"), F.col("state").alias("pq"))
    w = wedge.join(close, ["graph_id", "p", "q"], "left").withColumn("pq", F.coalesce("pq", F.lit(0)))
    # Out- and in-degrees inside the triple tell the class. State bits from the first to the second: 1 out, 2 in.
    out = lambda s: F.col(s).bitwiseAND(1)
    inn = lambda s: F.shiftright(s, 1)
    w = w.select(
        "graph_id",
        kind("pq").alias("kind"),  # of the third dyad, null if it is empty
        ((F.col("pq") == 0) | (F.col("c") < F.col("p"))).alias("once"),  # a triple with three live dyads has three centres
        ((F.col("cp") < 9) & (F.col("cq") < 9) & (F.col("pq") < 9)).alias("known"),
        *[F.expr(f"({' + '.join(f'cast({c} = {v} as int)' for c in ('cp', 'cq', 'pq'))})").alias(k) for k, v in (("mut", 3), ("none", 0))],
        (inn("cp") + inn("cq")).alias("in_c"), (out("cp") + inn("pq")).alias("in_p"), (out("cq") + out("pq")).alias("in_q"),
        (out("cp") + out("cq")).alias("out_c"), (inn("cp") + out("pq")).alias("out_p"), (inn("cq") + inn("pq")).alias("out_q"),
    )
    if g.directed:
        most_in, most_out = F.greatest("in_c", "in_p", "in_q"), F.greatest("out_c", "out_p", "out_q")
        least_in, least_out = F.least("in_c", "in_p", "in_q"), F.least("out_c", "out_p", "out_q")
        m, n = F.col("mut"), F.col("none")
        # With one null dyad and two asymmetric ones: a sender of both, a receiver of both, or a chain.
        name = (
            F.when((m == 0) & (n == 1), F.when(most_out == 2, "021D").when(most_in == 2, "021U").otherwise("021C"))
            .when((m == 1) & (n == 1), F.when((least_in == 0) & (most_in == 2), "111D").otherwise("111U"))
            .when((m == 0) & (n == 0), F.when(most_in == 2, "030T").otherwise("030C"))
            .when((m == 2) & (n == 1), F.lit("201"))
            .when((m == 1) & (n == 0), F.when(least_in == 0, "120D").when(least_out == 0, "120U").otherwise("120C"))
            .when((m == 2) & (n == 0), F.lit("210"))
            .otherwise(F.lit("300"))
        )
    else:
        name = (3 - F.col("none")).cast("string")
    sums = materialize(w.groupBy("graph_id", "kind", "once", F.when(F.col("known"), name).alias("triad")).agg(F.count("*").alias("count")))
    many = sums.where("once and triad is not null").groupBy("graph_id", "triad").agg(F.sum("count").alias("count"))
    # Triples with one live dyad: per dyad, all third vertices but those that touch either end; those that
    # touch both were taken away twice, and are the wedges over the dyad.
    ends = half.groupBy("graph_id", "c").agg(F.count("*").alias("k"))
    by_kind = half.join(ends, ["graph_id", "c"]).groupBy("graph_id", kind("state").alias("kind")).agg(F.sum("k").alias("touching"), (F.count("*") / 2).cast("long").alias("dyads"))
    both = sums.where("kind is not null").groupBy("graph_id", "kind").agg(F.sum("count").alias("both"))
    one = by_kind.join(both, ["graph_id", "kind"], "left").join(g.orders, "graph_id")
    one = materialize(one.select("graph_id", "kind", (F.col("n") * F.col("dyads") - F.col("touching") + F.coalesce("both", F.lit(0))).alias("alone")))
    single = one.where(f"kind <> '{unknown}'").select("graph_id", F.col("kind").alias("triad"), F.col("alone").alias("count"))
    # Live triples in all: each of the wedges' triples once, and the single ones.
    live = sums.where("once").select("graph_id", F.col("count").alias("x")).union(one.select("graph_id", "alone")).groupBy("graph_id").agg(F.sum("x").alias("live"))
    n = F.col("n")
    empty = g.orders.join(live, "graph_id", "left").select("graph_id", F.lit("003" if g.directed else "0").alias("triad"), ((n * (n - 1) * (n - 2) / 6).cast("long") - F.coalesce("live", F.lit(0))).alias("count"))
    classes = DIRECTED_TRIAD_CLASSES if g.directed else ("0", "1", "2", "3")
    grid = g.orders.select("graph_id", F.explode(F.array(*map(F.lit, classes))).alias("triad"))
    found = many.unionByName(single).unionByName(empty)
    return grid.join(found, ["graph_id", "triad"], "left").select("graph_id", "triad", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def triad_classify(g: Graph, triple: tuple[int, int, int]) -> str | None:
    """Class of one triple of vertices; None if a dyad of it is missing."""
    part = Graph(g.vertices.where(F.col("vid").isin(*triple)), g.edges.where(F.col("src").isin(*triple) & F.col("dst").isin(*triple)), g.directed, g.loops, g.threshold)
    if part.edges.where("missing and src <> dst").limit(1).count():
        return None
    return triad_census(part).where("count > 0").first()["triad"]


def _two_paths(g: Graph) -> DataFrame:
    """graph_id, i, j, k, wij, wjk of ties i -> j -> k, all three distinct."""
    t = g.ties.where("src <> dst")
    a = t.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("wij"))
    b = t.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("k"), F.col("weight").alias("wjk"))
    return a.join(b, ["graph_id", "j"]).where("i <> k")


def gtrans(g: Graph, measure: str = "weak") -> DataFrame:
    """graph_id, transitivity: weak, strong, weakcensus, strongcensus, rank or correlation. An empty ratio is 1."""
    if measure == "correlation":
        return _gtrans_correlation(g)
    close = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("k"), "weight", "missing", g.tie_mask.alias("tie"))
    p = _two_paths(g).join(close, ["graph_id", "i", "k"], "left").where("missing is null or not missing")
    tie = F.coalesce("tie", F.lit(False))
    if measure == "rank":
        closing = F.when(tie, F.col("weight")).otherwise(0.0)
        good = closing >= F.least("wij", "wjk")
    else:
        good = tie
    s = g.orders.join(p.groupBy("graph_id").agg(F.count("*").alias("paths"), F.sum(good.cast("long")).alias("good")), "graph_id", "left")
    paths, good = F.coalesce("paths", F.lit(0)), F.coalesce("good", F.lit(0))
    if measure in ("weak", "rank"):
        x = F.when(paths == 0, 1.0).otherwise(fdiv(good, paths))
    elif measure == "weakcensus":
        x = good.cast("double")
    elif measure in ("strong", "strongcensus"):
        # Both or neither of (i,j,k) and (i,k): closed two-paths, plus triples with no two-path and no tie i,k.
        n = F.col("n")
        if g.edges.where("missing and src <> dst").limit(1).count():
            raise ValueError("strong transitivity is not defined here with missing ties")
        arcs = g.ties.where("src <> dst").groupBy("graph_id").agg(F.count("*").alias("arcs"))
        s = s.join(arcs, "graph_id", "left")
        triples, tied = n * (n - 1) * (n - 2), F.coalesce("arcs", F.lit(0)) * (n - 2)
        agree = good + triples - (paths + tied - good)
        x = agree.cast("double") if measure == "strongcensus" else F.when(triples == 0, 1.0).otherwise(fdiv(agree, triples))
    else:
        raise ValueError(f"unknown measure {measure}")
    return s.select("graph_id", x.alias("transitivity"))


def _gtrans_correlation(g: Graph) -> DataFrame:
    """Pearson of W with its square over cells that miss no term."""
    import numpy as np

    rows = []
    for gid, m in zip([r[0] for r in g.vertices.select("graph_id").distinct().orderBy("graph_id").collect()], g.locals(), strict=True):
        w = m.values()
        square = w @ w
        keep = ~np.isnan(w) & ~np.isnan(square)
        if not g.loops:
            keep &= ~np.eye(len(w), dtype=bool)
        x, y = w[keep], square[keep]
        sd = x.std() * y.std() if len(x) else 0
        r = float(((x - x.mean()) * (y - y.mean())).mean() / sd) if sd else float(len(x) > 0 and np.array_equal(x, y))
        rows.append((gid, r))
    return g.vertices.sparkSession.createDataFrame(rows, "graph_id long, transitivity double")


def brokerage(g: Graph, classes: DataFrame) -> DataFrame:
    """graph_id, vid and the counts w_i, w_o, b_io, b_oi, b_o, t of brokered two-paths i -> j -> k without i -> k.

    classes: vid, cl (any scalar; null, and a vertex without a row, are one class of their own)."""
    t = g.known.where("src <> dst and weight <> 0").select("graph_id", "src", "dst")
    a, b = t.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")), t.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("k"))
    p = a.join(b, ["graph_id", "j"]).where("i <> k").join(t.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("k")), ["graph_id", "i", "k"], "left_anti")
    c = classes.select("vid", F.col("cl").cast("string").alias("cl"))
    for v in "ijk":
        p = p.join(c.select(F.col("vid").alias(v), F.col("cl").alias(f"c{v}")), v, "left").fillna("\0null", f"c{v}")
    role = F.when((F.col("ci") == F.col("cj")) & (F.col("cj") == F.col("ck")), "w_i").when(F.col("ci") == F.col("ck"), "w_o").when(F.col("ci") == F.col("cj"), "b_oi_").when(F.col("cj") == F.col("ck"), "b_oi").otherwise("b_o")
    s = p.groupBy("graph_id", F.col("j").alias("vid")).agg(*[F.sum((role == key).cast("long")).alias(name) for name, key in (("w_i", "w_i"), ("w_o", "w_o"), ("b_io", "b_oi_"), ("b_oi", "b_oi"), ("b_o", "b_o"))], F.count("*").alias("t"))
    return _vertices(g).join(s, ["graph_id", "vid"], "left").fillna(0, ["w_i", "w_o", "b_io", "b_oi", "b_o", "t"])


def simmelian(g: Graph, *, dichotomize: bool = True) -> DataFrame:
    """graph_id, src, dst, value: mutual ties with a shared mutual partner; the number of partners if not dichotomized."""
    t = g.ties.where("src <> dst").select("graph_id", "src", "dst")
    m = t.join(t.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), ["graph_id", "src", "dst"], "left_semi")
    two = m.select("graph_id", "src", F.col("dst").alias("k")).join(m.select("graph_id", F.col("src").alias("k"), "dst"), ["graph_id", "k"]).where("src <> dst")
    s = two.join(m, ["graph_id", "src", "dst"], "left_semi").groupBy("graph_id", "src", "dst").agg(F.count("*").cast("double").alias("value"))
    return s.withColumn("value", F.lit(1.0)) if dichotomize else s
