"""Summaries of results as tables and text: tests, fits, blockmodels, brokerage, draws."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import f_upper, fdiv, normal_two_sided, quantile
from ..graph import Graph
from .bayes import Draws
from .biased import BiasedNet
from .layouts import classical_mds
from .nulls import NullTest
from .regression import Fit, Lnam
from .roles import Dendrogram


def quantile_summary(values: DataFrame, value: str = "value") -> DataFrame:
    """min, q1, median, mean, q3, max over finite values; exact, linearly interpolated quartiles."""
    v = values.where(f"{value} is not null and not isnan({value}) and abs({value}) < double('inf')")
    q = lambda p: F.percentile(value, p)
    return v.agg(F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), F.avg(value).alias("mean"), q(0.75).alias("q3"), F.max(value).alias("max"))


def summary_null_test(t: NullTest) -> dict:
    """Of qaptest, cugtest and cug_test: observed, tail shares and the distribution's five numbers and mean."""
    ge, le = t.tails()
    return {"observed": t.observed, "p_ge": ge, "p_le": le, "reps": t.reps.count()} | quantile_summary(t.reps).first().asDict()


def print_null_test(t: NullTest) -> str:
    s = summary_null_test(t)
    name = {"qap": "QAP test", "cug": "CUG test"}.get(t.kind, f"Univariate CUG test given {t.kind}")
    return f"{name}\nobserved {s['observed']:.6g}\np(f(perm) >= f(d)): {s['p_ge']:.4f}\np(f(perm) <= f(d)): {s['p_le']:.4f}\nreplicates {s['reps']}"


def print_summary_null_test(t: NullTest) -> str:
    s = summary_null_test(t)
    return print_null_test(t) + "\n" + "\n".join(f"  {k:>6}: {s[k]:.6g}" for k in ("min", "q1", "median", "mean", "q3", "max"))


def plot_null_test(t: NullTest, bins: int = 30) -> DataFrame:
    """bin, low, high, count of the null distribution."""
    low, high = t.reps.agg(F.min("value"), F.max("value")).first()
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1)).alias("bin")
    return t.reps.groupBy(b).agg(F.count("*").alias("count")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "count")


def gdist_plotdiff(distances: DataFrame, measures: DataFrame) -> tuple[DataFrame, dict]:
    """Graph distance (g1, g2, d) against differences of a measure (graph_id, value), and the regression line."""
    a = measures.select(F.col("graph_id").alias("g1"), F.col("value").alias("a"))
    b = measures.select(F.col("graph_id").alias("g2"), F.col("value").alias("b"))
    d = distances.where("g1 < g2").join(a, "g1").join(b, "g2").select("g1", "g2", "d", F.abs(F.col("a") - F.col("b")).alias("difference"))
    line = d.agg(F.regr_slope("difference", "d").alias("slope"), F.regr_intercept("difference", "d").alias("intercept")).first().asDict()
    return d, line


def gdist_plotstats(distances: DataFrame, measures: DataFrame) -> DataFrame:
    """graph_id, x, y by classical scaling of the distances, with each measure over its maximum."""
    p = distances.toPandas()
    ids = sorted(set(p["g1"]) | set(p["g2"]))
    at = {g: i for i, g in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    m[p["g1"].map(at), p["g2"].map(at)] = p["d"]
    x = classical_mds(np.maximum(m, m.T))
    spark = distances.sparkSession
    where = spark.createDataFrame([(int(g), float(x[i, 0]), float(x[i, 1]) if x.shape[1] > 1 else 0.0) for g, i in at.items()], "graph_id long, x double, y double")
    names = [c for c in measures.columns if c != "graph_id"]
    top = measures.agg(*[F.max(c).alias(f"_{c}") for c in names])
    return where.join(measures.crossJoin(F.broadcast(top)), "graph_id").select("graph_id", "x", "y", *[fdiv(c, f"_{c}").alias(c) for c in names])  # one row


def summary_blockmodel(blocks: DataFrame, classes: DataFrame) -> dict:
    return {"blocks": blocks, "classes": classes.groupBy("cl").agg(F.count("*").alias("size"))}


def print_blockmodel(blocks: DataFrame) -> str:
    p = blocks.orderBy("graph_id", "row", "col").toPandas()
    return "\n\n".join(f"Graph {g}\n{x.pivot(index='row', columns='col', values='value').to_string()}" for g, x in p.groupby("graph_id"))


def print_summary_blockmodel(blocks: DataFrame, classes: DataFrame) -> str:
    s = summary_blockmodel(blocks, classes)
    return print_blockmodel(blocks) + "\n\nClass sizes\n" + s["classes"].orderBy("cl").toPandas().to_string(index=False)


def plot_blockmodel(g: Graph, classes: DataFrame) -> DataFrame:
    """row, col, value with actors arranged by class."""
    from .prep import as_sociomatrix_sna

    c = classes.select("vid", "cl")
    cells = as_sociomatrix_sna(g).join(c.select(F.col("vid").alias("src"), F.col("cl").alias("a")), "src").join(c.select(F.col("vid").alias("dst"), F.col("cl").alias("b")), "dst")
    return cells.select("a", "src", "b", "dst", F.col("weight").alias("value"))


def print_equiv_clust(d: Dendrogram) -> str:
    return f"Position analysis: {len(d.order)} actors, {len(d.merge)} merges\norder {d.order}\nheights {[round(x, 6) for x in d.height]}"


def plot_equiv_clust(d: Dendrogram, spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, a, b, float(h)) for i, ((a, b), h) in enumerate(zip(d.merge, d.height, strict=True))], "step int, left int, right int, height double")


BROKER_ROLES = ("w_i", "w_o", "b_io", "b_oi", "b_o", "t")


#: Whether a role takes sender, broker and receiver of these classes.
_ROLE = {
    "w_i": lambda a, b, c: a == b == c,
    "w_o": lambda a, b, c: a == c != b,
    "b_io": lambda a, b, c: a == b != c,
    "b_oi": lambda a, b, c: b == c != a,
    "b_o": lambda a, b, c: len({a, b, c}) == 3,
    "t": lambda a, b, c: True,
}


def _together(places: tuple[int, int, int], d: float) -> float:
    """Covariance, under independent ties of probability d, of brokerage of (0, 1, 2) and of ``places``
    (sender, broker, receiver; 3 and above are other vertices)."""
    signs: dict[tuple[int, int], set[int]] = {}
    for i, j, k in ((0, 1, 2), places):
        for arc, sign in (((i, j), 1), ((j, k), 1), ((i, k), 0)):
            signs.setdefault(arc, set()).add(sign)
    both = 0.0 if any(len(s) > 1 for s in signs.values()) else math.prod(d if s == {1} else 1 - d for s in signs.values())
    return both - (d * d * (1 - d)) ** 2


def role_moments(size: dict, role: str, d: float, broker=None) -> tuple[float, float]:
    """Mean and variance of a role's count, over all brokers, or for one broker of a class.

    Sums over the classes of the vertices of two brokered triples that share an arc; all others are independent."""
    fits, classes = _ROLE[role], list(size)

    def ways(of: tuple) -> int:
        """Choices of distinct vertices of these classes; the second is the given broker, if there is one."""
        left, total = dict(size), 1
        if broker is not None:
            left[broker] -= 1
        for at, c in enumerate(of):
            if at != 1 or broker is None:
                total *= max(0, left[c])
                left[c] -= 1
        return total

    mean = var = 0.0
    for of in itertools.product(classes, repeat=3):
        if fits(*of) and (broker is None or of[1] == broker):
            mean += ways(of) * d * d * (1 - d)
    for places in itertools.product(range(5), repeat=3):
        others = [x for x in places if x > 2]
        if len(set(places)) < 3 or others != sorted(set(others)) or others not in ([], [3]) or (broker is not None and places[1] != 1):
            continue
        cov = _together(places, d)
        if abs(cov) < 1e-18:
            continue
        for of in itertools.product(classes, repeat=3 + len(others)):
            if (broker is None or of[1] == broker) and fits(*of[:3]) and fits(*(of[x] for x in places)):
                var += ways(of) * cov
    return mean, max(0.0, var)


def brokerage_moments(g: Graph, classes: DataFrame) -> DataFrame:
    """cl, role, expected, sd: moments of each role for a broker of each class, and (cl null) over all brokers,
    under independent ties at the observed density. Grows with the number of classes, not of vertices."""
    n = g.orders.first()["n"]
    ties = g.known.where("src <> dst and weight <> 0").count()
    d = ties / (n * (n - 1)) if n > 1 else 0.0
    size = {r["cl"]: r["k"] for r in _labelled(g.vertices.select("vid"), classes).groupBy("cl").agg(F.count("*").alias("k")).collect()}
    rows = []
    for cl in [*size, None]:
        for role in BROKER_ROLES:
            mean, var = role_moments(size, role, d, cl)
            rows.append((cl, role, float(mean), math.sqrt(var)))
    return classes.sparkSession.createDataFrame(rows, "cl string, role string, expected double, sd double")


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (vid, ...) with their class as text; none and null are one class."""
    return rows.join(classes.select("vid", F.col("cl").cast("string").alias("cl")), "vid", "left").fillna("", "cl")


def _against_chance(long: DataFrame, g: Graph, classes: DataFrame) -> DataFrame:
    m = brokerage_moments(g, classes).withColumnsRenamed({"cl": "of", "role": "its"})
    j = long.join(F.broadcast(m), F.col("cl").eqNullSafe(F.col("of")) & (F.col("role") == F.col("its")))  # six rows a class
    j = j.withColumn("z", fdiv(F.col("count") - F.col("expected"), F.col("sd")))
    rows = [(*r, normal_two_sided(r["z"]) if math.isfinite(r["z"]) else math.nan) for r in j.select("vid", "role", "count", "expected", "sd", "z").collect()]  # six rows a vertex, a report
    return classes.sparkSession.createDataFrame(rows, "vid long, role string, count long, expected double, sd double, z double, p double")


def _by_role(g: Graph, classes: DataFrame) -> DataFrame:
    from .local import brokerage

    stacked = F.expr(f"stack({len(BROKER_ROLES)}, {', '.join(f'{chr(39)}{r}{chr(39)}, {r}' for r in BROKER_ROLES)}) as (role, count)")
    return _labelled(brokerage(g, classes), classes).select("vid", "cl", stacked)


def summary_brokerage(g: Graph, classes: DataFrame) -> DataFrame:
    """vid, role, count, expected, sd, z, p (normal, two-sided) of each broker."""
    return _against_chance(_by_role(g, classes), g, classes)


def global_brokerage(g: Graph, classes: DataFrame) -> DataFrame:
    """role, count, expected, sd, z, p over all brokers."""
    total = _by_role(g, classes).groupBy("role").agg(F.sum("count").alias("count"))
    return _against_chance(total.withColumns({"vid": F.lit(None).cast("long"), "cl": F.lit(None).cast("string")}), g, classes).drop("vid")


def print_summary_brokerage(g: Graph, classes: DataFrame) -> str:
    return summary_brokerage(g, classes).orderBy("vid", "role").toPandas().to_string(index=False)


def summary_fit(f: Fit) -> dict:
    """Of netlm, netlogit and pstar: coefficients with tail shares, and what the fit has."""
    return {"terms": [dict(zip(("term", "estimate", "statistic", "p_le", "p_ge", "p_two"), x, strict=True)) for x in zip(f.names, f.coefficients, f.statistic, f.p_le, f.p_ge, f.p_two, strict=True)]} | {k: v for k, v in f.extra.items() if isinstance(v, (int, float))}


def print_fit(f: Fit) -> str:
    lines = [f"{'term':<20}{'estimate':>12}{'Pr(<=b)':>10}{'Pr(>=b)':>10}{'Pr(>=|b|)':>11}"]
    lines += [f"{n:<20}{b:>12.6g}{le:>10.4g}{ge:>10.4g}{two:>11.4g}" for n, b, le, ge, two in zip(f.names, f.coefficients, f.p_le, f.p_ge, f.p_two, strict=True)]
    return "\n".join(lines)


def print_summary_fit(f: Fit) -> str:
    extra = dict(summary_fit(f))
    extra.pop("terms")
    out = [print_fit(f), *[f"{k}: {v:.6g}" for k, v in extra.items()]]
    if "f" in extra and extra.get("df", 0) > 0:
        p = len(f.names) - 1
        out.append(f"F-statistic p: {f_upper(extra['f'], max(p, 1), extra['df']):.4g}")
    return "\n".join(out)


def summary_netcancor(f: dict) -> list[dict]:
    return [{"cor": float(c), "p_le": float(a), "p_ge": float(b)} for c, a, b in zip(f["cor"], f["p_le"], f["p_ge"], strict=True)]


def print_netcancor(f: dict) -> str:
    return "\n".join(f"{i + 1}: r = {s['cor']:.6g}, Pr(<=) {s['p_le']:.4g}, Pr(>=) {s['p_ge']:.4g}" for i, s in enumerate(summary_netcancor(f)))


def print_summary_netcancor(f: dict) -> str:
    return print_netcancor(f) + f"\nX coefficients\n{f['xcoef']}\nY coefficients\n{f['ycoef']}"


def summary_lnam(f: Lnam) -> dict:
    z = f.coefficients / f.se[: len(f.coefficients)]
    k = f.df and len(f.residuals) - f.df
    return {"coefficients": f.coefficients, "se": f.se, "z": z, "p": [normal_two_sided(v) for v in z], "sigma": f.sigma, "log_likelihood": f.log_likelihood, "aic": -2 * f.log_likelihood + 2 * k, "bic": -2 * f.log_likelihood + math.log(len(f.residuals)) * k}


def print_lnam(f: Lnam) -> str:
    return f"beta {f.beta}\nrho1 {f.rho1}\nrho2 {f.rho2}\nsigma {f.sigma:.6g}"


def print_summary_lnam(f: Lnam) -> str:
    return "\n".join(f"{k}: {v}" for k, v in summary_lnam(f).items())


def plot_lnam(f: Lnam, y, spark) -> DataFrame:
    """fitted, residual and the quantile of a normal for each case."""
    r = f.residuals
    order = np.argsort(np.argsort(r))
    q = [_normal_quantile((k + 0.5) / len(r)) for k in order]
    return spark.createDataFrame([(i, float(b - a), float(a), float(c)) for i, (a, b, c) in enumerate(zip(r, y, q, strict=True))], "case int, fitted double, residual double, normal double")


def _normal_quantile(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def summary_bn(f: BiasedNet) -> dict:
    return f.coefficients | {"value": f.value, "method": f.method}


def print_bn(f: BiasedNet) -> str:
    return "\n".join(f"{k:<6} {v:.6g}" for k, v in f.coefficients.items())


def print_summary_bn(f: BiasedNet) -> str:
    return f"Biased net ({f.method})\n{print_bn(f)}\nnegative log likelihood {f.value:.6g}"


def plot_bn(f: BiasedNet, census: DataFrame) -> DataFrame:
    """triad, observed, expected counts."""
    from .biased import bn_ptriad
    from .local import DIRECTED_TRIAD_CLASSES

    p = bn_ptriad(f.pi, f.sigma, f.rho, f.d)
    total = census.agg(F.sum("count")).first()[0] or 0
    e = census.sparkSession.createDataFrame([(k, float(x) * total) for k, x in zip(DIRECTED_TRIAD_CLASSES, p, strict=True)], "triad string, expected double")
    return census.select("triad", F.col("count").alias("observed")).join(e, "triad")


def summary_bbnam(d: Draws) -> dict:
    """Mean net, and five numbers and mean of the error rates (of each observer in the actor model)."""
    five = lambda v: {"min": float(v.min()), "q1": quantile(v, 0.25), "median": quantile(v, 0.5), "mean": float(v.mean()), "q3": quantile(v, 0.75), "max": float(v.max())}
    return {"model": d.model, "draws": len(d.net), "net": d.net.mean(0), "em": [five(c) for c in d.em.T], "ep": [five(c) for c in d.ep.T]}


def print_bbnam(d: Draws) -> str:
    s = summary_bbnam(d)
    return f"Bayesian network accuracy, {s['model']} error model, {s['draws']} draws\nmean net\n{np.round(s['net'], 3)}"


def print_summary_bbnam(d: Draws) -> str:
    s = summary_bbnam(d)
    return print_bbnam(d) + "\n" + "\n".join(f"{k}[{i}]: {v}" for k in ("em", "ep") for i, v in enumerate(s[k]))


def plot_bbnam(d: Draws, spark) -> DataFrame:
    """draw, observer, em, ep."""
    return spark.createDataFrame([(t, o, float(d.em[t, o]), float(d.ep[t, o])) for t in range(len(d.em)) for o in range(d.em.shape[1])], "draw int, observer int, em double, ep double")


def summary_bbnam_fixed(posterior: DataFrame) -> DataFrame:
    return quantile_summary(posterior, "posterior")


def print_bbnam_fixed(posterior: DataFrame) -> str:
    return "Bayesian network accuracy, fixed error model\n" + summary_bbnam_fixed(posterior).toPandas().to_string(index=False)


def plot_bbnam_fixed(posterior: DataFrame, bins: int = 20) -> DataFrame:
    """bin, count of the posterior tie probabilities."""
    return posterior.groupBy(F.least(F.floor(F.col("posterior") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("count"))


def summary_bayes_factor(b: dict) -> dict:
    return {"log_marginal": dict(zip(b["models"], b["log_marginal"], strict=True)), "log_bf": b["log_bf"], "best": b["models"][int(np.argmax(b["log_marginal"]))], "reps": b["reps"]}


def print_bayes_factor(b: dict) -> str:
    return "\n".join(" ".join(f"{x:>12.4g}" for x in r) for r in b["log_bf"])


def print_summary_bayes_factor(b: dict) -> str:
    return f"log Bayes factors ({', '.join(b['models'])})\n{print_bayes_factor(b)}\nlog marginal likelihoods {b['log_marginal']}\nreplicates {b['reps']}"
