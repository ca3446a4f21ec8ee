"""Biased nets: parent bias pi, sibling bias sigma, double-role bias rho, base rate d."""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .local import DIRECTED_TRIAD_CLASSES
from .random_graphs import _bias
from .regression import nelder_mead

NAMES = ("pi", "sigma", "rho", "d")


def bn_triad_stats(g: Graph) -> DataFrame:
    """graph_id, i, j, parents (i < j): vertices tied to both; pairs without any are left out."""
    t = g.known.where("weight > 0 and src <> dst").select("graph_id", F.col("src").alias("k"), F.col("dst").alias("v"))
    return t.withColumnRenamed("v", "i").join(t.withColumnRenamed("v", "j"), ["graph_id", "k"]).where("i < j").groupBy("graph_id", "i", "j").agg(F.count("*").alias("parents"))


def bn_dyad_stats(g: Graph) -> DataFrame:
    """graph_id, parents, mutual, asymmetric, null: dyads by state and shared parents."""
    t = g.known.where("weight > 0 and src <> dst")
    d = t.groupBy("graph_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.count("*").alias("k"))
    j = bn_triad_stats(g).join(d, ["graph_id", "i", "j"], "full").select("graph_id", F.coalesce("parents", F.lit(0)).alias("parents"), F.coalesce("k", F.lit(0)).alias("k"))
    s = j.groupBy("graph_id", "parents").agg(F.sum((F.col("k") == 2).cast("long")).alias("mutual"), F.sum((F.col("k") == 1).cast("long")).alias("asymmetric"), F.sum((F.col("k") == 0).cast("long")).alias("null"))
    # Dyads with neither a tie nor a parent: all others.
    seen = j.groupBy("graph_id").agg(F.count("*").alias("seen"))
    rest = g.orders.join(seen, "graph_id", "left").select("graph_id", F.lit(0).cast("long").alias("parents"), F.lit(0).cast("long").alias("mutual"), F.lit(0).cast("long").alias("asymmetric"), ((F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.coalesce("seen", F.lit(0))).alias("null"))
    return s.unionByName(rest).groupBy("graph_id", "parents").agg(*[F.sum(c).alias(c) for c in ("mutual", "asymmetric", "null")]).where("mutual + asymmetric + `null` > 0")


def _log(x: float) -> float:
    return math.log(x) if x > 1e-300 else -690.0


def parameters(raw, fixed: dict | None = None) -> tuple[float, float, float, float]:
    """Free parameters are logits, in the order of NAMES; fixed ones are taken as they are."""
    fixed, it = fixed or {}, iter(raw)
    return tuple(float(fixed[k]) if k in fixed else 1 / (1 + math.exp(-max(-30, min(30, next(it))))) for k in NAMES)


def dyad_probabilities(parents: int, pi: float, sigma: float, rho: float, d: float) -> tuple[float, float, float]:
    """Mutual, asymmetric (either way) and null, given shared parents: a first tie, and its answer."""
    first, answer = _bias(parents, False, pi, sigma, rho, d), _bias(parents, True, pi, sigma, rho, d)
    m, a = first * answer, first * (1 - answer)
    return m, a, max(0.0, 1 - m - 2 * a)


def _rows(stats: DataFrame) -> list[tuple[int, int, int, int]]:
    return [(r["parents"], r["mutual"], r["asymmetric"], r["null"]) for r in stats.collect()]


def bn_nlpl_dyad(raw, rows, fixed: dict | None = None) -> float:
    p = parameters(raw, fixed)
    return -sum(c * _log(x) for k, *counts in rows for c, x in zip(counts, dyad_probabilities(k, *p), strict=True))


def bn_nlpl_edge(raw, rows, fixed: dict | None = None) -> float:
    p = parameters(raw, fixed)
    total = 0.0
    for k, m, a, n in rows:
        back, alone = _bias(k, True, *p), _bias(k, False, *p)
        total += 2 * m * _log(back) + a * (_log(alone) + _log(1 - back)) + 2 * n * _log(1 - alone)
    return -total


#: Dyads of a triple of vertices 0, 1, 2, and the states of one: null, up (first to second), down, mutual.
_DYADS = ((0, 1), (1, 2), (0, 2))
_ARCS = tuple({0: (), 1: (p,), 2: (p[::-1],), 3: (p, p[::-1])} for p in _DYADS)
#: Outcomes of a trial: a null dyad is answered as mutual, one way, or not; a one-way dyad becomes mutual or stays.
_TRIALS = {0: ((3, 0), (1, 1), (2, 1), (0, 2)), 1: ((3, 3), (1, 4)), 2: ((3, 3), (2, 4)), 3: ((3, None),)}


def _has_parent(states: tuple, dyad: int) -> bool:
    """Whether the third vertex sends to both of a dyad's."""
    on = {a for arcs, s in zip(_ARCS, states, strict=True) if s is not None for a in arcs[s]}
    i, j = _DYADS[dyad]
    return (3 - i - j, i) in on and (3 - i - j, j) in on


@functools.cache
def triad_terms(null_trials: bool) -> dict[tuple[int, int, int], list]:
    """How each state of a triple comes about, by the biased net's order-free process.

    The three dyads are drawn in random order, each with one parent more where the third vertex already
    sends to both. A dyad that gets its parent only later has one trial then: a one-way tie may be answered,
    and (with ``null_trials``) a null dyad be tied. What a trial adds may make further parents. For each
    state: (weight, ((drawn state, parents more) of each dyad), how often each outcome of _TRIALS)."""
    terms: dict[tuple, Counter] = {}
    for order in itertools.permutations(range(3)):
        paths = [((None,) * 3, (None,) * 3, frozenset(), (0,) * 5, 1 / 6)]  # states, draws, dyads with a trial, outcomes, weight
        for at in order:
            drawn = []
            for states, draws, tried, outcomes, w in paths:
                more = int(_has_parent(states, at))
                put = lambda t, x, at=at: (*t[:at], x, *t[at + 1 :])
                drawn += [(put(states, x), put(draws, (x, more)), tried | {at} if more else tried, outcomes, w) for x in range(4)]
            paths = []
            while drawn:
                states, draws, tried, outcomes, w = drawn.pop()
                due = [q for q in range(3) if states[q] is not None and q not in tried and _has_parent(states, q)]
                if not due:
                    paths.append((states, draws, tried, outcomes, w))
                    continue
                for results in itertools.product(*[_TRIALS[states[q]] if null_trials or states[q] else ((0, None),) for q in due]):
                    after, counts = list(states), list(outcomes)
                    for q, (x, outcome) in zip(due, results, strict=True):
                        after[q] = x
                        if outcome is not None:
                            counts[outcome] += 1
                    drawn.append((tuple(after), draws, tried | set(due), tuple(counts), w))
        for states, draws, _, outcomes, w in paths:
            terms.setdefault(states, Counter())[draws, outcomes] += w
    return {states: [(w, draws, outcomes) for (draws, outcomes), w in found.items()] for states, found in terms.items()}


def triad_probabilities(states: tuple[int, int, int], parents: np.ndarray, pi: float, sigma: float, rho: float, d: float, *, null_trials: bool) -> np.ndarray:
    """Probability of a triple's state for rows of the three dyads' shared parents."""
    answer = 1 - (1 - sigma) * (1 - rho)
    outcomes = np.array([sigma * answer, sigma * (1 - answer), 1 - sigma * (2 - answer), answer, 1 - answer])
    k = np.asarray(parents, float)
    tables = []
    for more in (0, 1):
        first = 1 - (1 - sigma) ** (k + more) * (1 - d)
        alone = (1 - pi) * ((1 - rho) * (1 - sigma)) ** (k + more) * (1 - d)
        tables.append((1 - first * (1 + alone), first * alone, first * alone, first * (1 - alone)))
    total = np.zeros(len(k))
    for w, draws, counts in triad_terms(null_trials)[states]:
        x = np.full(len(k), w * np.prod(outcomes ** np.array(counts)))
        for dyad, (state, more) in enumerate(draws):
            x = x * tables[more][state][:, dyad]
        total += x
    return np.maximum(total, 0.0)


def bn_triples(g: Graph) -> DataFrame:
    """a, b, c (states of the dyads of i < j < k: ij, jk, ik), p, q, r (their shared parents), count, over all
    triples of one graph. Rows of the plan are first vertices; the order guard holds."""
    m = g.local()
    on = (m.w > 0) & ~m.na & ~np.eye(m.n, dtype=bool)
    state = (on + 2 * on.T).astype(np.int64)
    shared = on.T.astype(np.int64) @ on
    np.fill_diagonal(shared, 0)
    spark, n = g.vertices.sparkSession, m.n

    def run(parts):
        for part in parts:
            for i in part["id"].astype(int):
                j, k = np.triu_indices(n - i - 1, 1)
                j, k = j + i + 1, k + i + 1
                rows = pd.DataFrame({"a": state[i, j], "b": state[j, k], "c": state[i, k], "p": shared[i, j], "q": shared[j, k], "r": shared[i, k]})
                yield rows.groupby(list("abcpqr"), as_index=False).size().rename(columns={"size": "count"})

    tasks = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, n, 1, tasks).mapInPandas(run, "a long, b long, c long, p long, q long, r long, count long").groupBy(*"abcpqr").agg(F.sum("count").alias("count"))


def bn_nlpl_triad(raw, triples: pd.DataFrame, fixed: dict | None = None) -> float:
    """Minus the log pseudo-likelihood of all triples, each given its dyads' shared parents; null dyads have no trial."""
    p, total = parameters(raw, fixed), 0.0
    for states, rows in triples.groupby(["a", "b", "c"]):
        x = triad_probabilities(tuple(int(s) for s in states), rows[["p", "q", "r"]].to_numpy(), *p, null_trials=False)
        total += float((rows["count"].to_numpy() * np.log(np.maximum(x, 1e-300))).sum())
    return -total


def bn_ptriad(pi: float, sigma: float, rho: float, d: float) -> np.ndarray:
    """Masses of the sixteen classes, in the order of DIRECTED_TRIAD_CLASSES, for a triple without other parents."""
    out = dict.fromkeys(DIRECTED_TRIAD_CLASSES, 0.0)
    for states in triad_terms(True):
        on = {a for arcs, s in zip(_ARCS, states, strict=True) for a in arcs[s]}
        out[triad_name(on)] += float(triad_probabilities(states, np.zeros((1, 3)), pi, sigma, rho, d, null_trials=True)[0])
    return np.array(list(out.values()))


def triad_name(on: set[tuple[int, int]]) -> str:
    """Class of a triple of vertices 0, 1, 2 by its arcs."""
    pairs = list(itertools.combinations(range(3), 2))
    m = sum((i, j) in on and (j, i) in on for i, j in pairs)
    n = sum((i, j) not in on and (j, i) not in on for i, j in pairs)
    base = f"{m}{3 - m - n}{n}"
    inn, out = ([sum((a, b)[side] == v for a, b in on) for v in range(3)] for side in (1, 0))
    if base == "021":
        return base + ("D" if 2 in out else "U" if 2 in inn else "C")
    if base == "111":
        return base + ("D" if sorted(inn) == [0, 1, 2] else "U")
    if base == "030":
        return base + ("T" if 2 in inn else "C")
    if base == "120":
        return base + ("D" if 0 in inn else "U" if 0 in out else "C")
    return base


def bn_nltl(raw, census, fixed: dict | None = None) -> float:
    p = bn_ptriad(*parameters(raw, fixed))
    return -sum(c * _log(x) for c, x in zip(census, p, strict=True))


@dataclass
class BiasedNet:
    pi: float
    sigma: float
    rho: float
    d: float
    value: float
    method: str

    @property
    def coefficients(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in NAMES}


def bn(g: Graph, method: str = "mple.triad", *, seed_parameters: dict | None = None, fixed: dict | None = None) -> BiasedNet:
    """Sufficient statistics by Spark once, then a simplex search on logits on the driver."""
    fixed = fixed or {}
    start = {"pi": 0.05, "sigma": 0.05, "rho": 0.05, "d": 0.2} | (seed_parameters or {})
    x0 = np.array([math.log(start[k] / (1 - start[k])) for k in NAMES if k not in fixed])
    if method == "mtle":
        from .local import triad_census

        counts = {r["triad"]: r["count"] for r in triad_census(g).collect()}
        census = [counts[k] for k in DIRECTED_TRIAD_CLASSES]
        loss = lambda x: bn_nltl(x, census, fixed)
    else:
        rows = _rows(bn_dyad_stats(g)) if method != "mple.triad" else bn_triples(g).toPandas()
        loss = {"mple.dyad": lambda x: bn_nlpl_dyad(x, rows, fixed), "mple.edge": lambda x: bn_nlpl_edge(x, rows, fixed), "mple.triad": lambda x: bn_nlpl_triad(x, rows, fixed)}[method]
    x, value = nelder_mead(loss, x0, step=0.2, maxit=1000) if len(x0) else (x0, loss(x0))
    return BiasedNet(*parameters(x, fixed), value, method)


def coef_bn(fit: BiasedNet) -> dict[str, float]:
    return fit.coefficients
