"""Consensus of informants' reports, and Bayesian network accuracy models. A stack has one graph per observer."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log_mean, rng
from ..graph import Graph


def _stack(g: Graph) -> np.ndarray:
    """observers x n x n reports, NaN where missing or on the unused diagonal."""
    ms = [m.values() for m in g.locals()]
    x = np.stack(ms) if ms else np.empty((0, 0, 0))
    if not g.loops:
        x[:, np.eye(x.shape[1], dtype=bool)] = np.nan
    return x


CONSENSUS = ("central.graph", "single.reweight", "iterative.reweight", "PCA.reweight", "romney.batchelder", "LAS.intersection", "LAS.union", "OR.row", "OR.col")


def consensus(g: Graph, method: str = "central.graph", *, tol: float = 1e-6, maxiter: int = 1000, no_bias: bool = False) -> DataFrame:
    """src, dst, value: nonzero cells of the consensus graph."""
    from .compare import centralgraph

    if method not in CONSENSUS:
        raise ValueError(f"unknown method {method}")
    own = g.edges.where("not missing and weight <> 0")
    if method == "central.graph":
        return centralgraph(g)
    if method in ("OR.row", "OR.col"):  # each observer is the authority on its own row or column
        key = "src" if method == "OR.row" else "dst"
        return own.where(F.col("graph_id") == F.col(key)).select("src", "dst", F.col("weight").alias("value"))
    if method.startswith("LAS"):  # both parties' own slices, or either's
        a = own.where("graph_id = src or graph_id = dst").groupBy("src", "dst").agg(F.countDistinct("graph_id").alias("k"))
        need = F.when(F.col("src") == F.col("dst"), 1).otherwise(2 if method.endswith("intersection") else 1)
        return a.where(F.col("k") >= need).select("src", "dst", F.lit(1.0).alias("value"))
    x = _stack(g)
    k = len(x)
    flat = x.reshape(k, -1)
    if method in ("single.reweight", "PCA.reweight"):
        r = np.eye(k)
        for i in range(k):
            for j in range(i):
                ok = ~np.isnan(flat[i]) & ~np.isnan(flat[j])
                a, b = flat[i][ok], flat[j][ok]
                s = a.std() * b.std() if len(a) else 0
                r[i, j] = r[j, i] = ((a - a.mean()) * (b - b.mean())).mean() / s if s else 0.0
        weight = np.maximum(r.sum(1), 0) if method.startswith("single") else np.abs(np.linalg.eigh(r)[1][:, -1])
        out = np.nansum(flat * weight[:, None], 0) / max(weight.sum(), 1e-300)
    else:
        out = _latent(flat, tol=tol, maxiter=maxiter, bias=method == "romney.batchelder" and not no_bias)
    return _cells(g, out.reshape(x.shape[1:]))


def _latent(flat: np.ndarray, *, tol: float, maxiter: int, bias: bool) -> np.ndarray:
    """Iterate: truth by the weighted vote of competent informants, competency by agreement with it."""
    d = np.where(np.isnan(flat), np.nan, (flat > 0).astype(float))
    ok = ~np.isnan(d)
    truth = np.nan_to_num(np.nanmean(np.where(ok.any(0), d, 0.0), 0)) >= 0.5
    comp, lean = np.full(len(d), 0.75), np.full(len(d), 0.5)
    for _ in range(maxiter):
        was = comp.copy()
        agree = np.array([(d[i][ok[i]] == truth[ok[i]]).mean() if ok[i].any() else 0.5 for i in range(len(d))])
        if bias:
            lean = np.array([np.clip(np.nanmean(d[i]) if ok[i].any() else 0.5, 1e-6, 1 - 1e-6) for i in range(len(d))])
            base = truth.mean() * lean + (1 - truth.mean()) * (1 - lean)
            comp = np.clip((agree - base) / np.maximum(1 - base, 1e-9), 0, 1 - 1e-6)
            hit, false = comp + (1 - comp) * lean, (1 - comp) * lean
        else:
            comp = np.clip(agree, 0.5, 1 - 1e-6)
            hit, false = comp, 1 - comp
        hit, false = np.clip(hit, 1e-9, 1 - 1e-9)[:, None], np.clip(false, 1e-9, 1 - 1e-9)[:, None]
        llr = np.where(ok, np.where(np.nan_to_num(d) > 0, np.log(hit / false), np.log((1 - hit) / (1 - false))), 0).sum(0)
        truth = llr > 0
        if np.abs(comp - was).max() < tol:
            break
    return truth.astype(float)


def _cells(g: Graph, m: np.ndarray) -> DataFrame:
    vid = [r[0] for r in g.vertices.select("vid").distinct().orderBy("vid").collect()]
    i, j = np.nonzero(m)
    rows = [(int(vid[a]), int(vid[b]), float(m[a, b])) for a, b in zip(i, j, strict=True)]
    return g.vertices.sparkSession.createDataFrame(rows, "src long, dst long, value double")


# Bayesian network accuracy ----------------------------------------------------------------


@dataclass
class Draws:
    """net: draws x n x n; em, ep: draws [x observers]; chain: chain of each draw."""

    net: np.ndarray
    em: np.ndarray
    ep: np.ndarray
    chain: np.ndarray
    model: str


def bbnam_fixed(g: Graph, *, nprior: float = 0.5, em: float = 0.25, ep: float = 0.25, outmode: str = "posterior", draws: int = 1500, seed: int = 0) -> DataFrame:
    """src, dst, posterior of every cell in closed form, by sums of logarithms over observers; or draw, src, dst of drawn ties."""
    lr = F.when(F.col("weight") > 0, math.log((1 - em) / ep)).otherwise(math.log(em / (1 - ep)))
    s = g.grid.where("not missing").groupBy("src", "dst").agg(F.sum(lr).alias("llr"))
    p = s.select("src", "dst", (1 / (1 + F.exp(-(F.col("llr") + math.log(nprior / (1 - nprior)))))).alias("posterior"))
    if outmode == "posterior":
        return p
    from .random_graphs import uniform

    d = p.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return d.where(uniform(seed, "draw", "src", "dst") < F.col("posterior")).select("draw", "src", "dst")


def _gibbs(x: np.ndarray, model: str, r: np.random.Generator, *, draws: int, burntime: int, nprior: float, em_prior=(1, 11), ep_prior=(1, 11), directed: bool = True):
    """One chain: error rates given the net are beta, ties given the error rates independent."""
    k, n = len(x), x.shape[1]
    ok, said = ~np.isnan(x), np.nan_to_num(x) > 0
    cell = ~np.eye(n, dtype=bool)
    shape = (k,) if model == "actor" else (1,)
    em, ep = r.beta(*em_prior, shape), r.beta(*ep_prior, shape)
    nets, ems, eps = [], [], []
    axis = (1, 2) if model == "actor" else None
    for t in range(burntime + draws):
        e, f = (np.broadcast_to(np.clip(v, 1e-9, 1 - 1e-9), (k,))[:, None, None] for v in (em, ep))
        llr = np.where(ok, np.where(said, np.log((1 - e) / f), np.log(e / (1 - f))), 0).sum(0) + math.log(nprior / (1 - nprior))
        if not directed:
            llr = np.tril(llr) + np.tril(llr).T
        net = (r.random((n, n)) < 1 / (1 + np.exp(-np.clip(llr, -500, 500)))) & cell
        if not directed:
            net = np.tril(net) | np.tril(net).T
        use = ok & cell
        miss, hit = (use & net & ~said).sum(axis), (use & net & said).sum(axis)
        false, rest = (use & ~net & said).sum(axis), (use & ~net & ~said).sum(axis)
        em = r.beta(em_prior[0] + miss, em_prior[1] + hit, shape)
        ep = r.beta(ep_prior[0] + false, ep_prior[1] + rest, shape)
        if t >= burntime:
            nets.append(net)
            ems.append(em)
            eps.append(ep)
    return np.array(nets), np.array(ems), np.array(eps)


def _sample(g: Graph, model: str, *, reps: int, draws: int, burntime: int, nprior: float, seed: int) -> Draws:
    """Rows are chains; each has its own generator."""
    x, directed, spark = _stack(g), g.directed, g.vertices.sparkSession
    each = -(-draws // reps)

    def run(parts):
        for p in parts:
            for i in p["id"]:
                net, em, ep = _gibbs(x, model, rng(seed, int(i)), draws=each, burntime=burntime, nprior=nprior, directed=directed)
                yield pd.DataFrame({"chain": [int(i)] * each, "draw": range(each), "net": [np.packbits(m).tobytes() for m in net], "em": em.tolist(), "ep": ep.tolist()})

    d = spark.range(0, reps, 1, reps).mapInPandas(run, "chain long, draw int, net binary, em array<double>, ep array<double>").orderBy("chain", "draw").toPandas()
    n = x.shape[1]
    nets = np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=n * n).reshape(n, n) for b in d["net"]])
    return Draws(nets, np.array(d["em"].tolist()), np.array(d["ep"].tolist()), d["chain"].to_numpy(), model)


def bbnam_pooled(g: Graph, *, reps: int = 5, draws: int = 1500, burntime: int = 500, nprior: float = 0.5, seed: int = 0) -> Draws:
    return _sample(g, "pooled", reps=reps, draws=draws, burntime=burntime, nprior=nprior, seed=seed)


def bbnam_actor(g: Graph, *, reps: int = 5, draws: int = 1500, burntime: int = 500, nprior: float = 0.5, seed: int = 0) -> Draws:
    return _sample(g, "actor", reps=reps, draws=draws, burntime=burntime, nprior=nprior, seed=seed)


def bbnam(g: Graph, model: str = "actor", **kw):
    return {"actor": bbnam_actor, "pooled": bbnam_pooled, "fixed": bbnam_fixed}[model](g, **kw)


def bbnam_jntlik_slice(s: int, x: np.ndarray, a: np.ndarray, em, ep, *, log: bool = True) -> float:
    """Likelihood of one observer's report given the net and the error rates."""
    r = x[s]
    ok = ~np.isnan(r)
    e, f = (float(np.broadcast_to(np.asarray(v, float), (len(x),))[s]) for v in (em, ep))
    p = np.where(a > 0, np.where(r > 0, 1 - e, e), np.where(r > 0, f, 1 - f))
    with np.errstate(divide="ignore"):
        total = float(np.log(p[ok]).sum())
    return total if log else math.exp(total)


def bbnam_jntlik(g: Graph | np.ndarray, a, em, ep, *, log: bool = True) -> float:
    """Likelihood of all reports. g: a stack, or the array of its reports where that is at hand."""
    x = g if isinstance(g, np.ndarray) else _stack(g)
    total = sum(bbnam_jntlik_slice(s, x, np.asarray(a), em, ep) for s in range(len(x)))
    return total if log else math.exp(total)


def bbnam_probtie(g: Graph, i: int, j: int, *, prior: float = 0.5, em=0.25, ep=0.25) -> float:
    """Posterior of one tie."""
    x = _stack(g)[:, i, j]
    e, f = (np.broadcast_to(np.asarray(v, float), x.shape) for v in (em, ep))
    ok = ~np.isnan(x)
    l1 = np.prod(np.where(x > 0, 1 - e, e)[ok]) * prior
    l0 = np.prod(np.where(x > 0, f, 1 - f)[ok]) * (1 - prior)
    return float(l1 / (l1 + l0))


def bbnam_bf(g: Graph, *, reps: int = 1000, nprior: float = 0.5, em: float = 0.25, ep: float = 0.25, seed: int = 0) -> dict:
    """Monte Carlo log marginal likelihoods of the fixed, pooled and actor models, and their log Bayes factors."""
    x, spark = _stack(g), g.vertices.sparkSession
    k, n = len(x), x.shape[1]

    def run(parts):
        for p in parts:
            out = []
            for i in p["id"]:
                r = rng(seed, int(i))
                a = (r.random((n, n)) < nprior).astype(float)
                row = [sum(bbnam_jntlik_slice(s, x, a, em, ep) for s in range(k))]
                row.append(sum(bbnam_jntlik_slice(s, x, a, e, f) for e, f in [(r.beta(1, 11), r.beta(1, 11))] for s in range(k)))
                e, f = r.beta(1, 11, k), r.beta(1, 11, k)
                row.append(sum(bbnam_jntlik_slice(s, x, a, e, f) for s in range(k)))
                out.append(row)
            yield pd.DataFrame({"rep": p["id"], "ll": out})

    d = np.array(spark.range(0, reps, 1, max(1, min(reps, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, "rep long, ll array<double>").orderBy("rep").toPandas()["ll"].tolist())
    ml = np.array([log_mean(d[:, i]) for i in range(3)])
    return {"models": ("fixed", "pooled", "actor"), "log_marginal": ml, "log_bf": ml[:, None] - ml[None, :], "sd": d.std(0), "reps": reps}


def npostpred(fit: Draws, fn: Callable[[np.ndarray], float]) -> np.ndarray:
    """A function of each drawn net."""
    return np.array([fn(m) for m in fit.net])


def potscalered_mcmc(chains: DataFrame) -> float:
    """Gelman and Rubin's factor, the square root of R-hat. chains: chain, value."""
    s = chains.groupBy("chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).agg(F.avg("n"), F.var_samp("m"), F.avg("v")).first()
    n, between, within = float(s[0]), float(s[1] or 0.0), float(s[2] or 0.0)
    return math.sqrt(((n - 1) / n * within + between) / within) if within else math.nan
