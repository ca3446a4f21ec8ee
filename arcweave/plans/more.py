"""More registered queries: models, tests, random graphs, files, drawing tables and single modes, each with its SQL.

Where an operator draws at random, the query returns what any draw must satisfy; where it solves a system,
what the solution must satisfy (residuals, rounded)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..graph import Graph, nested_matrix, number_matrix, set_max_graph_order
from ..operators import bayes, biased, compare, connectivity, layouts, local, nulls, paths, prep, random_graphs, regression, roles, spectral, summaries
from ..sources import formats
from . import graphs as G
from . import queries as Q
from .registry import TaskClient, execute_task

add, rounded, DROP = Q.add, Q.rounded, Q.DROP
TRADE, TRADE_SQL, FLAT, FLAT_SQL, STACK, STACK_SQL, INFORM, INFORM_SQL, USERS, USERS_SQL = Q.TRADE, Q.TRADE_SQL, Q.FLAT, Q.FLAT_SQL, Q.STACK, Q.STACK_SQL, Q.INFORM, Q.INFORM_SQL, Q.USERS, Q.USERS_SQL
DIST, SIGMA = Q.DIST, Q.SIGMA


def one(spark: SparkSession, **values) -> DataFrame:
    """A row of plain values; numbers are doubles, rounded."""
    kinds = {bool: "boolean", int: "long", str: "string"}
    plain = {k: (v if type(v) in kinds else round(float(v), 6) + 0.0) for k, v in values.items()}
    return spark.createDataFrame([tuple(plain.values())], ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in plain.items()))


def member(g: Graph, i: int) -> Graph:
    """One graph of a stack, as graph 0."""
    own = lambda df: df.where(F.col("graph_id") == i).withColumn("graph_id", F.lit(0).cast("long"))
    return Graph(own(g.vertices), own(g.edges), g.directed, g.loops, g.threshold)


# The graph model ----------------------------------------------------------------------------------

add("has_tie", lambda s, d: one(s, src=0, dst=1, tie=TRADE(s, d).has_tie(0, 1)), f"{TRADE_SQL} SELECT CAST(0 AS BIGINT) AS src, CAST(1 AS BIGINT) AS dst, count(*) > 0 AS tie FROM e WHERE src = 0 AND dst = 1")
add("tie_weight", lambda s, d: one(s, weight=TRADE(s, d).tie_weight(2, 3)), f"{TRADE_SQL} SELECT coalesce(sum(weight), 0) AS weight FROM e WHERE src = 2 AND dst = 3")
add("is_missing_tie", lambda s, d: (lambda g: one(s, low=g.is_missing_tie(3, 1), high=g.is_missing_tie(1, 3)))(prep.lower_tri_remove(TRADE(s, d))), "SELECT TRUE AS low, FALSE AS high")
add("max_graph_order", lambda s, d: (lambda was: one(s, previous=was, again=set_max_graph_order(was)))(set_max_graph_order(100)), "SELECT CAST(5000 AS BIGINT) AS previous, CAST(100 AS BIGINT) AS again")
add("dense_graph", lambda s, d: Graph.from_matrix(s, [[0, 2, None], [float("inf"), 5, 1], [3, 0, 0]]).edges.select("src", "dst", "weight"), "SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), 2), (1, 2, 1), (2, 0, 3)) t(src, dst, weight)")
add("dense_graph_to_matrix", lambda s, d: s.createDataFrame([(i, j, float(x)) for i, r in enumerate(TRADE(s, d).to_matrix(weighted=True)) for j, x in enumerate(r)], "i long, j long, x double"), f"{TRADE_SQL} SELECT a.vid AS i, b.vid AS j, coalesce(weight, 0) AS x FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.vid AND dst = b.vid")
add("number_matrix", lambda s, d: s.createDataFrame([(i, j, float(x)) for i, r in enumerate(number_matrix(2, 3, 7.0)) for j, x in enumerate(r)], "i long, j long, x double"), "SELECT a.i, b.j, CAST(7 AS DOUBLE) AS x FROM (SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(3)) AS j) b")
add("nested_matrix", lambda s, d: s.createDataFrame([(i, j, x) for i, r in enumerate(nested_matrix(range(6), 2, 3)) for j, x in enumerate(r)], "i long, j long, x double"), "SELECT a.i, b.j, CAST(3 * a.i + b.j AS DOUBLE) AS x FROM (SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(3)) AS j) b")
add("is_edgelist_sna", lambda s, d: (lambda g: one(s, fits=prep.is_edgelist_sna(prep.as_edgelist_sna(g), 25), short=prep.is_edgelist_sna(prep.as_edgelist_sna(g), 3)))(TRADE(s, d)), "SELECT TRUE AS fits, FALSE AS short")
_nos = lambda s, d: formats.parse_nos(s, formats.write_nos(STACK(s, d))).edges
add("nos_round_trip", lambda s, d: _nos(s, d).select("graph_id", "src", "dst", "weight"), f"{STACK_SQL} SELECT dense_rank() OVER (ORDER BY graph_id) - 1 AS graph_id, src, dst, weight FROM e")
add("write_dl", lambda s, d: s.createDataFrame([(i, x) for i, x in enumerate(formats.write_dl(TRADE(s, d)).splitlines())], "line long, text string"), f"""{TRADE_SQL}, rows AS (SELECT (src + 1) || ' ' || (dst + 1) || ' ' || CAST(weight AS BIGINT) AS text, row_number() OVER (ORDER BY dst, src) + 2 AS line FROM e)
SELECT line, text FROM rows UNION ALL SELECT 0, 'dl n = ' || (SELECT count(*) FROM v) || ', nm = 1' UNION ALL SELECT 1, 'format = edgelist1' UNION ALL SELECT 2, 'data:'""")


def dot(s: SparkSession, d: str) -> DataFrame:
    """The trade graph written as DOT and read again: tie ends by name."""
    text = TRADE(s, d).edges.groupBy("graph_id").agg(F.concat(F.lit("digraph g {\n"), F.array_join(F.collect_list(F.concat_ws(" -> ", "src", "dst")), ";\n"), F.lit("\n}")).alias("value"))
    g, names = formats.parse_dot(text)
    at = lambda c: names.select(F.col("vid").alias(c), F.col("name").cast("long").alias(f"{c}_name"))
    return g.edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


add("read_dot", dot, f"{TRADE_SQL} SELECT src, dst FROM e")

# Numbers ----------------------------------------------------------------------------------------------

_balance = "SELECT n_nationkey, ln(c_acctbal) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1"


def _logs(s: SparkSession, d: str, fn) -> DataFrame:
    c = G.table(s, d, "customer").where("c_acctbal > 1").groupBy(F.col("c_nationkey").cast("long").alias("n")).agg(F.collect_list(F.log("c_acctbal")).alias("x"))
    return c.groupBy("n").applyInPandas(lambda p: p.assign(value=[fn(x) for x in p["x"]])[["n", "value"]], "n long, value double")


add("log_sum", lambda s, d: rounded(_logs(s, d, stats.log_sum), "value"), f"SELECT CAST(n_nationkey AS BIGINT) AS n, round(ln(sum(exp(x))), 6) AS value FROM ({_balance}) GROUP BY 1")
add("log_mean", lambda s, d: rounded(_logs(s, d, stats.log_mean), "value"), f"SELECT CAST(n_nationkey AS BIGINT) AS n, round(ln(avg(exp(x))), 6) AS value FROM ({_balance}) GROUP BY 1")
add("log_sub", lambda s, d: rounded(_logs(s, d, lambda x: float(stats.log_sub(max(x), min(x) - 1))), "value"), f"SELECT CAST(n_nationkey AS BIGINT) AS n, round(ln(exp(max(x)) - exp(min(x) - 1)), 6) AS value FROM ({_balance}) GROUP BY 1")
add("quantile_summary", lambda s, d: rounded(summaries.quantile_summary(G.table(s, d, "customer"), "c_acctbal"), "min", "q1", "median", "mean", "q3", "max"), "SELECT min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS median, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS max FROM customer")
add("gliop", lambda s, d: one(s, value=prep.gliop(STACK(s, d), lambda g: local.gden(g).first()["density"], "-", 1, 2)), f"{STACK_SQL} SELECT round((SELECT avg(weight) FROM grid WHERE graph_id = 1) - (SELECT avg(weight) FROM grid WHERE graph_id = 2), 6) AS value")
add("numperm", lambda s, d: s.createDataFrame([(k, *compare.numperm(4, k)) for k in range(24)], "k long, a long, b long, c long, e long"), "SELECT row_number() OVER (ORDER BY a, b, c, e) - 1 AS k, a, b, c, e FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT unnest(range(4)) AS c), (SELECT unnest(range(4)) AS e) WHERE a <> b AND a <> c AND a <> e AND b <> c AND b <> e AND c <> e")
add("rperm", lambda s, d: (lambda p: s.createDataFrame([(i, sorted(p[i::5].tolist())) for i in range(5)], "label long, places array<long>"))(prep.rperm([i % 5 for i in range(25)], seed=3)), "SELECT i AS label, [i, i + 5, i + 10, i + 15, i + 20] AS places FROM (SELECT unnest(range(5)) AS i)")
add("rmperm", lambda s, d: prep.rmperm(STACK(s, d), seed=5).edges.groupBy("graph_id").agg(F.count("*").alias("arcs"), F.sum("weight").alias("weight")), f"{STACK_SQL} SELECT graph_id, count(*) AS arcs, sum(weight) AS weight FROM e GROUP BY 1")
add("seeded_rng", lambda s, d: one(s, same=bool((random_graphs.create_seeded_rng(9).random(5) == random_graphs.create_seeded_rng(9).random(5)).all()), other=bool((random_graphs.create_seeded_rng(9).random(5) == random_graphs.create_seeded_rng(8).random(5)).all())), "SELECT TRUE AS same, FALSE AS other")

# Random graphs: what every draw has -----------------------------------------------------------------------

_arcs = lambda g: g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).join(g.edges.groupBy("graph_id").agg(F.count("*").alias("arcs")), "graph_id", "left").fillna(0, ["arcs"])
_each = lambda k: f"(SELECT unnest(range({k})) AS graph_id)"
add("rgraph", lambda s, d: _arcs(random_graphs.rgraph(s, 30, 3, tprob=[0.0, 1.0, 1.0], seed=1)), f"SELECT graph_id, CAST(30 AS BIGINT) AS n, CAST(CASE WHEN graph_id = 0 THEN 0 ELSE 870 END AS BIGINT) AS arcs FROM {_each(3)}")
add("rgraph_binomial", lambda s, d: _arcs(random_graphs.rgraph(s, 200, 2, tprob=0.25, seed=1)).select("graph_id", (F.abs(F.col("arcs") - 9950) < 440).alias("within_five_sd")), f"SELECT graph_id, TRUE AS within_five_sd FROM {_each(2)}")
add("rgnm", lambda s, d: _arcs(random_graphs.rgnm(s, 40, 77, 3, seed=2)), f"SELECT graph_id, CAST(40 AS BIGINT) AS n, CAST(77 AS BIGINT) AS arcs FROM {_each(3)}")
add("rgnm_undirected", lambda s, d: local.nties(random_graphs.rgnm(s, 40, 77, 2, directed=False, seed=2)).join(_arcs(random_graphs.rgnm(s, 40, 77, 2, directed=False, seed=2)), "graph_id").select("graph_id", "nties", "arcs"), f"SELECT graph_id, CAST(780 AS DOUBLE) AS nties, CAST(154 AS BIGINT) AS arcs FROM {_each(2)}")
add("rguman", lambda s, d: local.dyad_census(random_graphs.rguman(s, 20, 30, 60, 100, 2, method="exact", seed=3)), f"SELECT graph_id, CAST(30 AS BIGINT) AS mut, CAST(60 AS BIGINT) AS asym, CAST(100 AS BIGINT) AS \"null\", CAST(0 AS BIGINT) AS missing FROM {_each(2)}")
add("rgnmix", lambda s, d: (lambda g: g.edges.groupBy((F.col("src") % 2).alias("a"), (F.col("dst") % 2).alias("b")).agg(F.count("*").alias("arcs")))(random_graphs.rgnmix(s, [i % 2 for i in range(30)], {(0, 0): 12, (0, 1): 5, (1, 0): 9, (1, 1): 1}, method="exact", seed=4)), "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(12 AS BIGINT)), (0, 1, 5), (1, 0, 9), (1, 1, 1)) t(a, b, arcs)")
add("rgws", lambda s, d: (lambda g: local.degree(g, "outdegree").drop("graph_id"))(random_graphs.rgws(s, 12, 1, 2, 0.0, seed=5)), "SELECT vid, CAST(least(vid, 2) + least(11 - vid, 2) AS DOUBLE) AS degree FROM (SELECT unnest(range(12)) AS vid)")
add("rewire_ud", lambda s, d: DROP(local.dyad_census(random_graphs.rewire_ud(TRADE(s, d), 0.5, seed=6))), f"{TRADE_SQL}, {Q._dyads} SELECT m AS mut, a AS asym, n AS \"null\", CAST(0 AS BIGINT) AS missing FROM c")
add("rewire_ws", lambda s, d: _arcs(random_graphs.rewire_ws(TRADE(s, d), 0.3, seed=7)), f"{TRADE_SQL} SELECT CAST(0 AS BIGINT) AS graph_id, (SELECT count(*) FROM v) AS n, count(*) AS arcs FROM e")
add("rgbn", lambda s, d: _arcs(random_graphs.rgbn(s, 8, 3, d=1.0, burn=2000, seed=8)), f"SELECT graph_id, CAST(8 AS BIGINT) AS n, CAST(56 AS BIGINT) AS arcs FROM {_each(3)}")
add("blockmodel_expand", lambda s, d: roles.blockmodel_expand([[1.0, 0.0], [1.0, 0.0]], [3, 2], s, seed=1).edges.select("src", "dst"), "SELECT a.i AS src, b.i AS dst FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS i) b WHERE a.i <> b.i AND b.i < 3")

# Tests: the observed statistic, and tail shares that add up ------------------------------------------------


def tested(s: SparkSession, t: nulls.NullTest) -> DataFrame:
    ge, le = t.tails()
    return one(s, observed=t.observed, reps=t.reps.count(), shares=bool(0 <= ge <= 1 and 0 <= le <= 1 and ge + le >= 1 - 1e-9))


_cor01 = "SELECT round(corr(a.weight, b.weight), 6) AS observed, CAST(40 AS BIGINT) AS reps, TRUE AS shares FROM grid a JOIN grid b USING (src, dst) WHERE a.graph_id = 0 AND b.graph_id = 1"
add("qaptest", lambda s, d: tested(s, nulls.qaptest(STACK(s, d), "gcor", reps=40, seed=1)), f"{STACK_SQL} {_cor01}")
add("cugtest", lambda s, d: tested(s, nulls.cugtest(STACK(s, d), "gcor", cmode="order", reps=40, seed=1)), f"{STACK_SQL} {_cor01}")
for _mode in ("size", "edges", "dyad.census"):
    add(f"cug_test_{_mode.replace('.', '_')}", lambda s, d, m=_mode: tested(s, nulls.cug_test(TRADE(s, d), "gtrans", cmode=m, reps=40, seed=1)), f"{TRADE_SQL}, {Q._closed} SELECT round(CASE WHEN p = 0 THEN 1 ELSE g / p END, 6) AS observed, CAST(40 AS BIGINT) AS reps, TRUE AS shares FROM ct")

# Regression -------------------------------------------------------------------------------------------------

_yx = "pr AS (SELECT a.weight AS y, b.weight AS x FROM grid a JOIN grid b USING (src, dst) WHERE a.graph_id = 0 AND b.graph_id = 1)"


def fitted(s: SparkSession, fit: regression.Fit, **extra) -> DataFrame:
    return one(s, intercept=fit.coefficients[0], slope=fit.coefficients[1], **extra)


add("netlm", lambda s, d: (lambda f: fitted(s, f, r2=f.extra["r2"], n=int(f.extra["n"]), df=int(f.extra["df"]), sigma=f.extra["sigma"]))(regression.netlm(member(STACK(s, d), 0), member(STACK(s, d), 1), nullhyp="classical", reps=0)), f"{STACK_SQL}, {_yx} SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, count(*) AS n, count(*) - 2 AS df, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 6) AS sigma FROM pr")
add("netlm_statistic", lambda s, d: (lambda f: one(s, se=f.se[1], t=f.statistic[1]))(regression.netlm(member(STACK(s, d), 0), member(STACK(s, d), 1), nullhyp="classical", reps=0)), f"{STACK_SQL}, {_yx}, r AS (SELECT regr_slope(y, x) AS b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM pr) SELECT round(se, 6) AS se, round(b / se, 6) AS t FROM r")
_two = f"{INFORM_SQL}, pr AS (SELECT CAST(a.src IS NOT NULL AS INT) AS y, CAST(b.src IS NOT NULL AS INT) AS x FROM pairs p LEFT JOIN (SELECT * FROM e WHERE graph_id = 0) a ON a.src = p.src AND a.dst = p.dst LEFT JOIN (SELECT * FROM e WHERE graph_id = 1) b ON b.src = p.src AND b.dst = p.dst), k AS (SELECT CAST(count(*) FILTER (y = 1 AND x = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0 AND x = 1) AS DOUBLE) AS b, CAST(count(*) FILTER (y = 1 AND x = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (y = 0 AND x = 0) AS DOUBLE) AS e FROM pr)"
add("netlogit", lambda s, d: (lambda f: fitted(s, f, null_deviance=f.extra["null_deviance"]))(regression.netlogit(member(INFORM(s, d), 0), member(INFORM(s, d), 1), nullhyp="classical", reps=0)), f"{_two} SELECT round(ln(c / e), 6) AS intercept, round(ln(a / b) - ln(c / e), 6) AS slope, round(2 * (a + b + c + e) * ln(2), 6) AS null_deviance FROM k")
add("netcancor", lambda s, d: one(s, cor=regression.netcancor(member(STACK(s, d), 0), member(STACK(s, d), 1), reps=0)["cor"][0]), f"{STACK_SQL}, {_yx} SELECT round(abs(corr(y, x)), 6) AS cor FROM pr")
add("pstar", lambda s, d: (lambda f: one(s, choice=f.coefficients[0], n=int(f.extra["n"])))(regression.pstar(TRADE(s, d), ["choice"])), f"{TRADE_SQL} SELECT round(ln(m / (n * (n - 1) - m)), 6) AS choice, n * (n - 1) AS n FROM (SELECT CAST((SELECT count(*) FROM e) AS DOUBLE) AS m, count(*) AS n FROM v)")
add("pstar_mutuality", lambda s, d: (lambda f: one(s, choice=f.coefficients[0], mutuality=f.coefficients[1]))(regression.pstar(TRADE(s, d), ["choice", "mutuality"])), f"{TRADE_SQL}, {Q._adj}, k AS (SELECT CAST(count(*) FILTER (x.t AND y.t) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT x.t AND y.t) AS DOUBLE) AS b, CAST(count(*) FILTER (x.t AND NOT y.t) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT x.t AND NOT y.t) AS DOUBLE) AS f FROM adj x JOIN adj y ON y.i = x.j AND y.j = x.i) SELECT round(ln(c / f), 6) AS choice, round(ln(a / b) - ln(c / f), 6) AS mutuality FROM k")
add("eval_edgeperturbation", lambda s, d: one(s, change=regression.eval_edgeperturbation(TRADE(s, d), 1, 2, lambda m: float(m.a.sum()))), "SELECT CAST(1 AS DOUBLE) AS change")
_land = "SELECT CAST(n_nationkey AS BIGINT) AS vid, avg(c_acctbal) AS y, CAST(n_regionkey AS DOUBLE) AS x FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"


def covariates(s: SparkSession, d: str) -> DataFrame:
    """vid, y (mean balance of a nation's customers), x (its region)."""
    mean = G.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("y"))
    return G.table(s, d, "nation").join(mean, F.col("n_nationkey") == F.col("k")).select(F.col("n_nationkey").cast("long").alias("vid"), "y", F.col("n_regionkey").cast("double").alias("x"))


def _lnam(s: SparkSession, d: str) -> regression.Lnam:
    p = covariates(s, d).orderBy("vid").toPandas()
    return regression.lnam(p["y"], np.stack([np.ones(len(p)), p["x"]], 1))


add("lnam", lambda s, d: (lambda f: one(s, intercept=regression.coef_lnam(f)[0], slope=regression.coef_lnam(f)[1], sigma=f.sigma))(_lnam(s, d)), f"SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)), 6) AS sigma FROM ({_land})")
add("lnam_se", lambda s, d: (lambda f: one(s, close=bool(abs(regression.se_lnam(f)[1] / (f.sigma / math.sqrt(float(((x := covariates(s, d).orderBy("vid").toPandas()["x"]) - x.mean()).pow(2).sum()))) - 1) < 0.01)))(_lnam(s, d)), "SELECT TRUE AS close")
_lags = f"{DIST}, la AS ({_land}), z AS (SELECT vid, y - (SELECT avg(y) FROM la) AS z FROM la), q AS (SELECT sum(z * z) AS ss, count(*) AS n FROM z), st AS (SELECT ds.d AS lag, sum(a.z * b.z) AS ab, sum((a.z - b.z) * (a.z - b.z)) AS dd, count(*) AS k FROM ds JOIN z a ON a.vid = ds.v JOIN z b ON b.vid = ds.s WHERE ds.d > 0 GROUP BY 1), l AS (SELECT CAST(unnest(range(4)) AS INT) AS lag)"
for _kind, _zero, _sql in (("covariance", "ss / n", "ab / k"), ("correlation", "(n - 1.0) / n", "ab / k / (ss / (n - 1))"), ("moran", "1", "n * ab / (k * ss)"), ("geary", "0", "(n - 1) * dd / (2 * k * ss)")):
    add(f"nacf_{_kind}", lambda s, d, k=_kind: rounded(regression.nacf(TRADE(s, d), covariates(s, d).select("vid", "y"), lag_max=3, kind=k), "nacf"), f"{_lags} SELECT l.lag, round(CAST(CASE WHEN l.lag = 0 THEN {_zero} WHEN k IS NULL THEN 0 ELSE {_sql} END AS DOUBLE), 6) AS nacf FROM l CROSS JOIN q LEFT JOIN st USING (lag)")

# Informants and biased nets -----------------------------------------------------------------------------------

_votes = f"{INFORM_SQL}, ob AS (SELECT graph_id FROM seg), rp AS (SELECT ob.graph_id, p.src, p.dst, CAST(e.src IS NOT NULL AS DOUBLE) AS x FROM ob CROSS JOIN pairs p LEFT JOIN e ON e.graph_id = ob.graph_id AND e.src = p.src AND e.dst = p.dst)"
add("consensus_single_reweight", lambda s, d: rounded(bayes.consensus(INFORM(s, d), "single.reweight"), "value"), f"{_votes}, r AS (SELECT a.graph_id AS i, b.graph_id AS j, coalesce(corr(a.x, b.x), 0) AS c FROM rp a JOIN rp b USING (src, dst) GROUP BY 1, 2), w AS (SELECT i, greatest(sum(c), 0) AS w FROM r GROUP BY 1) SELECT src, dst, round(sum(x * w) / (SELECT sum(w) FROM w), 6) AS value FROM rp JOIN w ON w.i = rp.graph_id GROUP BY 1, 2 HAVING sum(x * w) <> 0")
add("bbnam_jntlik", lambda s, d: (lambda x: one(s, log_likelihood=bayes.bbnam_jntlik(x, x[0] > 0, 0.2, 0.1)))(bayes._stack(INFORM(s, d))), f"{_votes}, t AS (SELECT src, dst, x AS a FROM rp WHERE graph_id = 0) SELECT round(sum(CASE WHEN a > 0 AND x > 0 THEN ln(0.8) WHEN a > 0 THEN ln(0.2) WHEN x > 0 THEN ln(0.1) ELSE ln(0.9) END), 6) AS log_likelihood FROM rp JOIN t USING (src, dst)")
add("bbnam_jntlik_slice", lambda s, d: (lambda x: s.createDataFrame([(i, round(bayes.bbnam_jntlik_slice(i, x, x[0] > 0, 0.2, 0.1), 6)) for i in range(len(x))], "slice long, log_likelihood double"))(bayes._stack(INFORM(s, d))), f"{_votes}, t AS (SELECT src, dst, x AS a FROM rp WHERE graph_id = 0) SELECT graph_id AS slice, round(sum(CASE WHEN a > 0 AND x > 0 THEN ln(0.8) WHEN a > 0 THEN ln(0.2) WHEN x > 0 THEN ln(0.1) ELSE ln(0.9) END), 6) AS log_likelihood FROM rp JOIN t USING (src, dst) GROUP BY 1")
add("bbnam_probtie", lambda s, d: one(s, p=bayes.bbnam_probtie(INFORM(s, d), 0, 1, prior=0.4, em=0.2, ep=0.1)), f"{_votes}, l AS (SELECT exp(sum(ln(CASE WHEN x > 0 THEN 0.8 ELSE 0.2 END))) * 0.4 AS a, exp(sum(ln(CASE WHEN x > 0 THEN 0.1 ELSE 0.9 END))) * 0.6 AS b FROM rp WHERE src = 0 AND dst = 1) SELECT round(a / (a + b), 6) AS p FROM l")
for _model, _width in (("pooled", 1), ("actor", 5)):
    add(f"bbnam_{_model}", lambda s, d, m=_model: (lambda f: one(s, draws=len(f.net), rates=int(f.em.shape[1]), order=int(f.net.shape[1]), sound=bool(((f.em > 0) & (f.em < 1) & (f.ep > 0) & (f.ep < 1)).all()), loops=int(f.net[:, range(25), range(25)].sum())))(bayes.bbnam(INFORM(s, d), m, reps=2, draws=20, burntime=10, seed=1)), f"SELECT CAST(20 AS BIGINT) AS draws, CAST({_width} AS BIGINT) AS rates, CAST(25 AS BIGINT) AS \"order\", TRUE AS sound, CAST(0 AS BIGINT) AS loops")
add("bbnam_bf", lambda s, d: (lambda b: one(s, models=",".join(b["models"]), reps=int(b["reps"]), antisymmetric=bool(np.allclose(b["log_bf"], -b["log_bf"].T))))(bayes.bbnam_bf(INFORM(s, d), reps=20, seed=1)), "SELECT 'fixed,pooled,actor' AS models, CAST(20 AS BIGINT) AS reps, TRUE AS antisymmetric")
add("npostpred", lambda s, d: (lambda f: one(s, same=bool((bayes.npostpred(f, lambda m: float(m.sum())) == f.net.sum((1, 2))).all())))(bayes.bbnam_pooled(INFORM(s, d), reps=2, draws=10, burntime=5, seed=1)), "SELECT TRUE AS same")
add("potscalered_mcmc", lambda s, d: one(s, factor=bayes.potscalered_mcmc(G.table(s, d, "events").select(F.col("event_type").alias("chain"), "value").where("value is not null"))), "SELECT round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS factor FROM (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)")
_raw, _p = [0.1, -0.4, -1.0, 0.2], biased.parameters([0.1, -0.4, -1.0, 0.2])
_stat = f"{TRADE_SQL}, {Q._par}, dd AS (SELECT coalesce(parents, 0) AS k, coalesce(c, 0) AS c FROM v a JOIN v b ON a.vid < b.vid LEFT JOIN pc ON i = a.vid AND j = b.vid LEFT JOIN (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*) AS c FROM e GROUP BY 1, 2) ON x = a.vid AND y = b.vid), pb AS (SELECT k, c, 1 - power({1 - _p[1]!r}, k) * {1 - _p[3]!r} AS f, 1 - {1 - _p[0]!r} * power({(1 - _p[2]) * (1 - _p[1])!r}, k) * {1 - _p[3]!r} AS b FROM dd)"
add("bn_nlpl_dyad", lambda s, d: one(s, value=biased.bn_nlpl_dyad(_raw, biased._rows(biased.bn_dyad_stats(TRADE(s, d))))), f"{_stat} SELECT round(-sum(ln(CASE c WHEN 2 THEN f * b WHEN 1 THEN f * (1 - b) ELSE 1 - f * b - 2 * f * (1 - b) END)), 6) AS value FROM pb")
add("bn_nlpl_edge", lambda s, d: one(s, value=biased.bn_nlpl_edge(_raw, biased._rows(biased.bn_dyad_stats(TRADE(s, d))))), f"{_stat} SELECT round(-sum(CASE c WHEN 2 THEN 2 * ln(b) WHEN 1 THEN ln(f) + ln(1 - b) ELSE 2 * ln(1 - f) END), 6) AS value FROM pb")
add("bn_triples", lambda s, d: biased.bn_triples(TRADE(s, d)).groupBy("a", "b", "c").agg(F.sum("count").alias("count")), f"{TRADE_SQL}, {Q._triples} SELECT CAST(ij + 2 * ji AS BIGINT) AS a, CAST(jk + 2 * kj AS BIGINT) AS b, CAST(ik + 2 * ki AS BIGINT) AS c, count(*) AS count FROM tr GROUP BY 1, 2, 3")
_m0, _a0, _n0 = 0.25 * (0.2 + 0.8 * 0.25), 0.25 * 0.75 * 0.8, 0.75 * (1 - 0.25 * 0.8)
add("bn_ptriad", lambda s, d: s.createDataFrame([(k, round(float(x), 6)) for k, x in zip(local.DIRECTED_TRIAD_CLASSES, biased.bn_ptriad(0.2, 0.3, 0.1, 0.25), strict=True) if k in ("003", "012", "102", "021U", "021C", "111D", "030C")], "triad string, mass double"), f"SELECT triad, CAST(mass AS DOUBLE) AS mass FROM (VALUES ('003', round({_n0**3!r}, 6)), ('012', round({6 * _a0 * _n0**2!r}, 6)), ('102', round({3 * _m0 * _n0**2!r}, 6)), ('021U', round({3 * _a0**2 * _n0!r}, 6)), ('021C', round({6 * _a0**2 * _n0!r}, 6)), ('111D', round({6 * _m0 * _a0 * _n0!r}, 6)), ('030C', round({2 * _a0**3!r}, 6))) t(triad, mass)")


def _better(s: SparkSession, d: str, method: str) -> DataFrame:
    """Whether the fit beats its start, and its coefficients are probabilities."""
    g = TRADE(s, d)
    fit = biased.bn(g, method)
    start = [math.log(x / (1 - x)) for x in (0.05, 0.05, 0.05, 0.2)]
    if method == "mple.triad":
        was = biased.bn_nlpl_triad(start, biased.bn_triples(g).toPandas())
    else:
        was = {"mple.dyad": biased.bn_nlpl_dyad, "mple.edge": biased.bn_nlpl_edge}[method](start, biased._rows(biased.bn_dyad_stats(g)))
    return one(s, method=fit.method, better=bool(fit.value <= was), sound=all(0 <= x <= 1 for x in biased.coef_bn(fit).values()))


for _method in ("mple.dyad", "mple.edge", "mple.triad"):
    add(f"bn_{_method.replace('.', '_')}", lambda s, d, m=_method: _better(s, d, m), f"SELECT '{_method}' AS method, TRUE AS better, TRUE AS sound")
_size = "cs AS (SELECT cl, count(*) AS k FROM v GROUP BY 1), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), de AS (SELECT (SELECT count(*) FROM e) / (n * (n - 1)) AS d FROM nn), a AS (SELECT cl, k, n, d * d * (1 - d) AS q, pow(d, 3) * pow(1 - d, 3) AS c FROM cs, nn, de)"
_moments = f"{_size}, m AS (SELECT cl, 'w_i' AS role, (k - 1) * (k - 2) AS p, 2 * (k - 1) * (k - 2) * (k - 3) AS x, q, c FROM a UNION ALL SELECT cl, 't', (n - 1) * (n - 2), 2 * (n - 1) * (n - 2) * (n - 3), q, c FROM a UNION ALL SELECT cl, r, (k - 1) * (n - k), (k - 1) * (n - k) * (n - k - 1) + (n - k) * (k - 1) * (k - 2), q, c FROM a, (VALUES ('b_io'), ('b_oi')) t(r) UNION ALL SELECT a.cl, 'w_o', sum(b.k * (b.k - 1)), sum(2 * b.k * (b.k - 1) * (b.k - 2)), any_value(a.q), any_value(a.c) FROM a JOIN cs b ON a.cl <> b.cl GROUP BY 1 UNION ALL SELECT a.cl, 'b_o', sum(b.k * (a.n - a.k - b.k)), sum(2 * b.k * (a.n - a.k - b.k) * (a.n - a.k - b.k - 1)), any_value(a.q), any_value(a.c) FROM a JOIN cs b ON a.cl <> b.cl GROUP BY 1)"
add("brokerage_moments", lambda s, d: rounded(summaries.brokerage_moments(TRADE(s, d), G.trade(s, d)[0]).where("cl is not null"), "expected", "sd"), f"{TRADE_SQL}, {_moments} SELECT CAST(cl AS VARCHAR) AS cl, role, round(p * q, 6) AS expected, round(sqrt(p * q * (1 - q) + x * c), 6) AS sd FROM m")
add("brokerage_summary", lambda s, d: rounded(summaries.summary_brokerage(TRADE(s, d), G.trade(s, d)[0]).select("vid", "role", "count", "z"), "z"), f"{TRADE_SQL}, {_moments}, {Q._roles}, ct AS (SELECT vid, v.cl, unnest(['w_i', 'w_o', 'b_io', 'b_oi', 'b_o', 't']) AS role, unnest([{Q._count('a = b AND b = c')}, {Q._count('a = c AND a <> b')}, {Q._count('a = b AND b <> c')}, {Q._count('b = c AND a <> b')}, {Q._count('a <> b AND b <> c AND a <> c')}, count(j)]) AS count FROM v LEFT JOIN br ON j = vid GROUP BY 1, 2)".replace("{_roles}", "") + " SELECT vid, ct.role, count, round((count - p * q) / sqrt(p * q * (1 - q) + x * m.c), 6) AS z FROM ct JOIN m ON m.cl = ct.cl AND m.role = ct.role")
add("brokerage_global", lambda s, d: summaries.global_brokerage(TRADE(s, d), G.trade(s, d)[0]).select("role", "count").where("role = 't'"), f"{TRADE_SQL}, {Q._roles} SELECT 't' AS role, count(*) AS count FROM br")

# Comparison by relabelling (orders of five: all 120 are tried) ---------------------------------------------------

_perms = f"{STACK_SQL}, pm AS (SELECT a, b, c, d, f FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b), (SELECT unnest(range(5)) AS c), (SELECT unnest(range(5)) AS d), (SELECT unnest(range(5)) AS f) WHERE len(list_distinct([a, b, c, d, f])) = 5), mp AS (SELECT row_number() OVER () AS k, unnest(range(5)) AS old, unnest([a, b, c, d, f]) AS new FROM pm), g1 AS (SELECT * FROM grid WHERE graph_id IN (0, 1)), pr AS (SELECT x.graph_id AS g1, y.graph_id AS g2, s.k, x.weight AS x, y.weight AS y FROM g1 x JOIN mp s ON s.old = x.src JOIN mp t ON t.k = s.k AND t.old = x.dst JOIN g1 y ON y.src = s.new AND y.dst = t.new)"
_few = lambda s, d: (lambda g: Graph(g.vertices.where("graph_id < 2"), g.edges.where("graph_id < 2"), g.directed, g.loops, g.threshold))(STACK(s, d))
for _name, _fn, _score, _best in (("gscov", compare.gscov, "covar_samp(x, y)", "max"), ("gscor", compare.gscor, "corr(x, y)", "max"), ("structdist", compare.structdist, "CAST(sum(abs(x - y)) AS DOUBLE)", "min")):
    add(_name, lambda s, d, f=_fn, n=_name: rounded(f(_few(s, d), method="exhaustive", reps=1), n), f"{_perms}, sc AS (SELECT g1, g2, k, {_score} AS x FROM pr GROUP BY 1, 2, 3) SELECT g1, g2, round({_best}(x), 6) AS {_name} FROM sc GROUP BY 1, 2")
add("sdmat", lambda s, d: rounded(compare.sdmat(_few(s, d), output="condensed", method="exhaustive", reps=1), "structdist"), f"{_perms}, sc AS (SELECT g1, g2, k, CAST(sum(abs(x - y)) AS DOUBLE) AS x FROM pr WHERE g1 < g2 GROUP BY 1, 2, 3) SELECT g1, g2, round(min(x), 6) AS structdist FROM sc GROUP BY 1, 2")


def _optimized(s: SparkSession, d: str, fn, **kw) -> DataFrame:
    """Whether a search's value is a correlation, no less than chance finds and no more than the best of all relabellings."""
    a, b = (m.values() for m in _few(s, d).locals())
    stat = compare._statistic("cor", True, False)
    found, best = fn(a, b, stat, seed=1, **kw), compare.lab_optimize_exhaustive(a, b, stat)
    return one(s, bounded=bool(-1 - 1e-9 <= found <= best + 1e-9))


for _name, _fn in (("lab_optimize", compare.lab_optimize), ("lab_optimize_hillclimb", compare.lab_optimize_hillclimb), ("lab_optimize_anneal", compare.lab_optimize_anneal), ("lab_optimize_mc", compare.lab_optimize_mc)):
    add(_name, lambda s, d, f=_fn: _optimized(s, d, f), "SELECT TRUE AS bounded")
add("lab_optimize_exhaustive", lambda s, d: (lambda ms: one(s, value=compare.lab_optimize_exhaustive(ms[0].values(), ms[1].values(), compare._statistic("cor", True, False))))(_few(s, d).locals()), f"{_perms}, sc AS (SELECT k, corr(x, y) AS x FROM pr WHERE g1 = 0 AND g2 = 1 GROUP BY 1) SELECT round(max(x), 6) AS value FROM sc")
add("lab_optimize_gumbel", lambda s, d: (lambda ms: one(s, finite=bool(math.isfinite(compare.lab_optimize_gumbel(ms[0].values(), ms[1].values(), compare._statistic("cor", True, False), seed=1, draws=100)))))(_few(s, d).locals()), "SELECT TRUE AS finite")
_half = lambda g: g.vertices.select("graph_id", (F.col("graph_id") % 2).alias("cluster")).distinct()
add("gclust_centralgraph", lambda s, d: (lambda g: rounded(compare.gclust_centralgraph(_half(g), g, normalize=True).edges.select("graph_id", "src", "dst", "weight"), "weight"))(STACK(s, d)), f"{STACK_SQL} SELECT graph_id % 2 AS graph_id, src, dst, round(avg(weight), 6) AS weight FROM grid GROUP BY 1, 2, 3 HAVING avg(weight) <> 0")
add("gclust_boxstats", lambda s, d: (lambda g: rounded(compare.gclust_boxstats(_half(g), local.gden(g).withColumnRenamed("density", "value")), "min", "q1", "median", "q3", "max"))(STACK(s, d)), f"{STACK_SQL}, ds AS (SELECT graph_id, avg(weight) AS x FROM grid GROUP BY 1) SELECT graph_id % 2 AS cluster, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max FROM ds GROUP BY 1")
add("equiv_clust", lambda s, d: (lambda t: one(s, actors=len(t.order), merges=len(t.merge), rising=bool(all(x <= y + 1e-9 for x, y in zip(t.height, t.height[1:], strict=False)))))(roles.equiv_clust(TRADE(s, d))[0]), f"{TRADE_SQL} SELECT count(*) AS actors, count(*) - 1 AS merges, TRUE AS rising FROM v")

# Single modes -----------------------------------------------------------------------------------------------------

add("transitivity_correlation", lambda s, d: rounded(DROP(local.gtrans(TRADE(s, d), "correlation")), "transitivity"), f"{TRADE_SQL}, sq AS (SELECT a.src, b.dst, sum(a.weight * b.weight) AS w FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2) SELECT round(corr(coalesce(e.weight, 0), coalesce(sq.w, 0)), 6) AS transitivity FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN e ON e.src = a.vid AND e.dst = b.vid LEFT JOIN sq ON sq.src = a.vid AND sq.dst = b.vid")
add("triad_classify", lambda s, d: one(s, triad=local.triad_classify(TRADE(s, d), (0, 1, 2))), f"{TRADE_SQL}, {Q._triples.replace('x.i < x.j)', 'x.i = 0 AND x.j = 1 AND z.j = 2)')}, {Q._classes} SELECT triad FROM nm")
add("betweenness_proximalsum", lambda s, d: rounded(DROP(paths.betweenness(TRADE(s, d), "proximalsum")), "betweenness"), f"{SIGMA}, bt AS (SELECT a.v AS vid, sum(a.n * b.n / st.n * (CAST(a.d = 1 AS INT) + CAST(b.d = 1 AS INT))) AS x {Q._on_path} GROUP BY 1) SELECT v.vid, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN bt USING (vid)")
add("geodist_weighted", lambda s, d: rounded(paths.geodist(STACK(s, d), ignore_eval=False).select("graph_id", "src", "dst", "dist"), "dist"), f"WITH RECURSIVE {G.transitions_sql()}, r(g, s, v, d, k) AS (SELECT graph_id, vid, vid, CAST(0 AS DOUBLE), 0 FROM v UNION ALL SELECT r.g, r.s, e.dst, r.d + e.weight, k + 1 FROM r JOIN e ON e.graph_id = r.g AND e.src = r.v WHERE k < 4) SELECT g AS graph_id, s AS src, v AS dst, min(d) AS dist FROM r GROUP BY 1, 2, 3")
add("geodist_predecessors", lambda s, d: paths.geodist(TRADE(s, d), predecessors=True).select("src", "dst", F.explode("preds").alias("pred")), f"{DIST} SELECT a.s AS src, b.v AS dst, a.v AS pred FROM ds a JOIN e ON e.src = a.v JOIN ds b ON b.s = a.s AND b.v = e.dst AND b.d = a.d + 1")
add("neighborhood_exact", lambda s, d: DROP(paths.neighborhood(TRADE(s, d), 2, kind="out", partial=False)), f"{DIST} SELECT s AS vid, v AS neighbor FROM ds WHERE d = 2")
add("neighborhood_orders", lambda s, d: DROP(paths.neighborhood(TRADE(s, d), 3, kind="in", return_all=True)), f"{DIST} SELECT v AS vid, s AS neighbor, CAST(k AS INT) AS \"order\" FROM ds, (VALUES (1), (2), (3)) t(k) WHERE d BETWEEN 1 AND k")
add("neighborhood_total", lambda s, d: DROP(paths.neighborhood(TRADE(s, d), 1, kind="total")), f"{TRADE_SQL} SELECT src AS vid, dst AS neighbor FROM e UNION SELECT dst, src FROM e")
add("geodist_all_pairs", lambda s, d: DROP(paths.geodist(Q._sparse(s, d), inf_replace=99.0)).select("src", "dst", "dist"), f"WITH RECURSIVE {G.nations_sql(1.5)}, r(s, v, d) AS (SELECT vid, vid, 0 FROM v UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON r.v = e.src WHERE r.d < 24) SELECT a.vid AS src, b.vid AS dst, CAST(coalesce(min(d), 99) AS DOUBLE) AS dist FROM v a CROSS JOIN v b LEFT JOIN r ON r.s = a.vid AND r.v = b.vid GROUP BY 1, 2")
add("single_source", lambda s, d: paths.single_source(USERS(s, d), 1), f"WITH RECURSIVE {G.handoffs_sql()}, r(v, d) AS (SELECT CAST(1 AS BIGINT), 0 FROM v WHERE vid = 1 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON r.v = e.src WHERE r.d < 6), ds AS (SELECT v, min(d) AS d FROM r GROUP BY 1), g(v, d, n) AS (SELECT CAST(1 AS BIGINT), 0, CAST(1 AS DOUBLE) FROM v WHERE vid = 1 UNION ALL SELECT v, d + 1, n FROM (SELECT e.dst AS v, g.d, sum(g.n) AS n FROM g JOIN e ON e.src = g.v JOIN ds ON ds.v = e.dst AND ds.d = g.d + 1 GROUP BY 1, 2)) SELECT v AS vid, CAST(d AS DOUBLE) AS dist, n AS sigma FROM g")
add("components_weak_users", lambda s, d: DROP(connectivity.component_dist(USERS(s, d), "weak")).groupBy("label").agg(F.count("*").alias("size")), f"WITH RECURSIVE {G.handoffs_sql()}, r(v) AS (SELECT min(vid) FROM v UNION SELECT x.dst FROM r JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) x ON x.src = r.v) SELECT CAST(0 AS BIGINT) AS label, count(*) AS size FROM r")
add("prestige_indegree_rownorm", lambda s, d: rounded(DROP(spectral.prestige(TRADE(s, d), "indegree.rownorm")), "prestige"), f"{TRADE_SQL}, w AS (SELECT dst, weight / sum(weight) OVER (PARTITION BY src) AS x FROM e) SELECT vid, round(coalesce(sum(x), 0), 6) AS prestige FROM v LEFT JOIN w ON dst = vid GROUP BY 1")
add("gapply_distance", lambda s, d: rounded((lambda g: prep.gapply(g, "row", local.degree(g).withColumnRenamed("degree", "value"), "sum", distance=2))(TRADE(s, d)), "value"), f"{DIST}, st AS ({Q._deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='weight').replace('AS degree', 'AS value')}) SELECT v.vid, round(coalesce(sum(value), 0), 6) AS value FROM v LEFT JOIN ds ON ds.s = v.vid AND ds.d BETWEEN 1 AND 2 LEFT JOIN st ON st.vid = ds.v GROUP BY 1")
add("gapply_function", lambda s, d: rounded((lambda g: prep.gapply(g, "col", local.degree(g).withColumnRenamed("degree", "value"), lambda x: float(x.max() - x.min())))(TRADE(s, d)), "value"), f"{TRADE_SQL}, st AS ({Q._deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='weight').replace('AS degree', 'AS value')}) SELECT v.vid, round(max(value) - min(value), 6) AS value FROM v LEFT JOIN e ON e.dst = v.vid LEFT JOIN st ON st.vid = e.src GROUP BY 1")
add("stochastic_rowcol", lambda s, d: (lambda e: e.groupBy("src").agg(F.sum("weight").alias("x")).select(F.col("src").alias("vid"), (F.abs(F.col("x") - 1) < 0.01).alias("near_one")))(prep.make_stochastic(G_FULL(s, d), "rowcol").edges), f"{TRADE_SQL} SELECT vid, TRUE AS near_one FROM v")
add("event2dichot_rank", lambda s, d: prep.event2dichot(STACK(s, d), "rrank", thresh=2).edges.select("graph_id", "src", "dst", "weight"), f"{STACK_SQL}, cell AS (SELECT a.graph_id, a.vid AS src, b.vid AS dst, coalesce(e.weight, 0) AS w FROM v a JOIN v b ON a.graph_id = b.graph_id LEFT JOIN e ON e.graph_id = a.graph_id AND e.src = a.vid AND e.dst = b.vid), rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY w DESC, dst) AS r FROM cell) SELECT graph_id, src, dst, CAST(1 AS DOUBLE) AS weight FROM rk WHERE r <= 2 AND src <> dst")
add("event2dichot_rank_order", lambda s, d: prep.event2dichot(STACK(s, d), "rrank", thresh=3, rank_semantics="order").edges.select("graph_id", "src", "dst", "weight"), f"{STACK_SQL}, cell AS (SELECT a.graph_id, a.vid AS src, b.vid AS dst, coalesce(e.weight, 0) AS w FROM v a JOIN v b ON a.graph_id = b.graph_id LEFT JOIN e ON e.graph_id = a.graph_id AND e.src = a.vid AND e.dst = b.vid), rk AS (SELECT graph_id, src, dst AS i, row_number() OVER (PARTITION BY graph_id, src ORDER BY w, dst) - 1 AS p FROM cell) SELECT graph_id, src, p AS dst, CAST(1 AS DOUBLE) AS weight FROM rk WHERE 5 - i < 3 AND p <> src")
G_FULL = lambda s, d: Graph.from_tables(G.trade(s, d)[0], prep.as_sociomatrix_sna(TRADE(s, d)).where("src <> dst").select("src", "dst", (F.col("weight") + 1).alias("weight")))
_spread = lambda x: f"count(*) * max({x}) - sum({x})"
for _name, _measure, _kw, _sql, _col in (
    ("indegree", "degree", {"cmode": "indegree"}, f"{TRADE_SQL}, m AS ({Q._deg.format(i='i', x='weight')})", "degree"),
    ("outdegree", "degree", {"cmode": "outdegree"}, f"{TRADE_SQL}, m AS ({Q._deg.format(i='o', x='weight')})", "degree"),
    ("closeness", "closeness", {}, None, "closeness"),
    ("graphcent", "graphcent", {}, None, "graphcent"),
    ("betweenness", "betweenness", {}, None, "betweenness"),
    ("stresscent", "stresscent", {}, None, "stress"),
    ("prestige", "prestige", {}, None, "prestige"),
):
    if _sql is None:
        _key = {"closeness": "closeness_directed", "betweenness": "betweenness_directed", "stresscent": "stress", "prestige": "prestige_indegree"}.get(_name, _name)
        _text = Q.ORACLE_SQL[_key]
        _cut = _text.rindex(" SELECT v.vid") if _key in ("betweenness_directed", "stress") else _text.rindex(" SELECT s AS vid") if "SELECT s AS vid" in _text else _text.rindex(" SELECT v.vid")
        _sql = f"{_text[:_cut]}, m AS ({_text[_cut:]})"
    add(f"centralization_raw_{_name}", lambda s, d, m=_measure, kw=_kw: one(s, deviation=round(spectral.centralization(TRADE(s, d), m, normalize=False, **kw), 2)), f"{_sql} SELECT round({_spread(_col)}, 2) AS deviation FROM m")

# Residuals of solutions ------------------------------------------------------------------------------------------------


def _times(g: Graph, x: DataFrame, name: str) -> DataFrame:
    """vid, x, y = (W x) of one graph."""
    e = g.ties.join(x.select(F.col("vid").alias("dst"), F.col(name).alias("x")), "dst").groupBy(F.col("src").alias("vid")).agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
    return x.select("vid", F.col(name).alias("x")).join(e, "vid", "left").fillna(0.0, ["y"])


def eigen_residual(s: SparkSession, g: Graph, x: DataFrame, name: str) -> DataFrame:
    """Largest |W x - l x| over l, with l the Rayleigh quotient, and the sum of squares of x."""
    j = _times(g, x, name)
    j = j.crossJoin(F.broadcast(j.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("l"), F.sum(F.col("x") * F.col("x")).alias("size"))))  # one row
    return j.agg((F.max(F.abs(F.col("y") - F.col("l") * F.col("x")) / F.col("l")) < 1e-6).alias("eigenvector"), F.round(F.max("size"), 6).alias("size"))


add("evcent_residual", lambda s, d: (lambda g: eigen_residual(s, g, DROP(spectral.evcent(g)), "evcent"))(TRADE(s, d)), "SELECT TRUE AS eigenvector, CAST(1 AS DOUBLE) AS size")
add("prestige_eigenvector_residual", lambda s, d: (lambda g: eigen_residual(s, prep.gt(g), DROP(spectral.prestige(g, "eigenvector")), "prestige"))(TRADE(s, d)), "SELECT TRUE AS eigenvector, CAST(1 AS DOUBLE) AS size")
add("evcent_joins_residual", lambda s, d: (lambda g: eigen_residual(s, g, spectral.evcent_joins(g), "evcent"))(FLAT(s, d)), "SELECT TRUE AS eigenvector, CAST(1 AS DOUBLE) AS size")


def power_residual(s: SparkSession, d: str) -> DataFrame:
    """(I - b W) c is proportional to W 1, and c has a sum of squares of n."""
    g, b = TRADE(s, d), 0.0001
    c = DROP(spectral.bonpow(g, exponent=b))
    row = g.ties.groupBy(F.col("src").alias("vid")).agg(F.sum("weight").alias("w"))
    j = _times(g, c, "bonpow").join(row, "vid", "left").fillna(0.0, ["w"]).withColumn("left", F.col("x") - b * F.col("y"))
    j = j.crossJoin(F.broadcast(j.agg((F.sum("left") / F.sum("w")).alias("a"), F.sum(F.col("x") * F.col("x")).alias("size"), F.count("*").alias("n"))))  # one row
    return j.agg((F.max(F.abs(F.col("left") - F.col("a") * F.col("w"))) < 1e-6).alias("solves"), (F.max(F.abs(F.col("size") - F.col("n"))) < 1e-6).alias("scaled"))


add("bonpow_residual", power_residual, "SELECT TRUE AS solves, TRUE AS scaled")


def core_check(s: SparkSession, g: Graph, cores: DataFrame) -> DataFrame:
    """Vertices with fewer than their core's number of ties into it, and the largest core's members by degree bound."""
    c = cores.select("vid", "core")
    j = g.ties.join(c.select(F.col("vid").alias("src"), F.col("core").alias("a")), "src").join(c.select(F.col("vid").alias("dst"), F.col("core").alias("b")), "dst")
    inside = j.where("b >= a").groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("k"))
    return c.join(inside, "vid", "left").fillna(0, ["k"]).agg(F.sum((F.col("k") < F.col("core")).cast("long")).alias("short"))


add("kcores_inside", lambda s, d: (lambda g: core_check(s, g, connectivity.kcores(g, "indegree")))(FLAT(s, d)), "SELECT CAST(0 AS BIGINT) AS short")
add("kcores_agree", lambda s, d: (lambda g: connectivity.kcores(g, "indegree").select("vid", "core").join(connectivity.kcores_peeled(g).select("vid", F.col("core").alias("peeled")), "vid").agg(F.sum((F.col("core") != F.col("peeled")).cast("long")).alias("differ")))(FLAT(s, d)), "SELECT CAST(0 AS BIGINT) AS differ")
add("cutpoints_weak", lambda s, d: DROP(connectivity.cutpoints(Q._big(s, d), "weak")), f"WITH RECURSIVE {G.nations_sql(1.5)}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT vid AS x FROM v UNION ALL SELECT CAST(-1 AS BIGINT)), r(x, s, v) AS (SELECT w.x, vid, vid FROM w, v WHERE vid <> w.x UNION SELECT r.x, r.s, u.dst FROM r JOIN u ON u.src = r.v WHERE u.dst <> r.x), k AS (SELECT x, count(DISTINCT root) AS c FROM (SELECT x, s, min(v) AS root FROM r GROUP BY 1, 2) GROUP BY 1) SELECT x AS vid FROM k WHERE x >= 0 AND c > (SELECT c FROM k WHERE x = -1)")
add("maxflow_bounds", lambda s, d: (lambda g: connectivity.maxflow(g).where("src <> dst").join(g.ties.groupBy("src").agg(F.sum("weight").alias("out")), "src", "left").join(g.ties.groupBy("dst").agg(F.sum("weight").alias("into")), "dst", "left").fillna(0.0, ["out", "into"]).agg(F.count("*").alias("pairs"), F.sum((F.col("flow") > F.least("out", "into") + 1e-9).cast("long")).alias("over")))(Q._big(s, d)), f"{Q._big_sql} SELECT count(*) * (count(*) - 1) AS pairs, CAST(0 AS BIGINT) AS over FROM v")
add("flowbet", lambda s, d: rounded(DROP(connectivity.flowbet(STACK_ONE(s, d))), "flowbet"))
STACK_ONE = lambda s, d: member(STACK(s, d), 0)

# Drawing tables and tasks ---------------------------------------------------------------------------------------------------

_round = f"{TRADE_SQL}, n AS (SELECT count(*) AS n FROM v), k AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS k FROM v), ci AS (SELECT vid, sin(2 * pi() * k / n) AS x, cos(2 * pi() * k / n) AS y FROM k, n)"
add("layout_circle", lambda s, d: rounded(DROP(layouts.circle(TRADE(s, d))), "x", "y"), f"{_round} SELECT vid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM ci")
add("layout_target", lambda s, d: (lambda g: rounded(DROP(layouts.gplot_target(g, local.degree(g).select("vid", F.col("degree").alias("value")))), "x", "y"))(TRADE(s, d)), f"{_round}, dg AS ({Q._deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='weight')}), r AS (SELECT vid, ((SELECT max(degree) FROM dg) - degree) / ((SELECT max(degree) FROM dg) - (SELECT min(degree) FROM dg)) AS r FROM dg) SELECT vid, round(x * r, 6) + 0.0 AS x, round(y * r, 6) + 0.0 AS y FROM ci JOIN r USING (vid)")
add("plot_sociomatrix", lambda s, d: layouts.plot_sociomatrix(TRADE(s, d)), f"{TRADE_SQL} SELECT a.vid AS \"row\", b.vid AS col, coalesce(weight, 0) AS value FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.vid AND dst = b.vid")
add("gplot_arrow", lambda s, d: rounded(layouts.gplot_arrow(TRADE(s, d), "circle"), "x1", "y1", "x2", "y2"), f"{_round} SELECT e.src, e.dst, e.weight, round(a.x, 6) + 0.0 AS x1, round(a.y, 6) + 0.0 AS y1, round(b.x, 6) + 0.0 AS x2, round(b.y, 6) + 0.0 AS y2, f.src IS NOT NULL AS answered FROM e JOIN ci a ON a.vid = e.src JOIN ci b ON b.vid = e.dst LEFT JOIN e f ON f.src = e.dst AND f.dst = e.src")
add("gplot_vertex", lambda s, d: layouts.gplot_vertex(TRADE(s, d), "fruchtermanreingold", rounds=20).select("vid", (~F.isnan("x") & ~F.isnan("y")).alias("placed")), f"{TRADE_SQL} SELECT vid, TRUE AS placed FROM v")
add("gplot_loop", lambda s, d: rounded(layouts.gplot_loop(LOOPS(s, d), "circle").select("vid", "weight"), "weight"), f"WITH {G.TRADE_SQL} SELECT src AS vid, weight FROM ne0 WHERE src = dst")
LOOPS = lambda s, d: Graph.from_tables(*G.trade(s, d), loops=True)
add("execute_task", lambda s, d: DROP(execute_task("dyadCensus", USERS(s, d))), Q.ORACLE_SQL["dyad_census"])


def by_client(s: SparkSession, d: str) -> DataFrame:
    client = TaskClient(s)
    try:
        rows = client.run("degree", TRADE(s, d), "outdegree", action=lambda df: [(r["vid"], r["degree"]) for r in df.collect()]).result()  # 25 vertices
    finally:
        client.terminate()
    return s.createDataFrame(rows, "vid long, degree double")


add("task_client", by_client, f"{TRADE_SQL} {Q._deg.format(i='o', x='weight')}")
