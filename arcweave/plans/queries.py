"""Registered queries: each operator on graphs derived from the standard tables, with its SQL twin.

Values that are not whole numbers are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import bayes, biased, compare, connectivity, local, paths, prep, roles, spectral
from . import graphs as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places, and no negative zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def _on(base: str, **kw):
    """(graph builder, SQL prefix) of a base graph."""
    if base == "trade":
        return lambda s, d: G.nations(s, d, **kw), "WITH " + G.nations_sql(**kw)
    if base == "users":
        return lambda s, d: G.handoffs(s, d, **kw), "WITH " + G.handoffs_sql(**kw)
    if base == "stack":
        return lambda s, d: G.transitions(s, d, **kw), "WITH " + G.transitions_sql(**kw)
    return G.informants, "WITH " + G.INFORMANTS_SQL


USERS, USERS_SQL = _on("users")
TRADE, TRADE_SQL = _on("trade")
FLAT, FLAT_SQL = _on("trade", directed=False)
STACK, STACK_SQL = _on("stack")
INFORM, INFORM_SQL = _on("informants")
DROP = lambda df: df.drop("graph_id")

# Degrees and density ----------------------------------------------------------------------

_deg = "SELECT v.vid, CAST(coalesce({i}, 0) AS DOUBLE) AS degree FROM v LEFT JOIN (SELECT dst AS vid, sum({x}) AS i FROM e GROUP BY 1) a USING (vid) LEFT JOIN (SELECT src AS vid, sum({x}) AS o FROM e GROUP BY 1) b USING (vid)"
for _mode, _sum in (("freeman", "coalesce(i, 0) + coalesce(o, 0)"), ("indegree", "i"), ("outdegree", "o")):
    add(f"degree_{_mode}", lambda s, d, m=_mode: DROP(local.degree(USERS(s, d), m)), f"{USERS_SQL} {_deg.format(i=_sum, x='weight')}")
add("degree_binary", lambda s, d: DROP(local.degree(USERS(s, d), ignore_eval=True)), f"{USERS_SQL} {_deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='1')}")
add("density", lambda s, d: rounded(DROP(local.gden(USERS(s, d))), "density"), f"{USERS_SQL} SELECT round((SELECT sum(weight) FROM e) / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM v)")
add("density_binary", lambda s, d: rounded(DROP(local.gden(USERS(s, d), ignore_eval=True)), "density"), f"{USERS_SQL} SELECT round((SELECT CAST(count(*) AS DOUBLE) FROM e) / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM v)")
add("density_stack", lambda s, d: rounded(local.gden(STACK(s, d)), "density"), f"{STACK_SQL} SELECT graph_id, round(avg(weight), 6) AS density FROM grid GROUP BY 1")
add("nties", lambda s, d: DROP(local.nties(USERS(s, d))), f"{USERS_SQL} SELECT CAST(count(*) * (count(*) - 1) AS DOUBLE) AS nties FROM v")
_sparse, _sparse_sql = _on("trade", factor=1.5)
add("isolates", lambda s, d: DROP(local.isolates(_sparse(s, d))), f"{_sparse_sql} SELECT vid FROM v WHERE vid NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
add("is_isolate", lambda s, d: DROP(local.is_isolate(_sparse(s, d), list(range(5)))), f"{_sparse_sql} SELECT vid, vid NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AS isolate FROM v WHERE vid < 5")
add("is_isolate_all", lambda s, d: DROP(local.is_isolate(_sparse(s, d))), f"{_sparse_sql} SELECT vid, vid NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AS isolate FROM v")

# Dyads and triads -----------------------------------------------------------------------------

_dyads = "dy AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, count(*) AS k FROM e GROUP BY 1, 2), c AS (SELECT CAST(coalesce(sum(CAST(k = 2 AS BIGINT)), 0) AS BIGINT) AS m, CAST(coalesce(sum(CAST(k = 1 AS BIGINT)), 0) AS BIGINT) AS a, CAST((SELECT count(*) * (count(*) - 1) // 2 FROM v) - count(*) AS BIGINT) AS n FROM dy)"
add("dyad_census", lambda s, d: DROP(local.dyad_census(USERS(s, d))), f"{USERS_SQL}, {_dyads} SELECT m AS mut, a AS asym, n AS \"null\", CAST(0 AS BIGINT) AS missing FROM c")
add("mutuality", lambda s, d: DROP(local.mutuality(USERS(s, d))), f"{USERS_SQL}, {_dyads} SELECT m AS mutuality FROM c")
for _name, _measure, _sql in (
    ("dyadic", "dyadic", "CAST(m + n AS DOUBLE) / (m + a + n)"),
    ("nonnull", "dyadic.nonnull", "CAST(m AS DOUBLE) / (m + a)"),
    ("edgewise", "edgewise", "2.0 * m / (2 * m + a)"),
    ("lrr", "edgewise.lrr", "CASE WHEN m = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(CAST(m AS DOUBLE) * (m + a + n) / ((m + a / 2.0) * (m + a / 2.0))) END"),
):
    add(f"reciprocity_{_name}", lambda s, d, m=_measure: rounded(DROP(local.grecip(USERS(s, d), m)), "reciprocity"), f"{USERS_SQL}, {_dyads} SELECT round({_sql}, 6) AS reciprocity FROM c")
add("reciprocity_correlation", lambda s, d: rounded(DROP(local.grecip(USERS(s, d), "correlation")), "reciprocity"), f"{USERS_SQL}, p AS (SELECT coalesce(e.weight, 0) AS x, coalesce(f.weight, 0) AS y FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN e ON e.src = a.vid AND e.dst = b.vid LEFT JOIN e f ON f.src = b.vid AND f.dst = a.vid) SELECT round(corr(x, y), 6) AS reciprocity FROM p")
_adj = "adj AS (SELECT a.vid AS i, b.vid AS j, e.src IS NOT NULL AS t FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN e ON e.src = a.vid AND e.dst = b.vid)"
_triples = f"""{_adj}, tr AS (SELECT CAST(x.t AS INT) AS ij, CAST(y.t AS INT) AS ji, CAST(z.t AS INT) AS ik, CAST(u.t AS INT) AS ki, CAST(p.t AS INT) AS jk, CAST(q.t AS INT) AS kj
  FROM adj x JOIN adj y ON y.i = x.j AND y.j = x.i JOIN adj z ON z.i = x.i AND z.j > x.j JOIN adj u ON u.i = z.j AND u.j = x.i JOIN adj p ON p.i = x.j AND p.j = z.j JOIN adj q ON q.i = z.j AND q.j = x.j WHERE x.i < x.j)"""
_classes = """st AS (SELECT ij*ji + ik*ki + jk*kj AS m, (1-ij)*(1-ji) + (1-ik)*(1-ki) + (1-jk)*(1-kj) AS n, ji + ki AS a, ij + kj AS b, ik + jk AS c, ij + ik AS x, ji + jk AS y, ki + kj AS z FROM tr),
nm AS (SELECT CASE WHEN n = 3 THEN '003' WHEN m = 0 AND n = 2 THEN '012' WHEN m = 1 AND n = 2 THEN '102'
  WHEN m = 0 AND n = 1 THEN CASE WHEN greatest(x, y, z) = 2 THEN '021D' WHEN greatest(a, b, c) = 2 THEN '021U' ELSE '021C' END
  WHEN m = 1 AND n = 1 THEN CASE WHEN least(a, b, c) = 0 AND greatest(a, b, c) = 2 THEN '111D' ELSE '111U' END
  WHEN m = 0 AND n = 0 THEN CASE WHEN greatest(a, b, c) = 2 THEN '030T' ELSE '030C' END WHEN m = 2 AND n = 1 THEN '201'
  WHEN m = 1 AND n = 0 THEN CASE WHEN least(a, b, c) = 0 THEN '120D' WHEN least(x, y, z) = 0 THEN '120U' ELSE '120C' END
  WHEN m = 2 THEN '210' ELSE '300' END AS triad FROM st)"""
_names = ", ".join(f"('{x}')" for x in local.DIRECTED_TRIAD_CLASSES)
add("triad_census_directed", lambda s, d: DROP(local.triad_census(TRADE(s, d))), f"{TRADE_SQL}, {_triples}, {_classes} SELECT k.triad, count(nm.triad) AS count FROM (VALUES {_names}) k(triad) LEFT JOIN nm USING (triad) GROUP BY 1")
add("triad_census_undirected", lambda s, d: DROP(local.triad_census(FLAT(s, d))), f"{FLAT_SQL}, {_triples} SELECT k.triad, count(t.triad) AS count FROM (VALUES ('0'), ('1'), ('2'), ('3')) k(triad) LEFT JOIN (SELECT CAST(ij + ik + jk AS VARCHAR) AS triad FROM tr) t USING (triad) GROUP BY 1")
_two = "tp AS (SELECT a.src AS i, a.dst AS j, b.dst AS k, a.weight AS w1, b.weight AS w2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst)"
_closed = f"{_two}, cl AS (SELECT tp.*, e.weight AS w3 FROM tp LEFT JOIN e ON e.src = tp.i AND e.dst = tp.k), ct AS (SELECT CAST(count(w3) AS DOUBLE) AS g, CAST(count(*) AS DOUBLE) AS p, CAST((SELECT count(*) FROM e) AS DOUBLE) AS m, CAST((SELECT count(*) FROM v) AS DOUBLE) AS n, CAST(coalesce(sum(CAST(coalesce(w3, 0) >= least(w1, w2) AS INT)), 0) AS DOUBLE) AS r FROM cl)"
for _name, _sql in (("weak", "CASE WHEN p = 0 THEN 1 ELSE g / p END"), ("weakcensus", "g"), ("rank", "CASE WHEN p = 0 THEN 1 ELSE r / p END"), ("strong", "(g + n * (n - 1) * (n - 2) - (p + m * (n - 2) - g)) / (n * (n - 1) * (n - 2))"), ("strongcensus", "g + n * (n - 1) * (n - 2) - (p + m * (n - 2) - g)")):
    add(f"transitivity_{_name}", lambda s, d, m=_name: rounded(DROP(local.gtrans(TRADE(s, d), m)), "transitivity"), f"{TRADE_SQL}, {_closed} SELECT round(CAST({_sql} AS DOUBLE), 6) AS transitivity FROM ct")
add("simmelian", lambda s, d: DROP(local.simmelian(TRADE(s, d), dichotomize=False)), f"{TRADE_SQL}, mu AS (SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src) SELECT mu.src, mu.dst, CAST(count(*) AS DOUBLE) AS value FROM mu JOIN mu x ON x.src = mu.src JOIN mu y ON y.src = x.dst AND y.dst = mu.dst GROUP BY 1, 2")
_roles = f"{_two}, br AS (SELECT j, x.cl AS a, y.cl AS b, z.cl AS c FROM tp JOIN v x ON x.vid = i JOIN v y ON y.vid = j JOIN v z ON z.vid = k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = tp.i AND e.dst = tp.k))"
_count = lambda c: f"CAST(coalesce(sum(CAST({c} AS INT)), 0) AS BIGINT)"
add("brokerage", lambda s, d: DROP(local.brokerage(TRADE(s, d), G.trade(s, d)[0])), f"{TRADE_SQL}, {_roles} SELECT vid, {_count('a = b AND b = c')} AS w_i, {_count('a = c AND a <> b')} AS w_o, {_count('a = b AND b <> c')} AS b_io, {_count('b = c AND a <> b')} AS b_oi, {_count('a <> b AND b <> c AND a <> c')} AS b_o, count(j) AS t FROM v LEFT JOIN br ON j = vid GROUP BY 1")

# Preparation ----------------------------------------------------------------------------------

_edges = lambda g: rounded(g.edges.where("not missing").select("src", "dst", "weight"), "weight")
for _rule, _sql in (
    ("weak", "SELECT DISTINCT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"),
    ("strong", "SELECT a.src, a.dst, CAST(1 AS DOUBLE) AS weight FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src"),
    ("upper", "SELECT src, dst, weight FROM e WHERE src < dst UNION ALL SELECT dst, src, weight FROM e WHERE src < dst"),
    ("lower", "SELECT src, dst, weight FROM e WHERE src > dst UNION ALL SELECT dst, src, weight FROM e WHERE src > dst"),
):
    add(f"symmetrize_{_rule}", lambda s, d, r=_rule: _edges(prep.symmetrize(USERS(s, d), r)), f"{USERS_SQL} {_sql}")
add("transpose", lambda s, d: _edges(prep.gt(USERS(s, d))), f"{USERS_SQL} SELECT dst AS src, src AS dst, weight FROM e")
add("add_isolates", lambda s, d: prep.add_isolates(TRADE(s, d), 3).vertices.select("vid"), f"{TRADE_SQL} SELECT vid FROM v UNION ALL SELECT (SELECT max(vid) FROM v) + k FROM (VALUES (1), (2), (3)) t(k)")
add("diag_remove", lambda s, d: _edges(prep.diag_remove(TRADE(s, d), 7.0)), f"{TRADE_SQL} SELECT src, dst, weight FROM e UNION ALL SELECT vid, vid, 7.0 FROM v")
add("upper_tri_remove", lambda s, d: _edges(prep.upper_tri_remove(TRADE(s, d), 0.0)), f"{TRADE_SQL} SELECT src, dst, weight FROM e WHERE src > dst")
add("lower_tri_remove", lambda s, d: _edges(prep.lower_tri_remove(TRADE(s, d), 2.0)), f"{TRADE_SQL} SELECT src, dst, weight FROM e WHERE src < dst UNION ALL SELECT a.vid, b.vid, 2.0 FROM v a JOIN v b ON a.vid > b.vid")
add("edgelist_sna", lambda s, d: DROP(prep.as_edgelist_sna(TRADE(s, d))), f"{TRADE_SQL} SELECT src, dst, weight, dst * (SELECT count(*) FROM v) + src AS pos FROM e")
add("sociomatrix_sna", lambda s, d: DROP(prep.as_sociomatrix_sna(TRADE(s, d))), f"{TRADE_SQL} SELECT a.vid AS src, b.vid AS dst, coalesce(weight, 0) AS weight FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.vid AND dst = b.vid")
add("ego_extract", lambda s, d: DROP(prep.ego_extract(TRADE(s, d))).drop("missing"), f"""{TRADE_SQL}, al AS (SELECT src AS ego, dst AS vid FROM e UNION SELECT dst, src FROM e), me AS (SELECT vid AS ego, vid FROM v UNION ALL SELECT ego, vid FROM al),
lb AS (SELECT ego, vid, row_number() OVER (PARTITION BY ego ORDER BY vid <> ego, vid) - 1 AS l FROM me) SELECT a.ego, CAST(a.l AS INT) AS src, CAST(b.l AS INT) AS dst, weight FROM e JOIN lb a ON a.vid = src JOIN lb b ON b.vid = dst AND a.ego = b.ego""")
add("gvectorize", lambda s, d: prep.gvectorize(STACK(s, d), censor_as_na=False), f"{STACK_SQL} SELECT graph_id, dst * (SELECT count(DISTINCT vid) FROM v) + src AS pos, CAST(weight AS DOUBLE) AS value FROM grid")
for _name, _cut in (("mean", "avg(weight)"), ("quantile", "quantile_cont(weight, 0.5)")):
    for _p, _by in (("", ""), ("r", "src"), ("c", "dst")):
        add(f"event2dichot_{_p}{_name}", lambda s, d, m=_p + _name: prep.event2dichot(STACK(s, d), m).edges.select("graph_id", "src", "dst", "weight"), f"{STACK_SQL}, g2 AS (SELECT x.graph_id, x.vid AS src, y.vid AS dst, coalesce(e.weight, 0) AS weight FROM v x JOIN v y ON x.graph_id = y.graph_id LEFT JOIN e ON e.graph_id = x.graph_id AND e.src = x.vid AND e.dst = y.vid) SELECT g2.graph_id, g2.src, g2.dst, CAST(1 AS DOUBLE) AS weight FROM g2 JOIN (SELECT graph_id{', ' + _by if _by else ''}, {_cut} AS c FROM g2 GROUP BY ALL) USING (graph_id{', ' + _by if _by else ''}) WHERE weight > c AND src <> dst")
add("event2dichot_absolute", lambda s, d: prep.event2dichot(STACK(s, d), "absolute", thresh=3.0).edges.select("graph_id", "src", "dst", "weight"), f"{STACK_SQL} SELECT graph_id, src, dst, CAST(1 AS DOUBLE) AS weight FROM e WHERE weight > 3")
for _mode, _by in (("row", "PARTITION BY src"), ("col", "PARTITION BY dst"), ("total", "")):
    add(f"stochastic_{_mode}", lambda s, d, m=_mode: _edges(prep.make_stochastic(USERS(s, d), m)), f"{USERS_SQL} SELECT src, dst, round(weight / sum(weight) OVER ({_by}), 6) AS weight FROM e")
add("sr2css", lambda s, d: (lambda g: g.edges.groupBy("graph_id").agg(F.sum("weight").alias("own"), F.sum(F.col("missing").cast("long")).alias("missing")))(prep.sr2css(TRADE(s, d))), f"{TRADE_SQL} SELECT vid AS graph_id, coalesce((SELECT sum(weight) FROM e WHERE src = vid), 0) AS own, (SELECT count(*) * (count(*) - 1) FROM v) AS missing FROM v")
_both = "least(a.t, b.t) - greatest(a.o, b.o)"
for _kind, _sql in (("simple", "1.0"), ("overlap", _both), ("fracxy", f"CASE WHEN a.t > a.o THEN ({_both}) / (a.t - a.o) ELSE CAST('nan' AS DOUBLE) END"), ("fracyx", f"CASE WHEN b.t > b.o THEN ({_both}) / (b.t - b.o) ELSE CAST('nan' AS DOUBLE) END"), ("jntfrac", f"CASE WHEN a.t - a.o + b.t - b.o > 0 THEN 2 * ({_both}) / (a.t - a.o + b.t - b.o) ELSE CAST('nan' AS DOUBLE) END")):
    add(f"interval_graph_{_kind}", lambda s, d, k=_kind: rounded(DROP(prep.interval_graph(G.spells(s, d), k, width=86400.0)), "value"), f"WITH {G.SPELLS_SQL} SELECT a.idx AS src, b.idx AS dst, round(CAST({_sql} AS DOUBLE), 6) AS value FROM sp a JOIN sp b ON a.o <= b.t AND a.t >= b.o AND a.idx <> b.idx")
add("graph_composition", lambda s, d: prep.graph_composition(TRADE(s, d), TRADE(s, d)).edges.select("src", "dst"), f"{TRADE_SQL} SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src")
for _fn, _sql in (("sum", "coalesce(sum(value), 0)"), ("mean", "avg(value)"), ("max", "max(value)"), ("count", "CAST(count(value) AS DOUBLE)")):
    add(f"gapply_{_fn}", lambda s, d, f=_fn: rounded((lambda g: prep.gapply(g, "row", local.degree(g).withColumnRenamed("degree", "value"), f))(TRADE(s, d)), "value"), f"{TRADE_SQL}, st AS ({_deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='weight').replace('AS degree', 'AS value')}) SELECT v.vid, round({_sql}, 6) AS value FROM v LEFT JOIN e ON e.src = v.vid LEFT JOIN st ON st.vid = e.dst GROUP BY 1")
add("stackcount", lambda s, d: STACK(s, d).stackcount(), f"{STACK_SQL} SELECT count(DISTINCT graph_id) AS graphs FROM v")
add("neighbors", lambda s, d: DROP(TRADE(s, d).neighbors(3)), f"{TRADE_SQL} SELECT dst FROM e WHERE src = 3")

# Comparison, roles, informants ------------------------------------------------------------------

_pair = "pr AS (SELECT a.graph_id AS g1, b.graph_id AS g2, a.weight AS x, b.weight AS y FROM grid a JOIN grid b USING (src, dst))"
add("gcov", lambda s, d: rounded(compare.gcov(STACK(s, d)), "gcov"), f"{STACK_SQL}, {_pair} SELECT g1, g2, round(covar_samp(x, y), 6) AS gcov FROM pr GROUP BY 1, 2")
add("gcor", lambda s, d: rounded(compare.gcor(STACK(s, d)), "gcor"), f"{STACK_SQL}, {_pair} SELECT g1, g2, round(corr(x, y), 6) AS gcor FROM pr GROUP BY 1, 2")
add("hdist", lambda s, d: compare.hdist(STACK(s, d)), f"{STACK_SQL}, {_pair} SELECT g1, g2, CAST(sum(abs(x - y)) AS DOUBLE) AS hdist FROM pr GROUP BY 1, 2")
add("hdist_normalized", lambda s, d: rounded(compare.hdist(STACK(s, d), normalize=True), "hdist"), f"{STACK_SQL}, {_pair} SELECT g1, g2, round(avg(abs(x - y)), 6) AS hdist FROM pr GROUP BY 1, 2")
add("central_graph", lambda s, d: compare.centralgraph(INFORM(s, d)), f"{INFORM_SQL} SELECT src, dst, CAST(1 AS DOUBLE) AS value FROM e GROUP BY 1, 2 HAVING count(*) >= (SELECT m FROM obs) / 2.0")
add("central_graph_mean", lambda s, d: rounded(compare.centralgraph(INFORM(s, d), normalize=True), "value"), f"{INFORM_SQL} SELECT src, dst, round(count(*) / CAST((SELECT m FROM obs) AS DOUBLE), 6) AS value FROM e GROUP BY 1, 2")
_block = "cells AS (SELECT a.vid AS i, b.vid AS j, a.cl AS r, b.cl AS c, coalesce(e.weight, 0) AS w FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN e ON e.src = a.vid AND e.dst = b.vid)"
for _name, _sql in (("density", "avg(w)"), ("sum", "sum(w)"), ("median", "median(w)"), ("min", "min(w)"), ("max", "max(w)")):
    add(f"blockmodel_{_name}", lambda s, d, k=_name: rounded(DROP(roles.blockmodel(TRADE(s, d), G.trade(s, d)[0], k)), "value"), f"{TRADE_SQL}, {_block} SELECT r AS \"row\", c AS col, round(CAST({_sql} AS DOUBLE), 6) AS value FROM cells GROUP BY 1, 2")
for _name, _by in (("meanrowsum", "i"), ("meancolsum", "j")):
    add(f"blockmodel_{_name}", lambda s, d, k=_name: rounded(DROP(roles.blockmodel(TRADE(s, d), G.trade(s, d)[0], k)), "value"), f"{TRADE_SQL}, {_block} SELECT r AS \"row\", c AS col, round(avg(s), 6) AS value FROM (SELECT r, c, {_by}, sum(w) AS s FROM cells GROUP BY ALL) GROUP BY 1, 2")
add("blockmodel_types", lambda s, d: DROP(roles.blockmodel(TRADE(s, d), G.trade(s, d)[0], "types")), f"{TRADE_SQL}, {_block}, rr AS (SELECT r, c, min(x) AS x FROM (SELECT r, c, i, max(CAST(w <> 0 AS INT)) AS x FROM cells GROUP BY ALL) GROUP BY ALL), cc AS (SELECT r, c, min(x) AS x FROM (SELECT r, c, j, max(CAST(w <> 0 AS INT)) AS x FROM cells GROUP BY ALL) GROUP BY ALL) SELECT b.r AS \"row\", b.c AS col, CASE WHEN s = 0 THEN 'null' WHEN s = k THEN 'complete' WHEN rr.x = 1 AND cc.x = 1 THEN '1 covered' WHEN rr.x = 1 THEN '1 row-covered' WHEN cc.x = 1 THEN '1 col-covered' ELSE 'other' END AS value FROM (SELECT r, c, sum(CAST(w <> 0 AS INT)) AS s, count(*) AS k FROM cells GROUP BY ALL) b JOIN rr ON rr.r = b.r AND rr.c = b.c JOIN cc ON cc.r = b.r AND cc.c = b.c")
_prof = "pf AS (SELECT x.vid AS a, 0 AS k, y.vid AS o, coalesce(e.weight, 0) AS w FROM v x JOIN v y ON x.vid <> y.vid LEFT JOIN e ON e.src = x.vid AND e.dst = y.vid UNION ALL SELECT y.vid, 1, x.vid, coalesce(e.weight, 0) FROM v x JOIN v y ON x.vid <> y.vid LEFT JOIN e ON e.src = x.vid AND e.dst = y.vid), pp AS (SELECT p.a AS i, q.a AS j, p.w AS x, q.w AS y FROM pf p JOIN pf q ON p.k = q.k AND p.o = q.o AND p.a <> q.a)"
for _name, _sql in (("hamming", "sum(abs(x - y))"), ("euclidean", "sqrt(sum((x - y) * (x - y)))"), ("exact", "sum(CAST(x <> y AS INT))"), ("gamma", "avg(CASE WHEN x = y THEN 1.0 ELSE -1.0 END)"), ("correlation", "CASE WHEN count(DISTINCT x) = 1 OR count(DISTINCT y) = 1 THEN 0 ELSE corr(x, y) END")):
    add(f"sedist_{_name}", lambda s, d, m=_name: rounded(roles.sedist(TRADE(s, d), m), "sedist"), f"{TRADE_SQL}, {_prof} SELECT i, j, round(CAST({_sql} AS DOUBLE), 6) AS sedist FROM pp GROUP BY 1, 2")
add("consensus_central_graph", lambda s, d: bayes.consensus(INFORM(s, d)), ORACLE_SQL["central_graph"])
for _name, _key in (("OR.row", "src"), ("OR.col", "dst")):
    add(f"consensus_{_name.replace('.', '_').lower()}", lambda s, d, m=_name: bayes.consensus(INFORM(s, d), m), f"{INFORM_SQL} SELECT src, dst, CAST(1 AS DOUBLE) AS value FROM e WHERE graph_id = {_key}")
for _name, _need in (("LAS.intersection", 2), ("LAS.union", 1)):
    add(f"consensus_{_name.replace('.', '_').lower()}", lambda s, d, m=_name: bayes.consensus(INFORM(s, d), m), f"{INFORM_SQL} SELECT src, dst, CAST(1 AS DOUBLE) AS value FROM e WHERE graph_id = src OR graph_id = dst GROUP BY 1, 2 HAVING count(DISTINCT graph_id) >= {_need}")
add("bbnam_posterior", lambda s, d: rounded(bayes.bbnam_fixed(INFORM(s, d)), "posterior"), f"{INFORM_SQL} SELECT src, dst, round(1 / (1 + exp(-((2 * k - (SELECT m FROM obs)) * ln(3.0)))), 6) AS posterior FROM (SELECT p.src, p.dst, count(e.src) AS k FROM pairs p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst GROUP BY 1, 2)")
_par = "pc AS (SELECT a.dst AS i, b.dst AS j, count(*) AS parents FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2)"
add("bn_triad_stats", lambda s, d: DROP(biased.bn_triad_stats(TRADE(s, d))), f"{TRADE_SQL}, {_par} SELECT i, j, parents FROM pc")
add("bn_dyad_stats", lambda s, d: DROP(biased.bn_dyad_stats(TRADE(s, d))), f"{TRADE_SQL}, {_par}, dd AS (SELECT coalesce(parents, 0) AS parents, coalesce(k, 0) AS k FROM v a JOIN v b ON a.vid < b.vid LEFT JOIN pc ON i = a.vid AND j = b.vid LEFT JOIN (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*) AS k FROM e GROUP BY 1, 2) ON x = a.vid AND y = b.vid) SELECT parents, {_count('k = 2')} AS mutual, {_count('k = 1')} AS asymmetric, {_count('k = 0')} AS \"null\" FROM dd GROUP BY 1")

# Geodesics --------------------------------------------------------------------------------------

_walk = "RECURSIVE " + G.nations_sql() + ", r(s, v, d) AS (SELECT vid, vid, 0 FROM v UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON r.v = e.src WHERE r.d < 12), ds AS (SELECT s, v, min(d) AS d FROM r GROUP BY 1, 2)"
DIST = f"WITH {_walk}"
_sig = ", g(s, v, d) AS (SELECT vid, vid, 0 FROM v UNION ALL SELECT g.s, e.dst, g.d + 1 FROM g JOIN e ON g.v = e.src JOIN ds ON ds.s = g.s AND ds.v = e.dst AND ds.d = g.d + 1), sg AS (SELECT s, v, d, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1, 2, 3)"
SIGMA = f"WITH {_walk}{_sig}"
_N = "(SELECT count(*) FROM v)"
add("geodist", lambda s, d: DROP(paths.geodist(TRADE(s, d))), f"{SIGMA} SELECT s AS src, v AS dst, CAST(d AS DOUBLE) AS dist, n AS sigma FROM sg")
add("average_path_length", lambda s, d: rounded(DROP(paths.average_path_length(TRADE(s, d))), "average_path_length"), f"{DIST} SELECT round(coalesce(avg(d), 0), 6) AS average_path_length FROM ds WHERE d > 0")
add("structure_statistics", lambda s, d: rounded(DROP(paths.structure_statistics(TRADE(s, d))), "share"), f"{DIST} SELECT k AS distance, round((SELECT count(*) FROM ds WHERE d <= k) / CAST({_N} * {_N} AS DOUBLE), 6) AS share FROM (SELECT unnest(range({_N})) AS k)")
add("reachability", lambda s, d: DROP(paths.reachability(TRADE(s, d))), f"{DIST} SELECT s AS src, v AS dst FROM ds")
for _kind, _sql in (("in", "SELECT v AS vid, s AS neighbor FROM ds WHERE d BETWEEN 1 AND 2"), ("out", "SELECT s AS vid, v AS neighbor FROM ds WHERE d BETWEEN 1 AND 2")):
    add(f"neighborhood_{_kind}", lambda s, d, k=_kind: DROP(paths.neighborhood(TRADE(s, d), 2, kind=k)), f"{DIST} {_sql}")
_reach = f"(SELECT s, sum(d) AS total, sum(1.0 / nullif(d, 0)) AS inv, count(*) - 1 AS k, max(d) AS far FROM ds GROUP BY 1)"
for _mode, _sql in (("directed", f"CASE WHEN k < {_N} - 1 THEN 0 ELSE CAST({_N} - 1 AS DOUBLE) / total END"), ("suminvdir", f"coalesce(inv, 0) / ({_N} - 1)"), ("gil-schmidt", "CASE WHEN k = 0 THEN 0 ELSE inv / k END")):
    add(f"closeness_{_mode.replace('-', '_')}", lambda s, d, m=_mode: rounded(DROP(paths.closeness(TRADE(s, d), m)), "closeness"), f"{DIST} SELECT s AS vid, round(CAST({_sql} AS DOUBLE), 6) AS closeness FROM {_reach}")
_uwalk = "RECURSIVE " + G.nations_sql(directed=False) + ", r(s, v, d) AS (SELECT vid, vid, 0 FROM v UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON r.v = e.src WHERE r.d < 12), ds AS (SELECT s, v, min(d) AS d FROM r GROUP BY 1, 2)"
for _mode, _sql in (("undirected", f"CASE WHEN k < {_N} - 1 THEN 0 ELSE CAST({_N} - 1 AS DOUBLE) / total END"), ("suminvundir", f"coalesce(inv, 0) / ({_N} - 1)")):
    add(f"closeness_{_mode}", lambda s, d, m=_mode: rounded(DROP(paths.closeness(TRADE(s, d), m)), "closeness"), f"WITH {_uwalk} SELECT s AS vid, round(CAST({_sql} AS DOUBLE), 6) AS closeness FROM {_reach}")
add("gilschmidt", lambda s, d: rounded(DROP(paths.gilschmidt(TRADE(s, d))), "gilschmidt"), f"{DIST} SELECT s AS vid, round(CAST(CASE WHEN k = 0 THEN 0 ELSE inv / k END AS DOUBLE), 6) AS gilschmidt FROM {_reach}")
add("graphcent", lambda s, d: rounded(DROP(paths.graphcent(TRADE(s, d))), "graphcent"), f"{DIST} SELECT s AS vid, round(CASE WHEN k < {_N} - 1 THEN 0 ELSE 1.0 / far END, 6) AS graphcent FROM {_reach}")
_on_path = "FROM sg st JOIN sg a ON a.s = st.s JOIN sg b ON b.s = a.v AND b.v = st.v AND a.d + b.d = st.d WHERE a.v <> st.s AND a.v <> st.v AND st.s <> st.v"
for _mode, _sql in (
    ("directed", f"SELECT a.v AS vid, sum(a.n * b.n / st.n) AS x {_on_path} GROUP BY 1"),
    ("lengthscaled", f"SELECT a.v AS vid, sum(a.n * b.n / st.n / st.d) AS x {_on_path} GROUP BY 1"),
    ("linearscaled", f"SELECT a.v AS vid, sum(a.n * b.n / st.n * a.d / st.d) AS x {_on_path} GROUP BY 1"),
    ("proximalsrc", f"SELECT a.v AS vid, sum(a.n * b.n / st.n) AS x {_on_path} AND b.d = 1 GROUP BY 1"),
    ("proximaltar", f"SELECT a.v AS vid, sum(a.n * b.n / st.n) AS x {_on_path} AND a.d = 1 GROUP BY 1"),
):
    add(f"betweenness_{_mode}", lambda s, d, m=_mode: rounded(DROP(paths.betweenness(TRADE(s, d), m)), "betweenness"), f"{SIGMA}, bt AS ({_sql}) SELECT v.vid, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN bt USING (vid)")
add("betweenness_endpoints", lambda s, d: rounded(DROP(paths.betweenness(TRADE(s, d), "endpoints")), "betweenness"), f"{SIGMA}, bt AS (SELECT a.v AS vid, sum(a.n * b.n / st.n) AS x FROM sg st JOIN sg a ON a.s = st.s JOIN sg b ON b.s = a.v AND b.v = st.v AND a.d + b.d = st.d WHERE st.s <> st.v GROUP BY 1) SELECT v.vid, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN bt USING (vid)")
add("stress", lambda s, d: rounded(DROP(paths.stresscent(TRADE(s, d))), "stress"), f"{SIGMA}, bt AS (SELECT a.v AS vid, sum(a.n * b.n) AS x {_on_path} GROUP BY 1) SELECT v.vid, round(coalesce(x, 0), 6) AS stress FROM v LEFT JOIN bt USING (vid)")
add("betweenness_undirected", lambda s, d: rounded(DROP(paths.betweenness(TRADE(s, d), "undirected")), "betweenness"), f"WITH {_uwalk}{_sig}, bt AS (SELECT a.v AS vid, sum(a.n * b.n / st.n) / 2 AS x {_on_path} GROUP BY 1) SELECT v.vid, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN bt USING (vid)")
add("prestige_indegree", lambda s, d: DROP(spectral.prestige(TRADE(s, d))), f"{TRADE_SQL} {_deg.format(i='i', x='weight').replace('AS degree', 'AS prestige')}")
add("prestige_domain", lambda s, d: DROP(spectral.prestige(TRADE(s, d), "domain")), f"{DIST} SELECT v AS vid, CAST(count(*) - 1 AS DOUBLE) AS prestige FROM ds GROUP BY 1")
add("prestige_domain_proximity", lambda s, d: rounded(DROP(spectral.prestige(TRADE(s, d), "domain.proximity")), "prestige"), f"{DIST} SELECT v AS vid, round(CASE WHEN count(*) = 1 THEN 0 ELSE CAST((count(*) - 1) * (count(*) - 1) AS DOUBLE) / (sum(d) * ({_N} - 1)) END, 6) AS prestige FROM ds GROUP BY 1")
add("centralization_degree", lambda s, d: s.createDataFrame([(spectral.centralization(USERS(s, d), "degree", ignore_eval=True),)], "centralization double").select(F.round("centralization", 6).alias("centralization")), f"{USERS_SQL}, dg AS ({_deg.format(i='coalesce(i, 0) + coalesce(o, 0)', x='1')}) SELECT round((max(degree) * count(*) - sum(degree)) / CAST((count(*) - 1) * (2 * (count(*) - 1) - 2) AS DOUBLE), 6) AS centralization FROM dg")

# Components ---------------------------------------------------------------------------------------

_big, _big_sql = _on("trade", factor=1.5)
_cwalk = "RECURSIVE " + G.nations_sql(1.5)
_weak = f"WITH {_cwalk}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(s, v) AS (SELECT vid, vid FROM v UNION SELECT r.s, u.dst FROM r JOIN u ON u.src = r.v), rt AS (SELECT s AS vid, min(v) AS root FROM r GROUP BY 1)"
_strong = f"WITH {_cwalk}, r(s, v) AS (SELECT vid, vid FROM v UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.v), rt AS (SELECT a.s AS vid, min(a.v) AS root FROM r a JOIN r b ON a.s = b.v AND a.v = b.s GROUP BY 1)"
_recur = f"WITH {_cwalk}, u AS (SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src), r(s, v) AS (SELECT vid, vid FROM v UNION SELECT r.s, u.dst FROM r JOIN u ON u.src = r.v), rt AS (SELECT s AS vid, min(v) AS root FROM r GROUP BY 1)"
for _kind, _sql in (("weak", _weak), ("strong", _strong), ("recursive", _recur)):
    add(f"components_{_kind}", lambda s, d, k=_kind: DROP(connectivity.component_dist(_big(s, d), k)), f"{_sql} SELECT vid, dense_rank() OVER (ORDER BY root) - 1 AS label FROM rt")
    add(f"component_count_{_kind}", lambda s, d, k=_kind: DROP(connectivity.components(_big(s, d), k)), f"{_sql} SELECT count(DISTINCT root) AS components FROM rt")
add("is_connected", lambda s, d: DROP(connectivity.is_connected(_big(s, d), "weak")), f"{_weak} SELECT count(DISTINCT root) <= 1 AS connected FROM rt")
add("component_size_by_vertex", lambda s, d: DROP(connectivity.component_size_by_vertex(_big(s, d), "weak")), f"{_weak} SELECT vid, count(*) OVER (PARTITION BY root) AS size FROM rt")
add("component_largest", lambda s, d: DROP(connectivity.component_largest(_big(s, d), "strong")), f"{_strong}, sz AS (SELECT vid, count(*) OVER (PARTITION BY root) AS k FROM rt) SELECT vid, k = (SELECT max(k) FROM sz) AS largest FROM sz")
add("connectedness", lambda s, d: rounded(DROP(connectivity.connectedness(_big(s, d))), "connectedness"), f"{_weak} SELECT round(CAST(sum(k * (k - 1)) AS DOUBLE) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS connectedness FROM (SELECT count(*) AS k FROM rt GROUP BY root)")
add("efficiency", lambda s, d: rounded(DROP(connectivity.efficiency(_big(s, d))), "efficiency"), f"{_weak} SELECT round(1 - ((SELECT sum(weight) FROM e) - sum(k - 1)) / CAST(sum(k * (k - 1) - (k - 1)) AS DOUBLE), 6) AS efficiency FROM (SELECT count(*) AS k FROM rt GROUP BY root)")
add("hierarchy_reciprocity", lambda s, d: rounded(DROP(connectivity.hierarchy(_big(s, d))), "hierarchy"), f"{_big_sql}, {_dyads} SELECT round(CAST(a AS DOUBLE) / (m + a + n), 6) AS hierarchy FROM c")
add("hierarchy_krackhardt", lambda s, d: rounded(DROP(connectivity.hierarchy(_big(s, d), "krackhardt")), "hierarchy"), f"WITH {_cwalk}, r(s, v) AS (SELECT vid, vid FROM v UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.v), p AS (SELECT least(s, v) AS i, greatest(s, v) AS j, count(*) AS k FROM r WHERE s <> v GROUP BY 1, 2) SELECT round(CASE WHEN count(*) = 0 THEN 1 ELSE 1 - CAST(sum(CAST(k = 2 AS INT)) AS DOUBLE) / count(*) END, 6) AS hierarchy FROM p")
add("lubness", lambda s, d: rounded(DROP(connectivity.lubness(_big(s, d))), "lubness"), f"""{_weak.replace("r(s, v)", "q(s, v)").replace("SELECT r.s, u.dst FROM r JOIN u ON u.src = r.v", "SELECT q.s, u.dst FROM q JOIN u ON u.src = q.v").replace("FROM r GROUP BY", "FROM q GROUP BY")}, r(s, v) AS (SELECT vid, vid FROM v UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.v),
sz AS (SELECT root, count(*) AS k FROM rt GROUP BY 1 HAVING count(*) > 2), pr AS (SELECT a.vid AS i, b.vid AS j FROM rt a JOIN rt b ON a.root = b.root AND a.vid < b.vid JOIN sz ON sz.root = a.root),
ub AS (SELECT i, j, x.s AS k FROM pr JOIN r x ON x.v = i JOIN r y ON y.v = j AND y.s = x.s),
ok AS (SELECT DISTINCT i, j FROM ub a WHERE NOT EXISTS (SELECT 1 FROM ub b WHERE b.i = a.i AND b.j = a.j AND NOT EXISTS (SELECT 1 FROM r WHERE r.s = b.k AND r.v = a.k)))
SELECT round(CASE WHEN (SELECT count(*) FROM sz) = 0 THEN 1 ELSE 1 - ((SELECT count(*) FROM pr) - (SELECT count(*) FROM ok)) / (SELECT CAST(sum((k - 1) * (k - 2)) AS DOUBLE) / 2 FROM sz) END, 6) AS lubness""")
add("kpath_census", lambda s, d: DROP(connectivity.kpath_census(_big(s, d), 2)["dyad"]), f"{_big_sql} SELECT CAST(1 AS BIGINT) AS size, src, dst, count(*) AS count FROM e GROUP BY 2, 3 UNION ALL SELECT 2, a.src, b.dst, count(*) FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst GROUP BY 2, 3")
add("kcycle_census", lambda s, d: DROP(connectivity.kcycle_census(_big(s, d), 3)["aggregate"]), f"{_big_sql} SELECT * FROM (SELECT CAST(2 AS BIGINT) AS size, count(*) AS count FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src AND a.src < a.dst UNION ALL SELECT 3, count(*) FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst) WHERE count > 0")

# Beyond SQL ---------------------------------------------------------------------------------------

add("loadcent", lambda s, d: rounded(DROP(paths.loadcent(TRADE(s, d))), "load"))
add("evcent", lambda s, d: rounded(DROP(spectral.evcent(TRADE(s, d))), "evcent"))
add("bonpow", lambda s, d: rounded(DROP(spectral.bonpow(TRADE(s, d), exponent=0.0001)), "bonpow"))
add("infocent", lambda s, d: rounded(DROP(spectral.infocent(FLAT(s, d))), "infocent"))
add("prestige_eigenvector", lambda s, d: rounded(DROP(spectral.prestige(TRADE(s, d), "eigenvector")), "prestige"))
add("kcores", lambda s, d: DROP(connectivity.kcores(FLAT(s, d), "indegree")))
add("kcores_peeled", lambda s, d: DROP(connectivity.kcores_peeled(FLAT(s, d))))
add("cutpoints", lambda s, d: DROP(connectivity.cutpoints(_big(s, d))))
add("bicomponent_dist", lambda s, d: DROP(connectivity.bicomponent_dist(_big(s, d), "weak")))
add("clique_census", lambda s, d: DROP(connectivity.clique_census(TRADE(s, d))["aggregate"]))
add("label_propagation", lambda s, d: DROP(connectivity.label_propagation(TRADE(s, d))))
add("maxflow", lambda s, d: connectivity.maxflow(_big(s, d)))
add("redist", lambda s, d: rounded(roles.redist(_big(s, d)), "redist"))

from . import more  # noqa: E402, F401  (registers more queries)
