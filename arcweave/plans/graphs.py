"""Graphs derived from the standard tables, as Spark plans and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and line counts from the customer's to the supplier's nation.

    Lines are counted by order and supplier's nation before the larger join; nations and
    suppliers' nations are small dimension tables, left to the optimizer's size check."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    by_order = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "dst").agg(F.count("*").alias("k"))
    e = by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("src", "dst").agg(F.sum("k").alias("weight"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), F.col("n_regionkey").alias("cl")), e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))


TRADE_SQL = """nv AS (SELECT CAST(n_nationkey AS BIGINT) AS vid, n_regionkey AS cl FROM nation),
ne0 AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def nations(spark: SparkSession, sf_dir: str, *, factor: float = 1.0, directed: bool = True) -> Graph:
    """Nation trade without loops: ties above ``factor`` times the mean count."""
    v, e = trade(spark, sf_dir)
    off = e.where("src <> dst")
    mean = off.agg((F.avg("weight") * factor).alias("cut"))
    kept = off.join(F.broadcast(mean), F.col("weight") > F.col("cut")).drop("cut")  # one row
    if not directed:
        kept = kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
        kept = kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph.from_tables(v, kept, directed=directed)


def nations_sql(factor: float = 1.0, directed: bool = True) -> str:
    one = f"ne1 AS (SELECT src, dst, weight FROM ne0 WHERE src <> dst AND weight > (SELECT avg(weight) * {factor} FROM ne0 WHERE src <> dst))"
    if directed:
        return f"{TRADE_SQL}, {one}, e AS (SELECT * FROM ne1), v AS (SELECT * FROM nv)"
    return f"{TRADE_SQL}, {one}, e AS (SELECT DISTINCT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT src, dst FROM ne1 UNION ALL SELECT dst, src FROM ne1)), v AS (SELECT * FROM nv)"


def handoffs(spark: SparkSession, sf_dir: str, *, least: int = 1) -> Graph:
    """Users; arcs count how often one user's event follows another's within an event type and day."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    e = ev.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Graph.from_tables(ev.select(F.col("user_id").alias("vid")).distinct(), e.where(F.col("weight") >= least) if least > 1 else e)


def handoffs_sql(least: int = 1) -> str:
    return f"""v AS (SELECT DISTINCT user_id AS vid FROM events),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2 HAVING count(*) >= {least})"""


TYPES = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS vid FROM (SELECT DISTINCT event_type FROM events))"


def transitions(spark: SparkSession, sf_dir: str, *, loops: bool = False) -> Graph:
    """A stack by day of the week: transitions between event types of consecutive events of a user that day of the week."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    kinds = ev.select("event_type").distinct().withColumn("vid", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))  # one row an event type
    day = (F.dayofweek("ts") - 1).cast("long")
    w = Window.partitionBy("user_id", "graph_id").orderBy("ts", "event_id")
    step = ev.withColumn("graph_id", day).select("graph_id", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null")
    e = step.groupBy("graph_id", "a", "b").agg(F.count("*").cast("double").alias("weight"))
    e = e.join(kinds.select(F.col("event_type").alias("a"), F.col("vid").alias("src")), "a").join(kinds.select(F.col("event_type").alias("b"), F.col("vid").alias("dst")), "b")
    v = ev.select(day.alias("graph_id")).distinct().join(kinds.select("vid"))  # graphs times event types
    return Graph.from_tables(v, e.select("graph_id", "src", "dst", "weight"), loops=loops)


def transitions_sql(loops: bool = False) -> str:
    return f"""kinds AS {TYPES},
v AS (SELECT g.graph_id, k.vid FROM (SELECT DISTINCT CAST(dayofweek(ts) AS BIGINT) AS graph_id FROM events) g, kinds k),
e AS (SELECT graph_id, a.vid AS src, b.vid AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT CAST(dayofweek(ts) AS BIGINT) AS graph_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id, dayofweek(ts) ORDER BY ts, event_id) AS b FROM events) t
  JOIN kinds a ON t.a = a.event_type JOIN kinds b ON t.b = b.event_type WHERE {'TRUE' if loops else 'a.vid <> b.vid'} GROUP BY 1, 2, 3),
grid AS (SELECT x.graph_id, x.vid AS src, y.vid AS dst, coalesce(e.weight, 0) AS weight FROM v x JOIN v y ON x.graph_id = y.graph_id LEFT JOIN e ON e.graph_id = x.graph_id AND e.src = x.vid AND e.dst = y.vid {'' if loops else 'WHERE x.vid <> y.vid'})"""


def informants(spark: SparkSession, sf_dir: str) -> Graph:
    """Market segments as observers of nation trade: a segment reports a tie above its own mean count.

    Orders get their customer before lines join, so that lines travel once, by order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"), "c_mktsegment")
    seg = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().withColumn("graph_id", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long"))  # one row a segment
    bought = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src", "c_mktsegment")
    n = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "dst").join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_mktsegment", "src", "dst").agg(F.count("*").alias("k"))
    n = n.where("src <> dst").join(seg, "c_mktsegment").select("graph_id", "src", "dst", "k")
    e = n.join(n.groupBy("graph_id").agg(F.avg("k").alias("m")), "graph_id").where("k > m").select("graph_id", "src", "dst", F.lit(1.0).alias("weight"))
    v = seg.select("graph_id").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vid")))  # observers times nations
    return Graph.from_tables(v, e)


INFORMANTS_SQL = """seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS graph_id FROM (SELECT DISTINCT c_mktsegment FROM customer)),
n0 AS (SELECT graph_id, CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN seg ON seg.c_mktsegment = c.c_mktsegment WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
e AS (SELECT graph_id, src, dst FROM n0 JOIN (SELECT graph_id, avg(k) AS m FROM n0 GROUP BY 1) USING (graph_id) WHERE k > m),
nv AS (SELECT CAST(n_nationkey AS BIGINT) AS vid FROM nation),
pairs AS (SELECT a.vid AS src, b.vid AS dst FROM nv a, nv b WHERE a.vid <> b.vid),
obs AS (SELECT count(*) AS m FROM seg)"""


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First to last second of each event type on each day: graph_id (0), idx, onset, terminus."""
    ev = table(spark, sf_dir, "events")
    second = F.datediff("ts", F.lit("2020-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    kinds = ev.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)  # one row an event type
    day = F.datediff("ts", F.lit("2020-01-01").cast("date")).cast("long")
    s = ev.groupBy("event_type", day.alias("day")).agg(F.min(second).cast("double").alias("onset"), F.max(second).cast("double").alias("terminus"))
    return s.join(kinds, "event_type").select(F.lit(0).cast("long").alias("graph_id"), (F.col("day") * 1000 + F.col("k")).alias("idx"), "onset", "terminus")


SPELLS_SQL = f"""ev AS (SELECT event_type, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS day, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events),
sp AS (SELECT day * 1000 + vid AS idx, CAST(min(s) AS DOUBLE) AS o, CAST(max(s) AS DOUBLE) AS t FROM ev JOIN {TYPES} k USING (event_type) GROUP BY day, vid)"""
