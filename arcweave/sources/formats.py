"""Graph file formats: DOT and NOS in, NOS and DL out, by DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import EDGE_SCHEMA, Graph


def read_dot(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A directed ``a -> b -> c`` subset, one graph a file. Returns the graph and labels (graph_id, vid, name), by first sight."""
    text = spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("h"), "value")
    ids = text.select("h", "value", (F.row_number().over(Window.orderBy("h")) - 1).cast("long").alias("graph_id"))  # one row a file
    return parse_dot(ids.select("graph_id", "value"))


def parse_dot(texts: DataFrame) -> tuple[Graph, DataFrame]:
    """texts: graph_id, value."""
    t = F.regexp_replace("value", r"(?s)/\*.*?\*/", " ")
    t = F.regexp_replace(t, r"(?m)//[^\n]*|^\s*#[^\n]*", " ")
    t = F.regexp_replace(t, r"\[[^\]]*\]", " ")
    body = F.regexp_extract(t, r"(?s)\{(.*)\}", 1)
    statements = texts.select("graph_id", F.posexplode(F.split(body, r"[;\n]")).alias("s", "line"))
    name = lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"|"$', ""))
    chain = statements.select("graph_id", "s", F.posexplode(F.split("line", "->")).alias("k", "word")).select("graph_id", "s", "k", name(F.col("word")).alias("name")).where("name <> '' and name not rlike '^(graph|node|edge)$' and name not rlike '='")
    first = chain.groupBy("graph_id", "name").agg(F.min(F.struct("s", "k")).alias("at"))
    labels = first.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("at")) - 1).cast("long").alias("vid"), "name")
    step = chain.select("graph_id", "s", "k", F.col("name").alias("a")).join(chain.select("graph_id", "s", (F.col("k") - 1).alias("k"), F.col("name").alias("b")), ["graph_id", "s", "k"])
    e = step.join(labels.select("graph_id", F.col("vid").alias("src"), F.col("name").alias("a")), ["graph_id", "a"]).join(labels.select("graph_id", F.col("vid").alias("dst"), F.col("name").alias("b")), ["graph_id", "b"])
    e = e.select("graph_id", "src", "dst").distinct().select("*", F.lit(1.0).alias("weight"), F.lit(False).alias("missing"))
    return Graph(labels.select("graph_id", "vid"), e, True, True), labels


def read_nos(spark: SparkSession, path: str) -> Graph:
    return parse_nos(spark, "\n".join(r[0] for r in spark.read.text(path).collect()))  # a NOS file is one header and one dense stack


def parse_nos(spark: SparkSession, text: str) -> Graph:
    """Three header lines (number of graphs; rows and columns; colours), then the numbers of the stack."""
    lines = [x for x in text.splitlines() if x.strip()]
    m = int(lines[0].split()[0])
    rows, cols = (int(x) for x in lines[1].split()[:2])
    numbers = spark.createDataFrame([(" ".join(lines[3:]),)], "t string").select(F.posexplode(F.split(F.trim("t"), r"\s+")).alias("pos", "x"))
    e = numbers.selectExpr(f"pos div {rows * cols} as graph_id", f"pos % {rows * cols} div {cols} as src", f"pos % {cols} as dst", "x")
    value = F.when(F.upper("x").isin("NA", "NAN"), math.nan).otherwise(F.col("x").try_cast("double") if hasattr(F.col("x"), "try_cast") else F.col("x").cast("double"))
    n = max(rows, cols)
    v = spark.range(m).select(F.col("id").alias("graph_id"), F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("vid"))
    return Graph.from_tables(v, e.select("graph_id", "src", "dst", value.alias("weight")).where("weight <> 0 or isnan(weight)"), loops=True)


def _ordered(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    return rows.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(text).alias("_t")))), lambda s: s["_t"]), "\n").alias("text"))


def _number(c: str):
    x = F.col(c)
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def write_nos(g: Graph, *, row_colors: list[int] | None = None, col_colors: list[int] | None = None) -> str:
    """The stack as NOS text."""
    from dataclasses import replace

    n = int(g.orders.agg(F.max("n")).first()[0] or 0)
    m = g.vertices.select("graph_id").distinct().count()
    cells = replace(g, loops=True).grid
    rows = cells.groupBy("graph_id", "src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", F.when(F.col("missing"), "NA").otherwise(_number("weight")).alias("x")))), lambda s: s["x"]), " ").alias("line"))
    body = [r[1] for r in _ordered(rows, ["src"], "line").orderBy("graph_id").collect()]
    colors = " ".join(map(str, (row_colors or [0] * n) + (col_colors or [0] * n)))
    return "\n".join([str(m), f"{n} {n}", colors, *body]) + "\n"


def write_dl(g: Graph, *, vertex_labels: list[str] | None = None, matrix_labels: list[str] | None = None) -> str:
    """The stack as DL edge lists: from 1, column-major, missing and empty cells left out, graphs parted by '!'."""
    n = int(g.orders.agg(F.max("n")).first()[0] or 0)
    ids = [r[0] for r in g.vertices.select("graph_id").distinct().orderBy("graph_id").collect()]
    rows = g.edges.where("not missing and weight <> 0").select("graph_id", F.col("dst").alias("d"), F.col("src").alias("s"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, _number("weight")).alias("line"))
    text = {r[0]: r[1] for r in _ordered(rows, ["d", "s"], "line").collect()}
    head = [f"dl n = {n}, nm = {len(ids)}", "format = edgelist1"]
    if vertex_labels:
        head += ["labels:", ",".join(f'"{x}"' if re_quote(x) else x for x in vertex_labels)]
    if matrix_labels:
        head += ["matrix labels:", ",".join(f'"{x}"' if re_quote(x) else x for x in matrix_labels)]
    return "\n".join([*head, "data:", "\n!\n".join(text.get(i, "") for i in ids)]) + "\n"


def re_quote(label: str) -> bool:
    return not label.replace("_", "").replace(".", "").isalnum()


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], "graph_id long, vid long"), spark.createDataFrame([], EDGE_SCHEMA))
