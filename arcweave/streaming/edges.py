"""Graph measures over an unbounded stream of events: windowed edges, degrees and density.

State is keyed by window and edge or vertex and dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_windows(stream: DataFrame, *, time: str = "ts", src: str = "src", dst: str = "dst", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, src, dst, weight: ties counted by window. Null ends and loops are left out."""
    rows = stream.where(f"{src} is not null and {dst} is not null and {src} <> {dst}").withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.groupBy(w.alias("w"), F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("weight")).select("w.start", "w.end", "src", "dst", "weight")


def degree_windows(stream: DataFrame, *, time: str = "ts", src: str = "src", dst: str = "dst", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, end, vid, indegree, outdegree, degree by window, in one stateful aggregate."""
    rows = stream.where(f"{src} is not null and {dst} is not null and {src} <> {dst}").withWatermark(time, late)
    ends = rows.select(time, F.explode(F.array(F.struct(F.col(src).alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy(F.window(time, window).alias("w"), F.col("x.vid").alias("vid")).agg(F.sum("x.i").alias("indegree"), F.sum("x.o").alias("outdegree"))
    return d.select("w.start", "w.end", "vid", "indegree", "outdegree", (F.col("indegree") + F.col("outdegree")).alias("degree"))


def density_windows(stream: DataFrame, order: int, *, time: str = "ts", src: str = "src", dst: str = "dst", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, end, density: summed ties of a window over the possible ones."""
    rows = stream.where(f"{src} is not null and {dst} is not null and {src} <> {dst}").withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("k")).select("w.start", "w.end", (F.col("k") / F.lit(order * (order - 1))).alias("density"))
