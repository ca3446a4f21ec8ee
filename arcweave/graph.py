"""The graph model: sparse vertices and edges, several graphs to a stack.

vertices: graph_id, vid, and any covariates. edges: graph_id, src, dst, weight, missing;
an absent row is no tie, a missing row an unknown one. A graph carries its options."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LIMIT = [5000]


def set_max_graph_order(limit: int) -> int:
    """Sets the largest order that kernels which hold a graph in one process accept; returns the previous one."""
    if not isinstance(limit, int) or limit < 1:
        raise ValueError("the limit must be a positive integer")
    was, _LIMIT[0] = _LIMIT[0], limit
    return was


EDGE_SCHEMA = "graph_id long, src long, dst long, weight double, missing boolean"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    loops: bool = False
    threshold: float = 0.0

    # Construction -----------------------------------------------------------------

    @staticmethod
    def from_tables(vertices: DataFrame, edges: DataFrame, *, directed: bool = True, loops: bool = False, threshold: float = 0.0) -> Graph:
        """From any tables with vid, and src, dst [, weight, missing, graph_id]. Loops go unless kept."""
        have = set(edges.columns)
        e = edges.select(
            (F.col("graph_id") if "graph_id" in have else F.lit(0)).cast("long").alias("graph_id"),
            F.col("src").cast("long").alias("src"),
            F.col("dst").cast("long").alias("dst"),
            (F.col("weight") if "weight" in have else F.lit(1.0)).cast("double").alias("weight"),
            (F.col("missing") if "missing" in have else F.lit(False)).alias("missing"),
        )
        e = e.withColumn("missing", F.coalesce("missing", F.lit(False)) | F.coalesce(F.isnan("weight"), F.lit(False)))
        e = e.where(F.col("missing") | (F.col("weight").isNotNull() & (F.abs("weight") < F.lit(math.inf))))
        if not loops:
            e = e.where("src <> dst")
        v = vertices if "graph_id" in vertices.columns else vertices.withColumn("graph_id", F.lit(0).cast("long"))
        return Graph(v, e, directed, loops, threshold)

    @staticmethod
    def from_matrix(spark: SparkSession, matrices, *, directed: bool = True, loops: bool = False, threshold: float = 0.0, symmetrize: str | None = None) -> Graph:
        """From a square nested matrix or a stack of them. NaN is a missing tie; None and infinities are none."""
        stack = [matrices] if _is_matrix(matrices) else list(matrices)
        rows, vs = [], []
        for g, m in enumerate(stack):
            n = len(m)
            if any(len(r) != n for r in m):
                raise ValueError("an adjacency matrix must be square")
            vs += [(g, i) for i in range(n)]
            for i, r in enumerate(m):
                for j, x in enumerate(r):
                    x = 0.0 if x is None else float(x)
                    if x and not math.isinf(x) and (loops or i != j):
                        rows.append((g, i, j, 0.0 if math.isnan(x) else x, math.isnan(x)))
        g = Graph(spark.createDataFrame(vs, "graph_id long, vid long"), spark.createDataFrame(rows, EDGE_SCHEMA), directed, loops, threshold)
        if symmetrize and not directed:
            from .operators.prep import symmetrize as sym

            return replace(g, edges=sym(g, symmetrize, keep_values=True).edges)
        return g

    @staticmethod
    def from_edge_list(edges: DataFrame, *, order: int | None = None, index_base: int = 0, directed: bool = True, loops: bool = False, threshold: float = 0.0, position: str = "pos") -> Graph:
        """From tail, head [, value] rows with an input position: the last of duplicates wins; an
        undirected edge fills both cells, so that the last of either direction wins."""
        e = edges.select((F.col("tail") - index_base).cast("long").alias("src"), (F.col("head") - index_base).cast("long").alias("dst"), (F.col("value") if "value" in edges.columns else F.lit(1.0)).cast("double").alias("weight"), F.col(position).alias("pos"))
        if e.where("src < 0 or dst < 0 or src is null or dst is null").limit(1).count():
            raise ValueError("vertices must be non-negative integers")
        pair = ["src", "dst"] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
        e = e.withColumn("r", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("pos")))).where("r = 1")
        if not directed:
            e = e.select("src", "dst", "weight").unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        n = order if order is not None else ((e.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1)
        return Graph.from_tables(edges.sparkSession.range(n).withColumnRenamed("id", "vid"), e, directed=directed, loops=loops, threshold=threshold)

    # Views ------------------------------------------------------------------------

    @property
    def tie_mask(self) -> Column:
        return ~F.col("missing") & (F.abs("weight") > self.threshold)

    @property
    def ties(self) -> DataFrame:
        """graph_id, src, dst, weight of the ties: known, and larger in size than the threshold."""
        return self.edges.where(self.tie_mask).select("graph_id", "src", "dst", "weight")

    @property
    def known(self) -> DataFrame:
        return self.edges.where(~F.col("missing"))

    @property
    def orders(self) -> DataFrame:
        """graph_id, n: one row a graph."""
        return self.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))

    @property
    def pairs(self) -> DataFrame:
        """All ordered pairs of vertices: only for outputs that are that large themselves."""
        v = self.vertices.select("graph_id", F.col("vid").alias("src"))
        w = self.vertices.select("graph_id", F.col("vid").alias("dst"))
        p = v.join(w, "graph_id")
        return p if self.loops else p.where("src <> dst")

    @property
    def grid(self) -> DataFrame:
        """All ordered pairs with value and missing (0 and false where there is no row)."""
        return self.pairs.join(self.edges, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("missing", F.lit(False)).alias("missing"))

    def stackcount(self) -> DataFrame:
        return self.vertices.agg(F.countDistinct("graph_id").alias("graphs"))

    def neighbors(self, v: int) -> DataFrame:
        return self.ties.where(F.col("src") == v).select("graph_id", "dst").orderBy("graph_id", "dst")

    def has_tie(self, i: int, j: int) -> bool:
        return bool(self.ties.where((F.col("src") == i) & (F.col("dst") == j)).limit(1).count())

    def tie_weight(self, i: int, j: int) -> float:
        r = self.edges.where((F.col("src") == i) & (F.col("dst") == j)).select("weight").first()
        return float(r[0]) if r else 0.0

    def is_missing_tie(self, i: int, j: int) -> bool:
        return bool(self.edges.where((F.col("src") == i) & (F.col("dst") == j) & F.col("missing")).limit(1).count())

    # One process ------------------------------------------------------------------

    def local(self, graph_id: int | None = None) -> Local:
        """The graph as arrays in the driver, for kernels and small results; refused above the limit."""
        v = self.vertices if graph_id is None else self.vertices.where(F.col("graph_id") == graph_id)
        e = self.edges if graph_id is None else self.edges.where(F.col("graph_id") == graph_id)
        vid = [r[0] for r in v.select("vid").orderBy("vid").limit(_LIMIT[0] + 1).collect()]
        _within_limit(len(vid))
        return Local.of(vid, e.select("src", "dst", "weight", "missing").toPandas(), self)

    def locals(self) -> list[Local]:
        """The graphs of the stack by id, each as by ``local``; however many they are, the edges are derived once."""
        for _, n in self.orders.collect():
            _within_limit(n)
        vid: dict[int, list] = {}
        for i, v in self.vertices.select("graph_id", "vid").orderBy("graph_id", "vid").collect():
            vid.setdefault(i, []).append(v)
        e = self.edges.select("graph_id", "src", "dst", "weight", "missing").toPandas()
        own = dict(iter(e.groupby("graph_id")))
        return [Local.of(vs, own.get(i, e.iloc[:0]), self) for i, vs in vid.items()]

    def to_matrix(self, weighted: bool = False) -> list[list[float]]:
        m = self.local()
        return (m.w if weighted else m.a.astype(float)).tolist()


def _within_limit(n: int) -> None:
    if n > _LIMIT[0]:
        raise ValueError(f"order over the limit of {_LIMIT[0]}; see set_max_graph_order")


def _is_matrix(m) -> bool:
    return not len(m) or not len(m[0]) or not hasattr(m[0][0], "__len__")


@dataclass
class Local:
    """Dense arrays of one graph: w values (0 where no tie), a ties, na missing."""

    vid: np.ndarray
    w: np.ndarray
    a: np.ndarray
    na: np.ndarray
    directed: bool = True
    loops: bool = False

    @staticmethod
    def of(vid: list[int], edges: pd.DataFrame, like: Graph) -> Local:
        n = len(vid)
        at = {x: i for i, x in enumerate(vid)}
        w, na = np.zeros((n, n)), np.zeros((n, n), bool)
        i, j = edges["src"].map(at).to_numpy(int), edges["dst"].map(at).to_numpy(int)
        w[i, j] = np.where(edges["missing"], 0.0, edges["weight"])
        na[i, j] = edges["missing"]
        return Local(np.array(vid), w, (np.abs(w) > like.threshold) & ~na, na, like.directed, like.loops)

    @staticmethod
    def from_array(m, *, directed: bool = True, loops: bool = False, threshold: float = 0.0) -> Local:
        m = np.array([[0.0 if x is None else float(x) for x in r] for r in m], float).reshape(len(m), -1)
        if m.shape != (len(m), len(m)):
            raise ValueError("an adjacency matrix must be square")
        na = np.isnan(m)
        w = np.where(np.isfinite(m), m, 0.0)
        if not loops:
            np.fill_diagonal(w, 0)
            np.fill_diagonal(na, False)
        return Local(np.arange(len(m)), w, (np.abs(w) > threshold) & ~na, na, directed, loops)

    @property
    def n(self) -> int:
        return len(self.vid)

    def values(self) -> np.ndarray:
        """w with NaN where missing."""
        return np.where(self.na, np.nan, self.w)


def number_matrix(rows: int, cols: int, fill: float = 0.0) -> np.ndarray:
    return np.full((rows, cols), float(fill))


def nested_matrix(values, rows: int, cols: int) -> list[list[float]]:
    """A flat row-major vector as nested rows; its length must fit."""
    v = np.asarray(values, float)
    if v.size != rows * cols:
        raise ValueError(f"{v.size} values do not fill {rows} x {cols}")
    return v.reshape(rows, cols).tolist()


def is_graph(x) -> bool:
    return isinstance(x, Graph)


def is_edge_list_input(x) -> bool:
    return isinstance(x, DataFrame) and {"tail", "head"} <= set(x.columns)
