"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are integers, floor(scale * x). A tile pairs a share of the documents with a share of
the queries. In a tile, documents are ordered by a tree of splits so that neighbours point the
same way, and cut into ranges of ``wide`` documents, these into blocks of ``block``. A bound for
a query is the sum over terms of its weight times the range's term maximum (minimum for negative
weights). Ranges, then blocks, are kept by their bounds alone; a query takes the blocks that are
left in order of bound, in waves, scores them through their forward index, and ends when the
next bound falls below its k-th score. What a first pass over one share of the documents finds
is every other tile's first threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

NONE = np.iinfo(np.int64).min


def near_order(docs: np.ndarray, leaf: int) -> np.ndarray:
    """Positions of the documents so that runs of ``leaf`` point the same way: halves, again and
    again, by the projection on the difference of two far documents; the last by nearest pairs."""
    out: list[np.ndarray] = []
    stack = [np.arange(len(docs))]
    while stack:
        at = stack.pop()
        if len(at) <= max(leaf, 2):
            out.append(at)
            continue
        x = docs[at]
        if len(at) <= 256:  # small enough for all products: chains of nearest documents
            near = (x @ x.T).astype(np.float64)
            np.fill_diagonal(near, -np.inf)
            chain, left = [], np.ones(len(at), bool)
            while left.any():
                i = int(np.flatnonzero(left)[np.argmax(near[left][:, left].max(1))]) if left.sum() > 1 else int(np.flatnonzero(left)[0])
                run, left[i] = [i], False
                total = near[i].copy()
                while len(run) < leaf and left.any():
                    j = int(np.argmax(np.where(left, total, -np.inf)))
                    run.append(j)
                    left[j] = False
                    total = total + near[j]
                chain += run
            out.append(at[chain])
            continue
        far = int(np.argmin(x @ x[0]))
        other = int(np.argmin(x @ x[far]))
        side = x @ (x[far] - x[other])
        order = np.argsort(side, kind="stable")
        half = -(-len(at) // (2 * leaf)) * leaf
        stack += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _bounds(queries: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    starts = np.arange(0, len(docs), size)
    return np.maximum(queries, 0) @ np.maximum.reduceat(docs, starts, axis=0).T + np.minimum(queries, 0) @ np.minimum.reduceat(docs, starts, axis=0).T


def tile_topk(doc_ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, *, floor: np.ndarray | None = None, block: int = 2, wide: int = 64, at_once: int = 128, wave: int = 256, seen: dict | None = None) -> list[np.ndarray]:
    """(query id, document id, score) of each query's best k, as arrays; exact integers.

    floor: scores below it cannot be among a query's k (NONE: not known); they may be left out.
    seen: counts of (query, block) pairs, all and scored."""
    limit = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, docs.shape[1])
    kind = np.float64 if limit < 2**52 else np.int64
    order = near_order(docs.astype(np.float64 if limit < 2**52 else np.int64), block)
    doc_ids, docs, queries = doc_ids[order], docs[order].astype(kind), queries.astype(kind)
    floor = np.full(len(queries), NONE) if floor is None else floor
    count = -(-len(docs) // block)
    out: list[tuple] = []
    for at in range(0, len(queries), at_once):
        q, own = queries[at : at + at_once], query_ids[at : at + at_once]
        bound = _bounds(q, docs, block)
        ranges = np.repeat(_bounds(q, docs, wide), wide // block, axis=1)[:, :count]
        for i in range(len(q)):
            best, who, least = np.empty(0, np.int64), np.empty(0, np.int64), int(floor[at + i])
            live = np.flatnonzero((ranges[i] >= least) & (bound[i] >= least))
            live = live[np.argsort(-bound[i, live], kind="stable")]
            step = wave
            while len(live):
                now, live = live[:step], live[step:]
                rows = (now[:, None] * block + np.arange(block)).ravel()
                rows = rows[rows < len(docs)]
                rows = rows[doc_ids[rows] != own[i]]
                score = (docs[rows] @ q[i]).astype(np.int64)
                ids = doc_ids[rows]
                if seen is not None:
                    seen["scored"] = seen.get("scored", 0) + len(now)
                good = score >= least
                best, who = np.concatenate([best, score[good]]), np.concatenate([who, ids[good]])
                if len(best) > k:
                    keep = np.lexsort((who, -best))[:k]
                    best, who = best[keep], who[keep]
                if len(best) >= k:
                    least = max(least, int(best.min()))
                live = live[bound[i, live] >= least]  # in order of bound: what follows is below the k-th
                step *= 2
            if seen is not None:
                seen["all"] = seen.get("all", 0) + count
            out.append((np.full(len(best), own[i]), who, best))
    return [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0, docs_per_tile: int = 16384, queries_per_tile: int = 4096, least_tiles: int = 32) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score.

    Queries: rows whose id is divisible by ``every``; candidates: all rows with another id;
    ties go to the smaller id. Rows with a null id, a null vector, or null or non-finite
    components take no part; shorter vectors count as ended by zeros; a repeated id is a
    candidate once for each row, and a query once, with the least of its vectors (by components
    in order). An empty table has an empty result."""
    number = lambda x: x.cast("double")
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(number(x) * scale).cast("long")).alias("v"))
    n = rows.count()
    shares = max(1, -(-n // docs_per_tile))
    groups = max(1, -(-n // (every * queries_per_tile)), min(-(-least_tiles // shares), -(-n // (every * 32))))
    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    docs = rows.select("id", "v", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("q"), share.alias("d"), each(groups).alias("g"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.lit(NONE).alias("floor"), F.lit(True).alias("q"), group.alias("g"))

    def tile(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        wide = int(sizes.max(initial=0))
        flat = np.zeros((len(sizes), wide), np.int64)
        flat[np.arange(wide) < sizes[:, None]] = v.flatten().to_numpy()
        ids = table.column("id").to_numpy()
        q = table.column("q").to_numpy().astype(bool)
        out = [np.empty(0, np.int64)] * 3
        if q.any() and (~q).any():
            floor = table.column("floor").filter(pa.array(q)).to_numpy().astype(np.int64)
            out = tile_topk(ids[~q], flat[~q], ids[q], flat[q], k, floor=floor)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    def tiles(of: DataFrame, queries: DataFrame) -> DataFrame:
        return of.unionByName(queries).groupBy("d", "g").applyInArrow(tile, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    everywhere = lambda of: of.withColumn("d", each(shares))
    if shares == 1:
        return ranked(tiles(docs, everywhere(asked))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    # The first share is searched first; its k-th score is the threshold that the others start from.
    first = materialize(ranked(tiles(docs.where("d = 0"), asked.withColumn("d", F.lit(0)))).drop("rank"))
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(f"n >= {k}")
    seeded = asked.join(known, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("low", "floor")).select("id", "v", "floor", "q", "g")
    rest = tiles(docs.where("d > 0"), everywhere(seeded).where("d > 0"))
    return ranked(first.unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
