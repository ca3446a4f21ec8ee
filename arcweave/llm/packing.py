"""Best-fit packing of tokenized documents by linear grouping.

The plan is made from the histogram of piece lengths alone, whose size is bounded by the
capacity, so nothing that grows with the corpus reaches the driver. Large lengths are
dealt into groups of equal cardinality and rounded up to their group's largest length;
configurations of these few sizes are optimised as a linear program by column generation;
actual pieces take the slots of the configurations; pieces left over and small pieces then
go, longest first, into the sequence with the least room that still holds them."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, materialize, tidy
from .tokens import WORD_BPE, Encoder, text_batches

END = (1).to_bytes(4, "little")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """(counts per size, how often) of a basic optimum of the configuration linear program
    min sum(x), sum(a x) >= demand, by column generation with an exact knapsack."""
    k = len(sizes)
    basis = [tuple(capacity // s if i == j else 0 for j in range(k)) for i, s in enumerate(sizes)]
    need = np.array(demand, float)
    for _ in range(60 * k + 200):
        inverse = np.linalg.inv(np.array(basis, float).T)
        x = inverse @ need
        duals = np.maximum(inverse.T @ np.ones(k), 0)
        best, column = _knapsack(sizes, duals, capacity)
        if best <= 1 + 1e-9:
            break
        step = inverse @ np.array(column, float)
        ratio = [x[i] / step[i] if step[i] > 1e-12 else np.inf for i in range(k)]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = column
    x = np.linalg.inv(np.array(basis, float).T) @ need
    return [(a, float(v)) for a, v in zip(basis, x, strict=True) if v > 1e-9]


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    """Best value of a multiset of sizes within capacity; by number of items."""
    most = capacity // min(sizes)
    best = [np.zeros(capacity + 1)]
    picks: list[np.ndarray] = []
    for _ in range(most):
        now, pick = best[-1].copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            with_i = best[-1][: capacity + 1 - s] + value[i]
            better = with_i > now[s:] + 1e-12
            now[s:][better], pick[s:][better] = with_i[better], i
        best.append(now)
        picks.append(pick)
        if not (pick >= 0).any():
            break
    at, counts = capacity, [0] * len(sizes)
    for pick in reversed(picks):
        if pick[at] >= 0:
            counts[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(best[-1][capacity]), tuple(counts)


def plan(histogram: dict[int, int], capacity: int, *, groups: int = 64, small: float = 1 / 3) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences.

    The piece of rank first + i among those of its length goes to sequence first + i, at
    offset. Each rank of each length is in exactly one run."""
    runs: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(histogram, 0)
    left = {n: c for n, c in histogram.items() if c > 0}
    total = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    classes: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
    if full := left.get(capacity, 0):
        place(capacity, full, 0, 0)
        total = full
    large = sorted((n for n in left if capacity > n > capacity * small and left[n]), reverse=True)
    if large:
        classes, total = _grouped(large, left, place, capacity, groups, total)
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            at = bisect_left(classes, (length, -1, -1))
            if at == len(classes):
                each = capacity // length
                many = max(1, left[length] // each)
                for i in range(min(each, left[length] // many)):
                    place(length, many, total, i * length)
                    used = (i + 1) * length
                insort(classes, (capacity - used, total, many))
                total += many
                continue
            room, first, many = classes.pop(at)
            now = min(many, left[length])
            place(length, now, first, capacity - room)
            if room > length:
                insort(classes, (room - length, first, now))
            if now < many:
                insort(classes, (room, first + now, many - now))
    return runs, total


def _grouped(large, left, place, capacity, groups, total):
    """Linear grouping of the large lengths; returns the sequence classes that are open."""
    n = sum(left[x] for x in large)
    share = -(-n // groups)
    queues: list[list[list[int]]] = [[]]  # per group: [length, count], longest first
    filled = 0
    for length in large:
        count = left[length]
        while count:
            if filled == share:
                queues.append([])
                filled = 0
            now = min(count, share - filled)
            queues[-1].append([length, now])
            filled += now
            count -= now
    sizes = [q[0][0] for q in queues]
    merged: dict[int, list[list[int]]] = {}
    for s, q in zip(sizes, queues, strict=True):  # groups that round to one length are one
        merged.setdefault(s, []).extend(q)
    sizes, queues = list(merged), list(merged.values())
    demand = [sum(c for _, c in q) for q in queues]
    classes: list[tuple[int, int, int]] = []
    for pattern, times in configurations(sizes, demand, capacity):
        have = [sum(c for _, c in q) for q in queues]
        times = min([int(times + 1e-7), *(h // a for h, a in zip(have, pattern, strict=True) if a)])
        if times <= 0:
            continue
        open_ = [(0, total, times)]  # (used, first, many)
        total += times
        for i, a in enumerate(pattern):
            for _ in range(a):
                after = []
                for used, first, many in open_:
                    while many:
                        length, count = queues[i][0]
                        now = min(many, count)
                        place(length, now, first, used)
                        after.append((used + length, first, now))
                        first, many = first + now, many - now
                        queues[i][0][1] -= now
                        if not queues[i][0][1]:
                            queues[i].pop(0)
                open_ = after
        for used, first, many in open_:
            if used < capacity:
                insort(classes, (capacity - used, first, many))
    return classes, total


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 4096, keep_words: int = 600_000, batch_chars: int = 8 << 20) -> DataFrame:
    """Tokenize and cut. Columns doc_id, piece, start, length, ids_crc32, and part, rank: the
    partition and the rank among pieces of equal length in it. Fixed once materialized."""
    arrow_rows(docs.sparkSession)
    path = path or public_tokenizers.path(WORD_BPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = kept(("encoder", path, keep_words), lambda: Encoder(path, keep=keep_words)), TaskContext.get().partitionId(), {}
        for ids, texts in text_batches(batches, batch_chars):
            out = [[] for _ in names]
            flat, bounds = encoder.encode(pa.array(texts, pa.string()))
            whole = flat.astype("<u4").tobytes()
            for doc_id, begin, end in zip(ids, (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True):
                own = whole[begin:end] + END
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[at : at + 4 * capacity]
                    length = len(cut) // 4
                    rank = seen[length] = seen.get(length, -1) + 1
                    for column, value in zip(out, (doc_id, piece, at // 4, length, zlib.crc32(cut), part, rank), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema=schema)

    return rows.mapInArrow(tidy(run, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 4096, **memory: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece holding only the end id; texts longer than the
    capacity are cut, nothing else is; repeated rows are packed each; other columns are
    not read. An empty table gives an empty result. ``memory``: keep_words, batch_chars of a worker."""
    cut = materialize(pieces(docs, id_col=id_col, text_col=text_col, path=path, capacity=capacity, **memory))
    # Per partition and length: how many there are, and how many in the partitions before.
    per = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    per = per.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before")
    cut = cut.join(per, ["part", "length"])
    runs.sort()
    by_rank = {c: np.array(v, np.int64) for c, v in zip(("length", "rank", "count", "sequence", "offset"), zip(*runs, strict=True), strict=True)} if runs else {}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = by_rank["length"] << 48 | by_rank["rank"] if by_rank else None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            rank = column["rank"].to_numpy(zero_copy_only=False) + column["before"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, column["length"].to_numpy(zero_copy_only=False) << 48 | rank, "right") - 1
            column["sequence_id"] = pa.array(by_rank["sequence"][at] + rank - by_rank["rank"][at])
            column["offset"] = pa.array(by_rank["offset"][at])
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names=names)

    return cut.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
