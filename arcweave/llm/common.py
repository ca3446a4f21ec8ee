"""Helpers that the operators share: shared folders, hashing, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd 64-bit multipliers for mixing word hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset a
    local master (tests) gets a temporary folder once; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arcweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of tables that were written here, by DataFrame.
WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, survives lost executors and makes what a task saw fixed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``materialize`` returned, once nothing reads it any more."""
    path = WRITTEN.pop(df, None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside all columns of ``df``, whatever these are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def look_up(rows: DataFrame, table: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """``rows`` with the column ``value`` of ``table`` (one row a ``key``; null where there is none).

    ``weight`` is about how many rows ask for a key. A key with over 1 / shuffle partitions of all weight is
    hot; there are no more of them than partitions, so they are broadcast, and only the rest is shuffled by
    key. Rows of a hot key are dealt by a hash of the whole row instead."""
    spark = rows.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(2, -(-total // shares))
    kind = dict(rows.dtypes)[key]
    mark, found, other, hot_key = private(rows, "hot", "found", "other", "hot_key")
    hot = table.where(F.col(weight) >= least).select(F.col(key).alias(hot_key), F.col(value).alias(mark))
    cold = table.where(F.col(weight) < least).select(F.col(key).alias(other), F.col(value).alias(found))
    asked = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left").drop(hot_key)
    dealt = F.when(F.col(mark).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns).cast(kind))
    joined = asked.withColumn(hot_key, dealt).join(cold, F.col(hot_key) == F.col(other), "left")
    taken = F.coalesce(mark, F.when(F.col(other) == F.col(key), F.col(found)))
    return joined.select(*rows.columns, taken.alias(value))


def arrow_rows(spark: SparkSession, most: int = 1000) -> None:
    """Texts are long: hand no more than ``most`` rows at once to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


#: What a worker keeps from task to task of one kind of work, by name.
KEPT: dict = {}


def kept(name, make):
    if name not in KEPT:
        KEPT.clear()
        KEPT[name] = make()
    return KEPT[name]


def tidy(fn, *, keep: bool = False):
    """An Arrow function that gives its memory back when its task ends: workers are used again.

    With ``keep`` what it has put into KEPT stays for the next task of its kind; any other kind drops it."""

    @functools.wraps(fn)
    def run(batches):
        if not keep:
            KEPT.clear()
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def fresh(df: DataFrame, key: str) -> DataFrame:
    """Hide the partitioning of an aggregate by ``key`` so that a following join deals
    both sides out anew and adaptive execution may split hot keys."""
    kind = dict(df.dtypes)[key]
    plain = F.concat(F.col(key), F.lit("")) if kind == "string" else F.col(key) + F.lit(0).cast(kind)
    return df.withColumn(key, plain)


class WordHash(dict):
    """64-bit hashes of byte words, remembered; starts afresh when ``limit`` is reached."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX[1]
    h = h ^ (h >> np.uint64(29))
    h = h * MIX[2]
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive words, in order (empty if there are fewer).

    A polynomial over the ring of 64-bit integers, from prefix sums."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=prefix[1:])
    return finish((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _POWERS[i] = np.cumprod(column)
    return _POWERS[0], _POWERS[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns ``u``, ``v`` (any equal orderable type; nulls and loops are left out).
    Returns ``node``, ``root`` (the least node of its component) for each node that has
    an edge. Nothing but whether a round was the last reaches the driver."""
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # Done when each node has one edge, to a root that has none: then all edges are stars.
        ends = e.select("u", F.lit(1).alias("up")).union(e.select("v", F.lit(0)).distinct()).groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
        if ends.where("ups > 1 or (ups = 1 and n > 1)").isEmpty():
            break
        both = e.union(e.select("v", "u"))
        least = fresh(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = fresh(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.union(least.select("u", "m")).where("u <> v").distinct())
        release(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    # Roots in two steps, so that no task gets all edges of a large star.
    # (Counts, since the optimizer would fold one distinct into the other.)
    roots = e.groupBy("v", F.pmod(F.xxhash64("u"), F.lit(64)).alias("part")).agg(F.count("*").alias("n")).groupBy("v").agg(F.sum("n").alias("n")).where("n > 0").select("v")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
