"""Exact n-gram Jaccard self-join with set-relation skipping.

Index level. Each document's shingles are ordered by document frequency, rarest first; only
the positions of its prefix can hold the first shingle that it shares with a partner, and of
these only shingles that another document has are posted. Lists are cut by class of set size
and, in the join itself, into blocks by position: a probe skips all blocks from the position on
that leaves too few shingles for the threshold.

Answer level. A set's answers are derived from those of the most similar set before it: what
that one's overlaps bound well enough is not verified, and a group that links join is met once.

The candidate graph's components are found first from narrow rows; then each document's
shingles travel once to its component (or, for a very large component, once to each tile of
a row of blocks), where the join is computed."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WordHash, arrow_rows, connected_components, finish, fresh, gram_hashes, look_up, materialize, private, tidy
from .tokens import text_batches

_SHORT = np.uint64(0x51ED270B2F3A9C4D)
_LOW = np.uint64((1 << 40) - 1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, k)) if len(words) >= k else finish(gram_hashes(words, len(words)) + _SHORT * np.uint64(len(words)))



def _set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(finish(np.array([np.sum(finish(s), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(texts: list[str], k: int, words: WordHash) -> list[np.ndarray]:
    return [shingle_set(words.of(t.encode("utf-8", "replace").lower().split()), k) for t in texts]


def size_bounds(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the classes: partners of a set lie in its class or a neighbouring one."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


def _deal(k: int, buckets: int, batch_docs: int = 4096, batch_shingles: int = 500_000):
    """Source rows to packed rows for the frequency count. A batch's postings are combined before they
    travel. Per batch one header (kind 0): ids, set names and sizes, and the documents of the shingles that
    several of them have. Per bucket of the shingle space, 40 bits of each shingle: with its document's number
    in the batch if it is the only one (kind 1), else once, with its number among the header's and how many
    documents it has (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, sets, held = WordHash(), [], [], 0
        key = (TaskContext.get().partitionId() << 32) - 1

        def flush():
            sizes = np.array([len(s) for s in sets], np.int64)
            name = np.array([_set_id(s) for s in sets], np.int64)
            has = np.array([i is not None for i in ids], np.int64)
            known = np.array([i if i is not None else 0 for i in ids], np.int64)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
            first = np.flatnonzero(np.diff(flat, prepend=flat[:1] - np.uint64(1))) if len(flat) else np.empty(0, np.int64)
            count = np.diff(first, append=len(flat))
            one = count == 1
            several = first[~one]
            many = count[~one].astype(np.uint16)
            shared = doc[np.repeat(~one, count)]
            header = np.array([len(ids), len(many)], np.int64).tobytes() + np.concatenate([known, has, name, sizes]).tobytes() + many.tobytes() + shared.tobytes()
            bucket, kind, blob = [key % buckets], [0], [header]
            for sort, at in ((1, first[one]), (2, several)):
                token = flat[at]
                b = (token >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[order], np.arange(buckets + 1))
                low = np.ascontiguousarray((token & _LOW).view(np.uint8).reshape(-1, 8)[:, :5])
                extra = [doc[at]] if sort == 1 else [np.arange(len(at), dtype=np.uint32), many]
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[i] : cut[i + 1]]
                    bucket.append(i)
                    kind.append(sort)
                    blob.append(b"".join([x[own].tobytes() for x in extra]) + low[own].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([key] * len(kind), pa.int64()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["batch", "bucket", "kind", "blob"])

        for some, texts in text_batches(batches, 1 << 20):
            for i, s in zip(some, _sets(texts, k, words), strict=True):
                ids.append(i)
                sets.append(s)
                held += len(s)
                if len(ids) >= batch_docs or held >= batch_shingles:
                    key += 1
                    yield flush()
                    ids, sets, held = [], [], 0
        if ids:
            key += 1
            yield flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one share of the shingle space; what occurs twice or more goes back to its
    batch: a shingle's document (kind 1) or number among the header's (kind 2), with its frequency. Headers pass."""
    where, extras, weights, tokens = [], [], [], []
    names = ["batch", "kind", "blob"]
    for batch in batches:
        key, bucket, kind, blob = (batch.column(c).to_pylist() for c in ("batch", "bucket", "kind", "blob"))
        head = [i for i, x in enumerate(kind) if x == 0]
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in head], pa.int64()), pa.array([0] * len(head), pa.int32()), pa.array([blob[i] for i in head], pa.binary())], names=names)
        for i, x in enumerate(kind):
            if x:
                wide = 7 if x == 1 else 11
                n = len(blob[i]) // wide
                low = np.zeros((n, 8), np.uint8)
                low[:, :5] = np.frombuffer(blob[i], np.uint8, offset=(wide - 5) * n).reshape(n, 5)
                where.append((key[i], x, n))
                extras.append(np.frombuffer(blob[i], np.uint16 if x == 1 else np.uint32, n).copy())
                weights.append(np.ones(n, np.uint16) if x == 1 else np.frombuffer(blob[i], np.uint16, n, 4 * n).copy())
                tokens.append(low.view(np.int64).ravel() | bucket[i] << 40)
    if not where:
        return
    flat, weight = np.concatenate(tokens), np.concatenate(weights)
    tokens.clear()
    weights.clear()
    order = np.argsort(flat)
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    df = np.empty(len(flat), np.uint32)
    df[order] = np.repeat(np.add.reduceat(weight[order].astype(np.uint32), first), np.diff(first, append=len(flat)))
    del order, first, weight
    at = 0
    for (key, kind, n), extra in zip(where, extras, strict=True):
        keep = df[at : at + n] > 1
        if keep.any():
            packed = extra[keep].tobytes() + flat[at : at + n][keep].tobytes() + df[at : at + n][keep].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([kind], pa.int32()), pa.array([packed], pa.binary())], names=names)
        at += n


def _unpack_counts(header: bytes, parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, has, name, sizes of a batch's documents, and doc, token, frequency of its shared postings."""
    docs, several = np.frombuffer(header, np.int64, 2).tolist()
    known, has, name, sizes = np.frombuffer(header, np.int64, 4 * docs, 16).reshape(4, -1)
    many = np.frombuffer(header, np.uint16, several, 16 + 32 * docs).astype(np.int64)
    shared = np.frombuffer(header, np.uint16, offset=16 + 32 * docs + 2 * several)
    starts = np.cumsum(many) - many
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))]
    for kind, b in parts:
        wide = 14 if kind == 1 else 16
        n, skip = len(b) // wide, wide - 12
        extra = np.frombuffer(b, np.uint16 if kind == 1 else np.uint32, n).astype(np.int64)
        token, df = np.frombuffer(b, np.int64, n, skip * n), np.frombuffer(b, np.uint32, n, (skip + 8) * n)
        if kind == 2:
            times = many[extra]
            ends = np.cumsum(times)
            extra = shared[np.arange(ends[-1]) + np.repeat(starts[extra] - ends + times, times)].astype(np.int64)
            token, df = np.repeat(token, times), np.repeat(df, times)
        out.append((extra, token, df))
    return known, has, name, sizes, *(np.concatenate(x) for x in zip(*out, strict=True))


def _post(percent: int):
    """Batches come together: a row (doc_id, name, n) for each document, and its postings
    (name, list) for those shingles of its prefix that occur elsewhere."""
    bounds = size_bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts = {}, {}
        for batch in batches:
            for key, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("batch", "kind", "blob")), strict=True):
                if kind:
                    parts.setdefault(key, []).append((kind, blob))
                else:
                    heads[key] = blob
        for key in list(heads):
            known, has, name, sizes, doc, token, df = _unpack_counts(heads.pop(key), parts.pop(key, []))
            ids = pa.array(known, mask=has == 0)
            null = pa.nulls(len(name), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(name), pa.array(sizes), null], names=["doc_id", "name", "n", "list"])
            if not len(doc):
                continue
            order = np.lexsort((token, df, doc))
            doc, token = doc[order], token[order]
            shared = np.bincount(doc, minlength=len(name))
            prefix = sizes - -(-percent * sizes // 100) + 1
            take = np.clip(prefix - (sizes - shared), 0, shared)  # shingles that no other set has come first
            rank = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared)
            keep = rank < take[doc]
            doc, token = doc[keep], token[keep].view(np.uint64)
            kind = (np.searchsorted(bounds, sizes, "right") - 1)[doc].astype(np.uint64)
            for add in (0, 1):
                lists = finish(token * MIX[0] + (kind + np.uint64(add)) * MIX[3]).view(np.int64)
                none = pa.nulls(len(lists), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(name[doc]), none, pa.array(lists)], names=["doc_id", "name", "n", "list"])

    return run


class Lists:
    """Index lists of shingles, each cut into blocks by position; a block's entries are by ascending size."""

    def __init__(self, percent: int):
        self.percent, self.lists, self.read, self.skipped = percent, {}, 0, 0

    def add(self, token: int, position: int, member: int, size: int) -> None:
        """Sizes come in ascending order."""
        blocks, positions = self.lists.setdefault(token, ({}, []))
        if position not in blocks:
            blocks[position] = [], []
            insort(positions, position)
        blocks[position][0].append(member)
        blocks[position][1].append(size)

    def probe(self, token: int, position: int, size: int) -> Iterator[list[int]]:
        """Members that may still link with a set of ``size``, no smaller than they, that has the token at
        ``position``. min(size - position, m - j) must reach the overlap that sizes ``size`` and m need: with
        growing j the least m grows, so that all blocks from some position on are skipped unread."""
        if token not in self.lists:
            return
        p = self.percent
        blocks, positions = self.lists[token]
        most = ((size - position) * (100 + p) - p * size) // p
        for at, j in enumerate(positions):
            least = -(-(p * size + j * (100 + p)) // 100)
            if least > min(most, size):
                self.skipped += len(positions) - at
                return
            members, sizes = blocks[j]
            if sizes[-1] < least or sizes[0] > most:
                self.skipped += 1
                continue
            self.read += 1
            yield members[bisect_left(sizes, least) : bisect_right(sizes, most)]


def join_sets(sets: list[np.ndarray], percent: int, seen: dict | None = None, groups: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, as pairs of their positions; sets of one group
    count as linked already.

    A set's answers begin with those of the candidate that shares most prefix shingles with it. Their exact
    overlap bounds the overlap with each set z that this pivot was compared with: it differs from the pivot's
    by at most what one has and the other has not. Only what the bounds leave open is verified.
    seen: counts of blocks read and skipped, and of pairs verified and derived."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, number, df = np.unique(flat, return_inverse=True, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(df), bool)
    leader: dict = {}
    parent = [leader.setdefault(g, i) for i, g in enumerate(groups)] if groups else list(range(len(sets)))
    answers: dict[int, dict[int, tuple[int, int]]] = {}  # of a set: bounds of its overlap with earlier ones
    counts = {"verified": 0, "derived": 0}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = Lists(percent)
    forest = []
    size_of = sizes.tolist()
    for x in order.tolist():
        n = size_of[x]
        own = number[starts[x] : starts[x] + n]
        least = -(-percent * n // 100)
        prefix = own[np.lexsort((own, df[own]))[: n - least + 1]]
        prefix = [(i, t) for i, (t, c) in enumerate(zip(prefix.tolist(), df[prefix].tolist(), strict=True)) if c > 1]
        found: dict[int, int] = {}
        for i, t in prefix:
            for some in lists.probe(t, i, n):
                for y in some:
                    found[y] = found.get(y, 0) + 1
        for i, t in prefix:
            lists.add(t, i, x, n)
        if not found:
            continue
        mark[own] = True
        mine = answers.setdefault(x, {})

        def verify(others: list[int], n=n, mine=mine, x=x) -> None:
            counts["verified"] += len(others)
            for y, both in zip(others, _overlaps(others, mark, number, starts, sizes), strict=True):
                mine[y] = both, both
                settle(y)

        def settle(y: int, n=n, mine=mine, x=x) -> bool:
            """Whether the bounds of y decide; a link joins the groups."""
            need = -(-percent * (n + size_of[y]) // (100 + percent))
            if mine[y][0] >= need and find(x) != find(y):
                forest.append((x, y))
                parent[find(x)] = find(y)
            return mine[y][0] >= need or mine[y][1] < need

        if all(find(y) == find(x) for y in found):
            mark[own] = False
            continue
        pivot = max(found, key=lambda y: (found[y], -y))
        verify([pivot])
        both = mine[pivot][0]
        lost, more = size_of[pivot] - both, n - both
        open_: dict[int, list[int]] = {}
        for y in found:
            if find(y) == find(x):  # its group's answers are x's as well
                continue
            known = answers.get(pivot, {}).get(y) or answers.get(y, {}).get(pivot)
            if known:
                mine[y] = max(0, known[0] - lost), min(known[1] + more, n, size_of[y])
                if settle(y):
                    counts["derived"] += 1
                    continue
                del mine[y]
            open_.setdefault(find(y), []).append(y)
        verify([g[0] for g in open_.values()])
        verify([y for g in open_.values() if find(g[0]) != find(x) for y in g[1:]])
        mark[own] = False
    if seen is not None:
        for name, n in (("read", lists.read), ("skipped", lists.skipped), *counts.items()):
            seen[name] = seen.get(name, 0) + n
    return forest


def _overlaps(others: list[int], mark, number, starts, sizes) -> list[int]:
    """How many shingles each of the sets has in common with the marked one."""
    if not others:
        return []
    at = np.array(others)
    counts = sizes[at]
    ends = np.cumsum(counts)
    flat = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts[at], counts)
    return np.add.reduceat(mark[number[flat]].astype(np.int64), ends - counts).tolist()


def squeeze(docs: DataFrame) -> DataFrame:
    """doc_id, z: texts compressed, for a shuffle; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for ids, texts in text_batches(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([pack.compress(t.encode("utf-8", "replace")) for t in texts], pa.binary())], names=["doc_id", "z"])

    return docs.mapInArrow(tidy(run), "doc_id long, z binary")


def _fetch(k: int):
    """Compressed texts to their sets; only the one that the row asks for is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(words.of(unpack(z).lower().split()), k) for z in part.column("z").to_pylist()]
                ok = [i for i, (s, name) in enumerate(zip(sets, part.column("name").to_pylist(), strict=True)) if _set_id(s) == name]
                part = part.take(pa.array(ok, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("name"), part.column("root"), part.column("size"), pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["name", "root", "size", "s"])

    return run


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _joined(tiles: DataFrame, percent: int, *keys: str) -> DataFrame:
    """Stars (u, v) of linked labels within each tile of rows (keys, name, label, s): v is the least label of
    a group, u any other. Sets of one label are linked already."""

    def link(table: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(table.column("name").to_pylist())}  # a set may be there twice
        names = sorted(at)
        s, label = table.column("s"), table.column("label").to_pylist()
        label = [label[at[x]] for x in names]
        least: dict[int, int] = {}

        def find(x: int) -> int:
            while least.get(x, x) != x:
                x = least[x]
            return x

        for x, y in join_sets([np.frombuffer(s[at[n]].as_py(), np.uint64) for n in names], percent, groups=label):
            low, high = sorted((find(label[x]), find(label[y])))
            least[high] = low
        stars = [(x, find(x)) for x in sorted(least) if find(x) != x]
        return pa.table({"u": pa.array([x for x, _ in stars], pa.int64()), "v": pa.array([y for _, y in stars], pa.int64())})

    return tiles.groupBy(*keys).applyInArrow(link, "u long, v long")


def _links(sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (u, v) whose components are those of all links among sets (name, root, size, s).

    Sets are joined in blocks of about ``tile`` of one candidate component. Where a component has several
    blocks, the groups' first members are joined in blocks again, until they fit one block or no longer get
    fewer. Then all sets outside a component's largest group (few, where the component is one of near copies)
    meet each of its blocks; sets of the largest group do not meet each other again. Tables on the way are
    narrow and mostly small: "rebalance" writes each to as few files as its size asks for."""
    block = lambda n: F.pmod(F.xxhash64("name"), F.ceil(F.col(n) / tile).cast("long")).cast("int")
    found = materialize(_joined(sets.select("root", "name", F.col("name").alias("label"), "s", block("size").alias("b")), percent, "root", "b").hint("rebalance"))
    deep = sets.where(f"size > {tile}")
    labels = deep.select("name", "root", "size", F.col("name").alias("label"))
    if labels.isEmpty():
        return found
    stars, before, last = found, None, False
    while True:
        labels = materialize(labels.join(stars, F.col("label") == F.col("u"), "left").select("name", "root", "size", F.coalesce("v", "label").alias("label")).hint("rebalance"))
        first = labels.where("name = label").select("name", "root")
        first = materialize(first.join(fresh(first.groupBy("root").agg(F.count("*").alias("groups")), "root"), "root").hint("rebalance"))
        most, now = first.agg(F.max("groups"), F.count("*")).first()
        if last or most == 1 or (before is not None and now > before / 2):
            break
        before, last = now, most <= tile  # within one block all first members of a component meet
        again = deep.select("name", "s").join(first.where("groups > 1"), "name").select("root", "name", F.col("name").alias("label"), "s", block("groups").alias("b"))
        stars = materialize(_joined(again, percent, "root", "b").hint("rebalance"))
        found = found.unionByName(stars)
    of = labels.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = of.groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rest = labels.join(fresh(largest, "root"), "root")
    rest = deep.select("name", "s").join(fresh(rest, "name"), "name")
    others = rest.where("label <> largest").select("root", "name", "label", "s", block("others").alias("a"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / tile).cast("int") - 1)).alias("b"))
    every = rest.select("root", "name", "label", "s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("others") / tile).cast("int") - 1)).alias("a"), block("size").alias("b"))
    return found.unionByName(_joined(others.unionByName(every), percent, "root", "a", "b"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, tile: int = 128, bucket_chars: int = 8 << 20) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Rows link when 100 * |A and B| >= percent * |A or B|, both non-empty. component_id: the
    smallest doc_id reachable by links, itself included; rows without words (null text too)
    are alone. Repeated ids keep their rows; a null id gets the smallest id of its group,
    null if there is none. Equal sets have one name, so a copy costs one narrow row."""
    arrow_rows(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Shares of the shingle space, so many that one stays small however large the input is.
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // bucket_chars))
    dealt = rows.mapInArrow(tidy(_deal(k, buckets)), "batch long, bucket int, kind int, blob binary").repartitionById(buckets, F.col("bucket"))
    counted = dealt.mapInArrow(tidy(_count), "batch long, kind int, blob binary").repartition(buckets, "batch")
    # A writing task takes eight shares, one after another, so that there are few small files (on file:// each costs
    # three chmod processes); there are as many tasks as cores at least.
    writers = max(min(buckets, spark.sparkContext.defaultParallelism), -(-buckets // 8))
    posted = materialize(counted.mapInArrow(tidy(_post(percent)), "doc_id long, name long, n long, list long").coalesce(writers))
    members = posted.where("list is null").select("doc_id", "name", "n")
    # Star edges of the index lists: the candidate graph's components hold all links.
    lists = posted.where("list is not null").select("name", "list").distinct()
    heads = fresh(lists.groupBy("list").agg(F.min("name").alias("head")), "list")
    roots = connected_components(lists.join(heads, "list").where("name <> head").select(F.col("name").alias("u"), F.col("head").alias("v")))
    sizes = fresh(roots.groupBy("root").agg(F.count("*").alias("size")), "root")
    named = members.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("many"))
    wanted = roots.join(sizes, "root").join(named, F.col("node") == F.col("name")).select("name", "root", "size", F.col("doc_id").alias("_id"))
    fetched = squeeze(rows).join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("z", "name", "root", "size")
    sets = materialize(fetched.mapInArrow(tidy(_fetch(k)), "name long, root long, size long, s binary").coalesce(writers))
    links = _links(sets, percent, tile)
    groups = connected_components(links)
    least = groups.join(named, F.col("node") == F.col("name"), "left").groupBy("root").agg(F.min("doc_id").alias("low"), F.count("*").alias("many"))
    found = look_up(groups, materialize(least), "root", "low", "many").select("node", "low")
    own = named.join(found, F.col("name") == F.col("node"), "left").selectExpr("name", "coalesce(low, doc_id) as component_id", "many")
    out = look_up(members, materialize(own), "name", "component_id", "many")
    return out.selectExpr("doc_id", "n as n_shingles", "if(n = 0, doc_id, component_id) as component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of the first document of each component, by id (nulls last), then by a hash of the text; all columns.

    Rows are told apart by id and text: of rows with one id and different texts each is a document of its
    own, rows alike in both are one document and stay together. Rows without words stay; an empty table
    stays empty. What goes are keys, one narrow row a document, so a large component is no large task."""
    (key,) = private(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    groups = components(keyed, id_col=key, text_col=text_col, **kw).select(F.col("doc_id").alias("k"), F.col("component_id").alias("g")).distinct()
    ids = keyed.select(F.col(key).alias("own"), F.col(id_col).cast("long").alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "k")
    first = groups.join(ids, F.col("k") == F.col("own")).groupBy("g").agg(F.min(order)["k"].alias("k"))
    (kept,) = private(keyed, "kept_key")
    return keyed.join(first.select(F.col("k").alias(kept)).hint("shuffle_hash"), F.col(key) == F.col(kept), "left_semi").select(*docs.columns)
