"""Substring deduplication with repeated-phrase automata.

Recurring passages are confirmed without sending all windows around: of each window of
``span`` words, the least hash of its inner runs of words is an anchor, equal windows have
equal anchors, and only windows whose anchor lies in two documents are hashed, counted and
given an owner (the least id that has them). The owner's text yields the passages: maximal runs
of its confirmed windows, dealt to shards of bounded size. The windows of each shard are compiled
into an Aho-Corasick automaton over words, once for every chunk of the documents that visit it,
and the chunk's documents stream through it. What is removed comes from the automaton's matches alone,
which compare words with the owner's words. Hashes only say which shards a document visits: a
document without a confirmed window's hash holds no passage and visits none."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow_rows, finish, fresh, gram_hashes, look_up, materialize, tidy
from .setjoin import squeeze, unpack
from .tokens import text_batches

#: Stands for a null id: above all others, and never an owner's.
LAST = (1 << 63) - 1


def text_name(words: np.ndarray) -> int:
    """A signed 64-bit name of a word sequence."""
    h = gram_hashes(words, len(words)) if len(words) else np.zeros(1, np.uint64)
    return int(finish(h + np.uint64(len(words))).view(np.int64)[0])


def anchors(words: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` words the least hash of its runs of half as many words."""
    inner = max(1, span // 2)
    g = gram_hashes(words, inner)
    wide = span - inner + 1
    return np.lib.stride_tricks.sliding_window_view(g, wide).min(axis=1) if len(g) >= wide else np.empty(0, np.uint64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _survey(span: int):
    names = ["id", "name", "n_words", "sha", "anchors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for ids, texts in text_batches(batches, 1 << 20):
            words = [t.encode("utf-8", "replace").split() for t in texts]
            hashed = [known.of(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([text_name(h) for h in hashed], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words]), pa.array([np.unique(anchors(h, span)).view(np.int64) for h in hashed], pa.list_(pa.int64()))], names=names)

    return run


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined rows (id, z, name, hits) without those whose text is that of another row with the id."""
    known = WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            same = [text_name(known.of(unpack(z.as_py()).split())) == name.as_py() for z, name in zip(part.column("z"), part.column("name"), strict=True)]
            yield part.filter(pa.array(same, pa.bool_()))


def _windows(span: int):
    """Rows (id, z, name, hits) to the distinct windows that have a hit as anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [], [], []
                for i, z, name, hits in zip(*(part.column(c) for c in ("id", "z", "name", "hits")), strict=True):
                    h = known.of(unpack(z.as_py()).split())
                    w = np.unique(gram_hashes(h, span)[np.isin(anchors(h, span), hits.values.to_numpy().view(np.uint64))]).view(np.int64)
                    out[0].append(w)
                    out[1].append(np.full(len(w), i.as_py()))
                    out[2].append(np.full(len(w), name.as_py()))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["w", "id", "name"])

    return run


def _passages(span: int, shards: int, most: int = 4096):
    """Owners' rows (id, z, name, own: windows and how many have them) to passages (shard, id, z) of at
    most ``most`` windows, and to where each window is (shard, id, w, n)."""
    names = ["shard", "id", "z", "w", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for i, z, own in zip(*(batch.column(c) for c in ("id", "z", "own")), strict=True):
                words = unpack(z.as_py()).split()
                g = gram_hashes(known.of(words), span).view(np.int64)
                asked = own.values
                w, n = (asked.field(c).to_numpy() for c in ("w", "n"))
                order = np.argsort(w)
                window, found = np.unique(g, return_index=True)
                found = np.sort(found[np.isin(window, w)])  # a window that repeats is in a passage once
                cuts = np.flatnonzero(np.diff(found, prepend=-2) > 1)
                cuts = np.concatenate([np.arange(a, b, most) for a, b in zip(cuts, [*cuts[1:], len(found)], strict=True)]) if len(cuts) else cuts
                ends = [*cuts[1:], len(found)]
                texts = [b" ".join(words[found[a] : found[b - 1] + span]) for a, b in zip(cuts, ends, strict=True)]
                shard = np.array([text_name(np.array([i.as_py() & (2**64 - 1), k], np.uint64)) % shards for k in range(len(texts))], np.int64)
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([i.as_py()] * len(texts), pa.int64()), pa.array(texts, pa.binary()), none, none], names=names)
                window = g[found]
                at = np.repeat(shard, np.diff([*cuts, len(found)])) if len(cuts) else shard
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(window), i.as_py())), pa.nulls(len(window), pa.binary()), pa.array(window), pa.array(n[order][np.searchsorted(w[order], window)])], names=names)

    return run


class Automaton:
    """Aho-Corasick over words. Its phrases are the windows of ``span`` words of some passages, each with its
    owner; all are of one length, so that at most one ends at a word of a document.

    A word is two symbols of unlike alphabets: a node looks its children up one by one, and so has few."""

    FEW = 128

    def __init__(self, span: int):
        self.span, self.numbers, self.ready = span, {}, False
        self.inner = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def _symbols(self, ids: list[int]) -> tuple[int, ...]:
        """0, for no word of a passage, begins no phrase."""
        n = np.array(ids, np.int64)
        return tuple(np.stack([np.where(n > 0, n // self.FEW + 1, 0), n % self.FEW + (1 << 24)], 1).ravel().tolist())

    def add(self, owner: int, words: list[bytes]) -> None:
        """A window is to be in one passage only."""
        number = self.numbers
        symbols = self._symbols([number.setdefault(w, len(number) + 1) for w in words])
        put, wide = self.inner.add_word, 2 * self.span
        for i in range(0, len(symbols) - wide + 1, 2):
            put(symbols[i : i + wide], owner)

    def covered(self, doc: int, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Runs of words (first, end) under matches whose owner is below ``doc``."""
        if not self.ready and len(self.inner):
            self.inner.make_automaton()
            self.ready = True
        lo: list[int] = []
        hi: list[int] = []
        if self.ready and len(words) >= self.span:
            get = self.numbers.get
            for at, owner in self.inner.iter(self._symbols([get(w, 0) for w in words])):
                if owner < doc:
                    end = at // 2 + 1
                    start = end - self.span
                    if hi and start <= hi[-1]:
                        hi[-1] = end
                    else:
                        lo.append(start)
                        hi.append(end)
        return lo, hi


def _locate(span: int):
    """Rows sorted by (shard, chunk, kind): a chunk's passages (kind 0) are compiled, then its documents
    stream through, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, automaton = None, None
        for batch in batches:
            out = [], [], [], []
            for shard, chunk, kind, i, name, z in zip(*(batch.column(c) for c in ("shard", "chunk", "kind", "id", "name", "z")), strict=True):
                if (at := (shard.as_py(), chunk.as_py())) != here:
                    here, automaton = at, Automaton(span)
                if not kind.as_py():
                    automaton.add(i.as_py(), z.as_py().split())
                    continue
                lo, hi = automaton.covered(i.as_py(), unpack(z.as_py()).split())
                if lo:
                    for column, x in zip(out, (i.as_py(), name.as_py(), lo, hi), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))], names=["id", "name", "lo", "hi"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, name, z, lo, hi) to what is left of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            gone, left = [], []
            for z, lo, hi in zip(*(part.column(c) for c in ("z", "lo", "hi")), strict=True):
                words = unpack(z.as_py()).split()
                step = np.bincount(lo.values.to_numpy(), minlength=len(words) + 1) - np.bincount(hi.values.to_numpy(), minlength=len(words) + 1)
                mask = np.cumsum(step[:-1]) > 0
                gone.append(int(mask.sum()))
                left.append([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
            texts = [b" ".join(x).decode("utf-8", "replace") for x in left]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("name"), pa.array(gone, pa.int64()), pa.array([_sha(x) for x in left], pa.string()), pa.array(texts, pa.string())], names=["id", "name", "n_removed", "sha", "kept"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 50, with_text: bool = False, shard_windows: int = 8192, chunk_docs: int = 4096) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept, the text, if asked for).

    A word goes if a window of ``span`` consecutive words that covers it also starts in a row
    with a smaller id. Null texts have no words. Null ids come after all others; rows of one
    id do not remove each other's words; equal rows give equal results; an empty table gives an
    empty result. A shard's passages hold about ``shard_windows`` windows (5 KB each in
    its automaton)."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    survey = materialize(rows.mapInArrow(tidy(_survey(span)), "id long, name long, n_words long, sha string, anchors array<long>"))
    # Of equal texts only the one with the least id is searched; the others lose every word.
    long_ones = survey.where(f"n_words >= {span}").select("id", "name", "anchors")
    first = long_ones.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    own = look_up(long_ones, first, "name", "first", "n").where("first is null or id = first").select("id", "name", F.explode("anchors").alias("h"))
    shared = own.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    hits = own.join(fresh(shared, "h"), "h").groupBy("id", "name").agg(F.collect_set("h").alias("hits"))
    packed = squeeze(rows.select("id", "text")).withColumnRenamed("doc_id", "id")
    searched = materialize(packed.join(hits.hint("shuffle_hash"), "id").select("id", "z", "name", "hits").mapInArrow(tidy(_own_text), "id long, z binary, name long, hits array<long>"))
    windows = materialize(searched.mapInArrow(tidy(_windows(span)), "w long, id long, name long"))
    texts = searched.select("id", "name", "z")
    owner = windows.groupBy("w").agg(F.min(F.struct("id", "name")).alias("o"), F.max("id").alias("hi"), F.count("*").alias("n")).where("o.id < hi")
    owner = materialize(owner.select("w", "o.id", "o.name", "n"))
    shards = max(1, -(-owner.count() // shard_windows))
    owned = owner.groupBy("id", "name").agg(F.collect_list(F.struct("w", "n")).alias("own"))
    built = materialize(texts.join(owned.hint("shuffle_hash"), ["id", "name"]).dropDuplicates(["id", "name"]).select("id", "z", "own").mapInArrow(tidy(_passages(span, shards)), "shard long, id long, z binary, w long, n long"))
    place = built.where("w is not null").select("w", F.struct("shard", "id").alias("at"), "n")
    routes = look_up(windows, place, "w", "at", "n").where("at.id < id").select("id", "name", "at.shard").distinct()
    routes = materialize(routes)
    visits = routes.groupBy("shard").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("visits") / chunk_docs).cast("int")
    visiting = look_up(routes, visits.withColumn("visits", F.col("n")), "shard", "visits", "n")
    visiting = visiting.select("id", "name", "shard", F.pmod(F.xxhash64("id", "name"), chunks).cast("int").alias("chunk"))
    streamed = texts.join(visiting.hint("shuffle_hash"), ["id", "name"]).select("shard", "chunk", F.lit(1).alias("kind"), "id", "name", "z")
    passages = built.where("z is not null").join(visits.withColumnRenamed("n", "visits"), "shard")
    passages = passages.select("shard", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("name"), "z")
    dealt = streamed.unionByName(passages).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "kind")
    found = dealt.mapInArrow(tidy(_locate(span)), "id long, name long, lo array<long>, hi array<long>")
    found = found.groupBy("id", "name").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    done = texts.join(found.hint("shuffle_hash"), ["id", "name"]).mapInArrow(tidy(_remove), "id long, name long, n_removed long, sha string, kept string")
    if not with_text:
        done = done.drop("kept")
    done = done.dropDuplicates(["id", "name"]).withColumnsRenamed({"id": "_id", "name": "_name", "sha": "_sha"})
    out = look_up(survey.drop("anchors"), first, "name", "first", "n").join(done, (F.col("id") == F.col("_id")) & (F.col("name") == F.col("_name")), "left")
    copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    columns = [
        F.nullif("id", F.lit(LAST)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:  # null where nothing was removed: the words of the row's own text
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
