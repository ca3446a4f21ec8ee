"""Toxicity by weak supervision.

Lexicon voters (words and word beginnings mined from labelled training rows) and pattern
voters fire or abstain on every training row; the given label is one more voter, which abstains
where there is none. A generative model with one hidden class estimates each voter's rates,
the labels' too, by EM over the firing patterns of all training rows, and the voters'
correlations given the class; correlated voters share their weight. A linear classifier is then
trained on the posterior labels of bounded samples of labelled rows and of unlabelled training
rows on which a voter fires, and scores whole texts. Labels, language, source and id are never features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, materialize, tidy
from .tokens import text_batches

_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = bytes(range(65, 91))
#: Voters on a text's form: name and test.
PATTERNS = (
    ("shouting", lambda t: len(t) >= 40 and len(b := t.encode("utf-8", "replace")) - len(b.translate(None, _CAPITALS)) > 0.5 * len(t)),
    ("exclaims", lambda t: t.count("!") > 0.01 * len(t) + 2),
    ("symbols", lambda t: sum(map(t.count, "%$&#*")) > 0.1 * len(t) + 2),
)


class Features(dict):
    """The names of a raw word's features: its letter runs, and their beginnings of 4, 5 and 6 letters."""

    def __init__(self, only: dict[str, int] | None = None, keep: int = 600_000):
        super().__init__()
        self.only, self.keep = only, keep
        starts = {k: {x[:-1]: i for x, i in (only or {}).items() if x.endswith("*") and len(x) == k + 1} for k in (4, 5, 6)}
        self.starts = [(k, v) for k, v in starts.items() if v]

    def __missing__(self, word: str) -> tuple:
        found: list = []
        if self.only is None:
            for run in _LETTERS.findall(word.lower()):
                found.append(run)
                found += [run[:k] + "*" for k in (4, 5, 6) if len(run) >= k]
        else:
            low = word.lower()
            for run in (low,) if low.isalpha() else _LETTERS.findall(low):
                if run in self.only:
                    found.append(self.only[run])
                for k, names in self.starts:
                    if (start := run[:k]) in names and len(start) == k:
                        found.append(names[start])
        value = tuple(dict.fromkeys(found)) if found else ()
        if len(self) < self.keep:
            self[word] = value
        return value

    def of(self, text: str) -> set:
        found: set = set()
        for value in map(self.__getitem__, set(text.split())):
            if value:
                found.update(value)
        return found

    def of_all(self, texts: list[str]) -> list[set]:
        """``of`` for many texts: Arrow numbers the distinct words, and only those with features are
        traced back to texts. Features are of letter runs, so any split at white space serves."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = lists.flatten().dictionary_encode()
        values = [self[w] for w in words.dictionary.to_pylist()]
        number = words.indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.fromiter(map(bool, values), bool, len(values))[number]) if len(number) else np.empty(0, np.int64)
        text = np.searchsorted(lists.offsets.to_numpy() - lists.offsets[0].as_py(), at, "right") - 1
        found: list[set] = [set() for _ in texts]
        for pair in np.unique(text * len(values) + number[at]).tolist() if len(at) else ():
            i, w = divmod(pair, len(values))
            found[i].update(values[w])
        return found


def sample_labels(labels: DataFrame, *, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows of the training folds, by a hash of the id; an id with
    contradicting labels is left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    one = rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high")).where("label = high").drop("high")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _mine(sample: DataFrame, *, least: int, least_share: float) -> tuple[list[str], list[str], tuple[int, int]]:
    """Voter entries and classifier features, from (text, label) rows; the sample's words bound both.

    A voter has odds of over e**2 and fires on ``least_share`` of the toxic rows; a beginning that is a voter
    stands for all longer ones whose odds are not clearly (e times) higher. A feature has odds of over e either way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pos, neg, total = Features(), Counter(), Counter(), [0, 0]
        for labels, texts in text_batches(batches):
            for y, t in zip(labels, texts, strict=True):
                (pos if y else neg).update(seen.of(t))
                total[bool(y)] += 1
        names = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*(pos[x] for x in names), total[1]], pa.int64()), pa.array([*(neg[x] for x in names), total[0]], pa.int64())], names=["name", "pos", "neg"])

    counts = sample.select("label", "text").mapInArrow(tidy(run), "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = materialize(counts.where(f"name is null or pos + neg >= {least}"))
    totals = counts.where("name is null").first()
    pos, neg = (totals["pos"] or 0, totals["neg"] or 0) if totals else (0, 0)
    if not pos or not neg:
        return [], [], (pos, neg)
    odds = f"log((pos + 0.5) / ({pos} - pos + 0.5)) - log((neg + 0.5) / ({neg} - neg + 0.5))"
    ranked = counts.where("name is not null").selectExpr("name", "pos", "neg", f"{odds} as odds")
    votes: dict[str, float] = {}
    able = ranked.where(f"odds > 2 and pos >= {max(least, least_share * pos)}").collect()
    for r in sorted(able, key=lambda r: (len(r["name"].rstrip("*")), not r["name"].endswith("*"), r["name"])):
        starts = [r["name"][:k] + "*" for k in (4, 5, 6) if len(r["name"].rstrip("*")) >= k]
        if all(votes.get(x, -np.inf) < r["odds"] - 1 for x in starts):
            votes[r["name"]] = r["odds"]
    strong = [r[0] for r in ranked.where("abs(odds) > 1").select("name").collect()]
    return sorted(votes), sorted(strong), (pos, neg)


def _firing(only: dict[str, int]):
    """Arrow function: the sorted voters that fire, per row; ``key`` passes through."""
    first = len(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = kept(("features", hash(frozenset(only.items()))), lambda: Features(only))
        for keys, texts in text_batches(batches):
            fired = [sorted(f | {first + i for i, (_, test) in enumerate(PATTERNS) if test(t)}) for t, f in zip(texts, seen.of_all(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fired, pa.list_(pa.int32()))], names=["key", "fired"])

    return run


class LabelModel:
    """One hidden class. Voters fire with rate a given 1 and b given 0; a given label, if there is one, is 1
    with rates ``gold``. Voters have weights for their correlation."""

    def __init__(self, prior: float, a: np.ndarray, b: np.ndarray, gold: tuple[float, float] = (0.95, 0.05)):
        self.prior, self.a, self.b, self.gold, self.weight = prior, a, b, gold, np.ones(len(a))

    def log_odds(self, fired: list[list[int]], given: np.ndarray) -> np.ndarray:
        """given: 1, 0, or -1 where no label is."""
        on = self.weight * (np.log(self.a) - np.log(self.b))
        off = self.weight * (np.log1p(-self.a) - np.log1p(-self.b))
        base = np.log(self.prior / (1 - self.prior)) + off.sum()
        size = np.fromiter(map(len, fired), np.int64, len(fired))
        flat = np.array([j for f in fired for j in f], np.int64)
        votes = np.bincount(np.repeat(np.arange(len(fired)), size), (on - off)[flat], len(fired))
        g1, g0 = self.gold
        return base + votes + np.where(given == 1, np.log(g1 / g0), np.where(given == 0, np.log((1 - g1) / (1 - g0)), 0.0))

    def expect(self, patterns: DataFrame, pairs: bool = False) -> dict[tuple[int, int, int], float]:
        """Posterior-weighted counts by (class, voter, voter): of single voters (i, i), all rows (m, m), given
        labels that are 1 (m + 1, m + 1) or anything (m + 2, m + 2), and of pairs if asked for. Sparse sums."""
        m, model = len(self.a), self
        wide = m + 3

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fired, given = batch.column("fired").to_pylist(), batch.column("key").to_numpy(zero_copy_only=False)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-np.clip(model.log_odds(fired, given), -500, 500)))
                codes, weights = [], []
                for f, y, k, q in zip(fired, given.tolist(), n.tolist(), p.tolist(), strict=True):
                    at = np.array([*f, m, *([m + 2] if y >= 0 else []), *([m + 1] if y == 1 else [])], np.int64)
                    code = (at[:, None] * wide + at).ravel() if pairs else at * (wide + 1)
                    codes += [code, code + wide * wide]
                    weights += [np.full(len(code), k * (1 - q)), np.full(len(code), k * q)]
                if codes:
                    at, of = np.unique(np.concatenate(codes), return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(of, np.concatenate(weights)))], names=["at", "x"])

        found = patterns.mapInArrow(tidy(run), "at long, x double").groupBy("at").agg(F.sum("x")).collect()
        return {(at // (wide * wide), at // wide % wide, at % wide): x for at, x in found}

    def fit(self, patterns: DataFrame, rounds: int) -> LabelModel:
        """EM over (key, fired, n): the given label or -1, the voters that fire, and how many rows."""
        m = len(self.a)
        for _ in range(rounds):
            e = self.expect(patterns)
            n0, n1 = e.get((0, m, m), 0.0), e.get((1, m, m), 0.0)
            self.a = np.clip([(e.get((1, j, j), 0.0) + 0.5) / (n1 + 1) for j in range(m)], 1e-4, 1 - 1e-4)
            self.b = np.clip([(e.get((0, j, j), 0.0) + 0.05) / (n0 + 1) for j in range(m)], 1e-6, 1 - 1e-4)
            self.gold = tuple(float(np.clip((e.get((y, m + 1, m + 1), 0.0) + s) / (e.get((y, m + 2, m + 2), 0.0) + 1), 1e-3, 1 - 1e-3)) for y, s in ((1, 0.95), (0, 0.05)))
            self.prior = float(np.clip((n1 + 0.5) / (n0 + n1 + 1), 1e-4, 0.5))
        e = self.expect(patterns, pairs=True)
        together = np.zeros(m)
        self.correlation: dict[tuple[int, int, int], float] = {}
        for (y, i, j), x in e.items():
            rate, n = (self.a if y else self.b), max(e[y, m, m], 1.0)
            if i != j and i < m and j < m and x >= 5:  # fewer tell nothing
                spread = np.sqrt(rate[i] * (1 - rate[i]) * rate[j] * (1 - rate[j]))
                self.correlation[y, i, j] = float(np.clip((x / n - rate[i] * rate[j]) / max(spread, 1e-9), 0, 1))
        strongest: dict[tuple[int, int], float] = {}
        for (_, i, j), rho in self.correlation.items():
            strongest[i, j] = max(strongest.get((i, j), 0.0), rho)
        for (i, _), rho in sorted(strongest.items()):
            together[i] += rho if rho > 0.3 else 0.0
        self.weight = 1 / (1 + together)
        return self


def _train(rows: list, size: int, *, l2: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, full batch. rows: (features, posterior)."""
    lengths = np.array([len(f) for f, _ in rows])
    flat = np.array([x for f, _ in rows for x in f], int)
    row = np.repeat(np.arange(len(rows)), lengths)
    y = np.array([p for _, p in rows])
    w = np.zeros(size + 1)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[flat], len(rows)) + w[size]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(flat, d[row], size), d.sum())
        g[:size] += l2 * w[:size] / max(1, len(rows)) * 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:size], float(w[size])


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", most_labels: int = 40_000, most_unlabelled: int = 10_000, least: int = 5, least_share: float = 0.02, rounds: int = 4) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 5 is 0), score in [0, 1], predicted.

    ``most_labels`` and ``most_unlabelled`` bound the samples (by a hash of the id) from which the lexicon
    (labelled rows only) and the classifier are fitted; voters' statistics are over all training rows. Null
    texts count as empty, and get the score of a text without features; null ids are not held out; repeated
    rows are scored each, and count each. Without labels of both classes every score is the share of toxic
    labels (0 without labels). An empty table has an empty result."""
    arrow_rows(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    chosen = materialize(sample_labels(labels, id_col=label_id_col, label_col=label_col, most=most_labels).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("long").alias("label")))
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most most_labels narrow rows are broadcast
    voters, names, (pos, neg) = _mine(sample, least=least, least_share=least_share)
    if not pos or not neg:
        share = 1.0 if pos else 0.0
        return texts.select("doc_id", held_out.alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    number = {x: i for i, x in enumerate(voters)}
    m = len(voters) + len(PATTERNS)
    fire = _firing(number)
    trained = texts.where(~held_out).join(F.broadcast(chosen), "doc_id", "left").withColumn("key", F.coalesce("label", F.lit(-1)))
    patterns = materialize(trained.select("key", "text").mapInArrow(tidy(fire, keep=True), "key long, fired array<int>").groupBy("key", "fired").agg(F.count("*").alias("n")))
    first = {(r[0], r[1]): r[2] for r in patterns.where("key >= 0").select("key", F.explode("fired").alias("j"), "n").groupBy("key", "j").agg(F.sum("n")).collect()}
    a = np.clip([(first.get((1, j), 0) + 0.5) / (pos + 1) for j in range(m)], 1e-4, 1 - 1e-4)
    b = np.clip([(first.get((0, j), 0) + 0.05) / (neg + 1) for j in range(m)], 1e-6, 1 - 1e-4)
    model = LabelModel(float(np.clip(pos / (pos + neg), 1e-4, 0.5)), np.array(a), np.array(b)).fit(patterns, rounds)
    column = {x: i for i, x in enumerate(names)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, votes = Features(column), Features(number)
        for given, texts_ in text_batches(batches):
            fired = [sorted(f | {len(number) + i for i, (_, test) in enumerate(PATTERNS) if test(t)}) for t, f in zip(texts_, votes.of_all(texts_), strict=True)]
            p = 1 / (1 + np.exp(-np.clip(model.log_odds(fired, np.array(given)), -30, 30)))
            told = np.array([bool(f) or y >= 0 for f, y in zip(fired, given, strict=True)], bool)  # where all voters abstain there is nothing to learn
            yield pa.RecordBatch.from_arrays([pa.array([sorted(f) for f in seen.of_all(texts_)], pa.list_(pa.int32())), pa.array(p)], names=["features", "p"]).filter(pa.array(told))

    others = texts.where(~held_out & F.col("doc_id").isNotNull()).select("doc_id").join(F.broadcast(chosen), "doc_id", "left_anti").distinct()
    others = materialize(others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_unlabelled))
    taught = texts.join(F.broadcast(chosen.unionByName(others.withColumn("label", F.lit(-1).cast("long")))), "doc_id")
    rows = [(r[0], r[1]) for r in taught.select("label", "text").mapInArrow(tidy(featured), "features array<int>, p double").collect()]  # bounded by the two samples
    rows.sort()
    weights, bias = _train(rows, len(names))
    shared = docs.sparkSession.sparkContext.broadcast((column, weights, bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column_, w, b0 = shared.value
        seen = kept(("features", hash(frozenset(column_.items()))), lambda: Features(column_))
        for ids, texts_ in text_batches(batches):
            z = np.array([b0 + w[sorted(f)].sum() for f in seen.of_all(texts_)], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p)], names=["doc_id", "score"])

    scored = texts.mapInArrow(tidy(apply, keep=True), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
