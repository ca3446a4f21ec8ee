"""Benchmark decontamination: every training passage queries a BM25 index of test items.

Block-max WAND with a fixed threshold, a block of units at a time. A passage's lists are taken
by falling list maximum; the pivot is where the maxima of the lists behind it no longer reach the
threshold, so that only blocks that a list before the pivot touches are candidates. These are
tested shallowly, by list maxima and then by block maxima; postings are read only in blocks that
pass both. Whatever scores what a unit needs is verified by the overlap of five-word shingles with
the item's question and answer. Units are of a question or of an answer, never of both, and what
one needs is at most the score that is left when the overlap is only just reached."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, private, tidy
from .tokens import text_batches

_TERM = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5


def term(word: str) -> str:
    """A word without case and marks."""
    return _TERM.sub("", word).casefold()


def terms(text: str) -> list[str]:
    return [t for t in map(term, text.split()) if t]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence of an item of two or more is its answer; the rest is its question."""
    parts = _SENTENCE.split(text.strip())
    cut = max((i for i in range(1, len(parts)) if terms(" ".join(parts[i:]))), default=0)
    return (terms(" ".join(parts[:cut])), terms(" ".join(parts[cut:]))) if cut else (terms(text), [])


def shingles(words: list[int] | list[str]) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def _entries(starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Positions of the entries of some lists that begin at starts[i] and end at starts[i + 1]."""
    first = starts[lists]
    counts = starts[lists + 1] - first
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)


def parts_of(words: list[int], unit: int) -> list[tuple[list[int], list[bool]]]:
    """Near-equal runs of at most ``unit`` terms, and which of the shingles that begin in each are
    the first of their kind in ``words``. Neighbours share terms, so that every shingle lies whole
    in one run: if a share of all distinct shingles is met, some run meets that share of its own."""
    count = max(1, len(words) - SHINGLE + 1)
    known: set[tuple] = set()
    first = []
    for i in range(count):
        gram = tuple(words[i : i + SHINGLE])
        first.append(gram not in known)
        known.add(gram)
    runs = -(-count // (unit - SHINGLE + 1))
    cuts = [count * i // runs for i in range(runs + 1)]
    return [(words[s : e + SHINGLE - 1], first[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def least_share(words: list[int], first: list[bool], share: dict[int, float], overlap: float) -> float:
    """At most the share of a unit's score that terms of its shingles hold when ``overlap`` of the
    ``first`` ones are met.

    A place is lost if all shingles over it are: a run of lost shingles loses as many places at
    an end, and SHINGLE - 1 fewer inside. Runs are chosen as if they could share places."""
    own = sum(first)
    lost = len(first) - max(1, math.ceil(overlap * own - 1e-9))
    times = Counter(words)
    at = np.array([share[w] / times[w] for w in words])
    if not lost:
        return 1.0
    held = min(sum(share[w] for w in set(words[i : i + SHINGLE])) for i in range(len(first)))  # one shingle at least is met
    sums = np.concatenate([[0.0], np.cumsum(at)])
    ahead, behind = sums[: lost + 1], sums[-1] - sums[::-1][: lost + 1]
    most = [max(ahead[p] + behind[r - p] for p in range(r + 1)) for r in range(lost + 1)]
    for r in range(SHINGLE, lost + 1):
        for run in range(SHINGLE, r + 1):
            n = run - SHINGLE + 1
            most[r] = max(most[r], most[r - run] + (sums[n:] - sums[:-n]).max())
    return max(1.0 - max(most), held)


class Index:
    """Postings of units of questions and answers (at most ``unit`` terms each) with list and block maxima.

    Weights are BM25 contributions over what the unit needs, so that one threshold, 1, serves all
    units. A unit needs ``threshold`` of its own score, or less if a passage that holds just
    ``overlap`` of its shingles may score less. A leak by all shingles of an item meets ``overlap``
    of its question's or answer's; where the answer is no longer than the question, a lower overlap
    of the question alone follows, and the answer has no units."""

    def __init__(self, items: list[tuple[int, str]], *, threshold: float = 0.5, overlap: float = 0.8, unit: int = 64, block: int = 4, k1: float = 1.2, b: float = 0.75):
        self.vocabulary: dict[str, int] = {}
        self.items = []  # (item id, question ids, answer ids)
        units: list[list[int]] = []
        firsts: list[tuple[list[bool], float]] = []  # and the overlap that is to be reached
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        owners: list[int] = []
        for item_id, text in sorted(items):
            q, a = question_and_answer(text)
            q, a = [number(w) for w in q], [number(w) for w in a]
            if not q:
                continue
            n_q, n_a = len(shingles(q)), len(shingles(a))
            for words, reached in [(q, overlap - (1 - overlap) * n_a / n_q)] if n_a <= n_q else [(q, overlap), (a, overlap)]:
                for part, first in parts_of(words, unit):
                    if any(first):
                        units.append(part)
                        firsts.append((first, reached))
                        owners.append(len(self.items))
            self.items.append((item_id, q, a))
        n, v = len(units), len(self.vocabulary)
        df = np.zeros(v)
        for u in units:
            df[list(set(u))] += 1
        # Units that share their commonest terms are neighbours, so that a block's maxima are of few lists.
        order = sorted(range(n), key=lambda i: (sorted(set(units[i]), key=lambda t: (-df[t], t))[:4], i))
        units, firsts, self.owner = [units[i] for i in order], [firsts[i] for i in order], [owners[i] for i in order]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = sum(map(len, units)) / max(n, 1)
        entries = []
        self.needs = np.zeros(n)
        for i, u in enumerate(units):
            w = np.bincount(u, minlength=v)
            at = np.flatnonzero(w)
            s = idf[at] * w[at] * (k1 + 1) / (w[at] + k1 * (1 - b + b * len(u) / mean))
            s /= s.sum()
            first, reached = firsts[i]
            self.needs[i] = min(threshold, least_share(u, first, dict(zip(at.tolist(), s.tolist(), strict=True)), reached))
            entries += zip(at.tolist(), [i] * len(at), (s / self.needs[i]).tolist(), strict=True)
        # Terms are numbered by falling list maximum.
        tops: dict[int, float] = {}
        for t, _, w in entries:
            tops[t] = max(tops.get(t, 0.0), w)
        new = {t: i for i, t in enumerate(sorted(range(v), key=lambda t: (-tops.get(t, 0.0), t)))}
        self.vocabulary = {word: new[t] for word, t in self.vocabulary.items()}
        self.items = [(i, [new[t] for t in q], [new[t] for t in a]) for i, q, a in self.items]
        entries = sorted((new[t], i, w) for t, i, w in entries)
        self.block, self.blocks = block, -(-n // block) if n else 0
        t = np.array([e[0] for e in entries], np.int64)
        self.unit_of = np.array([e[1] for e in entries], np.int64)
        self.weight = np.array([e[2] for e in entries])
        self.lists = np.searchsorted(t, np.arange(v + 1))
        self.list_max = np.zeros(v + 1)  # the last: words that no item has
        np.maximum.at(self.list_max, t, self.weight)
        key = t * max(self.blocks, 1) + self.unit_of // block
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.empty(0, np.int64)
        self.block_max = np.maximum.reduceat(self.weight, first) if len(key) else np.empty(0)
        self.block_of = (key[first] % max(self.blocks, 1)) if len(key) else np.empty(0, np.int64)
        self.block_lists = np.searchsorted(t[first] if len(key) else t, np.arange(v + 1))
        self.runs = np.append(first, len(key)).astype(np.int64)  # where the postings of each list in each block begin
        self.question = [shingles(q) for _, q, _ in self.items]
        self.answer = [shingles(a) for _, _, a in self.items]

    def search(self, query: np.ndarray, threshold: float, seen: dict | None = None) -> list[tuple[int, float]]:
        """(unit, score) of all units at or above the threshold; query: distinct term numbers."""
        _, unit, score = self.search_all(np.zeros(len(query), np.int64), np.sort(query), 1, threshold, seen)
        return list(zip(unit.tolist(), score.tolist(), strict=True))

    def search_all(self, of: np.ndarray, terms: np.ndarray, many: int, threshold: float, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, unit, score) of all units at or above the threshold, for ``many`` queries at once.

        Query ``of[i]`` has the term ``terms[i]``; both ascend, so that a query's lists come by falling maximum.
        seen: counts of blocks and postings of the queries' lists, all and read."""
        least = threshold - 1e-9
        top = self.list_max[terms]
        ends = np.cumsum(np.bincount(of, minlength=many))
        total = np.concatenate([[0.0], np.cumsum(top)])
        before_pivot = total[ends[of]] - total[:-1] >= least  # what a list and all behind it add up to
        at = _entries(self.block_lists, terms)
        size = self.block_lists[terms + 1] - self.block_lists[terms]
        cell = np.repeat(of * self.blocks, size) + self.block_of[at]
        touched = np.zeros(many * self.blocks, bool)
        touched[cell[np.repeat(before_pivot, size)]] = True
        live = touched & (np.bincount(cell, np.repeat(top, size), many * self.blocks) >= least)
        on = live[cell]
        at, cell = at[on], cell[on]
        live &= np.bincount(cell, self.block_max[at], many * self.blocks) >= least
        on = live[cell]
        at, cell = at[on], cell[on]
        if seen is not None:
            for name, n in (("blocks", len(live)), ("live", live.sum()), ("postings", (self.lists[terms + 1] - self.lists[terms]).sum()), ("read", (self.runs[at + 1] - self.runs[at]).sum())):
                seen[name] = seen.get(name, 0) + int(n)
        n = len(self.owner)
        key = np.repeat(cell // max(self.blocks, 1) * n, self.runs[at + 1] - self.runs[at])
        at = _entries(self.runs, at)
        score = np.bincount(key + self.unit_of[at], self.weight[at], many * n)
        found = np.flatnonzero(score >= least)
        return found // max(n, 1), found % max(n, 1), score[found]


class TermNumbers(dict):
    """Term numbers of raw words: -1 no term, the vocabulary's size if no item has it."""

    def __init__(self, vocabulary: dict[str, int], keep: int = 1_500_000):
        super().__init__()
        self.vocabulary, self.keep = vocabulary, keep

    def __missing__(self, word: str) -> int:
        t = term(word)
        value = self.vocabulary.get(t, len(self.vocabulary)) if t else -1
        if len(self) < self.keep:
            self[word] = value
        return value


def leaks_of(texts: list[str], index: Index, numbers: TermNumbers, *, overlap: float, passage: int, stride: int, cells: int = 1 << 22) -> Iterator[tuple[int, int, float, float, float]]:
    """(position of the text, item id, score, question overlap, answer overlap) of each leak in some texts.

    ``cells`` bounds passages times units that are scored at once."""
    words = [np.fromiter(map(numbers.__getitem__, t.split()), np.int64) for t in texts]
    words = [w[w >= 0] for w in words]
    none, count = len(index.vocabulary), len(index.owner)
    if not count:
        return
    flat = np.concatenate([np.empty(0, np.int64), *words])
    total = np.concatenate([[0.0], np.cumsum(index.list_max[flat])])
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    # Any passage - stride words lie whole in one passage.
    starts = [np.arange(0, max(1, n - passage + stride), stride) if n else np.empty(0, np.int64) for n in sizes.tolist()]
    doc = np.repeat(np.arange(len(words)), [len(x) for x in starts])
    start = np.concatenate([np.empty(0, np.int64), *starts]) + first[doc]
    end = np.minimum(start + passage, (first + sizes)[doc])
    able = total[end] - total[start] >= 1 - 1e-6
    doc, start, end = doc[able], start[able], end[able]
    best: dict[tuple[int, int], float] = {}
    where: dict[tuple[int, int], list[int]] = {}
    step = max(1, cells // max(count, passage))
    for i in range(0, len(start), step):
        s, n = start[i : i + step], (end - start)[i : i + step]
        many, ends = len(s), np.cumsum(n)
        term_of = flat[np.arange(ends[-1]) + np.repeat(s - ends + n, n)]
        known = term_of < none
        pairs = np.unique(np.repeat(np.arange(many), n)[known] * none + term_of[known])
        for p, unit, score in zip(*(x.tolist() for x in index.search_all(pairs // none, pairs % none, many, 1.0)), strict=True):
            key = int(doc[i + p]), index.owner[unit]
            best[key] = max(best.get(key, 0.0), score * index.needs[unit])
            where.setdefault(key, []).append(int(s[p] - first[key[0]]))
    for (d, item), score in sorted(best.items()):
        item_id, q, a = index.items[item]
        reach = passage + len(q) + len(a)
        seen: set[tuple] = set()
        for s in where[d, item]:
            near = words[d][max(0, s - reach) : s + passage + reach].tolist()
            for k in {min(SHINGLE, len(q)), min(SHINGLE, len(a) or SHINGLE)}:
                seen.update(zip(*(near[i:] for i in range(k)), strict=False))
        met_q, met_a = len(index.question[item] & seen), len(index.answer[item] & seen)
        in_q = met_q / len(index.question[item])
        in_a = met_a / len(index.answer[item]) if a else 0.0
        if in_q >= overlap or (met_q + met_a) / (len(index.question[item]) + len(index.answer[item])) >= overlap:
            yield d, item_id, score, in_q, in_a


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.8, passage: int = 160, stride: int = 96, shard_chars: int = 4 << 20) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score, question_overlap, answer_overlap, answer_leaked.

    score: the best passage's BM25 over that of a unit of the item's question or answer (1: all
    the unit's terms). Items without a
    term and null texts or item ids match nothing; repeated rows each give their rows; an item
    is leaked if ``overlap`` of its question's, or of all its, shingles lie near the passage.
    The index is broadcast, in shards of about ``shard_chars`` characters of test items (or one
    item that is longer): a benchmark beyond that is searched a shard after the other, and BM25's
    statistics are those of the shard. What is found does not depend on them, only the score does."""
    arrow_rows(docs.sparkSession)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string"))
    items = items.toDF("item", "text")
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for shard in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        part = _search_shard(texts, Index([(r[0], r[1]) for r in own.collect()], threshold=threshold, overlap=overlap), overlap=overlap, passage=passage, stride=stride)
        found = part if found is None else found.unionByName(part)
    return found


def _search_shard(texts: DataFrame, index: Index, *, overlap: float, passage: int, stride: int) -> DataFrame:
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, answer_leaked boolean"
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        numbers = TermNumbers(ix.vocabulary)
        for ids, some in text_batches(batches):
            rows = [(ids[d], *leak) for d, *leak in leaks_of(some, ix, numbers, overlap=overlap, passage=passage, stride=stride)]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.float64()) for x in c[2:]), pa.array([x >= overlap for x in c[4]], pa.bool_())], names=[x.split()[0] for x in schema.split(", ")])

    return texts.mapInArrow(tidy(run), schema)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows that hold no leaked item. Rows are told apart by id and text, so that a clean row
    stays beside a leaked one with its id, and a leaked row with a null id goes too."""
    (key,) = private(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    (gone,) = private(keyed, "leaked_key")
    leaked = find_leaks(keyed, benchmark, id_col=key, text_col=text_col, **kw).select(F.col("doc_id").alias(gone)).distinct()
    return keyed.join(leaked.hint("shuffle_hash"), F.col(key) == F.col(gone), "left_anti").select(*docs.columns)
