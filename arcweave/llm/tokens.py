"""Token counts and token ids of whole texts, memoised by piece.

Texts are split at boundaries that no pre-token, normalisation or special string of the
tokenizer can cross, the distinct pieces of a batch are encoded by the library in batches
balanced by bytes, and only lengths (or ids) come back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidy

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Before a blank between two characters that are not white space.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_bytes(pieces: list[str], batch_bytes: int) -> Iterator[list[str]]:
    """Consecutive runs of pieces of about ``batch_bytes`` each."""
    run, size = [], 0
    for p in pieces:
        run.append(p)
        size += len(p) if p.isascii() else len(p.encode("utf-8", "replace"))
        if size >= batch_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


class Counter:
    """Token counts of texts under a byte-level BPE that keeps a blank with the word after it."""

    def __init__(self, path: str, batch_bytes: int = 1 << 16, keep: int = 1_000_000):
        self.tokenizer, self.batch_bytes, self.keep = load(path), batch_bytes, keep
        self.after: dict[str, int] = {}  # counts of " " + word; such words have no white space at their ends
        self.whole: dict[str, int] = {}  # counts of pieces as they are
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with the blank
        self.starts[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _each(self, pieces: list[str]) -> list[int]:
        encode = self.tokenizer.encode_batch_fast
        return [len(e) for run in by_bytes(pieces, self.batch_bytes) for e in encode(run, add_special_tokens=False)]

    def _after(self, words: list[str]) -> None:
        """Counts of " " + word, many to a string: a token that begins with the blank begins a word."""
        odd = [w for w in words if "<|" in w or not w.isprintable()]
        self.after.update(zip(odd, self._each([" " + w for w in odd]), strict=True))
        plain = list(set(words).difference(odd)) if odd else words
        runs = list(by_bytes(plain, self.batch_bytes))
        for run in runs:
            ids = np.array(self.tokenizer.encode(" " + " ".join(run), add_special_tokens=False).ids, np.int64)
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(run):  # cannot be for these words; then one by one
                self.after.update(zip(run, self._each([" " + w for w in run]), strict=True))
            else:
                self.after.update(zip(run, np.diff(at, append=len(ids)).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        for memo in (self.after, self.whole):
            if len(memo) > self.keep:
                memo.clear()
        split = [t.split(" ") for t in texts]
        wanted: set[str] = set()
        for words in split:
            wanted.update(words)
        self._after([w for w in wanted.difference(self.after) if w and not w[0].isspace() and not w[-1].isspace()])
        out, rest, get = [0] * len(texts), [], self.after.__getitem__
        for i, words in enumerate(split):
            try:  # the first word has no blank before it
                out[i] = sum(map(get, words)) - get(words[0]) if len(words) > 1 else 0
                rest.append((i, [words[0]]))
            except KeyError:  # white space beside a blank
                out[i] = 0
                rest.append((i, _SAFE.split(texts[i])))
        heads = sorted({p for _, pieces in rest for p in pieces}.difference(self.whole))
        self.whole.update(zip(heads, self._each(heads), strict=True))
        for i, pieces in rest:
            out[i] += sum(map(self.whole.__getitem__, pieces))
        return out


#: The pre-token pattern in word_bpe_49k.json.
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Words of printable characters below U+0100, none of them white space.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+").fullmatch


class Encoder:
    """Ids of texts under a BPE that drops white space.

    Arrow cuts the texts at ASCII white space and numbers the distinct words; only these are
    looked up, and only new ones encoded; ids are then gathered by position."""

    def __init__(self, path: str, batch_bytes: int = 1 << 16, keep: int = 350_000):
        self.tokenizer, self.batch_bytes, self.keep = load(path), batch_bytes, keep
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, int] = {}  # numbers of words
        self.parts: dict[str, bytes] = {}  # ids of pre-tokens
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number, into the store
        self.store = np.zeros(0, np.uint32)

    def _each(self, pieces: list[str]) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        return [np.array(e.ids, "<u4").tobytes() for run in by_bytes(pieces, self.batch_bytes) for e in encode(run, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        # Below U+0100 composed form is the text itself and lower case is by character, so
        # pre-tokens can be taken here and shared between words.
        pieces_of, known, new = _PRE.findall, self.parts, set()
        plain = [bool(_PLAIN(w)) and "<|" not in w for w in words]
        odd = [w for w, ok in zip(words, plain, strict=True) if not ok]
        rest = dict(zip(odd, self._each(odd), strict=True))
        cut = [((w,) if w in known else tuple(pieces_of(w))) if ok else () for w, ok in zip(map(str.lower, words), plain, strict=True)]
        for pieces in cut:
            new.update(pieces)
        new = new.difference(known)
        marks = [p for p in new if not p.isalpha()]
        known.update(zip(marks, self._each(marks), strict=True))
        for run in by_bytes([p for p in new if p.isalpha()], self.batch_bytes):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(run) or at[-1] != len(ids):  # cannot be for these; then one by one
                known.update(zip(run, self._each(run), strict=True))
            else:
                flat, start = ids.tobytes(), 0
                for w, end in zip(run, (4 * at).tolist(), strict=True):
                    known[w] = flat[start:end]
                    start = end
        found = [b"".join([known[p] for p in pieces]) if ok else rest[w] for w, pieces, ok in zip(words, cut, plain, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.memo.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.store) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.store = np.concatenate([self.store, np.frombuffer(b"".join(found), "<u4")])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (unsigned 32-bit), and where each text's begin and end."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        get = self.memo.get
        at = [get(w, -1) for w in distinct]
        new = [w for w, i in zip(distinct, at, strict=True) if i < 0]
        full = len(self.memo) >= self.keep  # then new words are for this batch only
        before = len(self.first), len(self.store)
        if new:
            self._add(new)
            at = [get(w) for w in distinct]
        number = np.array(at, np.int64)[words.indices.to_numpy(zero_copy_only=False)]
        size = self.size[number]
        ends = np.cumsum(size)
        flat = self.store[np.repeat(self.first[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if new and full:
            for w in new:
                del self.memo[w]
            self.first, self.size, self.store = self.first[: before[0]], self.size[: before[0]], self.store[: before[1]]
        if len(self.parts) > self.keep:
            self.parts.clear()
        return flat, bounds


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of columns 0 and 1 in runs of about ``most`` characters, over batches; a null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Every row of the input gives one row,
    repeated and null ids too; other columns are not read. Lengths only leave Python."""
    arrow_rows(docs.sparkSession)
    path = path or public_tokenizers.path(BYTE_BPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counter = Counter(path)
        for ids, texts in text_batches(batches):
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
