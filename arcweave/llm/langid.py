"""Language identification by Bayesian evidence fusion.

Log-likelihoods of hashed byte trigrams (naive Bayes, from grouped counts over all rows with
a declared language), the declared language itself, the address suffix, and a host prior
smoothed towards its parent domain and that towards the whole corpus are added up."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, private, tidy
from .tokens import text_batches

BUCKETS = 1 << 15
#: Languages whose counts a task holds at once.
MOST_HELD = 64
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts that hold a letter, one after another,
    and where each text's begin. Digits and ASCII marks count as blanks, runs of them as one."""
    data = [_MARKS.sub(b" ", t.lower().encode("utf-8", "replace")) for t in texts]
    joined = np.frombuffer(b"".join(b" " + d + b"  " for d in data), np.uint8).astype(np.uint32)
    code = (joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77) + joined[2:] * np.uint32(0xC2B2AE3D)) if len(joined) > 2 else np.empty(0, np.uint32)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    sizes = np.array([len(d) + 3 for d in data])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(data) else np.empty(0, int)
    return code.astype(np.int64), starts.astype(np.int64)


_MARKS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def declared_language(html: str):
    """Column: the two-letter language in the markup's html tag, or null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2})", 1), F.lit("")))


def host(url: str):
    """Column: lower-case host of an address, or null."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def address_suffix(url: str):
    """Column: a language part of the path (/fr/ ...) if there is one, else the last label of the host."""
    path = F.nullif(F.regexp_extract(url, r"^[^?#]*?//[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    return F.lower(F.coalesce(path, F.nullif(F.regexp_extract(host(url), r"\.([a-z]{2,})$", 1), F.lit(""))))


def page_text(html: str):
    """Column: a page's text, with a blank for each tag, comment, script and style."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def evidence(rows: DataFrame, *, id_col: str, text_col: str, declared: F.Column | None = None, suffix: F.Column | None = None, host_col: F.Column | None = None) -> DataFrame:
    """Only the columns that are used: id, text, declared, suffix, host (nulls where absent)."""
    none = F.lit(None).cast("string")
    low = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")) if c is not None else none
    return rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), low(declared).alias("declared"), low(suffix).alias("suffix"), low(host_col).alias("host"))


class Model:
    """What is broadcast: languages x buckets log-likelihoods (256 KB a language) and small tables. Its
    size depends on the number of languages and suffixes, never on the number of rows."""

    def __init__(self, languages, text, prior, declared, suffix, alpha):
        self.languages, self.text, self.prior, self.declared, self.suffix, self.alpha = languages, text, prior, declared, suffix, alpha

    def of_suffix(self, suffix: str) -> np.ndarray:
        at, counts = self.suffix[suffix]
        v = np.full(len(self.languages), self.alpha)
        v[at] += counts
        return np.log(v / v.sum()) - self.prior


def smoothed(counts: np.ndarray, rows: np.ndarray, alpha: float, few: float) -> np.ndarray:
    """Log-likelihoods of buckets by language, from counts (languages x buckets) and rows by language.

    A bucket that no text has weighs the same in all languages. What a language lacks in rows the
    whole corpus stands in for, by (few / (few + rows)) ** 2: much with one row, so that a wrong
    mark draws no others to it, and next to nothing with hundreds."""
    size = counts.sum(1, keepdims=True)
    floor = alpha * np.maximum(size, 1) / max(size.max(), 1)
    own = (counts + floor) / (size + floor * counts.shape[1])
    whole = (counts.sum(0) + alpha) / (size.sum() + alpha * counts.shape[1])
    lack = ((few / (few + rows)) ** 2)[:, None]
    return np.log((1 - lack) * own + lack * whole)


def fit(ev: DataFrame, *, alpha: float = 0.5, few: float = 5.0, declared_trust: float = 0.9) -> Model | None:
    """Grouped counts over all rows: trigrams by declared language, and suffixes by declared language.

    Every language that a row declares is modelled; those of few rows are smoothed towards the corpus."""
    by_language = {r[0]: r[1] for r in ev.where("declared is not null").groupBy("declared").count().collect()}
    if not by_language:
        return None
    languages = sorted(by_language)
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [(k, np.flatnonzero(x), x) for k, x in sorted(held.items())]
            at = np.concatenate([k * BUCKETS + i for k, i, _ in found]) if found else np.empty(0, np.int64)
            n = np.concatenate([x[i] for _, i, x in found]) if found else np.empty(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

        for lang, texts in text_batches(batches, 1 << 20):
            code, starts = grams(texts)
            sizes = np.diff(np.append(starts, len(code) + 2))
            of = np.array([index[x] for x in lang])
            which = np.repeat(of, sizes)[: len(code)]
            for k in np.unique(of).tolist():
                if k not in held and len(held) >= MOST_HELD:
                    yield out()
                n = np.bincount(code[which == k], minlength=BUCKETS)
                held[k] = held[k] + n if k in held else n
        yield out()

    sums = ev.where("declared is not null").select("declared", "text").mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = np.zeros(len(languages) * BUCKETS)
    found = sums.toPandas()  # at most languages x BUCKETS rows
    table[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    rows = np.array([by_language[x] for x in languages], float)
    text = smoothed(table.reshape(len(languages), BUCKETS), rows, alpha, few)
    prior = np.log((rows + alpha) / (rows + alpha).sum())
    known = len(languages)
    declared = np.log(np.where(np.eye(known, dtype=bool), declared_trust, (1 - declared_trust) / max(1, known - 1)))
    pairs: dict[str, list[tuple[int, int]]] = {}
    for r in ev.where("suffix is not null and declared is not null").groupBy("suffix", "declared").count().collect():
        pairs.setdefault(r[0], []).append((index[r[1]], r[2]))
    suffix = {k: (np.array([j for j, _ in v]), np.array([n for _, n in v], float)) for k, v in pairs.items()}
    return Model(languages, text, prior, declared, suffix, alpha)


def host_priors(ev: DataFrame, languages: list[str], *, strength: float = 20.0) -> DataFrame:
    """host, prior (map language -> probability): counts by host, smoothed towards the parent
    domain's, which are smoothed towards the corpus's. All by grouped aggregation."""
    named = ev.where(F.col("host").isNotNull() & F.col("declared").isin(languages))
    counts = named.groupBy("host", "declared").agg(F.count("*").alias("n"))
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host"))
    counts = counts.withColumn("parent", parent)
    by_parent = counts.groupBy("parent", "declared").agg(F.sum("n").alias("n"))
    whole = by_parent.groupBy("declared").agg(F.sum("n").alias("n"))
    total = whole.agg(F.sum("n").alias("total"))
    top = F.broadcast(whole.crossJoin(F.broadcast(total)).selectExpr("declared", "n / total as p0"))  # one row a language
    parents = by_parent.groupBy("parent").agg(F.sum("n").alias("size"))
    grid = parents.join(top)  # a row a parent and language
    level1 = grid.join(by_parent, ["parent", "declared"], "left").selectExpr("parent", "declared", f"(coalesce(n, 0) + {strength} * p0) / (size + {strength}) as p1")
    hosts = counts.groupBy("host", "parent").agg(F.sum("n").alias("size"))
    level2 = hosts.join(level1, "parent").join(counts.select("host", "declared", "n"), ["host", "declared"], "left")
    level2 = level2.selectExpr("host", "declared", f"(coalesce(n, 0) + {strength} * p1) / (size + {strength}) as p")
    return level2.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("declared", "p"))).alias("prior"))


def identify(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: F.Column | None = None, suffix: F.Column | None = None, host_col: F.Column | None = None, least: float = 0.5, text_weight: float = 0.05) -> DataFrame:
    """Per row: id, lang (``und`` if nothing tells), confidence (posterior), accepted.

    Rows without a letter and without other evidence are ``und`` and not accepted; the text's
    log-likelihood is tempered by ``text_weight``, as neighbouring trigrams are not independent.
    accepted: confidence >= least and the text holds a letter. Null text counts as empty;
    null declared, suffix or host adds no evidence; ids may repeat or be null."""
    arrow_rows(rows.sparkSession)
    ev = evidence(rows, id_col=id_col, text_col=text_col, declared=declared, suffix=suffix, host_col=host_col)
    kind = dict(ev.dtypes)["id"]
    schema = f"id {kind}, lang string, confidence double, accepted boolean"
    model = fit(ev)
    if model is None:
        return ev.selectExpr("id", f"'{UNKNOWN}' as lang", "cast(0 as double) as confidence", "false as accepted")
    shared = ev.sparkSession.sparkContext.broadcast(model)
    if host_col is not None:
        priors = host_priors(ev, model.languages)
        # Few wide rows a host on one side and a hot host on the other: dealt anew, so that it can be split.
        priors = priors.withColumn("host", F.concat("host", F.lit("")))
        priors = priors.select("host", F.array(*[F.coalesce(F.element_at("prior", x), F.lit(0.0)) for x in model.languages]).alias("prior"))
        scored = _text_scores(ev, shared).join(priors, "host", "left")
    else:
        scored = _text_scores(ev, shared).withColumn("prior", F.lit(None).cast("array<double>"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = {x: i for i, x in enumerate(m.languages)}
        of_suffix = functools.lru_cache(4096)(m.of_suffix)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            score = np.array(batch.column("score").to_pylist(), float).reshape(n, -1) * text_weight
            letters = np.array(batch.column("letters").to_pylist())
            for i, (d, s, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("declared", "suffix", "prior")), strict=True)):
                score[i] += np.log(np.maximum(p, 1e-9)) if p is not None else m.prior
                if d in index:
                    score[i] += m.declared[:, index[d]]
                if s in m.suffix:
                    score[i] += of_suffix(s)
            top = score.max(1)
            confidence = 1 / np.exp(score - top[:, None]).sum(1)
            told = letters | np.array([d in index or s in m.suffix for d, s in zip(batch.column("declared").to_pylist(), batch.column("suffix").to_pylist(), strict=True)])
            lang = [m.languages[j] if t else UNKNOWN for j, t in zip(score.argmax(1), told, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(np.where(told, confidence, 0.0)), pa.array((confidence >= least) & letters)], names=["id", "lang", "confidence", "accepted"])

    return scored.mapInArrow(tidy(fuse), schema)


def _text_scores(ev: DataFrame, shared) -> DataFrame:
    """id, declared, suffix, host, letters, score: the text's log-likelihood by language. No text goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.text)
        for batch in batches:
            keys = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["i", "text"])
            scores, letters = [], []
            for _, texts in text_batches(iter([keys]), 1 << 20):
                code, starts = grams(texts)
                scores.append(np.stack([np.add.reduceat(np.append(row[code], [0.0, 0.0]), starts) for row in table], 1))
                letters += [any(map(str.isalpha, t)) for t in texts]
            if batch.num_rows:
                flat = np.concatenate(scores)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), batch.column("suffix"), batch.column("host"), pa.array(letters, pa.bool_()), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "declared", "suffix", "host", "letters", "score"])

    kind = dict(ev.dtypes)["id"]
    return ev.mapInArrow(tidy(run), f"id {kind}, declared string, suffix string, host string, letters boolean, score array<double>")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: str = "lang", host: str = "source", **kw) -> DataFrame:
    """The rows that ``identify`` accepts, all columns, ``declared`` replaced by what it found.

    Verdicts are by a hash of id, text, ``declared`` and host; rows with a null id take part like others,
    repeated rows stay repeated, null texts go, and an empty table stays empty."""
    (key,) = private(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col, declared, host))
    kept, lang = private(keyed, "kept_key", "found_lang")
    found = identify(keyed, id_col=key, text_col=text_col, declared=F.col(declared), host_col=F.col(host), **kw)
    found = found.where("accepted").select(F.col("id").alias(kept), F.col("lang").alias(lang)).distinct()
    out = keyed.join(found.hint("shuffle_hash"), F.col(key) == F.col(kept))
    return out.withColumn(declared, F.col(lang)).select(*docs.columns)
