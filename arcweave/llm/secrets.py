"""Incremental secret scan over a ledger of content-addressed blobs, in DataFrame functions only.

Each distinct text is a blob, named by its SHA-256. Only pairs of blob and rule version
that the ledger does not hold are scanned; findings are joined back to every path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, private


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1


#: Runs are maximal, so the least length of access and hex can stand in the pattern.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", least=40),
)
RULES = BASE + ADDED
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,`end`:bigint>>"


def with_blobs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans of blobs (blob, text, kinds: what to scan for): one row (blob, kind, at, start, end) per kept match.

    The pieces between matches and the matches themselves give all offsets by a running
    sum of lengths in code points."""
    kinds = []
    for r in rules:
        hit = F.array_contains("kinds", r.kind) & F.regexp_like("text", F.lit(r.pattern))
        kinds.append(
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.when(hit, F.transform(F.split("text", r.pattern, -1), lambda p: F.length(p))).alias("between"),
                F.when(hit, F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), lambda m: F.length(m))).alias("size"),
                (F.when(hit, F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda m: F.length(m))) if r.group else F.lit(None).cast("array<int>")).alias("judged"),
                F.lit(r.least).alias("least"),
            )
        )
    found = blobs.select("blob", F.explode(F.filter(F.array(*kinds), lambda k: k["size"].isNotNull())).alias("k"))
    found = found.groupBy("blob", "k.kind").agg(F.first("k").alias("k"))  # a repeated row is scanned into one
    each = found.select("blob", "k.kind", "k.least", F.posexplode(F.arrays_zip("k.between", "k.size", F.coalesce("k.judged", "k.size").alias("judged"))).alias("at", "m"))
    each = each.selectExpr("blob", "kind", "least", "at", "m.size as size", "m.judged as judged", "cast(sum(m.between + coalesce(m.size, 0)) over (partition by blob, kind order by at) as bigint) as `end`")
    return each.where("size is not null and judged >= least").selectExpr("blob", "kind", "at", "`end` - size as start", "`end`")


def unseen(first: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """path, blob, kinds: the blobs (one path each) with the kinds whose rule version the ledger lacks."""
    wanted = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return first.withColumn("kinds", wanted)
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    known = ledger.where(F.array_contains(now, F.struct("kind", "version"))).groupBy("blob").agg(F.collect_set("kind").alias("known"))
    pairs = first.join(known, "blob", "left").withColumn("kinds", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
    return pairs.where(F.size("kinds") > 0).select("path", "blob", "kinds")


def found(texts: DataFrame, pairs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, kind, version, spans of the pairs (path, blob, kinds) that have any. Texts move once, to the
    blobs that have such pairs, whatever the number of rules."""
    narrow = pairs.select(F.col("blob").alias("b"), F.col("path").alias("p"), "kinds").hint("shuffle_hash")
    one = texts.join(narrow, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    scanned = scan(one.select("blob", "text", "kinds"), rules)
    spans = scanned.groupBy("blob", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "start", "end"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return spans.select("blob", "kind", versions(rules)[F.col("kind")].alias("version"), "spans")


def versions(rules: tuple[Rule, ...]) -> F.Column:
    return F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])


def firsts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("blob").agg(F.min("path").alias("path"))


def update(docs: DataFrame, ledger: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans), one for each pair of a blob and a rule version that
    ``ledger`` lacks."""
    texts = with_blobs(docs, id_col, text_col)
    pairs = unseen(firsts(texts), ledger, rules)
    if ledger is not None:
        pairs = materialize(pairs)
        if pairs.isEmpty():  # then no text is moved or scanned
            return ledger.select("blob", "kind", "version", "spans").where("false")
    rows = pairs.select("blob", F.explode("kinds").alias("kind")).withColumn("version", versions(rules)[F.col("kind")])
    spans = found(texts, pairs, rules).drop("version")
    return rows.join(spans, ["blob", "kind"], "left").select("blob", "kind", "version", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def report(docs: DataFrame, ledger: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, spans (kind, start, end by start, then rule order; empty, never null): the ledger's
    findings under the rules' versions, joined back to every row. No text is scanned."""
    paths = with_blobs(docs, id_col, text_col).select("path", "blob")
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    held = ledger.where((F.size("spans") > 0) & F.array_contains(now, F.struct("kind", "version"))).dropDuplicates(["blob", "kind", "version"])
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    each = held.select("blob", "kind", F.explode("spans").alias("s"))
    by_blob = each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", order[F.col("kind")].alias("rank"), "s.end", "kind"))).alias("spans"))
    # Hidden partitioning: both sides are dealt anew, so that a blob with very many paths can be split.
    by_blob = by_blob.withColumn("blob", F.concat("blob", F.lit("")))
    return paths.join(by_blob, "blob", "left").select("path", "blob", F.coalesce(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Paths and new ledger rows.

    paths: path, blob, spans (array of kind, start, end by start, then rule order; empty,
    never null), one row for each input row. new ledger: blob, kind, version, spans for each
    pair that was not in ``ledger``, written to the shared folder; append it, and a later call scans
    only what is new: new texts under all rules, and old ones under rules whose version changed.
    A null text is the empty blob. Null and repeated ids keep their rows; an empty table has empty results."""
    new = materialize(update(docs, ledger, id_col=id_col, text_col=text_col, rules=rules))
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return report(docs, whole, id_col=id_col, text_col=text_col, rules=rules), new


def spans_text(spans: str, kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` joined by commas, of all or of some kinds."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of ``find`` replaced by ``mark`` (overlaps by one mark).

    Rows whose text has no finding, null texts too, are returned as they are; repeated rows stay repeated,
    and an empty table stays empty. Without a ledger nothing is known before and nothing is handed on, so
    no table of new rows is written: the blobs' findings go straight to the rows."""
    if ledger is None:
        texts = with_blobs(docs, id_col, text_col)
        held = found(texts, unseen(firsts(texts), None, rules), rules)
        paths = report(docs, held, id_col=id_col, text_col=text_col, rules=rules)
    else:
        paths, _ = find(docs, id_col=id_col, text_col=text_col, ledger=ledger, rules=rules)
    path, blob, spans = private(docs, "secret_path", "secret_blob", "secret_spans")
    hits = paths.where(F.size("spans") > 0).select(F.col("path").alias(path), F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([path, blob])
    own = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    joined = docs.join(hits.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(path)) & (own == F.col(blob)), "left")
    # Fold spans, in order of start, into (text so far, where it ended).
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, s):
        inside = s["start"] < state["at"]
        add = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(F.col(text_col), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.concat(state["out"], add).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda st: F.concat(st["out"], F.substring(F.col(text_col), (st["at"] + 1).cast("int"), F.length(text_col))))
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(done)).select(*docs.columns)
