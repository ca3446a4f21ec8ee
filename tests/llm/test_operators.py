"""Each operator on small tables: nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arcweave.llm import decontam, html, langid, packing, passages, secrets, setjoin, tokens, topk, toxicity
from arcweave.llm.common import connected_components, gram_hashes, look_up, materialize, release

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def words(n: int, rng=RNG) -> list[str]:
    return [rng.choice(VOCAB) for _ in range(n)]


def text(n: int, rng=RNG) -> str:
    return " ".join(words(n, rng))


def frame(spark, rows):
    """documents with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("id", "name", "path", "blob", "root", "u", "v", "z", "word")})


def docs(spark):
    base = words(300)
    near = list(base)
    near[150] = "changed"
    long = text(40_000)
    rows = [
        (0, " ".join(base), "en", "a.example.org", 1),
        (1, " ".join(near), "en", "a.example.org", 1),
        (2, " ".join(base), "en", None, 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "de", "b", 0),
        (6, "one two", "en", "b", 1),
        (7, "ONE  two", "en", "b", 1),
        (8, long, "en", "b", 1),
        (9, "Zeile eins: password = \"abcdef123456\" token=short1 AKIA" + "Q" * 16 + " " + "0a" * 12, "de", "b", 1),
        (10, text(60) + " " + " ".join(base[100:180]) + " " + text(30), "en", "b", 1),
        (11, "été 日本 🙂 <|endoftext|> x y", "fr", "b", 1),
        (11, "été 日本 🙂 <|endoftext|> x y", "fr", "b", 1),
        (12, text(80), "en", "b", 1),
        (None, " ".join(base), "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return docs(spark)


@pytest.fixture(scope="module")
def table(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# Tokens -----------------------------------------------------------------------------------------


def test_token_counts(spark, rows, table, empty):
    t = tokens.load(public_tokenizers.path(tokens.BYTE_BPE))
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x, *_ in rows)
    assert Counter(map(tuple, tokens.count_tokens(table).collect())) == want
    assert tokens.count_tokens(empty).count() == 0


@pytest.mark.parametrize("odd", ["", " ", "a  b", "a \n b", "\n a", "a ", "it's  'tis", "a\x1cb c", "x  y", "<|endoftext|> a<|endoftext|>", "á ́b", "１２ ½ ²", "a\r\n\r\nb  \t c"])
def test_pieces_are_safe(odd):
    c = tokens.Counter(public_tokenizers.path(tokens.BYTE_BPE))
    e = tokens.Encoder(public_tokenizers.path(tokens.WORD_BPE))
    import pyarrow as pa

    mixed = [odd, "foo " + odd + " bar", odd + odd, "plain words here"]
    assert c.counts(mixed) == [len(c.tokenizer.encode(x, add_special_tokens=False).ids) for x in mixed]
    flat, at = e.encode(pa.array(mixed, pa.string()))
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(at)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in mixed]


# Packing -----------------------------------------------------------------------------------------


def test_packing(spark, rows, table, empty):
    t = tokens.load(public_tokenizers.path(tokens.WORD_BPE))
    got = packing.pack(table).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    copies = Counter(i for i, *_ in rows)
    for i, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == Counter({(k, 4096 * k, len(c), zlib.crc32(c.tobytes())): copies[i] for k, c in enumerate(cut)})
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 4096])
    h = Counter(min(capacity, max(1, int(r.choice([r.uniform(1, capacity), r.expovariate(4 / capacity), capacity / 3 + 1])))) for _ in range(r.randint(0, 3000)))
    runs, n = packing.plan(dict(h), capacity)
    seq, seen = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in runs:
        seen[length] += range(rank, rank + count)
        for k in range(count):
            seq[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in h.items()}
    assert sorted(seq) == list(range(n))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    largest = [x for k, c in h.items() for x in [k] * c if 2 * k > capacity]
    least = max(-(-sum(k * c for k, c in h.items()) // capacity), len(largest))
    ffd: list[int] = []
    for x in sorted((k for k, c in h.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(ffd) if room >= x), None)
        if at is None:
            ffd.append(capacity - x)
        else:
            ffd[at] -= x
    assert least <= n <= len(ffd) * 1.05 + 3


# Secrets ------------------------------------------------------------------------------------------

KINDS = (("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def base_spans(x: str) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(KINDS) for m in p.finditer(x) if len(m.group(g)) >= least)


SECRETS = [
    "api_key=token:abcdefghijklmnop", "APIKEY : 'abcdefghijkl' secret=x", "password=password=abcdefghijkl", "xAKIA" + "A" * 13 + "AKIAAKIA" + "B" * 20, "deadbeef" * 3 + "g" + "0" * 15, "🙂 token='ABCDEFGHIJKLM' été " + "0f" * 9,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "token=" + "a" * 100_000, " ".join(["secret=abcdefabcdef0123"] * 400),
]


def test_secret_spans(spark, rows, table, empty):
    many = rows + [(100 + i, s, "en", "b", 1) for i, s in enumerate(SECRETS)]
    out, ledger = secrets.find(frame(spark, many))
    got = Counter((r["path"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in ("assign", "access", "hex"))) for r in out.collect())
    assert got == Counter((i, tuple((a, kind, b) for a, _, kind, b in base_spans(x or ""))) for i, x, *_ in many)
    kinds = {s["kind"] for r in out.collect() for s in r["spans"]}
    assert {"pem", "hub"} <= kinds
    assert secrets.find(empty)[0].count() == 0
    # A second call with the ledger scans nothing and finds the same.
    again, new = secrets.find(frame(spark, many), ledger=ledger)
    assert Counter(map(str, again.collect())) == Counter(map(str, out.collect()))
    assert new.count() == 0
    more, new = secrets.find(frame(spark, many + [(500, "token=zzzzzzzzzzzzzz", "en", "b", 1)]), ledger=ledger)
    assert {r["blob"] for r in new.collect()} == {hashlib.sha256(b"token=zzzzzzzzzzzzzz").hexdigest()}
    assert more.where("path = 500").first()["spans"][0]["end"] == 20


def test_redaction(spark, rows):
    many = rows + [(100 + i, s, "en", "b", 1) for i, s in enumerate(SECRETS)]
    got = {(r["doc_id"], r["text"]) for r in secrets.redact(frame(spark, many), rules=secrets.BASE).collect()}
    for i, x, *_ in many:
        out, at = "", 0
        for a, _, _, b in base_spans(x or ""):
            if a >= at:
                out += (x or "")[at:a] + "[SECRET]"
            at = max(at, b)
        assert (i, None if x is None else out + x[at:]) in got
    assert len(got) == len({(i, x) for i, x, *_ in many})


def test_redaction_writes_no_table(spark, rows, monkeypatch):
    """Each part file costs processes that executors start (chmod on file://): a ledger that nobody gets is not written."""
    many = rows + [(100 + i, s, "en", "b", 1) for i, s in enumerate(SECRETS)]
    df, written = frame(spark, many), []
    _, ledger = secrets.find(df)
    monkeypatch.setattr(secrets, "materialize", lambda x: written.append(x) or materialize(x))
    plain = Counter(map(str, secrets.redact(df).collect()))
    assert not written
    assert plain == Counter(map(str, secrets.redact(df, ledger=ledger).collect()))  # by way of a stored ledger
    assert written


def test_secret_scan_is_native(table):
    plan = secrets.find(table)[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Set join ------------------------------------------------------------------------------------------


def shingles(x: str | None, k: int) -> frozenset:
    w = (x or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent):
    sets = [shingles(x, k) for _, x, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, *_) in enumerate(rows))


def families(seed: int):
    """Groups of near copies at many distances, chains, and copies."""
    r, out, doc = random.Random(seed), [], 0
    for _ in range(12):
        base = words(r.randint(3, 120), r)
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            if r.random() < 0.2:
                base = w
            out.append((doc, " ".join(w), "en", "s", 1))
            doc += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "tile"), [(4, 85, 128), (5, 80, 4)])
def test_jaccard_components(spark, rows, table, empty, k, percent, tile):
    got = Counter(map(tuple, setjoin.components(table, k=k, percent=percent, tile=tile).collect()))
    assert got == brute_components(rows, k, percent)
    many = families(percent)
    got = Counter(map(tuple, setjoin.components(frame(spark, many), k=k, percent=percent, tile=tile).collect()))
    assert got == brute_components(many, k, percent)
    assert setjoin.components(empty).count() == 0


def test_join_writes_few_files(spark, monkeypatch):
    """Each part file costs processes that executors start (chmod on file://): shares are written together."""
    files = []

    def counted(df):
        out = materialize(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(setjoin, "materialize", counted)
    many = families(7)
    got = Counter(map(tuple, setjoin.components(frame(spark, many).repartition(40), tile=4, bucket_chars=300).collect()))
    assert got == brute_components(many, 4, 85)
    shares = -(-sum(len(x) for _, x, *_ in many) // 300)
    assert shares >= 40 and max(files) <= -(-shares // 8)


def test_join_sets_in_one_task():
    for seed in range(20):
        many = families(seed)
        sets = [np.unique(gram_hashes(np.array([hash(w) & (2**64 - 1) for w in x.split()], np.uint64), 2)) for _, x, *_ in many]
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in setjoin.join_sets(sets, 80):
            assert 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
            parent[find(x)] = find(y)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert find(i) == find(j)


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 7)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {row["node"]: row["root"] for row in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    live = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in live}


# Passages ------------------------------------------------------------------------------------------


def brute_dedup(rows, span=50):
    owner: dict = {}
    split = [(x or "").encode().split() for _, x, *_ in rows]
    key = lambda i: (i is None, i or 0)
    for (i, *_), w in zip(rows, split, strict=True):
        for j in range(len(w) - span + 1):
            g = tuple(w[j : j + span])
            if g not in owner or key(i) < key(owner[g]):
                owner[g] = i
    out = Counter()
    for (i, *_), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if key(owner[tuple(w[j : j + span])]) < key(i):
                gone[j : j + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_passage_dedup(spark, rows, table, empty):
    assert Counter(map(tuple, passages.dedup(table).collect())) == brute_dedup(rows)
    assert passages.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passage_dedup_random(spark, seed):
    r = random.Random(seed)
    shared = [words(r.randint(50, 130), r) for _ in range(6)]
    many = []
    for i in range(60):
        w = words(r.randint(0, 80), r)
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, 30)
            w = w + s[a : a + r.randint(40, 130)] + words(r.randint(0, 20), r)
        many.append((i // 2 * 3 if seed == 2 else i, " ".join(w), "en", "s", 1))
    assert Counter(map(tuple, passages.dedup(frame(spark, many)).collect())) == brute_dedup(many)


# Top-k --------------------------------------------------------------------------------------------


def brute_topk(rows, k=20, every=20):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in reversed(ok)}.items():
        if q % every == 0:
            score = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(score)}
    return out


@pytest.mark.parametrize("tiles", [1, 7])
def test_topk(spark, tiles):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(500)]
    rows += [(600, None), (620, [1.0, None]), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (None, [1.0] * 8), (680, []), (700, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("x"), "score": F.lit(2), "label": F.lit(None).cast("int")})
    got = {tuple(x) for x in topk.search(df, least_tiles=tiles, docs_per_tile=200, queries_per_tile=5).collect()}
    assert got == brute_topk(rows)
    assert topk.search(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 3, 5)")
    assert {tuple(x) for x in topk.search(few).collect()} == brute_topk([x for x in rows if x[0] in (0, 3, 5)])


# HTML ----------------------------------------------------------------------------------------------


def test_field_beats_held_out_pages():
    field = html.default_field()
    wrong = total = 0
    for page, good in html.labelled_pages(150, seed=77):
        b, y = html.label(page, good)
        wrong += sum(p != q for p, q in zip(field.decode(b), y, strict=True))
        total += len(b)
    assert wrong / total < 0.02


def test_viterbi_is_exact():
    field = html.default_field()
    for page, _ in itertools.islice(html.labelled_pages(60, seed=5), 60):
        b = html.blocks(page)[:8]
        if not b:
            continue
        s = field.scores(*field.rows(b))

        def value(y, s=s):
            return s[np.arange(len(y)), list(y)].sum() + field.ends[0, y[0]] + field.ends[1, y[-1]] + sum(field.t[i, j] for i, j in itertools.pairwise(y))

        assert value(field.decode(b)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(b)))))


PAGE = """<html lang=en><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Caf&eacute; &amp; bar</h1><p>One <b>two</b>&nbsp;three.<br>Four<p>Five &#102;ine.</p><!-- no --></article>
<section class="comments"><p>First comment, nice.</p></section><footer>&copy; me</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (5, "u", "<p title='broken"), (6, "u", "<" * 2000), (7, "u", "<div>" * 3000), (8, "u", "<article><p>" + "word. " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("q")})
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got[1] == got[None] == ("Café & bar One two three. Four Five fine.", len("Café & bar One two three. Four Five fine."))
    assert got[2] == got[3] == ("", 0)
    assert got[8][1] == 6 * 60_000 - 1
    assert html.extract(df.limit(0)).count() == 0


# Language -------------------------------------------------------------------------------------------


def language_rows():
    r = random.Random(2)
    parts = {"en": ["the", "and", "ing", "wh", "tion"], "de": ["sch", "ung", "ein", "keit", "ü"], "fr": ["eau", "è", "oi", "ment", "que"]}
    return [(i, " ".join("".join(r.choice(p) for _ in range(r.randint(1, 4))) for _ in range(40)), k, f"www.{k}.example.org") for i, (k, p) in enumerate(list(parts.items()) * 40)]


def test_language(spark):
    rows = language_rows()
    odd = [(900, None, None, None), (901, "", "en", "www.en.example.org"), (902, "1234 %%%", None, None), (903, rows[1][1], "en", "x.org"), (None, rows[0][1], "en", None), (904, rows[2][1] * 300, "xx", "y.org")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumns({"declared": F.lit("q"), "host": F.lit("h"), "prior": F.lit(1)})
    got = {r["id"]: r for r in langid.identify(df, declared=F.col("lang"), host_col=F.col("source")).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i]["lang"] == k and got[i]["accepted"] for i, _, k, _ in rows)
    assert not got[900]["accepted"] and got[900]["lang"] == langid.UNKNOWN and not got[901]["accepted"] and not got[902]["accepted"]
    assert got[903]["lang"] == "de"
    assert langid.identify(df.limit(0), declared=F.col("lang")).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(len(rows))) and not {900, 901, 902} & {r["doc_id"] for r in kept.collect()}


def made_languages(n: int, rows: list[int], seed: int = 3):
    """Rows of languages with syllables of their own: (id, text, language, host)."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        parts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzåéîøüß") for _ in range(3)) for _ in range(8)]
        for _ in range(rows[k % len(rows)]):
            out.append((len(out), " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(40)), f"l{k}", f"www.{k % 7}.org"))
    return out


def test_every_language_is_modelled(spark):
    rows = made_languages(80, [7, 8, 7])  # more than 64, and each of several rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for kw in ({}, {"host_col": F.col("source")}, {"suffix": F.concat(F.lit("s"), F.col("lang"))}):
        got = {r["id"]: r for r in langid.identify(df, declared=F.col("lang"), **kw).collect()}
        assert all(got[i]["lang"] == k and got[i]["accepted"] for i, _, k, _ in rows)


def test_rare_languages_keep_their_rows(spark):
    rows = made_languages(6, [300, 1, 2, 60, 4, 3])
    odd = [(9000, rows[5][1], "l9", "www.1.org"), (9001, rows[-1][1], None, None), (9002, rows[7][1], "l0", None)]  # a wrong mark, none, a right one
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in langid.identify(df, declared=F.col("lang"), host_col=F.col("source")).collect()}
    assert all(got[i]["lang"] == k and got[i]["accepted"] for i, _, k, _ in rows)
    assert got[9001]["lang"] == "l5" and got[9002]["lang"] == "l0"
    kept = langid.keep_identified(df)
    assert {(r["doc_id"], r["lang"]) for r in kept.collect()} >= {(i, k) for i, _, k, _ in rows}


@pytest.mark.parametrize("rows", [[1], [1, 2, 3, 4]])
def test_small_tables_keep_their_languages(spark, rows):
    rows = made_languages(4, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in langid.identify(df, declared=F.col("lang"), host_col=F.col("source")).collect()}
    assert all(got[i]["lang"] == k and got[i]["accepted"] for i, _, k, _ in rows)
    assert langid.keep_identified(df).count() == len(rows)


def test_more_suffixes_than_a_table_held_before(spark):
    rows = [(i, "the same words here", "en" if i % 2 else "de", f"x{i // 2 * 2 + i % 2}") for i in range(5000)] + [(9000 + i, "the same words here", None, f"x{4990 + i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string")
    got = {r["id"]: r["lang"] for r in langid.identify(df, declared=F.col("lang"), suffix=F.col("suffix")).where("id >= 9000").collect()}
    assert got == {9000: "de", 9001: "en", 9002: "de", 9003: "en"}


def test_evidence_columns(spark):
    df = spark.createDataFrame([("https://m.site.example.de/fr/825?page=2", '<HTML class=a lang="FR-ca">'), ("//site.de", "<p>"), (None, None), ("site", "<html>")], "url string, html string")
    got = [tuple(r) for r in df.select(langid.host("url"), langid.address_suffix("url"), langid.declared_language("html")).collect()]
    assert got == [("m.site.example.de", "fr", "fr"), ("site.de", "de", None), (None, None, None), (None, None, None)]


def test_host_priors_are_smoothed(spark):
    df = spark.createDataFrame([(i, "x", "en" if i % 10 else "de", "a.big.org") for i in range(100)] + [(200, "x", "fr", "b.big.org")], "doc_id long, text string, lang string, source string")
    ev = langid.evidence(df, id_col="doc_id", text_col="text", declared=F.col("lang"), host_col=F.col("source"))
    p = {r["host"]: r["prior"] for r in langid.host_priors(ev, ["de", "en", "fr"]).collect()}
    assert all(sum(v.values()) == pytest.approx(1) for v in p.values())
    assert p["b.big.org"]["en"] > p["b.big.org"]["fr"] > p["a.big.org"]["fr"]


# Toxicity -------------------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["grumpface", "nastywort", "grumpling", "vilebag"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(r.randint(5, 60), r), int(r.random() < 0.3)
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 2:
            labels.append((i, toxic))
    truth = dict(labels)
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "grumpface you", "en", "s", 1), (5002, text(20_000), "en", "s", 1)]
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (7, 1 - truth[7])], "doc_id long, toxic int").withColumn("text", F.lit("label"))
    got = {x["doc_id"]: x for x in toxicity.score(frame(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["score"], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.97
    assert got[None]["predicted"] == 1 and not got[None]["held_out"]
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[5002]["predicted"] == 0
    assert {x["score"] for x in toxicity.score(frame(spark, rows), lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), lab).count() == 0


# Decontamination -------------------------------------------------------------------------------------


def test_leaks(spark, empty):
    r = random.Random(8)
    items = [(k, ". ".join(text(r.randint(6, 40), r).capitalize() for _ in range(r.randint(1, 3))) + ".") for k in range(60)]
    items += [(60, None), (61, ""), (62, "..."), (None, text(20, r)), (63, " ".join(words(200, r)))]
    rows = []
    for i in range(200):
        x = text(r.randint(0, 300), r)
        if i % 4 == 0:
            k, item = items[i // 4] if i // 4 < 60 else items[-1]
            x += " " + (item.upper().replace(".", " !") if i % 8 else item) + " " + text(r.randint(0, 100), r)
        rows.append((i, x, "en", "s", 1))
    rows += [(300, None, None, None, None), (301, items[-1][1] + " " + text(5000, r), "en", "s", 1), (302, items[0][1], "en", "s", 1), (302, items[0][1], "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((x["doc_id"], x["item_id"]) for x in decontam.find_leaks(frame(spark, rows), bench).collect())
    want = Counter()
    for i, x, *_ in rows:
        near = decontam.terms(x or "")
        for k, item in items:
            q, a = decontam.question_and_answer(item or "")
            if k is None or not q:
                continue
            seen = set().union(*(set(zip(*(near[j:] for j in range(n)), strict=False)) for n in {min(5, len(q)), min(5, len(a) or 5)}))
            qs, as_ = decontam.shingles(q), decontam.shingles(a)
            if len(qs & seen) >= 0.8 * len(qs) or len((qs | as_) & seen) >= 0.8 * len(qs | as_):
                want[i, k] += 1
    assert got == want
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
    clean = decontam.drop_leaked(frame(spark, rows), bench)
    assert {x["doc_id"] for x in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in want}


def test_question_only_leaks(spark):
    """Questions whose long answers are absent, whole or as changed as the overlap lets them be."""
    r = random.Random(11)
    own = lambda k, n: [f"{c}{k}x{i}" for i, c in enumerate(r.choices("abcdefgh", k=n))]
    items, rows = [], []
    for k, (n_q, n_a) in enumerate([(2, 33), (5, 32), (6, 47), (9, 60), (14, 90), (24, 70), (40, 130), (90, 300), (150, 200), (12, 10), (30, 20)]):
        q, a = own(k, n_q), own(k, n_a)
        items.append((k, " ".join(q) + ". " + " ".join(a).capitalize() + "."))
        shown = [q, a]
        lost = int(0.2 * max(1, n_q - 4) + 1e-9)
        shown += [q[lost:], q[: n_q - lost], q[lost + 1 :]]  # the last has too few shingles
        shown += [q[: n_q // 2] + ["other"] + q[n_q // 2 + 1 :]]
        for x in shown:
            rows.append((len(rows), " ".join(words(100, r) + x + words(100, r)), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(frame(spark, rows), bench).collect()}
    want = set()
    for i, x, *_ in rows:
        near = decontam.terms(x)
        for k, item in items:
            q, a = decontam.question_and_answer(item)
            qs, as_ = decontam.shingles(q), decontam.shingles(a)
            seen = set().union(*(set(zip(*(near[j:] for j in range(n)), strict=False)) for n in {min(5, len(q)), 5}))
            if len(qs & seen) >= 0.8 * len(qs) or len((qs | as_) & seen) >= 0.8 * len(qs | as_):
                want.add((i, k))
    assert {(i, k) for k in range(len(items)) for i in (6 * k, 6 * k + 2, 6 * k + 3)} <= want
    assert got == want
    assert {x["doc_id"] for x in decontam.drop_leaked(frame(spark, rows), bench).collect()} == set(range(len(rows))) - {i for i, _ in want}


def test_units_need_no_more_than_a_leak_scores():
    r = random.Random(12)
    for n in (3, 5, 8, 9, 20, 33, 64, 65, 150):
        for pool in (8, 400):
            q = [r.randrange(pool) for _ in range(n)]
            units, at = decontam.parts_of(q, 64), 0
            assert sum(sum(first) for _, first in units) == len(decontam.shingles(q)) and all(len(u) <= 64 for u, _ in units)
            for u, first in units:
                assert u == q[at : at + len(u)]
                at += len(first)
                own = [i for i, x in enumerate(first) if x]
                if not own:
                    continue
                share = {w: r.random() ** 4 for w in u}
                share = {w: x / sum(share.values()) for w, x in share.items()}
                least = decontam.least_share(u, first, share, 0.8)
                assert 0 < least <= 1
                for _ in range(200):
                    lost, a = int(0.2 * len(own) + 1e-9), r.choice((0, len(own), r.randint(0, len(own))))
                    met = own[:a] + own[a + lost :] if a + lost <= len(own) else own[: len(own) - lost]
                    met = met if r.random() < 0.7 else r.sample(own, len(own) - lost)
                    assert sum(share[w] for w in set().union(*(u[i : i + 5] for i in met))) >= least - 1e-9


def test_pruning_keeps_every_score():
    r = random.Random(9)
    items = [(k, text(r.randint(3, 60), r)) for k in range(150)]
    ix = decontam.Index(items, block=4)
    dense = np.zeros((len(ix.vocabulary), len(ix.owner)))
    for t in range(len(ix.vocabulary)):
        for e in range(ix.lists[t], ix.lists[t + 1]):
            dense[t, ix.unit_of[e]] = ix.weight[e]
    for _ in range(60):
        q = np.unique([ix.vocabulary[w] for w in words(80, r) if w in ix.vocabulary])
        exact = dense[q].sum(0)
        assert [(u, pytest.approx(s)) for u, s in ix.search(q, 0.3)] == [(int(u), exact[u]) for u in np.flatnonzero(exact >= 0.3 - 1e-9)]


# Rows that are told apart, and names that clash --------------------------------------------------------


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = "row_key kept_key found_lang leaked_key secret_path secret_blob secret_spans _key _kept _lang _p _b _s _leaked _id _group hot found other hot_key"
    return df.withColumns({c: F.lit("mine") for c in taken.split()})


def test_clashing_names_and_repeated_ids(spark):
    r = random.Random(21)
    item = text(30, r)
    plain = [text(60, r) for _ in range(6)]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(plain)]
    rows += [(1, plain[0], "en", "s", 1), (2, plain[2] + " " + item, "en", "s", 1), (None, plain[3], "en", "s", 1), (None, text(50, r) + " " + item, "en", "s", 1), (9, "token=abcdefghijklmnop x", "en", "s", 1), (9, "token=abcdefghijklmnop x", "en", "s", 1), (10, None, "en", "s", 1), (11, "", "en", "s", 1)]
    df = clashing(spark, rows)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    pairs = lambda d: Counter((x["doc_id"], x["text"]) for x in d.collect())
    every = Counter((i, x) for i, x, *_ in rows)
    near = setjoin.keep_one(df, k=5, percent=80)
    assert near.columns == df.columns and {x["_group"] for x in near.collect()} == {"mine"}
    assert pairs(near) == every - Counter([(1, plain[0]), (None, plain[3])])
    clean = decontam.drop_leaked(df, bench)
    assert clean.columns == df.columns and pairs(clean) == Counter({k: n for k, n in every.items() if item not in (k[1] or "")})
    masked = secrets.redact(df)
    assert masked.columns == df.columns and pairs(masked) == Counter((i, x.replace("token=abcdefghijklmnop", "[SECRET]") if x else x) for (i, x), n in every.items() for _ in range(n))
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {x["_key"] for x in kept.collect()} == {"mine"}
    assert pairs(kept) == Counter({k: n for k, n in every.items() if k[1]})
    none = df.where("false")
    for out in (setjoin.keep_one(none), decontam.drop_leaked(none, bench), secrets.redact(none), langid.keep_identified(none)):
        assert out.columns == df.columns and out.count() == 0


def test_look_up_of_hot_keys(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "i long, k long")
    table = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where("k <> 9")
    top: dict = {}
    for i, k in rows:
        if k is not None and k != 9:
            top[k] = max(i, top.get(k, i))
    got = {(x["i"], x["k"]): x["top"] for x in look_up(df, table, "k", "top", "n").collect()}
    assert got == {(i, k): top.get(k) for i, k in rows}


def test_materialized_tables_are_deleted(spark):
    import os

    df = materialize(spark.range(10).toDF("x"))
    path = next(iter(df.inputFiles())).rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert df.count() == 10 and os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)


# Skipping ------------------------------------------------------------------------------------------------


def test_wand_skips_postings_and_shards_agree(spark):
    r = random.Random(31)
    pool = {k: ["".join(r.choice(c) for _ in range(4)) for _ in range(150)] for k, c in enumerate(("abcdef", "ghijkl", "mnopqr"))}
    items = [(k, " ".join(r.choices(pool[k % 3], k=30)) + ".") for k in range(120)]
    ix = decontam.Index(items)
    seen: dict = {}
    for k in range(3):
        q = np.unique([ix.vocabulary[w] for w in r.choices(pool[k], k=25) if w in ix.vocabulary])
        ix.search(q, 1.0, seen)
    assert seen["read"] < 0.7 * seen["postings"] and seen["live"] < 0.7 * seen["blocks"]
    rows = [(i, " ".join(r.choices(pool[i % 3], k=100)) + (" " + items[i][1] if i % 2 else ""), "en", "s", 1) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (Counter((x["doc_id"], x["item_id"]) for x in decontam.find_leaks(frame(spark, rows), bench, shard_chars=n).collect()) for n in (1 << 22, 1500))
    assert one == many and {(i, i) for i in range(1, 40, 2)} <= set(one)


def test_set_join_skips_and_derives():
    seen: dict = {}
    r = random.Random(3)
    base = [r.getrandbits(40) for _ in range(200)]
    away = [r.getrandbits(40) for _ in range(24)]
    other = base[:176] + away  # close to the base's copies, and not linked; what differs is frequent, so that prefixes do not tell
    sets = [np.unique(np.array(base[176:] + away + [r.getrandbits(40) for _ in range(300)], np.uint64)) for _ in range(60)]
    for of in (base, other) * 15:
        sets.append(np.unique(np.array([x for x in of if r.random() > 0.01] + [r.getrandbits(40)], np.uint64)))
    forest = setjoin.join_sets(sets, 90, seen)
    assert len(forest) == 28 and all((x - y) % 2 == 0 and min(x, y) >= 60 for x, y in forest)
    assert seen["derived"] > 50 and seen["skipped"] > 50


def test_topk_skips_blocks():
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 40
    docs = np.floor(centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 16)) * 4).astype(np.int64)
    ids = np.arange(3000)
    seen: dict = {}
    q = ids % 20 == 0
    who, what, score = topk.tile_topk(ids, docs, ids[q], docs[q], 20, seen=seen)
    assert seen["scored"] < 0.5 * seen["all"]
    for i in ids[q][:40]:
        s = docs @ docs[i]
        want = sorted((-int(x), int(j)) for j, x in enumerate(s) if j != i)[:20]
        assert sorted(zip((-score[who == i]).tolist(), what[who == i].tolist(), strict=True)) == want


@pytest.mark.parametrize("rows", [[(0, [1.0, 2.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])]])
def test_topk_of_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.search(df).orderBy("rank").collect()] == [(0, 1, 1, 64 * 192), (0, 2, 2, 64 * 192)]


def test_passages_are_found_by_the_automaton_alone():
    r = random.Random(5)
    enc = lambda ws: [w.encode() for w in ws]
    body = words(90, r)
    a = passages.Automaton(50)
    a.add(1, enc(body))
    a.add(2, enc(["na"] * 50))
    assert a.covered(5, enc(["x"] * 7 + body[10:80] + ["y"])) == ([7], [77])
    assert a.covered(5, enc(body[:49])) == ([], []) and a.covered(1, enc(body)) == ([], [])
    lo, hi = a.covered(9, enc(["na"] * 400))
    assert {x for p, q in zip(lo, hi, strict=True) for x in range(p, q)} == set(range(400))


# Ledger ---------------------------------------------------------------------------------------------------


def test_ledger_scans_only_new_rule_versions(spark):
    import dataclasses

    rows = [(i, s, "en", "b", 1) for i, s in enumerate(SECRETS)] + [(50, SECRETS[0], "en", "b", 1), (51, None, "en", "b", 1)]
    df = frame(spark, rows)
    first, ledger = secrets.find(df, rules=secrets.BASE)
    newer = tuple(dataclasses.replace(r, version=2, least=20) if r.kind == "assign" else r for r in secrets.BASE) + secrets.ADDED
    out, new = secrets.find(df, rules=newer, ledger=ledger)
    blobs = {hashlib.sha256((x or "").encode()).hexdigest() for _, x, *_ in rows}
    assert {(x["blob"], x["kind"], x["version"]) for x in new.collect()} == {(b, k, v) for b in blobs for k, v in (("assign", 2), ("pem", 1), ("hub", 1))}
    whole, _ = secrets.find(df, rules=newer)
    assert Counter(map(str, out.collect())) == Counter(map(str, whole.collect())) != Counter(map(str, first.collect()))


# Weak supervision and language by brute force ------------------------------------------------------------


def test_label_model_is_plain_em(spark):
    r = random.Random(6)
    rows = []
    for _ in range(400):
        y = r.random() < 0.3
        fired = [j for j, (a, b) in enumerate([(0.6, 0.02), (0.5, 0.05), (0.3, 0.1)]) if r.random() < (a if y else b)]
        rows.append((r.choice([-1, -1, int(y)]), fired))
    counted = Counter((k, tuple(f)) for k, f in rows)
    patterns = spark.createDataFrame([(k, list(f), n) for (k, f), n in counted.items()], "key long, fired array<int>, n long")
    a, b, prior, gold = np.array([0.5, 0.4, 0.3]), np.array([0.1, 0.1, 0.1]), 0.3, (0.95, 0.05)
    model = toxicity.LabelModel(prior, a.copy(), b.copy()).fit(patterns, 3)
    for _ in range(3):
        post = []
        for k, f in rows:
            p, q = prior, 1 - prior
            for j in range(3):
                p *= a[j] if j in f else 1 - a[j]
                q *= b[j] if j in f else 1 - b[j]
            if k >= 0:
                p *= gold[0] if k else 1 - gold[0]
                q *= gold[1] if k else 1 - gold[1]
            post.append(p / (p + q))
        n1, n0 = sum(post), len(post) - sum(post)
        on = lambda of: np.array([sum(x for x, (_, f) in zip(of, rows, strict=True) if j in f) for j in range(3)])
        anti = [1 - x for x in post]
        given = lambda of, y: sum(x for x, (k, _) in zip(of, rows, strict=True) if (k == 1 if y else k >= 0))
        a, b = (on(post) + 0.5) / (n1 + 1), (on(anti) + 0.05) / (n0 + 1)
        gold = ((given(post, 1) + 0.95) / (given(post, 0) + 1), (given(anti, 1) + 0.05) / (given(anti, 0) + 1))
        prior = (n1 + 0.5) / (len(rows) + 1)
    assert np.allclose(model.a, a) and np.allclose(model.b, b) and model.prior == pytest.approx(prior) and np.allclose(model.gold, np.clip(gold, 1e-3, 1 - 1e-3))


def test_language_posterior_by_brute_force(spark):
    rows = language_rows()[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in langid.identify(df, declared=F.col("lang")).collect()}
    langs = sorted({k for *_, k, _ in rows})
    counts = {k: Counter() for k in langs}
    each = {}
    for i, t, k, _ in rows:
        code, _ = langid.grams([t])
        each[i] = Counter(code.tolist())
        counts[k].update(each[i])
    n = np.array([sum(k == x for *_, x, _ in rows) for k in langs], float)
    size = np.array([sum(counts[k].values()) for k in langs], float)
    lack = (5.0 / (5.0 + n)) ** 2
    whole = sum(counts.values(), Counter())

    def likelihood(j, g):
        floor = 0.5 * max(size[j], 1) / max(size.max(), 1)
        own = (counts[langs[j]][g] + floor) / (size[j] + floor * langid.BUCKETS)
        return (1 - lack[j]) * own + lack[j] * (whole[g] + 0.5) / (size.sum() + 0.5 * langid.BUCKETS)

    for i, _, k, _ in rows[:12]:
        z = np.array([0.05 * sum(c * np.log(likelihood(j, g)) for g, c in each[i].items()) + np.log((n[j] + 0.5) / (n + 0.5).sum()) + np.log(0.9 if langs[j] == k else 0.1 / (len(langs) - 1)) for j in range(len(langs))])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang"] == langs[int(p.argmax())] and got[i]["confidence"] == pytest.approx(p.max())


def test_repeated_rows_are_scored_alike(spark):
    rows = [(i, text(20), "en", "s", 1) for i in range(20)] * 2
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    scored = Counter(x["doc_id"] for x in toxicity.score(frame(spark, rows), lab).collect())
    told = Counter(x["id"] for x in langid.identify(frame(spark, rows), declared=F.col("lang")).collect())
    pages = spark.createDataFrame([(1, "u", PAGE)] * 2, "page_id long, url string, html string")
    assert scored == told == Counter(i for i, *_ in rows) and len(html.extract(pages).collect()) == 2


def test_text_of_odd_elements():
    page = "<html><body><nav><a href=x>Home</a></nav><article><p>One <svg viewBox='0'/>two.</p><noscript><p>Three four five.</p></noscript><p>Six <math><mi>x</mi><mo>=</mo><mn>2</mn></math> seven <object>eight</object> nine.</p></article></body></html>"
    assert " ".join(b.text for b in html.blocks(page)[1:]) == "One two. Three four five. Six x=2 seven eight nine."


def test_whole_texts_of_held_out_pages():
    field, exact, pages = html.default_field(), 0, list(html.labelled_pages(100, seed=91))
    for page, good in pages:
        b, y = html.label(page, good)
        exact += html.main_text(page, field) == " ".join(x.text for x, keep in zip(b, y, strict=True) if keep)
    assert exact > 0.85 * len(pages)
