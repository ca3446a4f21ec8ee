"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text between block boundaries) with
ancestor tags, class and id words and text features. The field is trained by gradient
ascent on labelled pages, which ``labelled_pages`` lays out in many ways, and decodes each
page by Viterbi. Blocks labelled content, in page order, are the text."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidy

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|(?P<rest>[^>]*)>)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
#: Their content is no text of the page: code, drawings, form values. All else is kept, or left out by the field.
_RAW = {"script", "style", "template", "iframe", "svg", "canvas", "textarea", "select"}
_VOID = {"img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr math mi mo mn ms mtext mrow msup msub mfrac msqrt semantics annotation object".split())
#: What an opening tag closes, if it is open above the nearest of the containers.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
_CONTAINERS = {"ul", "ol", "dl", "table", "html"}
_SECTIONS = {"article", "main", "section", "aside", "nav", "header", "footer", "form", "head", "body"}


class Block:
    __slots__ = ("text", "tag", "above", "names", "home", "linked")

    def __init__(self, text, tag, above, names, home, linked):
        self.text, self.tag, self.above, self.names, self.home, self.linked = text, tag, above, names, home, linked


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order. Scripts, styles and comments have no text; white space in a
    block is one blank; character references are decoded; never fails on broken markup."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset, str]] = []
    pieces: list[str] = []
    linked, anchors, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, *(stack[-1] if stack else _NOWHERE), linked))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                linked += len(text.strip())

    def close(tags: set, until: set) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag, end = m["tag"].lower(), m["end"]
        if not end and tag in _RAW:
            if tag == "svg" and (m["attrs"] if m["attrs"] is not None else m["rest"]).rstrip().endswith("/"):
                continue  # closed at once
            stop = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            pieces.append(" ")
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            anchors = 0 if end else 1
        elif tag in _INLINE or tag in _VOID:
            continue
        elif tag == "hr":
            flush()
        elif end:
            close({tag}, set())
        else:
            flush()
            anchors = 0
            if tag in _CLOSES:
                close(_CLOSES[tag], _CONTAINERS)
            elif stack and stack[-1][0] in ("p", "title", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            attrs = m["attrs"] if m["attrs"] is not None else m["rest"]
            _, above, names, home = stack[-1] if stack else _NOWHERE
            if attrs:
                words = {w.lower() for a in _ATTR.finditer(attrs) for w in _WORD.findall(a[2] or a[3] or a[4] or "")}
                if words:
                    names = names | words
            stack.append((tag, above | {tag}, names, tag if tag in _SECTIONS else home))
    add(html[at:])
    flush()
    return out


_NOWHERE = ("", frozenset(), frozenset(), "")


def _bin(x: float, cuts: tuple) -> int:
    return sum(x >= c for c in cuts)


def features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    for i, b in enumerate(page):
        words = b.text.split()
        size = len(words)
        ends = sum(b.text.count(c) for c in ".!?")
        f = ["bias", f"tag={b.tag}", f"size={_bin(size, (2, 4, 8, 16, 32, 64))}", f"links={_bin(b.linked / max(1, len(b.text)), (0.01, 0.3, 0.7, 0.95))}", f"stops={_bin(ends / size, (0.01, 0.05, 0.15))}", f"place={_bin(i / n, (0.1, 0.3, 0.7, 0.9))}"]
        f += [f"above={t}" for t in b.above]
        f += [f"name={w}" for w in b.names]
        if not b.names:
            f.append("unnamed")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("copyright")
        if b.text[-1] in ".!?…\"”":
            f.append("ends")
        f.append(f"home={b.home},{'named' if b.names else 'plain'}")
        f.append(f"tag,size={b.tag},{_bin(size, (4, 16))}")
        out.append(f)
    return out


# Labelled pages ------------------------------------------------------------------------

_SYLLABLES = "an re the ti on ent er ion sh wh ou ea ly ing and ble st ha or ed de le qu ré è au ch sch keit ung zu ver ión ado ez ll ñ ra os ü ä".split()
#: Names that page authors give to what is not the article.
_NAMES = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs tabs mainmenu skip toolbar pagination pager",
    "head": "header masthead banner top branding logo sitehead topbar",
    "foot": "footer foot bottom colophon copyright legal sitefooter",
    "side": "sidebar side aside widget related rail popular trending recommended secondary tags archive blogroll toc",
    "note": "notice cookie cookies consent alert gdpr popup modal message banner warning overlay paywall privacy info",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense banner advertising adbox teaser",
    "form": "form newsletter subscribe signup login search register contact poll survey feedback",
    "talk": "comments comment discussion replies responses reader disqus thread reply commentlist respond",
    "share": "share social sharing byline meta author related more follow print",
}
_MAIN = "content article post entry main story body text page single articlebody postcontent maincontent entrycontent".split()


def _text(rng: random.Random, least: int, most: int, stop: bool = True) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    if stop:
        words = [w + (rng.choice(".,.") if rng.random() < 0.15 else "") for w in words]
    text = " ".join(words).capitalize()
    return text + "." if stop and rng.random() < 0.85 else text


def labelled_pages(count: int, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the blocks that are content) of generated pages."""
    rng = random.Random(seed)
    esc = lambda t: t.replace("&", "&amp;")
    for _ in range(count):
        good: set[str] = set()

        def attr(kind: str, rng=rng) -> str:
            if rng.random() < 0.2:
                return ""
            name = rng.choice(_NAMES[kind].split() if kind in _NAMES else _MAIN)
            if rng.random() < 0.3:
                name += rng.choice(["-box", "_wrap", " clearfix", "-1", " block", "-list"])
            return f' {rng.choice(["class", "class", "id"])}="{name}"'

        def wrap(kind: str, tags: str, inner: str) -> str:
            tag = rng.choice(tags.split())
            a = attr(kind)
            if tag in ("div", "section", "p", "ul") and not a:  # nothing else tells these from the article's own
                a = f' class="{rng.choice((_NAMES[kind]).split())}"'
            return f"<{tag}{a}>{inner}</{tag}>"

        def links(n: int) -> str:
            items = [f'<a href="/{i}">{esc(_text(rng, 1, 4, False))}</a>' for i in range(n)]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.8 else " ".join(items)

        def boiler(kind: str) -> str:
            long = lambda a, b: f"<p>{_text(rng, a, b)}</p>" if rng.random() < 0.6 else _text(rng, a, b)
            if kind == "menu":
                return wrap(kind, "nav nav div", links(rng.randint(2, 9)))
            if kind == "head":
                return wrap(kind, "header header div", (f"<h1>{_text(rng, 1, 4, False)}</h1>" if rng.random() < 0.3 else f"<div>{_text(rng, 1, 6, False)}</div>") + (links(3) if rng.random() < 0.5 else ""))
            if kind == "foot":
                return wrap(kind, "footer footer div", rng.choice(["&copy; ", "Copyright ", ""]) + _text(rng, 2, 25) + (links(3) if rng.random() < 0.4 else ""))
            if kind == "side":
                return wrap(kind, "aside aside div section", f"<h3>{_text(rng, 1, 4, False)}</h3>" + rng.choice([links(rng.randint(2, 8)), long(5, 60), long(5, 40) + links(4)]))
            if kind in ("note", "ad"):
                return wrap(kind, "div div div section aside p" if kind == "ad" else "div div section", rng.choice([_text(rng, 2, 30), long(3, 40), long(4, 30) + "<button>ok</button>", f'<a href="x">{_text(rng, 3, 15)}</a>']))
            if kind == "form":
                return f"<form{attr(kind)}>" + rng.choice([f"<label>{_text(rng, 1, 5, False)}</label><input name=q>", long(3, 30) + "<input><button>go</button>", f"<fieldset><legend>{_text(rng, 1, 4, False)}</legend>{long(3, 12)}</fieldset>"]) + "</form>"
            if kind == "talk":
                one = lambda: rng.choice([f"<p>{_text(rng, 3, 80)}</p>", f"<div>{_text(rng, 1, 3, False)}</div><p>{_text(rng, 5, 70)}</p>", _text(rng, 4, 40)])
                n = rng.randint(1, 6)
                inner = "<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>" if rng.random() < 0.4 else "".join(f'<div class="{rng.choice(_NAMES["talk"].split())}">{one()}</div>' for _ in range(n))
                return wrap(kind, "section div div aside", (f"<h3>{_text(rng, 1, 3, False)}</h3>" if rng.random() < 0.6 else "") + inner)
            return wrap("share", "div div ul p", links(rng.randint(1, 4)))

        def content(kind: str) -> str:
            def keep(t: str) -> str:
                good.add(" ".join(t.split()))
                return esc(t)

            if kind == "p":
                t = _text(rng, 2, 120)
                if rng.random() < 0.2:
                    good.add(t)
                    half = t.split(" ")
                    cut = rng.randint(0, len(half) - 1)
                    mark = rng.choice(["b", "i", "em", "strong", 'a href="#"', "span"])
                    return f"<p>{esc(' '.join(half[:cut]))} <{mark}>{esc(' '.join(half[cut:]))}</{mark.split()[0]}>" + rng.choice(["</p>", ""])
                return f"<p>{'<b>' if (open_ := rng.random() < 0.2) else ''}{keep(t)}{'<br>' if open_ else '</p>'}"
            if kind == "h":
                h = rng.choice(["h2", "h3", "h4"])
                return f"<{h}>{keep(_text(rng, 1, 10, False))}</{h}>"
            if kind == "list":
                tag = rng.choice(["ul", "ol"])
                return f"<{tag}>" + "".join(f"<li>{keep(_text(rng, 2, 30))}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
            if kind == "quote":
                return f"<blockquote><p>{keep(_text(rng, 4, 60))}</p></blockquote>"
            if kind == "table":
                return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(_text(rng, 1, 5, False))}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
            return f"<div>{keep(_text(rng, 3, 80))}</div>" if kind == "div" else f"<pre>{keep(_text(rng, 3, 30))}</pre>"

        title = _text(rng, 3, 12)
        parts = [] if rng.random() < 0.1 else [f"<h1>{esc(title)}</h1>"]
        if parts:
            good.add(title)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])):
            parts.append(content(rng.choice(["p"] * 12 + ["h", "h", "list", "quote", "table", "div", "pre"])))
            if rng.random() < 0.08:
                parts.append(boiler(rng.choice(["ad", "ad", "side", "form", "share", "note"])))
        if rng.random() < 0.15:
            parts.append(boiler("talk"))
        tag = rng.choice(["article"] * 5 + ["main", "div", "div", "section"])
        body = f"<{tag}{attr('main') if tag != 'div' else f' class={chr(34)}{rng.choice(_MAIN)}{chr(34)}'}>" + "".join(parts) + f"</{tag}>"
        if rng.random() < 0.3:
            body = f"<main>{body}</main>" if rng.random() < 0.5 else f"<div>{body}</div>"
        before = [k for k in ("note", "head", "menu", "ad", "form", "side") if rng.random() < (0.8 if k == "menu" else 0.45)]
        if rng.random() < 0.3:
            rng.shuffle(before)
        after = [k for k in ("share", "talk", "side", "ad", "form", "foot", "note") if rng.random() < (0.85 if k == "foot" else 0.3)]
        head = f"<title>{esc(title)}</title>" if rng.random() < 0.9 else f"<title>{_text(rng, 1, 5)}</title>"
        noise = "<style>p{margin:0}</style><script>var t=\"</p>\";</script>"
        page = f"<!DOCTYPE html><html><head>{head}{noise}</head><body>" + "".join(map(boiler, before)) + "<!-- x -->" + body + "".join(map(boiler, after)) + "</body></html>"
        yield page, good


class Field:
    """Weights of a linear chain with two labels: 0 boilerplate, 1 content."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # of the first and the last block

    def rows(self, page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        known = [[self.names[x] for x in f if x in self.names] for f in features(page)]
        return np.array([i for f in known for i in f], int), np.array([len(f) for f in known])

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[flat], np.cumsum(sizes) - sizes, axis=0) if len(sizes) else np.empty((0, 2))  # every block has "bias"

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi; a tie goes to boilerplate."""
        if not page:
            return []
        s = self.scores(*self.rows(page)).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = s[0][0] + self.ends[0, 0], s[0][1] + self.ends[0, 1]
        back = []
        for x, y in s[1:]:
            p = (a + t00 < b + t10, a + t01 < b + t11)
            a, b = x + max(a + t00, b + t10), y + max(a + t01, b + t11)
            back.append(p)
        label = int(a + self.ends[1, 0] < b + self.ends[1, 1])
        out = [label]
        for p in reversed(back):
            label = int(p[label])
            out.append(label)
        return out[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[int]]], *, rounds: int = 150, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Maximum conditional likelihood by Adam over all pages at once, forward and backward."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    for page, _ in pages:
        for f in features(page):
            for x in f:
                names.setdefault(x, len(names))
    field = Field(names)
    rows = [field.rows(p) for p, _ in pages]
    flat, sizes = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    length = np.array([len(p) for p, _ in pages])
    wide, many = int(length.max()), len(pages)
    at = np.concatenate([i * wide + np.arange(n) for i, n in enumerate(length)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    gold = np.concatenate([y for _, y in pages]).astype(int)
    truth = np.zeros((many * wide, 2))
    truth[at, gold] = 1
    last = np.arange(many), length - 1
    padded = np.full(many * wide, -1)
    padded[at] = gold
    padded = padded.reshape(many, wide)
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = ((padded[:, :-1] == i) & (padded[:, 1:] == j)).sum()
    theta = [field.w, field.t, field.ends]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in theta]
    real = np.arange(wide) < length[:, None]
    for step in range(1, rounds + 1):
        s = np.zeros((many * wide, 2))
        s[at] = field.scores(flat, sizes)
        s = s.reshape(many, wide, 2)
        s[:, 0] += field.ends[0]
        s[last] += field.ends[1]
        fore, aft = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for i in range(1, wide):
            step_in = s[:, i] + _sum_exp(fore[:, i - 1, :, None] + field.t, 1)
            fore[:, i] = np.where(real[:, i, None], step_in, fore[:, i - 1])
        z = _sum_exp(fore[:, -1], 1)
        for i in range(wide - 2, -1, -1):
            step_out = _sum_exp(field.t + (s[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
            aft[:, i] = np.where(real[:, i + 1, None], step_out, 0)
        p = np.exp(fore + aft - z[:, None, None]) * real[:, :, None]
        both = np.exp(fore[:, :-1, :, None] + field.t + (s[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        d = (truth.reshape(many, wide, 2) - p).reshape(-1, 2)[at]
        gw = np.zeros_like(field.w)
        np.add.at(gw, flat, d[owner])
        ge = np.stack([(truth.reshape(many, wide, 2) - p)[:, 0].sum(0), (truth.reshape(many, wide, 2) - p)[last].sum(0)])
        for x, g, (m, v) in zip(theta, (gw, pairs - both.sum((0, 1)), ge), moments, strict=True):
            g = g / many - l2 * x / many * 10
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


def label(html: str, good: set[str]) -> tuple[list[Block], list[int]]:
    page = blocks(html)
    return page, [int(b.text in good and "head" not in b.above) for b in page]


@lru_cache(maxsize=1)
def default_field(count: int = 400) -> Field:
    return train([label(h, g) for h, g in labelled_pages(count)])


def main_text(html: str, field: Field) -> str:
    page = blocks(html)
    return " ".join(b.text for b, y in zip(page, field.decode(page), strict=True) if y)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of text).

    A null or empty page, and one without content, has an empty text; null ids and urls and
    repeated rows keep their rows; the whole page is read, whatever its length."""
    arrow_rows(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py() or "", model) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
