"""Main text of web pages by a graphical model over the DOM tree.

Every block element and every run of text is a node with two states, content
and boilerplate.  A node's own potential is a logistic score of its features; a
potential on each edge ties it to its parent.  Sum-product messages go from the
leaves to the root and back, which gives exact marginals on a tree; runs whose
marginal is over one half are the main text.  Both kinds of potentials are
trained from labelled pages."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches

#: Labelled pages that the model is trained on.
TRAINING_PAGES = 500

# Fixed values of HTML: inline elements, elements without an end tag, elements
# whose text is no text of the page, and which open elements an element ends.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var img wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
HIDDEN = frozenset("script style noscript template iframe svg math object title select textarea button canvas "
                   "video audio".split())
#: Hidden elements that hold no elements: without an end tag they run to the
#: end of the page.
RAW = frozenset("script style iframe title textarea".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
          "body": ("head", "p")}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
          "thead": ("table",), "tbody": ("table",)}

# Quotes only quote behind an equals sign; elsewhere, and inside an unquoted
# value, they are characters like others.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>"'=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s<>]*)|["'])*+)>"""
                  r"""|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]{2,}")
_STOP = re.compile(r"[.!?]['\"»”]*(?:\s|\Z)")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_MARK = re.compile(r'data-content="([01])"')
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_NESTED = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN - RAW))})\b", re.I)


@dataclass
class Tree:
    """Nodes in document order, so parents come before their children."""
    parent: list[int]
    features: list[tuple[str, ...]]
    text: list[str | None]
    label: list[int]


def _text_features(text: str, linked: int, raw: int) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = "1" if n < 4 else "4" if n < 10 else "10" if n < 25 else "25"
    share = linked / raw if raw else 0.0
    links = "no" if share == 0 else "few" if share < 0.5 else "many"
    out = ("text", f"words={size}", f"links={links}", "stop" if text[-1] in ".!?:;\"'»”…" else "no stop")
    if "\xa9" in text or "all rights reserved" in text.lower():
        out += ("copyright",)
    return out


def _inside_features(words: int, linked: int, stops: int) -> tuple[str, ...]:
    """What an element holds: how many words, their share in links, sentences."""
    size = "0" if not words else "1" if words < 15 else "15" if words < 60 else "60" if words < 200 else "200"
    share = linked / words if words else 0.0
    return (f"holds={size}", f"links inside={'no' if share < 0.05 else 'some' if share < 0.4 else 'many'}",
            f"sentences={'0' if not stops else '1' if stops < 3 else '3' if stops < 8 else '8'}")


_ELEMENTS: dict[tuple[str, str], tuple[str, ...]] = {}


def _element_features(tag: str, attrs: str) -> tuple[str, ...]:
    key = (tag, attrs)
    got = _ELEMENTS.get(key)
    if got is None:
        if len(_ELEMENTS) > 20_000:
            _ELEMENTS.clear()
        named = " ".join(m[1] for m in _ATTR.finditer(attrs)) if attrs else ""
        words = sorted(set(_WORD.findall(_CAMEL.sub(r"\1 \2", named).lower())))
        got = _ELEMENTS[key] = ("element", f"tag={tag}", *(f"name={w}" for w in words))
    return got


def _raw_end(page: str, tag: str, pos: int) -> int:
    end = _END[tag].search(page, pos)
    return end.end() if end else len(page)


def _hidden_ends(page: str) -> dict[int, int]:
    """By the places behind their start tags, the ends of the hidden elements
    that may hold elements.  One that its parent closes, or the next button a
    button, lacks its end tag and is not in the table."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    many: Counter = Counter()                       # open elements by name

    def pop(tag: str) -> int:
        while True:
            name, at = stack.pop()
            many[name] -= 1
            if name == tag:
                return at

    pos = 0
    for m in _TAG.finditer(page):
        if m.start() < pos or not m[2]:
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if many[tag]:
                at = pop(tag)
                if tag in HIDDEN:
                    ends[at] = pos
        elif tag in RAW:
            if not m[3].endswith("/"):
                pos = _raw_end(page, tag, pos)
        elif tag not in INLINE and tag not in VOID and tag != "br" and not m[3].endswith("/"):
            if tag == "button" and many[tag]:
                pop(tag)
            stack.append((tag, m.end()))
            many[tag] += 1
    return ends


def dom(page: str) -> Tree:
    """The tree of a page.  Inline elements are part of the text around them,
    a line break is a space, unclosed elements end where HTML ends them.  The
    text of hidden elements is left out; one that lacks its end tag, though it
    may hold elements, hides the text up to the next element only."""
    hidden = _hidden_ends(page) if _NESTED.search(page) else {}
    mute = False
    t = Tree([-1], [("element", "tag=#root")], [None], [0])
    stack: list[tuple[str, int]] = [("#root", 0)]
    depth: Counter = Counter()                      # open elements by name
    sums = [(0, 0, 0)]                              # words, of them in links, sentences
    buf: list[str] = []
    link, linked, raw, pos = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, raw
        if buf:
            s = "".join(buf)
            buf.clear()
            s = " ".join((entities.unescape(s) if "&" in s else s).split())
            if s:
                up = stack[-1][1]
                t.parent.append(up)
                t.features.append(_text_features(s, linked, raw))
                t.text.append(s)
                t.label.append(t.label[up])
                n = s.count(" ") + 1
                sums.append((n, n * linked // raw if raw else 0, len(_STOP.findall(s))))
            linked = raw = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            depth[stack.pop()[0]] -= 1

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(depth[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                pop(k)
                return
            if stack[k][0] in scope:
                return

    def say(text: str) -> None:
        nonlocal linked, raw
        buf.append(text)
        raw += len(text)
        if link:
            linked += len(text)

    for m in _TAG.finditer(page):
        start = m.start()
        if start < pos:
            continue
        if start > pos and not mute:
            say(page[pos:start])
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[1] else 1
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in HIDDEN:
            mute = False
            if not m[1] and not m[3].endswith("/"):
                if tag in RAW:
                    pos = _raw_end(page, tag, pos)
                elif pos in hidden:
                    pos = hidden[pos]
                else:
                    mute = True
            buf.append(" ")
            continue
        mute = False
        flush()
        if tag in VOID:
            continue
        if m[1]:
            link = 0
            close((tag,), ())
            continue
        if stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag in CLOSES:
            while len(stack) > 1 and stack[-1][0] in CLOSES[tag]:
                pop(len(stack) - 1)
            close(CLOSES[tag], SCOPES.get(tag, ()))
        up = stack[-1][1]
        mark = _MARK.search(m[3]) if "data-content" in m[3] else None
        t.parent.append(up)
        t.features.append(_element_features(tag, m[3]))
        t.text.append(None)
        t.label.append(int(mark[1]) if mark else t.label[up])
        sums.append((0, 0, 0))
        if not m[3].endswith("/"):
            stack.append((tag, len(t.parent) - 1))
            depth[tag] += 1
    if pos < len(page) and not mute:
        say(page[pos:])
    flush()
    for i in range(len(sums) - 1, 0, -1):
        up = t.parent[i]
        sums[up] = tuple(a + b for a, b in zip(sums[up], sums[i]))
    for i, inside in enumerate(sums):
        if t.text[i] is None:
            t.features[i] += _inside_features(*inside)
    return t


@dataclass
class Model:
    """Feature weights (log-odds of content), and per kind of child (text,
    element) the log-potentials of (parent state, child state)."""
    weights: dict[str, float]
    edges: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def score(self, features: tuple[str, ...]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def marginals(t: Tree, model: Model) -> list[float]:
    """Probability of content of every node, by sum-product: one sweep from the
    last node to the root gathers messages, one back hands them down."""
    n = len(t.parent)
    own = [model.score(f) for f in t.features]      # log-odds, messages from below added
    up = [0.0] * n                                  # log-odds message to the parent
    kinds = [model.edges[f[0]] for f in t.features]
    for i in range(n - 1, 0, -1):
        e = kinds[i]
        x = own[i]
        up[i] = _log_add(e[1][0], e[1][1] + x) - _log_add(e[0][0], e[0][1] + x)
        own[t.parent[i]] += up[i]
    out = own
    for i in range(1, n):
        e = kinds[i]
        x = out[t.parent[i]] - up[i]                # the parent without this child
        out[i] += _log_add(e[0][1], e[1][1] + x) - _log_add(e[0][0], e[1][0] + x)
    return [1 / (1 + math.exp(-min(60.0, max(-60.0, x)))) for x in out]


def train(pages: list[str], rounds: int = 400, rate: float = 0.5, shrink: float = 1e-4) -> Model:
    """Potentials from labelled pages, in which ``data-content="1"`` or ``"0"``
    marks an element and what is inside it.  Own potentials are a logistic
    regression of the labels; edge potentials are what a parent's state adds to
    a child's, from counts."""
    trees = [dom(p) for p in pages]
    # nodes of equal features are one row with their counts
    counts: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    for t in trees:
        for fs, y in zip(t.features, t.label):
            counts[fs][y] += 1
    names = sorted({f for fs in counts for f in fs})
    number = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    for row, fs in enumerate(counts):
        x[row, [number[f] for f in fs]] = 1
    c = np.array(list(counts.values()), float)
    total, hits = c.sum(1), c[:, 1]
    w = np.zeros(len(names))
    step = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = 0.9 * step + rate * (x.T @ (hits - total * p) / total.sum() - shrink * w)
        w += step
    seen: dict[str, Counter] = defaultdict(Counter)
    for t in trees:
        for i in range(1, len(t.parent)):
            seen[t.features[i][0]][t.label[t.parent[i]], t.label[i]] += 1
    edges = {}
    for kind, pairs in seen.items():
        share = [(pairs[0, s] + pairs[1, s] + 1) / (sum(pairs.values()) + 2) for s in (0, 1)]
        edges[kind] = tuple(tuple(math.log((pairs[a, s] + 0.5) / (pairs[a, 0] + pairs[a, 1] + 1) / share[s]) for s in (0, 1))
                            for a in (0, 1))
    return Model(dict(zip(names, w.tolist())), edges)


#: Containers of the article: layout -> (element, names, one of which it gets).
LAYOUTS = {"article": ("article", ("",)), "named article": ("article", ("post", "entry")), "main": ("main", ("",)),
           "section": ("section", ("content", "story")),
           "named div": ("div", ("content", "article", "post", "entry", "main", "text", "body", "story")),
           "plain div": ("div", ("",)), "nested divs": ("div", ("",)), "odd names": ("div", ("x1", "col", "left", "c-7f", "inner"))}


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> list[str]:
    """Labelled pages of many layouts, with invented words: articles under
    different containers, among menus, headers, sidebars, notices, adverts,
    forms, comments and footers."""
    r = random.Random(seed)
    parts = "ka lo mi ter su ven dra pol ix an be tor qui les par en do".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def text(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + r.choice([".", ".", ".", "!", "", "?"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

    def off(tag: str, inner: str, names: list[str]) -> str:
        attr = r.choice(['class="{}"', 'id="{}"', 'class="box {}"']).format(r.choice(names)) if names else ""
        return f'<{tag} {attr} data-content="0">{inner}</{tag}>'

    def menu() -> str:
        tag = r.choice(["nav", "nav", "div", "ul"])
        body = links(r.randint(3, 9))
        return off(tag, body if tag == "ul" else f"<ul>{body}</ul>",
                   ["menu", "nav", "navigation", "breadcrumb"] if tag != "nav" or r.random() < .4 else [])

    def header() -> str:
        return off(r.choice(["header", "header", "div"]), f"<h2>{words(1, 4)}</h2><p>{text(2, 8)}</p>",
                   ["header", "masthead", "banner", "topbar"])

    def notice() -> str:
        return off("div", f"<p>{text(4, 25)}</p>" if r.random() < .5 else text(4, 25),
                   ["notice", "cookie", "cookies", "consent", "alert", "popup"])

    def advert() -> str:
        return off("div", r.choice([text(2, 20), f"<p>{text(3, 20)}</p>", f'<a href="/b">{text(2, 9)}</a>']),
                   ["ad", "ads", "advert", "advertisement", "sponsor", "promo"])

    def form() -> str:
        return off("form", f"<label>{words(1, 4)}</label><input name='q'><p>{text(2, 12)}</p><button>ok</button>",
                   ["search", "login", "subscribe", "newsletter"] if r.random() < .5 else [])

    def sidebar() -> str:
        tag = r.choice(["aside", "aside", "div"])
        return off(tag, f"<h3>{words(1, 4)}</h3><ul>{links(r.randint(2, 6))}</ul><p>{text(4, 30)}</p>",
                   ["sidebar", "related", "widget", "recommended"] if tag == "div" or r.random() < .5 else [])

    def comments() -> str:
        one = "".join(off(r.choice(["div", "li", "article"]), f"<b>{words(1, 2)}</b><p>{text(3, 40)}</p>", ["comment", "reply"])
                      for _ in range(r.randint(1, 5)))
        return off(r.choice(["section", "div"]), f"<h3>{words(1, 3)}</h3>{one}", ["comments", "discussion", "responses"])

    def footer() -> str:
        tag = r.choice(["footer", "footer", "div"])
        return off(tag, r.choice([f"&copy; {words(1, 3)} &middot; {text(3, 20)}", f"<p>{text(3, 20)}</p><ul>{links(3)}</ul>"]),
                   ["footer", "bottom", "copyright"] if tag == "div" or r.random() < .4 else [])

    def paragraph() -> str:
        body = text(*r.choice([(1, 3), (4, 12), (15, 60), (40, 120)]))
        if r.random() < .25:
            body = f"<b>{body}</b>" if r.random() < .5 else f"<b>{body}<br>"
        if r.random() < .15:
            body += f' <a href="/y">{words(1, 3)}</a> {text(3, 12)}'
        return f"<p>{body}" + ("</p>" if r.random() < .85 else "")

    def block() -> str:
        k = r.random()
        if k < .74:
            return paragraph()
        if k < .82:
            return f"<h{r.randint(2, 4)}>{words(2, 7)}</h{r.randint(2, 4)}>"
        if k < .88:
            return "<ul>" + "".join(f"<li>{text(3, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < .92:
            return f"<blockquote><p>{text(8, 40)}</p></blockquote>"
        if k < .96:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src='a.png'><figcaption>{text(3, 12)}</figcaption></figure>"

    def article() -> str:
        layout = r.choice(layouts)
        tag, names = LAYOUTS[layout]
        inner = [f"<h1>{words(2, 9)}</h1>"] if r.random() < .8 else []
        for _ in range(r.choice([0, 1, 2, 5, 9, 14])):
            inner.append(block())
            if r.random() < .08:
                inner.append(r.choice([advert, sidebar, form, notice, menu])())
        if not inner:
            inner = [paragraph()]
        if r.random() < .2:
            inner.append(r.choice([comments, footer])())
        name = r.choice(names)
        if layout == "nested divs":
            cut = r.randrange(len(inner) + 1)
            inner = [f"<div>{''.join(part)}</div>" for part in (inner[:cut], inner[cut:]) if part]
        return f'<{tag} {f"class=\'{name}\'" if name else ""} data-content="1">{"".join(inner)}</{tag}>'

    out = []
    for _ in range(n):
        top = [f for f in (header, menu, notice, advert) if r.random() < .6]
        end = [f for f in (sidebar, comments, form, advert, footer) if r.random() < .5]
        r.shuffle(top)
        body = "".join(f() for f in top) + article() + "".join(f() for f in end)
        if r.random() < .4:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return out


def main_text(page: str | None, model: Model) -> str:
    """The main text of a page: its content runs in page order, joined by one
    space; empty if there is none."""
    t = dom(page or "")
    p = marginals(t, model)
    return " ".join(s for s, x in zip(t.text, p) if s is not None and x > 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: Model | None = None) -> DataFrame:
    """``id_col, url_col, text`` per row, from the whole page.

    A null or blank page has an empty text, repeated rows come out once each,
    other columns are ignored, an empty table gives no rows.  A narrow pass;
    the model, a few hundred numbers, travels with the tasks."""
    require(pages, id_col, url_col, html_col)
    small_batches(pages.sparkSession)
    model = model or train(labelled_pages())
    slim = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=[id_col, url_col, "text"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:2], T.StructField("text", T.StringType())]))
