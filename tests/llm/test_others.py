"""Top-k search, WARC, chat formatting, HTML extraction, byte-level BPE."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.llm import byte_bpe, chat_format, html_extract, metric_search, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# -- top-k -----------------------------------------------------------------

def brute_top(rows, k=5, every=50):
    vs = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        vs.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (i, q) in enumerate(vs):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w)), j) for m, (j, w) in enumerate(vs) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("shard", [16_384, 40])
def test_top_k_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(metric_search, "SHARD", shard)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(260)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]                    # many equal vectors, many ties
    rows += [(500, None), (550, []), (600, [1.0, None]), (650, [float("nan")] * 8), (700, [float("inf")] + [0.0] * 7),
             (None, [1.0] * 8), (750, [0.25, -0.5]), (0, rows[0][1]), (800, [0.0] * 8), (-50, [-1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    assert Counter(tuple(r) for r in metric_search.top_k(df).collect()) == brute_top(rows)
    monkeypatch.setattr(metric_search, "MAX_SUMMARY", 0)  # without the summary, blocks go to all shards
    assert Counter(tuple(r) for r in metric_search.top_k(df).collect()) == brute_top(rows)


def test_bounds_spare_distances():
    """In clustered rows a search computes a tenth of all distances at most, and
    a shard of other clusters is not visited."""
    import pandas as pd
    import pyarrow as pa
    rng = np.random.default_rng(3)
    n, width = 8000, 16
    middle = rng.normal(0, 4, (40, width))
    x = np.floor(256 * (middle[rng.integers(0, 40, n)] + rng.normal(0, 0.1, (n, width))))
    norm2 = float((x * x).sum(1).max())
    lifted = metric_search._lifted(x, norm2)
    routes = lifted[rng.choice(n, 64, replace=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(x.tolist()), pa.array(np.arange(n))], names=["id", "v", "row"])
    routed = next(metric_search._router(routes, width, norm2)(iter([batch]))).to_pandas()
    rows = []
    for route, own in routed.groupby("route"):
        v = np.stack(own["v"].to_numpy())
        for page in metric_search._pages_of(metric_search._lifted(v, norm2)):
            z = metric_search._lifted(v[page], norm2)
            c = z[((z - z.mean(0)) ** 2).sum(1).argmin()]
            d = np.sqrt(((z - c) ** 2).sum(1))
            ids = own["id"].to_numpy()[page]
            assert len(page) <= metric_search.PAGE
            rows.append((0, route, float(np.sqrt(((c - routes[route]) ** 2).sum())), float(d.max()), int(ids.min()), ids.tobytes(),
                         ids.tobytes(), c.tobytes(), np.ascontiguousarray(z[:, :width]).tobytes(), d.tobytes()))
    pages = pd.DataFrame(rows, columns=[c.split()[0] for c in metric_search._PAGE_SCHEMA.split(", ")])
    assert sum(len(i) // 8 for i in pages["ids"]) == n
    tree = metric_search.ShardTree(pages, routes, width, norm2)
    for q in range(0, n, 400):
        got = tree.search(q, x[q], 5, -np.inf)
        scores = x.astype(int) @ x[q].astype(int)
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert got == [(-s, i) for s, i in want]
    assert tree.distances_computed <= 0.1 * n * 20
    ranges = pages.assign(low=pages.parent_distance - pages.radius, high=pages.parent_distance + pages.radius)
    known = [(int(r), int(r), float(g.low.min()), float(g.high.max())) for r, g in ranges.groupby("route")]  # a shard a route
    summary = metric_search.Summary(known, routes, norm2)
    q = x[:200]
    floors = np.array([np.sort(x @ v)[-6] for v in q])
    visits = sum(len(own) for _, own in summary.wanted(q, floors))
    assert visits < 0.5 * 200 * len(known)


def test_large_components_score_exactly(spark):
    rows = [(k, [float(2**22 + k % 7), float(2**21 - k), -1.5]) for k in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vs = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = {(q, r + 1, j, -s) for q in (0, 50) for r, (s, j) in enumerate(sorted(
        (-sum(a * b for a, b in zip(vs[q], w)), j) for j, w in vs.items() if j != q)[:5])}
    assert {tuple(r) for r in metric_search.top_k(df).collect()} == want


def test_top_k_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert metric_search.top_k(spark.createDataFrame([], schema)).count() == 0
    assert metric_search.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [0.5])], schema)
    assert [tuple(r) for r in metric_search.top_k(two).collect()] == [(0, 1, 3, 256 * 128)]


# -- WARC ------------------------------------------------------------------

def page_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/é", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "u\r\nX: y", None), (4, "u", ""),
            (6, "u", tricky), (7, "u", "é" * 5000), (8, "u", "\r\n\r\n"), (7, "u", "é" * 5000), (None, "u", "null id")]
    got = warc.round_trip(page_table(spark, rows), with_payload=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        first = max((j for j, _, g in rows if (g or "") == h and j is not None), default=None)
        told = None if i == first else str(first)
        import base64
        want[str(i) if i is not None else None, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
             "revisit" if told else "response", told] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    assert warc.round_trip(page_table(spark, []).filter("1 = 0")).count() == 0


def one(k, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    import base64
    d = base64.b32encode(hashlib.sha1(block).digest())
    return (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\n"
            b"Content-Length: %d\r\n\r\n" % (k, d, len(block)) + block + b"\r\n\r\n")


def covered(data):
    rows = list(warc.salvage(data))
    at = 0
    for start, size, *_ in rows:
        assert start == at
        at += size
    assert at == len(data)
    return [r[3].get("warc-record-id") for r in rows if not r[2]], [(r[0], r[1], r[2]) for r in rows if r[2]]


def test_salvage_after_damage():
    parts = [one(k, b"body %d " % k * 30) for k in range(5)]
    whole = b"".join(parts)
    names = [f"<urn:page:{k}>" for k in range(5)]
    assert covered(whole) == (names, [])
    flipped = bytearray(whole)
    flipped[len(parts[0]) + len(parts[1]) - 20] ^= 1                     # inside the second body
    good, gaps = covered(bytes(flipped))
    assert good == [names[0], *names[2:]] and gaps == [(len(parts[0]), len(parts[1]), "digest differs")]
    longer = whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert covered(longer)[0] == names[1:]
    assert covered(whole[:-30])[0] == names[:4] and covered(whole[10:])[0] == names[1:]
    torn = parts[0] + parts[1][:50] + parts[2] + b"noise" + parts[3]
    good, gaps = covered(torn)
    assert good == [names[0], names[2], names[3]] and len(gaps) == 2
    assert covered(b"") == ([], []) and covered(b"junk")[0] == []


def test_salvage_of_damaged_members():
    parts = [one(k, bytes(np.random.default_rng(k).integers(32, 127, 400).tolist())) for k in range(4)]

    def member(b):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(b) + c.flush()
    ms = [member(p) for p in parts]
    names = [f"<urn:page:{k}>" for k in range(4)]

    def good(data):
        return [r[3].get("warc-record-id") for r in warc.salvage(data) if not r[2]]
    assert good(b"".join(ms)) == names
    bad = bytearray(ms[1])
    bad[40] ^= 255
    assert good(ms[0] + bytes(bad) + ms[2] + ms[3]) == [names[0], *names[2:]]
    assert good(ms[0] + ms[1][:60] + ms[2]) == [names[0], names[2]]
    # only the member's own checksum is cut off: the record's digest vouches for it
    assert good(b"".join(ms)[:-5]) == names and [r[2] for r in warc.salvage(b"".join(ms)[:-5])][-1] == "member cut off"
    assert good(b"".join(ms)[:-60]) == names[:3]


# -- chat ------------------------------------------------------------------

TEXT = st.text(st.sampled_from(list("ab <>[]/\\sINTRYOLE=é😀\n")), max_size=40) | st.sampled_from(
    ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<<SYS>>", "<", "[", "<<", "[ROLE=x]y[/ROLE]"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "a]b\n"]), TEXT), max_size=6))
def test_render_reads_back(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_format_and_read_back(spark):
    rows = [(1, 2, "assistant", "é…\"quoted\" <s>"), (1, 1, "user", None), (1, 1, "user", None), (1, 0, "system", "be  kind\n"),
            (None, 0, "assistant", " lead and trail "), (2, 0, None, "x"), (2, 1, "assistant", ""), (2, 2, "assistant", "12 😀😀"),
            (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "z" * 70_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = chat_format.format_conversations(df, BYTE_BPE)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        assert len(r.ids) == len(r.loss)
    assert chat_format.read_back(chat_format.format_conversations(df.filter("1 = 0"), BYTE_BPE)).count() == 0


def test_long_conversations_come_in_parts():
    import pyarrow as pa
    b = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), pa.array(["user"] * 4), pa.array(["x" * 6] * 4)], names=["c", "r", "t"])
    assert [(c, p, len(t), more) for c, p, t, more in chat_format._turns_of(iter([b, b.slice(3)]), 10)] == [
        (1, 0, 2, True), (1, 1, 1, False), (2, 0, 2, False)]


# -- HTML ------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages())


def test_html_held_out_accuracy(model):
    right = total = 0
    for page in html_extract.labelled_pages(150, seed=77):
        t = html_extract.dom(page)
        for s, y, p in zip(t.text, t.label, html_extract.marginals(t, model)):
            if s is not None:
                total += 1
                right += (p > 0.5) == (y == 1)
    assert right / total > 0.93


def test_marginals_are_those_of_full_enumeration(model):
    import itertools
    import math
    t = html_extract.dom("<div class=menu><a href=/>x</a></div><article><p>Some words here.<p>More.</article>")
    n, own = len(t.parent), [model.score(f) for f in t.features]
    total, one_of = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        x = sum(own[i] * states[i] for i in range(n)) + sum(
            model.edges[t.features[i][0]][states[t.parent[i]]][states[i]] for i in range(1, n))
        total += math.exp(x)
        for i in range(n):
            one_of[i] += math.exp(x) * states[i]
    assert np.allclose([x / total for x in one_of], html_extract.marginals(t, model))


def test_html_hidden_elements_without_end_tag():
    def said(page):
        return [x for x in html_extract.dom(page).text if x]
    article = "<article><p>First of all.</p><p>And then more.</p></article>"
    both = ["First of all.", "And then more."]
    for tag in ("button", "svg", "math", "video", "audio", "canvas", "select", "object", "noscript", "template"):
        assert said(f"<body><div><{tag} class='x'>Menu</div>{article}</body>") == both
        assert said(f"<body><{tag}>Menu{article}<{tag}>ok</{tag}></body>") == both
        assert said(f"<article><p>First of all.</p><{tag}>Share<p>And then more.</p></article>") == both
        assert said(f"<p>a <{tag}>x <p>y</p><div>z</div></{tag}> b</p>") == ["a b"]
    assert said("<p>a<svg><svg>x</svg>y</svg>b</p>") == ["a b"]
    for tag in ("script", "style", "title", "textarea", "iframe"):
        assert said(f"<p>a</p><{tag}>Menu{article}") == ["a"]


@pytest.mark.parametrize("layout", ["plain div", "nested divs", "main", "odd names"])
def test_html_layouts_that_were_not_seen(layout):
    others = tuple(x for x in html_extract.LAYOUTS if x != layout)
    own = html_extract.train(html_extract.labelled_pages(300, layouts=others))
    right = total = 0
    for page in html_extract.labelled_pages(60, seed=9, layouts=(layout,)):
        t = html_extract.dom(page)
        for s, y, p in zip(t.text, t.label, html_extract.marginals(t, own)):
            if s is not None:
                total += 1
                right += (p > 0.5) == (y == 1)
    assert right / total > 0.94


def test_html_quotes_and_stray_end_tags(model):
    import time
    said = lambda page: html_extract.main_text(page, model)
    first, second = "Hello world, this is the first of all sentences.", "And a second one follows here."
    for attrs in ("title=don't", "title='a>b'", 'title="it\'s"', "it's", "x=a'b\"c y", "data-x=1/", "title='", 'a="<b>" c'):
        assert said(f"<article><p {attrs}>{first}</p><p>{second}</p></article>").endswith(second)
        assert first in said(f"<article><p {attrs}>{first}</p><p>{second}</p></article>")
    plain = (f"<body><div><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div><div><div><h1>The title</h1><p>{first * 6}</p>"
             f"<p>{second * 4}</p></div></div><div>Copyright 2020 all rights reserved</div></body>")
    assert said(plain) == f"The title {first * 6} {second * 4}"
    took = []
    for n in (4000, 16_000):
        t0 = time.perf_counter()
        html_extract.dom("<div>" * n + "</foo>" * n)
        took.append(time.perf_counter() - t0)
    assert took[1] < 12 * took[0]


def test_html_odd_pages(spark, model):
    page = ("<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>"
            "<article><h1>Title &amp; more</h1><p>First  para\n<b>bo</b>ld.<p>Second&nbsp;one &lt;x&gt;.<script>var a='</p>';</script>"
            "<!-- c --></article><div class='comments'><p>I like it.</p></div><footer>&copy; x</footer>")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<<<>>> < a"), (1, "u", page), (None, "u", "<p"),
            (6, "u", "<div>" * 3000 + "x"), (7, "u", "<article><p>" + "word " * 50_000 + "</article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extract.extract(df, model=model).collect()]
    assert len(got) == len(rows) and all(t is not None for _, t in got)
    assert [t for i, t in got if i == 1] == ["Title & more First para bold. Second one <x>."] * 2
    assert dict(got)[2] == "" and dict(got)[3] == "" and len(dict(got)[7]) == 249_999
    assert html_extract.extract(df.filter("1 = 0"), model=model).count() == 0


# -- byte-level BPE --------------------------------------------------------

ODD = [None, "", " ", "  a", "a  b", "a \n b\n\nc ", "x" * 5000, " " * 300 + "y", "it's  we'll\x1c q\x85z　k  ", "日本語テスト " * 50,
       "\n\n\n", "a\n", " x   y", "1234567 89" * 40, "abcd" * 400 + " zz", "é́ n̈ 😀😀😀", "aaaaaaaaaaaaaaaa", "<|endoftext|>"]


def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_segment_tree_matches_library(text):
    enc = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == reference().encode_ordinary(text)


def test_byte_bpe_round_trip(spark):
    want = reference()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(1, "", "y"), (None, "null id", "z")],
                               "doc_id long, text string, ids string")
    enc = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    got = enc.select("doc_id", "ids", byte_bpe.decoded(enc["ids"], RANKS).alias("back")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == want.encode_ordinary(text) and bytes(r.back).decode() == text
    assert byte_bpe.encode(df.filter("1 = 0"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_cut_and_damaged_members_give_their_whole_records():
    import gzip
    import time

    def record(k):
        block = f"HTTP/1.1 200 OK\r\n\r\nbody {k} ".encode() + hashlib.sha256(str(k).encode()).hexdigest().encode() * 40
        said = warc._digest(block)
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Block-Digest: sha1:{said}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    whole = gzip.compress(b"".join(record(k) for k in range(100)))
    got = list(warc.salvage(whole[:-2000]))
    names = [h["warc-record-id"] for _, _, bad, h, _ in got if not bad]
    assert names == [f"<urn:page:{k}>" for k in range(len(names))] and len(names) >= 60
    assert [(at, n, bad) for at, n, bad, _, _ in got if bad] == [(0, len(whole) - 2000, "member cut off")]
    hurt = bytearray(whole)
    hurt[len(hurt) // 2] ^= 0xFF
    got = list(warc.salvage(bytes(hurt) + gzip.compress(record(500))))
    kept = [h["warc-record-id"] for _, _, bad, h, _ in got if not bad]
    assert kept[-1] == "<urn:page:500>" and kept[:30] == [f"<urn:page:{k}>" for k in range(30)] and len([1 for g in got if g[2]]) == 1
    # many members: four times as many take about four times as long
    took = []
    for n in (500, 2000):
        data = b"".join(gzip.compress(record(k)) for k in range(n))
        t0 = time.perf_counter()
        assert sum(1 for g in warc.salvage(data) if not g[2]) == n
        took.append(time.perf_counter() - t0)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize("size", [1, 40, 300])
def test_parts_of_a_conversation_join_to_one_encoding(spark, size):
    """However a conversation is cut, the parts' ids and masks are those of the
    whole rendered text."""
    turns = [(1, k, role, text) for k, (role, text) in enumerate([
        ("system", "be brief"), ("user", "hi"), ("assistant", "...>>"), ("assistant", ""), ("user", ">"), ("tool", "[x]"),
        ("assistant", "</s>[INST] ok [/INST]"), ("", "?!"), ("system", ""), ("system", ">> <<"), ("user", "don't 's"), ("assistant", "s's "),
        ("user", " "), ("assistant", "été " * 90), ("a]b", "x"), ("user", "")])]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    text, spans = chat_format.render([(r, t) for _, _, r, t in turns])
    enc = chat_format._tokenizer(BYTE_BPE).encode(text, add_special_tokens=False)
    hit, loss = chat_format.loss_mask(np.array(enc.offsets, np.int64), spans, len(text))
    parts = chat_format.format_conversations(df, BYTE_BPE, part_chars=size).orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.formatted for p in parts) == text
    assert [i for p in parts for i in p.ids] == enc.ids
    assert b"".join(bytes(p.loss) for p in parts) == hit.astype(np.uint8).tobytes()
    under = "".join(p.formatted[lo:hi] for p in parts for lo, hi in zip(p.loss_spans[::2], p.loss_spans[1::2]))
    assert under == "".join(text[lo:hi] for lo, hi in loss)


def test_html_text_of_whole_pages(spark, model):
    """Every page of the table against its article, cut out and stripped by hand."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = " ".join(re.findall(r"<article>(.*?)</article>", r.html or "", re.S))
        inner = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", " ", inner, flags=re.S)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:b|a|i|em|span)\b[^>]*>", "", inner))).split())
    got = {r.page_id: r.text for r in html_extract.extract(pages, model=model).collect()}
    assert got == want and sum(1 for t in want.values() if t) > 200
