"""Decontamination, tokenizer alignment and source divergence against brute
force, with the odd rows each has to bear."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reqlens.llm import decontaminate, divergence_audit, tokenizer_alignment

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, value long, block int, n_hit int"

POEM = "The quick brown fox jumps over the lazy dog while seven Zebras watch quietly from the old stone bridge"
ITEMS = [("7", POEM), ("10", "quick brown fox jumps over the lazy dog while seven zebras"), ("9", "Only Four words here"),
         ("3", ""), ("4", None), ("8", "été"), (None, "no id but words"), ("7", POEM)]


# -- decontamination --------------------------------------------------------

def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, n=10):
    w, hit, which = fold(text), set(), set()
    for item, t in items:
        own = fold(t)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(w) - size + 1):
                if w[at:at + size] == own[i:i + size]:
                    hit |= set(range(at, at + size))
                    which.add(item or "")
    return len(w), len(hit), sorted(which)


def doc_rows():
    texts = ["Nothing here", None, "", POEM, "x. " + POEM.upper() + " -- and " + POEM.replace(" ", "\n\t, "),
             " ".join(POEM.split()[3:14]), " ".join(POEM.split()[:9]), "only four WORDS here, été; ÉTÉ", "no id but words",
             "a b " * 30_000 + POEM + " c", POEM.replace("seven", "eight"), "only four words\x00here", "!!! ... ---",
             "été été", "the quick " * 50 + POEM + "été"]
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, POEM, None, None, 1, 2, 3), (None, "clean", None, None, 1, 2, 3)]


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_contamination_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", limit)
    rows = doc_rows()
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id string, text string, items int")
    got = decontaminate.contamination(docs, items).collect()
    want = Counter((r[0], r[1], *map(str, brute_hits(r[1], ITEMS))) for r in rows)
    assert Counter((r.doc_id, r.text, str(r.n_words), str(r.n_hit), str(list(r["items"]))) for r in got) == want
    for r in got:
        assert sum(len(fold(r.text[s.start:s.end])) for s in r.spans) == r.n_hit
    assert decontaminate.contamination(docs.filter("1 = 0"), items).count() == 0
    assert decontaminate.contamination(docs, items.filter("1 = 0")).filter("n_hit > 0").count() == 0


def test_decontaminate_removes_spans_or_documents(spark):
    items = spark.createDataFrame([("1", POEM)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"été avant, {POEM}! après. {POEM.lower()}", 5), (2, "clean text", 6), (3, None, 7)],
                                 "doc_id long, text string, n_hit long")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [
        (2, "clean text", 6), (3, None, 7)]
    cut = decontaminate.decontaminate(docs, items, whole_documents=False)
    assert cut.columns == docs.columns
    assert [tuple(r) for r in cut.orderBy("doc_id").collect()] == [(1, "été avant, ! après. ", 5), (2, "clean text", 6), (3, None, 7)]


def test_no_window_reaches_over_documents(spark):
    w = POEM.split()
    docs = spark.createDataFrame([(1, " ".join(w[:9])), (2, " ".join(w[9:]))], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("1", " ".join(w[4:14]))], "item_id string, text string")
    assert decontaminate.contamination(docs, items).filter("n_hit > 0").count() == 0


# -- alignment ---------------------------------------------------------------

def brute_alignment(texts):
    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    docs = []
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if t and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, x, y, at_a, at_b = [], [], [], 0, 0
        i = j = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                x.append(a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                y.append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append((x, y))
                x, y = [], []
        docs.append((len(a), len(b), groups))
    held = Counter(p for _, _, g in docs for p in {(u, v) for x, y in g for u in x for v in y})
    most = defaultdict(int)
    for (u, _), n in held.items():
        most[u] = max(most[u], n)
    out = []
    for n_a, n_b, groups in docs:
        links = [(u, v) for x, y in groups for u in x for v in y]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(told.encode()).hexdigest() if n_a else ""))
    return out


@pytest.mark.parametrize("block", [tokenizer_alignment.BLOCK_BYTES, 60])
def test_alignment_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tokenizer_alignment, "BLOCK_BYTES", block)
    texts = [None, "", " ", "a", "Hello world, the tokenizers differ.", "Hello world, the tokenizers differ.", "  two  spaces \n\n tabs\t\tx ",
             "<|endoftext|> and </s> <s> <0x41> <unk>", "été ÑAÑDÚ 東京都 🙂🙂👩‍👩‍👧 ไทย", "▁marked▁", "=" * 700 + " end", "x" + "=" * 333,
             "".join(base64.b64encode(hashlib.sha256(bytes([k])).digest()).decode() for k in range(9)), "line\r\nline\x00nul",
             "don't we'll I'm 12345 67.89", "the the the", " lead", "trail ", "word " * 3000, "ﬁ ligature ½  nbsp  em"]
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in enumerate(texts)] + [(None, "the end", None, None, 1, 2, 3)] * 2
    got = tokenizer_alignment.align(spark.createDataFrame(rows, DOCS).coalesce(2), BYTE_BPE, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([r[1] for r in rows])
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], *w) for r, w in zip(rows, want))
    empty = spark.createDataFrame([], DOCS)
    assert tokenizer_alignment.align(empty, BYTE_BPE, PIECES).count() == 0


def test_pointers_meet_at_the_terminal_token():
    import numpy as np
    a, b = np.array([2, 4, 9, 10, 12]), np.array([1, 3, 5, 6, 9, 12])
    of_a, of_b = tokenizer_alignment.terminals(a, b)
    assert of_a.tolist() == [4, 4, 4, 5, 5] and of_b.tolist() == [4, 4, 4, 4, 4, 5]
    none = np.empty(0, np.int64)
    assert [x.tolist() for x in tokenizer_alignment.terminals(none, none)] == [[], []]


# -- divergence --------------------------------------------------------------

def brute_audit(rows, min_docs=10, top=10):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (its, t), k in docs.items() if its == lang and k >= min_docs]
        own = sorted(s for its, s in groups if its == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        counts = {s: Counter({t: n[lang, s, t] for t in kept}) for s in own}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))

        def ranked(part, s, found, most=None):
            order = sorted(found, key=lambda e: (-e[1], e[0].encode()))
            return {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(order[:most])}

        for s in own:
            out |= ranked("pair", s, [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in own if o != s])
            out |= ranked("term", s, [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept
                                      if counts[s][t] and p[s][t] > q[t]], top)
    return out


@pytest.mark.parametrize("chunk,held", [(divergence_audit.CHUNK_TERMS, divergence_audit.HELD_TERMS), (3, 5)])
def test_audit_matches_brute_force(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(divergence_audit, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence_audit, "HELD_TERMS", held)
    import random
    rng = random.Random(3)
    words = ["alpha", "Beta", "gam-ma", "déjà", "ÉTÉ", "zeta's", "東京", "n0de", "x"] + [f"rare{c}" for c in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]),
             rng.choice(["hot", "hot", "a", "b", None]), 1, 2, 3) for i in range(400)]
    rows += [(9, "once", "fr", "solo", 1, 2, 3), (9, "alone", "fr", "duo", 1, 2, 3), (9, None, "en", "mute", 1, 2, 3), (9, "!!!", "en", "mark", 1, 2, 3)]
    rows += rows[:20] + [(1, "beta " * 60_000, "en", "long", 1, 2, 3)]
    got = divergence_audit.audit(spark.createDataFrame(rows, DOCS))
    assert [tuple(r) for r in got.groupBy("lang", "source", "part", "item").count().filter("count > 1").collect()] == []
    assert {tuple(r) for r in got.collect()} == brute_audit(rows)
    assert divergence_audit.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    import numpy as np
    counts = np.array([10**13, 0, 3, 10**13])
    assert divergence_audit.shares(counts, 3 * 10**13, 7).tolist() == [
        1 + 10**9 * (c + 2) // (3 * 10**13 + 14) for c in counts.tolist()]


def test_column_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(divergence_audit._share(F.lit(10**13), F.lit(3 * 10**13), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)
