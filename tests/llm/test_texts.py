"""Quality rules, near-duplicates, packing, secrets, licences: small tables
against brute force, and the defined results of odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.llm import license_scan, minhash, packing, quality_rules, secret_scan

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, component_id string, kept string, _id string, _w int"


def docs(spark, rows):
    """(doc_id, text) rows beside columns whose names clash with the operators'."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


# -- quality rules ---------------------------------------------------------

def brute_measures(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if words(x)]
    count = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality_measures_match_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b c a b c", "x y z\nx y z\n \nx y z ", "# * $ é|ü <b> &", "one\x0btwo\x0cthree\rfour",
             "a a a a a", "w " * 3000, "é́ 😀 \xa0 b", "p q r s p q r t p q"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a b c")]
    got = quality_rules.ledger(docs(spark, rows)).collect()
    want = Counter((i, *brute_measures(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_quality_policy_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean), (2, "short"), (3, clean.replace("word", "w###")), (4, clean.upper()), (5, clean), (5, clean)]
    table = docs(spark, rows)
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5]
    ab = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(table)).collect()}
    assert ab["few_words"].n_decided == 1 and ab["symbols"].n_decided == 1 and ab["upper_case"].n_decided == 1
    assert ab["few_words"].n_failed == 1


def test_quality_empty_table(spark):
    empty = docs(spark, []).filter("1 = 0")
    assert quality_rules.keep_good(empty).count() == 0
    assert all(r.n_failed == 0 for r in quality_rules.ablation(quality_rules.ledger(empty)).collect())


# -- near-duplicates -------------------------------------------------------

def brute_components(rows):
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None))
                   for k, (i, _) in enumerate(rows))


def near_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, next_id = [], 100

    def add(t):
        nonlocal next_id
        rows.append((next_id, t))
        next_id -= 1
    for size in (2, 3, 40, 90):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                w[at] = rng.choice(vocabulary)
            add(" ".join(w))
    for _ in range(20):
        add(" ".join(rng.choice(vocabulary, 60)))
    shared = rng.choice(vocabulary, 60).tolist()
    for _ in range(30):
        add(" ".join(shared + rng.choice(vocabulary, rng.integers(5, 60)).tolist()))
    odd = [None, "", " \n", "A b C", "a B c", "a b c d", "one", "ONE", "É b c d e f", "é b c d e f", "same text here now ok yes"]
    for t in odd:
        add(t)
    rows += [rows[0], (rows[1][0], "quite other words than before in this row"), (None, "lonely null id row with words"),
             (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("small", [64, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)          # 4: most buckets take the block path
    monkeypatch.setattr(minhash, "BLOCK", 16 if small == 4 else 512)
    monkeypatch.setattr(minhash, "STRAYS", 8 if small == 4 else 256)
    rows = near_rows()
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    long = " ".join(f"t{k}" for k in range(80))
    rows = [(7, long), (3, long), (3, long), (9, long + " more"), (1, None), (2, ""), (4, "other words that stand alone here")]
    out = minhash.drop_near_duplicates(docs(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4]


def test_drop_near_duplicates_judges_rows_not_ids(spark):
    def text(k, n=80):
        return " ".join(f"t{k}x{j}" for j in range(n))
    a, b, c, d, e, f = map(text, range(6))
    rows = [(None, a), (None, b), (None, a), (None, None), (None, " "),           # without an id: a once, b, both blanks
            (5, c), (5, d), (5, d), (5, ""), (5, None),                           # one id, two texts: each once, one blank
            (2, e), (8, e + " more"), (8, f), (None, e + " more"),                # the copies of e go, f stays
            (9, text(6)), (9, text(6) + " more"), (7, text(7)), (None, text(7))]  # a group inside one id; id before null
    out = minhash.drop_near_duplicates(docs(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    got = Counter((r.doc_id, None if not words(r.text) else r.text) for r in out.collect())
    nine = [k for k in got if k[0] == 9]
    assert len(nine) == 1 and got.pop(nine[0]) == 1
    assert got == Counter([(None, a), (None, b), (None, None), (None, None), (5, c), (5, d), (5, None), (2, e), (8, f),
                           (7, text(7))])


def test_near_duplicates_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, []).filter("1 = 0")).count() == 0


# -- packing ---------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_slots_fill_sequences_without_gaps(histogram):
    slots = packing.plan_slots(histogram, 40)
    ranks, places = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in slots:
        for k in range(n):
            ranks[length].append(rank + k)
            places[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 40
    # best fit leaves no two sequences that could be one
    loads = sorted(sum(x for _, x in s) for s in places.values())
    assert len(loads) < 2 or loads[0] + loads[1] > 40
    assert sorted(places) == list(range(len(places)))


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORD_BPE)
    tok.encode_special_tokens = True
    texts = [None, "", "Hello, world.", "it's a\x00b \x00 ÀÉ ŉ İx ΣΑΣ. end.. 12①", "word " * 150, "日本 テスト　q", "x" * 300,
             "<|endoftext|> a", "Hello, world."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "Hello, world."), (None, "null id")]
    packed = packing.pack(docs(spark, rows), WORD_BPE, capacity=64, with_ids=True)
    got = packed.collect()
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 64 * r.piece
        pieces[r.doc_id].append((r.piece, ids))
    for i, t in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        cut = [(k, want[64 * k:64 * k + 64]) for k in range(-(-len(want) // 64))]
        assert [p for p in sorted(pieces[i]) if p in cut][:len(cut)] and all(p in pieces[i] for p in cut)
    assert len(got) == sum(-(-(len(tok.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for _, t in rows)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert sum(map(len, whole.values())) == sum(r.length for r in got)


def test_pack_empty_table(spark):
    assert packing.pack(docs(spark, []).filter("1 = 0"), WORD_BPE).count() == 0


# -- secrets ---------------------------------------------------------------

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def secret_docs(spark):
    return docs(spark, [
        (1, f'set token = "{KEY}" now'), (2, f"commit {KEY} fixes it"), (3, None), (4, ""), (5, "plain words only"),
        (6, f'password = "{KEY[::-1]}" and token = "{KEY}" twice {KEY}'), (1, f'set token = "{KEY}" now'), (None, f'secret = "{KEY}"'),
        (7, "see https://example.com/aaaaaaaaaaaaaaaaaaaaaaa/index9 and VeryLongIdentifierNames2")])


def test_secret_scan_and_redaction(spark):
    table = secret_docs(spark)
    found = secret_scan.scan(table, WORD_BPE).collect()
    by_doc = defaultdict(set)
    for r in found:
        if r.is_secret:
            by_doc[r.doc_id].add(r.token)
    assert by_doc[1] == {KEY} and by_doc[None] == {KEY} and {KEY, KEY[::-1]} <= by_doc[6]
    assert not {2, 3, 4, 5, 7} & set(by_doc)
    assert sum(r.doc_id == 1 for r in found) == 2
    clean = secret_scan.redact(table, WORD_BPE)
    assert clean.columns == table.columns and clean.count() == table.count()
    texts = defaultdict(list)
    for r in clean.collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == ['set token = "[SECRET]" now'] * 2 and texts[3] == [None]
    assert KEY not in texts[6][0] and KEY[::-1] not in texts[6][0] and KEY in texts[2][0]


def test_secret_forest_on_held_out_kinds(spark):
    """Every kind of finding is judged by a forest that has not seen it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    dic = secret_scan.dictionary(spark, WORD_BPE).cache()
    table = secret_scan.transitions(dic)
    rows = secret_scan.labelled_findings(spark, 2500).cache()
    right = {}
    for part in range(4):
        model = secret_scan.fit(rows.filter(f"kind % 4 <> {part}"), dic, table)
        held = VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(
            secret_scan.features(rows.filter(f"kind % 4 = {part}"), dic, table))
        p = F.get(vector_to_array("probability"), F.lit(1))
        judged = model.transform(held).groupBy("kind").agg(F.avg(((p > 0.5) == (F.col("label") > 0)).cast("double")).alias("share"))
        right |= {r.kind: r.share for r in judged.collect()}
    assert len(right) == len(secret_scan._finding_kinds(__import__("random").Random(1)))
    assert sum(right.values()) / len(right) > 0.75, right
    seen = secret_scan.fit(rows.filter("rid < 2000"), dic, table)
    held = VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(
        secret_scan.features(rows.filter("rid >= 2000"), dic, table))
    good = seen.transform(held).filter("label = prediction").count() / held.count()
    assert good > 0.95


def test_masks_go_by_the_row_not_by_the_id(spark):
    """Rows without an id, and rows that share one, do not mask each other."""
    sha = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    rows = [(None, f'secret = "{sha}"'), (None, f"commit {sha} fixed"), (7, f'api_key = "{sha}"'), (7, f"commit {sha}"),
            (7, f"commit {sha}"), (None, None), (8, ""), (None, "long " * 40_000 + f'token = "{KEY}"')]
    clean = secret_scan.redact(docs(spark, rows), WORD_BPE)
    want = [(i, t if t is None or "commit" in t else t.replace(sha, "[SECRET]").replace(KEY, "[SECRET]")) for i, t in rows]
    key = lambda r: (r[0] is None, r[0], r[1] is None, r[1])
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    assert secret_scan.redact(docs(spark, []).filter("1 = 0"), WORD_BPE).count() == 0


def test_chosen_passwords_are_found(spark):
    rows = [(1, "my password=hunter2secret! here"), (2, "password: correct4horse# ok"), (3, "the password: required field")]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, rows), WORD_BPE).collect()}
    assert clean == {1: "my password=[SECRET] here", 2: "password: [SECRET] ok", 3: rows[2][1]}


def brute_candidates(text):
    """Tokens by Python's own regular expressions, word by word."""
    import re
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    out = []
    named = re.compile(secret_scan.NAMED + r"\Z", re.I)
    for k, x in enumerate(w):
        around = " ".join(w[max(0, k - 2):k])
        behind = k > 0 and re.search(r"[=:]>?\Z", w[k - 1]) and named.search(around)
        runs = re.findall(secret_scan.RUN, x)
        found = (re.findall(r"^[\"'`(]*" + secret_scan.VALUE, x) if behind else []) + [
            m.group(1) for m in re.finditer(secret_scan.INNER, x)] + re.findall(secret_scan.LOGIN, x)
        out += [(k, t) for t in runs] + [(k, t) for t in dict.fromkeys(found) if t not in runs]
    return out


def test_candidates_match_brute_force(spark):
    rows = [(1, f'a token = "{KEY}" b'), (2, "mysql://app:pa$$w0rd@db/x and password='s3cret;x'"), (3, None), (4, ""),
            (5, "secret => abc, passwd:=q1w2e3! api_key: zz"), (6, "x" * 70_000 + " password=deep5"), (7, "AKIA" + "Z" * 16 + "==/" + KEY),
            (8, "auth: bearer abcd1234. credential=(tok-en_99)"), (9, "été password: ñandú77! (token=aa)"), (None, "pwd=1234"), (None, "pwd=1234")]
    got = Counter((r.id, r.word_no, r.token) for r in secret_scan.candidates(docs(spark, rows)).collect())
    assert got == Counter((i, k, t) for i, text in rows for k, t in brute_candidates(text))


def test_secrets_behind_long_names_and_short_secrets(spark):
    b64 = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzK3q9LmT2v"
    hidden = {1: (f"run GITHUB_ACCESS_TOKEN={KEY} now", KEY), 2: (f"export AWS_SECRET_ACCESS_KEY={b64} and go", b64),
              3: ('set password = "hT7#kq2!" here', "hT7#kq2!"), 4: ("set passwd=Kolo482! here", "Kolo482!"),
              5: ("use postgres://app:x9Q!vR2mz@db.internal/app here", "x9Q!vR2mz"), 6: ('token = "qzkvjxwpybgtdnrq"', "qzkvjxwpybgtdnrq")}
    plain = {11: "password: required for all", 12: f"the IMAGE_SHA256={KEY}{KEY[:24]} is new", 13: f"set GIT_COMMIT={KEY} here",
             14: "the token: string is optional", 15: "eine geschwindigkeitsbegrenzung of all", 16: "password = ${DB_PASSWORD} here",
             17: "see https://example.com:8080/a@b here"}
    rows = [(i, t) for i, (t, _) in hidden.items()] + list(plain.items())
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, rows), WORD_BPE).collect()}
    assert clean == {i: t.replace(s, "[SECRET]") for i, (t, s) in hidden.items()} | plain


def test_secret_scan_empty_table(spark):
    assert secret_scan.scan(docs(spark, []).filter("1 = 0"), WORD_BPE).count() == 0


# -- licences --------------------------------------------------------------

def brute_licences(rows):
    out = Counter()
    templates = {k: Counter(zip(w, w[1:])) for k, t in license_scan.TEMPLATES.items()
                 for w in [license_scan.template_words(t)]}
    for i, t in rows:
        lines = (t or "").split("\n")
        for unit, x in [(k, x) for k, x in enumerate(lines)] + ([(-1, t)] if len(lines) > 1 else []):
            w = re.findall(r"[^\W_]+", x.lower())
            g = Counter(zip(w, w[1:]))
            best = max(((2 * sum((g & s).values()) / (sum(g.values()) + sum(s.values())), -k, name)
                        for k, (name, s) in enumerate(sorted(templates.items())) if g), default=(0, 0, ""))
            if best[0] >= 0.8:
                out[i, unit, best[2], len(w) - 1, round(best[0], 9)] += 1
    return out


def test_license_scan_matches_brute_force(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, mit), (2, "intro\n" + mit.replace("\n", " ")), (3, None), (4, ""), (5, "Released under the MIT License!\nmore"),
            (5, "Released under the MIT License!\nmore"), (6, "released UNDER the mit licence"), (None, "Licensed under CC BY-NC 4.0."),
            (7, "the the the the " * 50), (8, "licensed under the licensed under the apache license version 2 0")]
    got = license_scan.scan(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.unit, r.license_id, r.n_bigrams, round(r.dice, 9)) for r in got) == brute_licences(rows)
    assert license_scan.scan(docs(spark, []).filter("1 = 0")).count() == 0


def brute_passages(t):
    """All windows of all templates that reach 0.8, then the best apart."""
    w = re.findall(r"[^\W_]+", (t or "").lower())
    pairs, out = list(zip(w, w[1:])), []

    def apart(found):
        kept = []
        for c in sorted(found):
            if all(c[-2] > k[-1] or k[-2] > c[-1] for k in kept):
                kept.append(c)
        return kept
    for name, text in license_scan.TEMPLATES.items():
        tw = license_scan.template_words(text)
        want, m, found = Counter(zip(tw, tw[1:])), len(tw) - 1, []
        for s in range(len(pairs)):
            seen, both = Counter(), 0
            for e in range(s, min(len(pairs), s + 2 * m)):
                seen[pairs[e]] += 1
                both += seen[pairs[e]] <= want[pairs[e]]
                if 2 * both / (e - s + 1 + m) >= 0.8:
                    found.append((-2 * both / (e - s + 1 + m), -both, s, e))
        out += [(b, d, name, s, e) for d, b, s, e in apart(found)]
    return [(s, name, e - s + 1, round(-d, 9)) for _, d, name, s, e in apart(out)]


def test_license_passages_match_brute_force(spark):
    rng = np.random.default_rng(5)

    def prose(n):
        return " ".join(rng.choice(["alpha", "of", "the", "beta", "software", "this", "in", "license", "under"], n))

    def wrapped(name, changed=0):
        w = license_scan.TEMPLATES[name].split()
        for at in rng.choice(len(w), changed, replace=False):
            w[at] = "other"
        return "\n".join("# " + " ".join(w[k:k + 9]) for k in range(0, len(w), 9))
    rows = [(1, "\n".join([prose(300), wrapped("bsd-2-clause", 8), prose(200)])), (2, wrapped("apache-2.0-header", 3) + "\n" + prose(400)),
            (3, prose(40) + " Released under the MIT License. " + prose(40)), (4, None), (5, ""), (6, "word"), (None, prose(50)),
            (7, "\n".join([wrapped("gpl-3.0-header"), wrapped("mit", 4), prose(90), wrapped("mit", 2)])),
            (8, (license_scan.TEMPLATES["cc-by-4.0-notice"] + "\n") * 6), (9, prose(30) + "\n" + wrapped("mpl-2.0-notice", 1)),
            (9, prose(30) + "\n" + wrapped("mpl-2.0-notice", 1)), (10, wrapped("gpl-2.0-notice") + " " + wrapped("mit", 60))]
    got = license_scan.passages(docs(spark, rows)).collect()
    want = Counter((i, *x) for i, t in rows for x in brute_passages(t))
    assert Counter((r.doc_id, r.first_word, r.license_id, r.n_bigrams, round(r.dice, 9)) for r in got) == want
    names = Counter((i, name) for i, _, name, *_ in want.elements())
    assert names[1, "bsd-2-clause"] == 1 and names[2, "apache-2.0-header"] == 1 and names[3, "mit-notice"] == 1
    assert names[7, "gpl-3.0-header"] == 1 and names[7, "mit"] == 2 and names[8, "cc-by-4.0-notice"] == 6
    assert not {r.doc_id for r in license_scan.scan(docs(spark, rows)).collect()} & {1, 3, 7}
    assert license_scan.passages(docs(spark, []).filter("1 = 0")).count() == 0


def test_a_chunk_is_looked_up_once_for_all_its_texts():
    """Whole texts by the tokenizer itself; a chunk of many texts is asked for
    once, however often it occurs."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORD_BPE)
    tok.encode_special_tokens = True
    texts = [None, "", "  \n", "a  b\t", " Éa. x,\x0b\x1c d\0e ", "it's 1.5, <|endoftext|> İ", "word Word. WORD, " * 50]
    enc = packing.ChunkEncoder(WORD_BPE)
    asked = []

    class Memo(dict):
        def __getitem__(self, c):
            asked.append(c)
            return super().__getitem__(c)
    enc._memo = Memo()
    for part in (pa.array(texts), pa.array(["x", *texts])[1:], pa.array(texts, pa.large_string())):
        got = [np.frombuffer(raw, "<u4").tolist() for raw in enc.encode(part)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked.count(b"word,") == 3 and enc.encode(pa.array([], pa.string())) == []
