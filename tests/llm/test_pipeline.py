"""The pipeline against a brute-force version, and its registration."""

import random
from collections import Counter

import __spark_entry__ as E
import corpus_pipeline
from test_texts import KEY, brute_components, brute_measures, words


def table():
    r = random.Random(4)

    def text(n):
        return " ".join(r.choice("abcdefgh") + str(r.randint(0, 3000)) + "ern" for _ in range(n))
    rows = []
    for i in range(30):
        rows.append((i, text(r.randint(55, 200))))
    rows += [(40, rows[3][1]), (41, rows[4][1] + " extra"), (42, "short"), (43, None), (44, ""), (45, "x y z " * 100),
             (46, rows[5][1].upper()), (47, " ".join(w + "###" for w in words(rows[6][1]))),
             (48, text(60) + f' token = "{KEY}" ' + text(20)), (49, text(5000))]
    return rows


def brute(rows):
    kept = []
    for i, t in rows:
        n, chars, symbols, dup, repeat = brute_measures(t)
        lines = len([x for x in (t or "").split("\n") if words(x)])
        upper = sum(c.isupper() for c in t or "")
        letters = sum(c.isalpha() for c in t or "")
        fatal = n < 50 or repeat * 2 > n or 10 * symbols > n or 100 * dup > 40 * lines or 100 * upper > 60 * letters
        soft = (100 * letters < 50 * chars) + (chars > 15 * n) + (chars < 2 * n)
        if not fatal and soft <= 1:
            kept.append((i, t))
    single = {i for i, _, c in brute_components(kept) if i == c}
    return [(i, t.replace(KEY, "[SECRET]")) for i, t in kept if i in single]


def test_pipeline_matches_brute_force(spark, scratch):
    from tokenizers import Tokenizer
    rows = table()
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], cols).write.parquet(f"{scratch}/documents.parquet")
    want = brute(rows)
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    tok.encode_special_tokens = True
    pieces = Counter()
    for i, t in want:
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        pieces.update((i, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
    got = corpus_pipeline.run(spark, scratch).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == pieces
    assert {40, 41, 42, 43, 44, 45, 46, 47}.isdisjoint(r.doc_id for r in got) and {48, 49} <= {r.doc_id for r in got}


def test_stages_keep_columns(spark, scratch):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, scratch).columns == docs.columns


def test_every_operator_is_registered():
    names = E.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_near_duplicate_stage_takes_80_percent(spark, scratch):
    """Against brute force at 0.8, with pairs between 0.80 and 0.85 and below 0.8."""
    r = random.Random(8)
    rows, least = [], []
    for k in range(60):
        base = [f"w{r.randint(0, 10**9)}" for _ in range(270)]
        copy = list(base)
        for at in range(20, 20 + 30 * (5 if k % 3 else 8), 30):   # 5 or 8 words changed, 5 shingles each
            copy[at] = f"x{r.randint(0, 10**9)}"
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        share = len(a & b) / len(a | b)
        assert 0.80 <= share < 0.85 if k % 3 else share < 0.8
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(copy), "en", "s", 1)]
        least += [2 * k] if k % 3 else [2 * k, 2 * k + 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, scratch)
    assert sorted(x.doc_id for x in got.collect()) == least
