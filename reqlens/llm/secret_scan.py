"""Secret scan: candidate strings, then a random forest that removes false
positives.

Candidates are runs of 16 or more characters of keys and digests, and values of
four and more characters that are assigned to a name of secrets or stand for the
password of a URL.  The forest sees a candidate's length and character classes, how plausible its letter
transitions are, how much of it a dictionary covers, its path and its
neighbouring words.  It is trained on labelled findings, a bounded table.  All
work on documents is done by DataFrame functions and Spark's own forest."""

from __future__ import annotations

import json
import math
import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import let, require, stage, words

#: Labelled findings that the forest is fitted on, at most.
MAX_FINDINGS = 6000
TREES, DEPTH, SEED = 40, 8, 11
MASK = "[SECRET]"

RUN = "[A-Za-z0-9+/_-]{16,}={0,2}"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Fixed word lists: what secrets are called, what other digests are called,
# and paths of sample files.
SECRET_WORDS = "secret|token|passw|pwd|api_?key|apikey|access_?key|private|credential|auth|bearer|client_?key"
DIGEST_WORDS = "sha|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|version|build|order|trace|id\\b"
SAMPLE_PATHS = "test|example|sample|fixture|mock|docs?/|readme|\\.md|\\.lock|vendor"
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your|xxxx|0000000|1234567|test"

# What a value is assigned to, at the end of the text before it; values inside
# a word, and the password of a URL.
ASSIGNED = "[A-Za-z0-9_.-]*[\"'`]?\\]?\\s*(?:=>|:?=|:)"
NAMED = f"(?i)(?:{SECRET_WORDS}){ASSIGNED}"
VALUE = "((?:(?!&\\w+=)[^\\s\"'`,;]){3,}(?!&\\w+=)[^\\s\"'`,;.)\\]}>])"
INNER = f"{NAMED}[\"'`(]?{VALUE}"
LOGIN = "://[^/\\s:@]*:([^\\s/]+)@"

FEATURES = ["f_length", "f_runs", "f_digits", "f_upper", "f_symbols", "f_distinct", "f_hex", "f_transition",
            "f_dictionary", "f_secret_word", "f_digest_word", "f_assigned", "f_quoted", "f_sample_path",
            "f_placeholder", "f_slashes", "f_login"]


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Words of three and more letters of a public tokenizer's vocabulary file
    (``word``), a fixed table of some ten thousand rows."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    found = sorted({w for t in vocab if t.endswith("</w>") and (w := t[:-4]).isascii() and w.isalpha() and len(w) > 2})
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(found)), " ")).alias("word"))


def transitions(dic: DataFrame) -> list[float]:
    """Log-probability of each letter after each letter, by the dictionary:
    26 * 26 numbers, in alphabetical order."""
    pairs = dic.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    counts = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in LETTERS:
        total = sum(counts.get(a + b, 0) for b in LETTERS) + 26
        out += [math.log((counts.get(a + b, 0) + 1) / total) for b in LETTERS]
    return out


def _digest(text_col: str, path_col: str | None) -> Column:
    """Tells apart rows that share an id, or have none, by text and path."""
    return F.xxhash64(*[F.col(c).cast("string") for c in (text_col, path_col) if c])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: ``id, digest, word_no, part, token, path, before2,
    before, word, after, head, tail``; the last are the word's text before and
    behind the candidate, ``digest`` is :func:`_digest` of the row."""
    require(docs, id_col, text_col)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    hit = docs.filter(F.col(text_col).rlike(f"{RUN}|{LOGIN}|{NAMED}")).select(
        F.col(id_col).alias("id"), _digest(text_col, path_col).alias("digest"), path.alias("path"),
        words(F.col(text_col)).alias("w"))

    def behind_name(before2: Column, before: Column) -> Column:
        return F.coalesce(before.rlike("[=:]>?$") & F.concat_ws(" ", before2, before).rlike(f"{NAMED}$"), F.lit(False))

    def near(w: Column) -> Column:
        return F.filter(F.transform(w, lambda x, i: F.when(
            x.rlike(f"{RUN}|{LOGIN}|{INNER}") | behind_name(F.get(w, i - 2), F.get(w, i - 1)), F.struct(
                i.alias("word_no"), x.alias("word"), F.get(w, i - 2).alias("before2"), F.get(w, i - 1).alias("before"),
                F.get(w, i + 1).alias("after")))), lambda x: x.isNotNull())

    rows = hit.select("id", "digest", "path", F.explode(let(F.col("w"), near)).alias("c")).select("id", "digest", "path", "c.*").select(
        "*", F.regexp_extract_all("word", F.lit(f"({RUN})"), F.lit(1)).alias("runs"), F.split("word", RUN, -1).alias("gaps"))
    # the runs with the text before each, then the values that are no run
    long = F.transform("runs", lambda r, k: F.struct(r.alias("token"), F.concat(F.array_join(F.transform(
        F.slice("runs", 1, k), lambda x, j: F.concat(F.get("gaps", j), x)), ""), F.get("gaps", k)).alias("head")))
    whole = F.when(behind_name(F.col("before2"), F.col("before")), F.regexp_extract_all(
        "word", F.lit(f"^[\"'`(]*{VALUE}"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    values = F.array_distinct(F.concat(whole, F.regexp_extract_all("word", F.lit(INNER), F.lit(1)),
                                       F.regexp_extract_all("word", F.lit(LOGIN), F.lit(1))))
    short = F.transform(F.array_except(values, "runs"), lambda v: F.struct(
        v.alias("token"), F.substring(F.col("word"), F.lit(1), F.call_function("locate", v, F.col("word")) - 1).alias("head")))
    each = rows.select("*", F.posexplode(F.concat(long, short)).alias("part", "f")).drop("runs", "gaps").select(
        "*", "f.token", "f.head").drop("f")
    return each.withColumn("tail", F.expr("substring(word, length(head) + length(token) + 1)"))


def features(found: DataFrame, dic: DataFrame, table: list[float]) -> DataFrame:
    """``found`` (as of :func:`candidates`, with a unique ``rid``) and FEATURES."""
    low = F.lower("token")
    runs = found.select("rid", F.explode(F.expr("regexp_extract_all(token, '([A-Z]?[a-z]+|[A-Z]+)', 1)")).alias("run"))
    known = runs.select("rid", F.lower("run").alias("run")).filter(F.length("run") > 2).join(
        F.broadcast(dic), F.col("run") == F.col("word")).groupBy("rid").agg(F.sum(F.length("run")).alias("covered"))
    size = F.length("token")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace("token", pattern, ""))) / size

    letters = F.regexp_replace(low, "[^a-z]", "")
    logs = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded into one constant

    def mean_log(s: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.get(logs, (
            (F.ascii(F.substring(s, i, F.lit(1))) - 97) * 26 + F.ascii(F.substring(s, i + 1, F.lit(1))) - 97).cast("int")))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.length(s) - 1)

    around = F.lower(F.concat_ws(" ", "before2", "before", "head", "tail"))
    back = F.concat_ws(" ", "before", "head")
    out = {
        "f_length": size.cast("double"),
        "f_runs": F.length(classes) / size,
        "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_symbols": share("[^A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(low, ""))) / size,
        "f_hex": F.col("token").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "f_transition": F.when(F.length(letters) > 1, let(letters, mean_log)).otherwise(F.lit(0.0)),
        "f_dictionary": F.coalesce("covered", F.lit(0)) / size,
        "f_secret_word": around.rlike(SECRET_WORDS).cast("double"),
        "f_digest_word": (around.rlike(DIGEST_WORDS) | F.lower("after").rlike(DIGEST_WORDS)).cast("double"),
        "f_assigned": F.trim(back).rlike("[=:]+>?\\s*[\"'`]?$").cast("double"),
        "f_quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "f_sample_path": F.lower("path").rlike(SAMPLE_PATHS).cast("double"),
        "f_placeholder": low.rlike(PLACEHOLDERS).cast("double"),
        "f_slashes": F.col("word").rlike("://|/.*/").cast("double"),
        "f_login": F.col("head").rlike("://[^/\\s:@]*:$").cast("double"),
    }
    joined = found.join(known, "rid", "left")
    return joined.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.items()]).drop("covered")


def _finding_kinds(r: random.Random) -> list[tuple]:
    """One example of every kind of finding: label, token, path, the two words
    before it, and the text before and behind it in its own word."""
    h = ["%064x" % r.getrandbits(256) for _ in range(3)]
    b64 = "".join(r.choices(string.ascii_letters + string.digits, k=40))
    digits, mark = str(r.randrange(1000)), r.choice("!#$@%*?^")

    def invented(n: int = 3) -> str:
        return "".join(r.choice(("ka", "lo", "mi", "ter", "ven", "dra", "pol", "ing", "tion", "est", "ber")) for _ in range(n))

    def caps() -> str:
        return r.choice(("Request", "Customer", "Handler", "Factory", "Invoice", "Payment", "Session", "Manager"))

    name = r.choice(("token", "secret", "password", "api_key", "auth_token", "SECRET_KEY", "access_key", "TOKEN", "passwd"))
    digest_name = r.choice(("commit", "sha256", "checksum", "md5", "etag", "revision", "digest", "build"))
    plain = r.choice(("the", "of", "see", "with", "from", "und", "que", "les"))
    path = r.choice(("src/main.py", "app/config.yml", "deploy/env.sh", "notes.txt", "data.csv", "server.go"))
    sample = r.choice(("tests/test_login.py", "docs/readme.md", "examples/demo.js", "package.lock"))
    prose = caps() + caps() + caps() + digits[0]
    camel = r.choice(("get", "Very", "my", "The")) + invented().title() + caps() + invented().title() + digits[0]
    # as names of the environment, and values that people choose
    env = r.choice(("GITHUB_ACCESS", "AWS_SECRET_ACCESS", "PRODUCTION_DATABASE", "DB", "STRIPE_PRIVATE", "my_service")) + r.choice(
        ("_TOKEN", "_KEY_SECRET", "_PASSWORD", "_API_KEY", "_SECRET")) + "="
    digest_env = r.choice(("GIT", "RELEASE", "IMAGE", "my_build")) + r.choice(("_COMMIT", "_SHA256", "_CHECKSUM", "_REVISION")) + "="
    chosen, own = invented().title() + digits + mark, invented(2) + digits[0] + invented(2) + mark
    mixed = b64[3:8] + mark + b64[9:13]
    letters = "".join(r.choices("qwzxkvjypmbgtdnr", k=16))
    said = r.choice(("required", "string", "true", "none", "null", "optional", "missing", "invalid", "please", "self.password",
                     "os.environ", "${DB_PASSWORD}", "<password>", "********", "get_password()", "changeme", "your-password"))
    login = r.choice(("postgres", "mysql", "https", "amqp", "redis")) + "://" + r.choice(("app", "root", "admin", "")) + ":"
    host, quoted = "@db.internal/app", ('"', '"')
    bare = ("", "")
    return [
        (1, h[0][:40], path, name, "=", *quoted), (1, h[1][:32], path, name, "=", *quoted),
        (1, h[2][:40].upper(), path, name, "=", *quoted), (1, b64[:36], path, name, name + ":", *bare),
        (1, "AKIA" + b64[:16].upper(), path, plain, plain, *bare), (1, "ghp_" + b64[:36], path, plain, name, *bare),
        (1, b64[:24], sample, name, "=", *quoted),
        (0, h[0][:40], path, plain, digest_name, *bare), (0, h[1], sample, digest_name, "=", *quoted),
        (0, h[2][:32], path, plain, plain, *bare),
        (0, "-".join((h[0][:8], h[0][8:12], h[0][12:16], h[0][16:20], h[0][20:32])), path, plain, "id", *bare),
        (0, prose, path, plain, plain, *bare), (0, prose, path, name, "=", *bare),
        (0, f"usr/{caps().lower()}/{caps().lower()}/v2", path, plain, plain, *bare),
        (0, r.choice(("your_", "example_", "dummy_", "test_")) + caps().lower() + "_key_1234567", sample, name, "=", *quoted),
        (0, "".join(c if c.isdigit() else "7" for c in h[2][:20]), path, plain, plain, *bare),
        (0, camel, path, plain, plain, *bare), (0, camel, path, plain, name, *bare),
        (0, f"{invented()}_{invented()}_{caps().lower()}_2", path, plain, plain, *bare),
        (0, f"com/{invented()}{invented()}/index9", path, plain, plain, *bare),
        (1, h[0][:40], path, plain, plain, env, ""), (1, b64, path, plain, r.choice(("export", "-", "env")), env, ""),
        (1, mixed, path, name, "=", *quoted), (1, mixed, path, plain, plain, name + "=", ""),
        (1, chosen, path, name, name + ":", *bare), (1, chosen, path, plain, plain, env, ""),
        (1, own, path, name, "=", *quoted), (1, own, path, plain, plain, name + "=", ""), (1, own, path, plain, name + ":", *bare),
        (1, r.choice((chosen, mixed, own)), path, plain, plain, login, host),
        (1, letters, path, name, "=", *quoted), (1, letters, path, plain, plain, name + "=", ""),
        (0, env, path, plain, plain, "", h[0][:40]),
        (0, said, path, plain, name + ":", *bare), (0, said, path, name, "=", *quoted), (0, said, path, plain, plain, name + "=", ""),
        (0, r.choice(("password", "${DB_PASS}", "<password>", "********", "your-password")), path, plain, plain, login, host),
        (0, h[1][:40], path, plain, plain, digest_env, ""), (0, h[2], path, plain, plain, "sha256:", ""),
        (0, invented() + invented() + invented(), path, plain, plain, *bare),
        (0, invented() + caps().lower() + invented(), path, plain, name, *bare),
    ]


_FINDING = ("rid long, kind int, label double, token string, path string, before2 string, before string, after string, "
            "head string, tail string, word string")


def labelled_findings(spark: SparkSession, rows: int = MAX_FINDINGS) -> DataFrame:
    """A bounded table of labelled findings (``label`` 1.0 for a secret, the
    ``kind`` of finding, and the columns of :func:`candidates`), made from a
    seed: random keys behind the names that hold them, chosen passwords, and
    digests, identifiers, paths, placeholders and long words that only look like
    keys.  The rows reach Spark as one constant."""
    made = []
    for rid in range(min(rows, MAX_FINDINGS)):
        r = random.Random(f"{SEED}:{rid}")
        kinds = _finding_kinds(r)
        kind = rid % len(kinds)
        label, token, path, before2, before, head, tail = kinds[kind]
        made.append({"rid": rid, "kind": kind, "label": float(label), "token": token, "path": path, "before2": before2,
                     "before": before, "after": r.choice(("and", "in", ";", "is", "on", "as")), "head": head, "tail": tail,
                     "word": head + token + tail})
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(made)), f"array<struct<{_FINDING.replace(' ', ':').replace(',:', ',')}>>")).alias(
        "f")).select("f.*")


def fit(findings: DataFrame, dic: DataFrame, table: list[float]) -> RandomForestClassificationModel:
    """The forest, fitted on at most MAX_FINDINGS labelled findings."""
    rows = features(findings.orderBy("rid").limit(MAX_FINDINGS), dic, table)
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    one = vec.select("rid", "label", "features").coalesce(1).sortWithinPartitions("rid")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(one)


def _judged(docs: DataFrame, dictionary_path: str, id_col: str, text_col: str, path_col: str | None,
            findings: DataFrame | None, threshold: float) -> DataFrame:
    """The candidates with the forest's ``p`` and ``is_secret``."""
    spark = docs.sparkSession
    dic = stage(dictionary(spark, dictionary_path), "dictionary")
    table = transitions(dic)
    model = fit(stage(labelled_findings(spark), "findings") if findings is None else findings, dic, table)
    found = stage(candidates(docs, id_col, text_col, path_col).withColumn("rid", F.monotonically_increasing_id()),
                  "candidates")
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found, dic, table))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(vec).withColumn("p", p).withColumn("is_secret", F.col("p") > threshold)


def scan(docs: DataFrame, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: ``id_col, word_no, part, token, probability,
    is_secret`` (the forest's vote against ``threshold``).

    ``findings`` are labelled rows as of :func:`labelled_findings`, its default.
    Null texts have no candidates, null paths and neighbours count as empty,
    repeated rows are scanned once each, an empty table gives no rows."""
    return _judged(docs, dictionary_path, id_col, text_col, path_col, findings, threshold).select(
        F.col("id").alias(id_col), F.col("word_no").cast("long").alias("word_no"), F.col("part").cast("long").alias("part"),
        "token", F.col("p").alias("probability"), "is_secret")


def redact(docs: DataFrame, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text",
           size_col: str | None = None, path_col: str | None = None, findings: DataFrame | None = None,
           threshold: float = 0.5) -> DataFrame:
    """``docs`` with every found secret replaced by MASK, all columns kept.
    Secrets that are no run of 16 characters are replaced where no letter or
    digit stands beside them.
    ``size_col`` gets the new number of characters of changed texts.

    A row is masked by what was found in its own text: rows with a repeated or
    null id are told apart by text and path, equal rows are masked alike.  Null
    and empty texts stay, an empty table gives no rows, a very long text's
    secrets are one row."""
    found = _judged(docs, dictionary_path, id_col, text_col, path_col, findings, threshold).filter("is_secret")
    tokens = stage(found.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.collect_set("token").alias("t")).select(
        "_id", "_digest", F.array_sort("t", lambda a, b: F.length(b) - F.length(a)).alias("_tokens")), "secrets")
    j = docs.join(tokens, docs[id_col].eqNullSafe(tokens["_id"]) & (_digest(text_col, path_col) == tokens["_digest"]), "left")

    def masked(text: Column, token: Column) -> Column:
        exact = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                         F.lit("\\E(?![A-Za-z0-9])"))
        return F.when(token.rlike(f"^{RUN}$"), F.replace(text, token, F.lit(MASK))).otherwise(
            F.regexp_replace(text, exact, F.lit(MASK)))

    clean = F.aggregate(tokens["_tokens"], docs[text_col].cast("string"), masked)
    text = F.when(tokens["_tokens"].isNull(), docs[text_col]).otherwise(clean)
    made = {text_col: text}
    if size_col and size_col in docs.columns:
        made[size_col] = F.when(tokens["_tokens"].isNull() | docs[text_col].isNull(), docs[size_col]).otherwise(
            F.length(clean).cast(docs.schema[size_col].dataType))
    return j.select(*[made.get(c, docs[c]).alias(c) for c in docs.columns])
