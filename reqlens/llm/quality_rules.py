"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements
and one failure bit per rule.  ``apply_policy`` turns the bits into a verdict
under a versioned policy, without touching the texts again, and ``ablation``
says from the bits alone what each rule of a policy decides.  Only DataFrame
functions are used; every step is one narrow pass, the ablation one global
aggregation of counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import ASCII_SPACE, let, require, words

#: Rule -> (bit, failure condition over the measurements).  Bits are never reused.
RULES = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 40 * n_lines"),
    "upper_case": (4, "100 * n_upper > 60 * n_letters"),
    "few_letters": (5, "100 * n_letters < 50 * word_chars"),
    "long_words": (6, "word_chars > 15 * n_words"),
    "short_words": (7, "word_chars < 2 * n_words"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


@dataclass(frozen=True)
class Policy:
    """Rejects a document when a rule of ``fatal`` fails, or more than
    ``tolerance`` rules of ``soft``."""
    version: int
    fatal: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerance: int = 0

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(1 << RULES[n][0] for n in names)


POLICIES = {
    1: Policy(1, fatal=("few_words", "repeated_windows")),
    2: Policy(2, fatal=("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case"),
              soft=("few_letters", "long_words", "short_words"), tolerance=1),
}
BASE = 1
CURRENT = 2


def _repeat_words(w: Column, window: int = 3) -> Column:
    """Words inside windows of three that occur at least twice.  The windows
    are sorted with their positions only where some window repeats."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - window),
                        lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(window)]))

    def covered(s: Column) -> Column:
        twins = F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
        hit = F.flatten(F.transform(twins, lambda x: F.array(*[x["i"] + k for k in range(window)])))
        return F.size(F.array_distinct(hit))

    def of(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, covered))

    return F.when(F.size(w) < window, F.lit(0)).otherwise(let(grams, of))


def measurements(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements (all long) of each row's whole
    text.  Null and blank texts measure 0 everywhere."""
    require(docs, text_col, *keep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("_text"), words(F.col(text_col)).alias("_w"))

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace("_text", pattern, ""))

    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\x20\x09-\x0d]"))
    out = {
        "n_words": F.size("_w"),
        "word_chars": without(ASCII_SPACE + "+"),
        "n_symbols": F.length("_text") - without("[#*$%&|<>]"),
        "n_lines": let(lines, F.size),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(F.col("_w"), lambda w: _repeat_words(w)),
        "n_upper": F.length("_text") - without("\\p{Lu}+"),
        "n_letters": F.length("_text") - without("\\p{L}+"),
    }
    return base.select(*keep, *[out[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failures`` (long): bit b is set when rule b fails.  A
    row per row, repeated ones too; null and blank texts fail the rules that 0
    words fail; an empty table gives no rows."""
    m = measurements(docs, text_col, keep)
    bits = [F.when(F.expr(cond), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
            for bit, cond in RULES.values()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return m.withColumn("failures", mask)


def rejected(failures: Column, policy: Policy) -> Column:
    fatal = failures.bitwiseAND(F.lit(policy.mask(policy.fatal)).cast("long")) != 0
    soft = F.bit_count(failures.bitwiseAND(F.lit(policy.mask(policy.soft)).cast("long"))) > policy.tolerance
    return fatal | soft


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy_version`` to a ledger, row by
    row; an empty ledger stays empty."""
    return led.select("*", rejected(F.col("failures"), POLICIES[BASE]).alias("base_failed"),
                      (~rejected(F.col("failures"), POLICIES[version])).alias("kept"),
                      F.lit(version).alias("policy_version"))


def ablation(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, and documents that only it
    rejects (they would pass with its bit cleared).  One row per rule, from one
    aggregation with map-side combine; an empty ledger gives zeros."""
    policy = POLICIES[version]
    f = F.col("failures")
    aggs = []
    for name in (*policy.fatal, *policy.soft):
        bit = 1 << RULES[name][0]
        cleared = f.bitwiseAND(F.lit(~bit).cast("long"))
        aggs.append(F.struct(
            F.lit(name).alias("rule"),
            F.count(F.when(f.bitwiseAND(F.lit(bit).cast("long")) != 0, 1)).alias("n_failed"),
            F.count(F.when(rejected(f, policy) & ~rejected(cleared, policy), 1)).alias("n_decided")))
    return led.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select(
        "r.*", F.lit(version).alias("policy_version"))


def keep_good(docs: DataFrame, text_col: str = "text", version: int = CURRENT) -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with all their columns.  The
    texts are measured in the same narrow pass, without a join; repeated rows
    are judged one by one."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    led = ledger(boxed, "_t", keep=("_row",))
    # a generator, because a filter would be pushed below the measurements and
    # repeat them for each of their uses
    good = ~rejected(F.col("failures"), POLICIES[version])
    return led.select(F.explode(F.when(good, F.array("_row"))).alias("_row")).select("_row.*")
