"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units are the lines of a document and the document as a whole.  A unit and a
template of a and b bigrams reach a coefficient t only if a lies between
b * t / (2 - t) and b * (2 - t) / t, so the word count of a unit leaves out most
templates, and most units, before a bigram is made.  The bigrams that are left
meet an index of the templates' bigrams, a fixed table that is broadcast.

:func:`passages` finds licences at any place: over several lines, or inside a
longer one.  Its units are windows of a document's bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import let, require
from reqlens.llm.license_templates import TEMPLATES

THRESHOLD = 0.8


def normalized(text: Column) -> Column:
    """Words (letters and digits, lower case) joined by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def size_bounds(bigrams: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold."""
    return math.ceil(bigrams * threshold / (2 - threshold) - 1e-9), math.floor(bigrams * (2 - threshold) / threshold + 1e-9)


def template_index(spark: SparkSession, templates: dict[str, str], threshold: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """One row per template and distinct bigram, and the size bounds of all."""
    rows, bounds = [], []
    for name, text in templates.items():
        w = template_words(text)
        grams = Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
        if not grams:
            raise ValueError(f"template {name} has no bigram")
        lo, hi = size_bounds(len(w) - 1, threshold)
        bounds.append((lo, hi))
        rows += [(g, name, n, len(w) - 1, lo, hi) for g, n in grams.items()]
    return spark.createDataFrame(rows, "gram string, license_id string, t_count long, t_size long, lo long, hi long"), bounds


def _merged(bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(bounds):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _grams(w: Column) -> Column:
    """Bigrams of two words at least."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, unit, license_id, n_bigrams, dice`` for every unit that reaches
    the threshold, with its best template (ties to the first name).  ``unit`` is
    the number of the line from 0, and -1 the whole of a document of several
    lines.  Null and empty texts have no units that match, repeated rows are
    scanned once each, other columns are ignored, an empty table gives no rows."""
    require(docs, id_col, text_col)
    index, bounds = template_index(docs.sparkSession, templates or TEMPLATES, threshold)
    lines = F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"),
                        lambda x, i: F.struct(i.cast("long").alias("unit"), x.alias("t")))
    units = let(lines, lambda x: F.when(F.size(x) > 1, F.concat(F.array(
        F.struct(F.lit(-1).cast("long").alias("unit"), F.col(text_col).cast("string").alias("t"))), x)).otherwise(x))
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.explode(units).alias("u"))

    # words and size of a unit, then its bigrams if a template can match; a
    # unit is normalised once, because the lambdas hand it on
    sized = F.filter(F.array(let(F.split(normalized(F.col("u.t")), " "), lambda w: F.struct(
        (F.size(w) - 1).cast("long").alias("n"), w.alias("w")))), lambda s: _in_bounds(s["n"], _merged(bounds)))
    kept = each.select("row", "id", F.col("u.unit").alias("unit"), F.explode(sized).alias("s"))
    pairs = kept.select("row", "id", "unit", F.col("s.n").alias("n"), F.explode(let(F.col("s.w"), _grams)).alias("gram"))
    met = pairs.join(F.broadcast(index), "gram").filter("n between lo and hi")
    common = met.groupBy("row", "id", "unit", "n", "license_id", "t_size", "gram", "t_count").agg(
        F.count(F.lit(1)).alias("c")).groupBy("row", "id", "unit", "n", "license_id", "t_size").agg(
        F.sum(F.least("c", "t_count")).alias("both"))
    dice = (2.0 * F.col("both") / (F.col("n") + F.col("t_size"))).alias("dice")
    best = common.select("row", "id", "unit", "n", "license_id", dice).filter(F.col("dice") >= threshold).groupBy(
        "row", "id", "unit", "n").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license_id")).alias("b"))
    return best.select(F.col("id").alias(id_col), "unit", F.col("b.license_id").alias("license_id"),
                       F.col("n").alias("n_bigrams"), (-F.col("b.d")).alias("dice"))


def _in_bounds(n: Column, bounds: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for lo, hi in bounds:
        out = out | n.between(lo, hi)
    return out


def _apart(found: Column) -> Column:
    """Of (.., s, e) in order of preference, those that overlap none before them."""
    return F.aggregate(found, F.filter(found, lambda c: F.lit(False)), lambda kept, c: F.when(
        F.exists(kept, lambda k: (k["s"] <= c["e"]) & (c["s"] <= k["e"])), kept).otherwise(F.concat(kept, F.array(c))))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
             threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, first_word, license_id, n_bigrams, dice`` of the passages, runs
    of a document's words whatever its lines, that reach the threshold.
    ``first_word`` counts the document's normalized words from 0.

    Of overlapping passages of one template that of the highest coefficient is
    given (ties: more bigrams in common, then the first); of overlapping ones
    of several templates that with most bigrams in common (ties: the higher
    coefficient, then the first name).  Rows without text have no passages,
    repeated rows are scanned once each, an empty table gives no rows.

    A best passage starts and ends with a bigram of the template.  A template of
    m bigrams needs at least lo = m * t / (2 - t) of them within hi = m * (2 - t) / t
    places, so only starts with that many close behind them are tried."""
    require(docs, id_col, text_col)
    index, _ = template_index(docs.sparkSession, templates or TEMPLATES, threshold)
    said = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.explode(F.filter(
        F.array(F.split(normalized(F.col(text_col)), " ")), lambda w: F.size(w) > 1)).alias("w"))
    pairs = said.select("row", "id", F.posexplode(let(F.col("w"), _grams)).alias("p", "gram"))
    met = pairs.join(F.broadcast(index), "gram")
    of = ["row", "id", "license_id", "t_size", "lo", "hi"]
    # each hit with the place q at which its bigram stood t_count times before:
    # in a passage that starts behind q it counts
    same = met.repartition("row", "license_id").groupBy(*of, "gram", "t_count").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    hits = same.select(*of, F.transform("ps", lambda p, k: F.struct(p.alias("p"), F.when(
        k >= F.col("t_count"), F.get("ps", (k - F.col("t_count")).cast("int"))).otherwise(-1).alias("q"))).alias("h")).groupBy(
        *of).agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("h")).filter(F.size("h") >= F.col("lo"))

    def place(i: Column) -> Column:
        return F.get("h", i.cast("int"))["p"]

    starts = F.filter(F.sequence(F.lit(0), F.size("h") - F.col("lo").cast("int")),
                      lambda i: place(i + F.col("lo") - 1) - place(i) < F.col("hi"))

    def ends(i: Column) -> Column:
        s = place(i)
        counted = F.filter(F.slice("h", i + 1, F.col("hi").cast("int")), lambda x: (x["q"] < s) & (x["p"] - s < F.col("hi")))
        return F.filter(F.transform(counted, lambda x, k: F.struct(
            (-2.0 * (k + 1) / (x["p"] - s + 1 + F.col("t_size"))).alias("d"), (-(k + 1)).alias("both"), s.alias("s"),
            x["p"].alias("e"))), lambda c: c["d"] <= -threshold)

    own = hits.select("row", "id", "license_id", F.array_sort(F.flatten(F.transform(starts, ends))).alias("c")).filter(
        F.size("c") > 0).select("row", "id", "license_id", _apart(F.col("c")).alias("c"))
    ranked = own.select("row", "id", F.transform("c", lambda c: F.struct(
        c["both"].alias("both"), c["d"].alias("d"), F.col("license_id"), c["s"].alias("s"), c["e"].alias("e"))).alias("c"))
    best = ranked.groupBy("row", "id").agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("c")).select(
        "id", F.explode(_apart(F.col("c"))).alias("c"))
    return best.select(F.col("id").alias(id_col), F.col("c.s").cast("long").alias("first_word"), F.col("c.license_id").alias("license_id"),
                       (F.col("c.e") - F.col("c.s") + 1).cast("long").alias("n_bigrams"), (-F.col("c.d")).alias("dice"))
