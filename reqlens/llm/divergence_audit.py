"""Source divergence audit: how far the sources of a language differ in their
use of words.

The counts of a language's kept terms form one column per source.  The terms
are put in order of their counts, so that equal counts stand together, and the
columns are stored as runs.  Two sources are compared run by run: the run
boundaries of both are intersected, and the divergence of a run's two shares is
multiplied by its length.  All arithmetic is on whole numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches, stage

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 10
#: Shares are counted in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Distinct (group, term) pairs that a worker counts before it hands them on.
HELD_TERMS = 400_000
#: Terms of a chunk of the run-length columns.
CHUNK_TERMS = 65_536

#: Letters of ASCII in lower case and all bytes from 128 on; the rest separates terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
                         T.StructField("docs", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a part of the
    rows; a group's row without a term says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array([t if t is None else t.decode("utf-8", "replace") for t in terms], pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                names=_COUNTED.names)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_FOLD).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the
    term, per group; one row with a null term per group that occurs."""
    require(docs, text_col, lang_col, source_col)
    small_batches(docs.sparkSession)

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    slim = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"),
                       filled(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_COLUMNS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("chunk", T.LongType()),
                         T.StructField("terms", T.LongType()), T.StructField("source", T.StringType()),
                         T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _run_lengths(lang: str, chunk: int, vectors: list) -> Iterator[dict]:
    """The columns of one chunk of terms as runs, zero runs left out."""
    runs: dict[str, list[list[int]]] = {}  # source -> [start, end, count]
    for at, vector in enumerate(vectors):
        for entry in vector:
            own = runs.setdefault(entry["source"], [])
            if own and own[-1][1] == at and own[-1][2] == entry["n"]:
                own[-1][1] = at + 1
            else:
                own.append([at, at + 1, entry["n"]])
    for source, own in runs.items():
        starts, counts, end = [], [], 0
        for lo, hi, n in own:
            if lo > end or not starts and lo > 0:
                starts.append(end)
                counts.append(0)
            starts.append(lo)
            counts.append(n)
            end = hi
        if end < len(vectors):
            starts.append(end)
            counts.append(0)
        yield {"lang": lang, "chunk": chunk, "terms": len(vectors), "source": source, "starts": starts, "counts": counts}


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length columns of a partition's terms, which come in order."""
    from pyspark import TaskContext
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.int64()), ("source", pa.string()),
                        ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    first, k, lang, vectors = TaskContext.get().partitionId() << 32, 0, None, []

    def done() -> Iterator[pa.RecordBatch]:
        if vectors:
            yield pa.RecordBatch.from_pylist(list(_run_lengths(lang, first + k, vectors)), schema=schema)

    for batch in batches:
        for its, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vectors and (its != lang or len(vectors) == CHUNK_TERMS):
                yield from done()
                k, vectors = k + 1, []
            lang = its
            vectors.append(vector)
    yield from done()


def run_length_columns(kept: DataFrame) -> DataFrame:
    """``(lang, chunk, terms, source, starts, counts)`` of ``kept`` (lang, term,
    vector): the terms of a language in order of their count vectors, in chunks,
    and each source's counts in a chunk as runs (run k from ``starts[k]`` on).
    A source without a count in the chunk has no row.

    Terms are dealt to partitions by their total and a hash of their vector, so
    that equal vectors meet, and what the range bounds are sampled from is two
    numbers a term; inside a partition they go by the vectors themselves."""
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v["n"])
    ordered = kept.select("lang", "vector", "term", total.alias("_n"), F.xxhash64("vector").alias("_h")).repartitionByRange(
        "lang", "_n", "_h").sortWithinPartitions("lang", "vector", "term").select("lang", "vector")
    return ordered.mapInArrow(_columns, _COLUMNS)


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)) of each count,
    exactly; runs have few distinct counts."""
    own, back = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * size) for c in own], np.int64)[back]


def _compare(chunk: pd.DataFrame) -> pd.DataFrame:
    """Divergence of each two sources over one chunk's terms."""
    terms = int(chunk["terms"].iloc[0])
    columns = []
    for r in chunk.sort_values("source").itertuples():
        starts = np.array([0] if r.starts is None else r.starts, np.int64)
        counts = np.array([0] if r.counts is None else r.counts, np.int64)
        columns.append((r.source, starts, shares(counts, int(r.total), int(r.size))))
    out = []
    for k, (a, starts_a, p) in enumerate(columns):
        for b, starts_b, q in columns[:k]:
            cuts = np.union1d(starts_a, starts_b)
            x = p[np.searchsorted(starts_a, cuts, "right") - 1]
            y = q[np.searchsorted(starts_b, cuts, "right") - 1]
            f = (x - y) ** 2 // (x + y)
            out.append((a, b, int((f * np.diff(np.append(cuts, terms))).sum())))
    return pd.DataFrame(out, columns=["a", "b", "value"]).assign(lang=chunk["lang"].iloc[0])[["lang", "a", "b", "value"]]


def _share(n: Column, total: Column, size: Column) -> Column:
    """As :func:`shares`, on columns; decimals keep 10^9 times a count exact."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", part, (total + 2 * size).cast("decimal(20,0)")).cast("long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    ``pair`` rows: the divergence of each (lang, source) group from each other
    source of its language, summed over the language's kept terms (those in at
    least ``min_docs`` of its rows; 0 if there are none).  ``term`` rows: the
    ``top`` terms that the group uses more than its language does.  Ranks go by
    value, then item.

    Null texts, languages and sources count as ''.  Every row is a document,
    repeated ones too; a group without terms is compared as well; an empty table
    gives no rows; other columns are ignored.  A row holds at most one count per
    source of a language, a task one chunk of terms; the number of terms and of
    documents is not bounded, and a language or source that has most of them is
    spread over chunks."""
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = stage(counts.filter("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")).filter(
        F.col("docs") >= min_docs), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = kept.select("lang", F.explode("vector").alias("v")).groupBy("lang", "v.source").agg(F.sum("v.n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(
        sizes, "lang", "left").fillna(0, ["total", "size"])
    groups = stage(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "groups")

    columns = stage(run_length_columns(kept), "run-lengths")
    chunks = columns.select("lang", "chunk", "terms").distinct().join(groups, "lang")
    parts = chunks.join(columns.drop("terms"), ["lang", "chunk", "source"], "left").groupBy("lang", "chunk").applyInPandas(
        _compare, "lang string, a string, b string, value long")
    found = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter(
        "source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])

    each = kept.select("lang", F.col("term").alias("item"), F.explode("vector").alias("v"), F.aggregate(
        "vector", F.lit(0).cast("long"), lambda s, v: s + v["n"]).alias("lang_n")).select(
        "lang", "v.source", "item", "v.n", "lang_n").join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("size"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    more = each.select("lang", "source", "item", p.alias("p"), q.alias("q")).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value")).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
