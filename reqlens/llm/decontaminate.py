"""Benchmark decontamination: training documents against test items.

The windows of ``n`` words of all test items, normalised, are a hash set that
every task holds.  A document's words are turned into the numbers of the test
vocabulary, hashed window by window, looked up, and hits are verified word by
word.  Hit spans or whole documents can be removed.

The hash set is only broadcast while the items are below a number of bytes.
Beyond it, hashed windows of documents and items are joined by a shuffle, and
the same verification follows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches, stage

WINDOW = 10
#: Bytes of all items up to which their windows are broadcast.
MAX_BROADCAST_BYTES = 16_000_000
#: Documents that are scanned at once, by bytes.
SCAN_BYTES = 4_000_000
#: Parts that the windows of one hash are dealt to when they are joined.
SALTS = 16

#: Lower case, digits and all bytes from 128 on; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or b"").translate(_FOLD).split()


class WindowIndex:
    """The windows of a set of items by their length, as rows of word numbers,
    their sorted hashes, and the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                windows.setdefault(size, {}).setdefault(tuple(ids[at:at + size]), set()).add(item)
        self.tables = [(size, *self._table(size, own)) for size, own in sorted(windows.items())]

    @staticmethod
    def _table(size: int, own: dict[tuple[int, ...], set[str]]):
        rows = np.array(list(own), np.int64).reshape(-1, size)
        items = [sorted(s) for s in own.values()]
        for factor in range(0x9E3779B97F4A7C15, 1 << 64, 2):  # until no two windows share a hash
            hashes = WindowIndex.hashes(rows.reshape(-1), size, factor)[::size] if len(rows) else np.empty(0, np.uint64)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) == len(rows):
                break
        hashes = hashes[order]
        bits = np.zeros(1 << 20, bool)
        bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return np.uint64(factor), rows[order], hashes, bits, [items[k] for k in order]

    @staticmethod
    def hashes(ids: np.ndarray, size: int, factor: int) -> np.ndarray:
        """A hash of each window of ``size`` numbers."""
        u = ids.astype(np.uint64)
        last = len(u) - size + 1
        h = np.zeros(last, np.uint64)
        for k in range(size):
            h *= np.uint64(factor)
            h += u[k:k + last]
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, list[str]] | None]:
        """For each document (its words) the hit words and the items, sorted;
        None without any."""
        flat: list[int] = []
        ends = []
        for w in docs:
            flat.extend(map(self.vocabulary.get, w, repeat(0)))
            flat.append(0)  # no window reaches over the end of a document
            ends.append(len(flat))
        ids = np.array(flat, np.int64)
        hit = np.zeros(len(ids) + 1, np.int64)
        found: dict[int, set[str]] = {}
        unknown = np.append(0, np.cumsum(ids == 0))
        for size, factor, rows, hashes, bits, items in self.tables:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = self.hashes(ids, size, int(factor))[at]
            maybe = bits[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], k[same]
            same = (ids[at[:, None] + np.arange(size)] == rows[k]).all(axis=1)  # word by word
            at, k = at[same], k[same]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            doc = np.searchsorted(ends, at, "right")
            for d, w in set(zip(doc.tolist(), k.tolist())):
                found.setdefault(d, set()).update(items[w])
        covered = np.cumsum(hit) > 0
        return [(covered[(ends[d - 1] if d else 0):ends[d] - 1], sorted(found[d])) if d in found else None
                for d in range(len(docs))]


#: The index that a worker used last.
_INDEXES: dict[str, WindowIndex] = {}


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character ranges of the text."""
    out, at, chars = [], 0, 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    for lo, hi in zip(edges[::2], edges[1::2]):
        start, end = places[lo][0], places[hi - 1][1]
        chars += len(text[at:start].decode("utf-8", "replace"))
        wide = len(text[start:end].decode("utf-8", "replace"))
        out.append({"start": chars, "end": chars + wide})
        at, chars = end, chars + wide
    return out


_FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": _SPANS}


def _batches_of(batch: pa.RecordBatch, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > SCAN_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _emit(part: pa.RecordBatch, texts: list[bytes | None], split: list[list[bytes]], found: list, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([len(w) for w in split], pa.int64()),
            pa.array([int(f[0].sum()) if f else 0 for f in found], pa.int64()),
            pa.array([f[1] if f else [] for f in found], pa.list_(pa.string())),
            pa.array([_spans(t, f[0]) if f else [] for t, f in zip(texts, found)], _HITS)]
    return pa.RecordBatch.from_arrays([*part.columns, *cols], names=names)


def _normal(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence of a
    window of an item), ``items`` (ids, as strings, of the items with occurring
    windows, sorted) and ``spans`` (character ranges from the first to the last
    of consecutive hit words).  Columns of ``docs`` with these names are
    replaced.

    An item of fewer than ``n`` words is one window, one without words none.
    Null texts have no words; null item ids count as ''; repeated items and
    repeated rows change nothing but come out once each; empty tables have no
    hits or no rows.  Documents are scanned whole, in one narrow pass while the
    items have at most MAX_BROADCAST_BYTES."""
    require(docs, text_col)
    require(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in _FOUND])
    items = _normal(benchmark, item_col, item_text_col).distinct()
    held = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if held > MAX_BROADCAST_BYTES:
        return _joined(docs, items, text_col, n)
    shared = spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in items.collect()])
    small_batches(spark)
    slim = docs.withColumn("_raw", F.col(text_col).cast("string").cast("binary"))
    names, key = [*docs.columns, *_FOUND], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = WindowIndex(shared.value, n)
        index = _INDEXES[key]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in _batches_of(batch, texts):
                split = [words(t) for t in texts[lo:hi]]
                part = batch.select(range(batch.num_columns - 1)).slice(lo, hi - lo)
                yield _emit(part, texts[lo:hi], split, index.find(split), names)

    return slim.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in _FOUND.items()]]))


def _window_rows(sizes: list[int], n: int, whole: bool):
    """Rows ``(hash, key...)`` of windows: of items (``whole``) those of length
    ``n`` or the item's own, of documents those of every length in ``sizes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for size in [min(n, len(w))] if whole else sizes:
                    if 0 < size <= len(w):
                        own = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)]
                        got = set(own)
                        cols = [pa.array([xxhash.xxh64_intdigest(g) - (1 << 63) for g in got], pa.int64()),
                                pa.array([size] * len(got), pa.int32()), pa.array([key] * len(got))]
                        if whole:
                            cols.append(pa.array(list(got), pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names=["hash", "size", "key", *(["gram"] if whole else [])])
    return run


def _joined(docs: DataFrame, items: DataFrame, text_col: str, n: int) -> DataFrame:
    """As :func:`contamination`, for items of any size: the distinct windows of
    each document are joined by hash with those of the items (salted, as many
    documents may share one), and the few matches go back to their row, whose
    words decide."""
    small_batches(docs.sparkSession)
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    grams = stage(items.select("item", "text").mapInArrow(
        _window_rows([], n, True), "hash long, size int, key string, gram binary"), "item-windows")
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most n numbers
    known = grams.groupBy("hash", "size", "gram").agg(F.sort_array(F.collect_set("key")).alias("items")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = rows.select("_row", raw.alias("text")).mapInArrow(_window_rows(sizes, n, False), "hash long, size int, _row long")
    seen = seen.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    hits = seen.join(known, ["hash", "size", "_salt"]).groupBy("_row").agg(
        F.collect_list(F.struct("gram", "items")).alias("_grams"))
    j = rows.join(hits, "_row", "left").select(*docs.columns, "_grams", raw.alias("_raw"))
    names = [*docs.columns, *_FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, texts = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            split, found = [words(t) for t in texts], []
            for w, own in zip(split, grams):
                index = WindowIndex([], n)
                if own:
                    index = WindowIndex([(item, g["gram"]) for g in own for item in g["items"]], n)
                found += index.find([w])
            yield _emit(batch.select(range(batch.num_columns - 2)), texts, split, found, names)

    return j.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in _FOUND.items()]]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole_documents: bool = True, text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``whole_documents`` False)
    with every hit span cut from its text.  The columns stay as they are; nulls,
    repeats and empty tables as of :func:`contamination`."""
    columns = docs.columns
    kept = {c: f"_own_{c}" for c in columns if c in _FOUND}  # names that the scan uses itself
    found = contamination(docs.withColumnsRenamed(kept), benchmark, kept.get(text_col, text_col), **options)
    if whole_documents:
        found = found.filter("n_hit = 0")
    else:
        text = F.col(kept.get(text_col, text_col))
        # what lies before each span, and what follows the last
        gaps = F.transform(F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end")), lambda end, k: F.substring(
            text, (end + 1).cast("int"), F.coalesce(F.get(F.col("spans"), k)["start"], F.length(text)).cast("int") - end.cast("int")))
        found = found.withColumn(kept.get(text_col, text_col), F.when(F.col("n_hit") > 0, F.array_join(gaps, "")).otherwise(text))
    return found.select(*[F.col(kept.get(c, c)).alias(c) for c in columns])
