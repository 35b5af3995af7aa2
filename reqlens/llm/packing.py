"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over the histogram of piece lengths, at most ``capacity``
counts, not over documents: best-fit decreasing places whole runs of equal
lengths into whole runs of equal bins.  Its steps are slots (length, rank
interval -> sequence interval, offset); each piece takes the slot of its rank
within its length by an equi-join."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches, stage

CAPACITY = 4096
#: Whitespace-separated chunks whose ids a worker keeps.
CHUNK_MEMO = 500_000
#: Bytes of texts that are encoded together, about.
TEXT_BYTES = 1 << 23
#: Rows of one length that are ranked together, and ranks of one join key.
RANK_ROWS = 100_000
RANK_BLOCK = 4096


#: A word of Latin letters that normalisation only lower-cases, and one stop.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+)([.,]?)")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on, in order; spaces stay."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest) if b != 32}


class ChunkEncoder:
    """Ids of whole texts by ``tokenizers``, as little-endian 32-bit bytes.

    The vocabulary never joins characters across white space, so a text's ids
    are those of its chunks between ASCII white space, one after the other.
    Chunks not met before are encoded together.  Plain words, the most of them,
    go to the same BPE model past normalisation and splitting, which would only
    lower-case them; the last token of a word shows by its end mark.  Others go
    the whole way, with a mark between them that only a NUL character makes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        mark = self._ids("\0")
        assert len(mark) == 1
        self._mark = mark[0]
        spec = json.load(open(path, encoding="utf-8"))
        spec |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self._bare = Tokenizer.from_str(json.dumps(spec))
        self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = spec["model"]["vocab"]
        self._last = np.zeros(max(vocab.values()) + 1, bool)
        self._last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._letters = _byte_letters()
        self._memo: dict[bytes, bytes] = {}
        self._stops = {c: self._raw(self._ids(c)) for c in (".", ",")} | {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self._tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _cut(self, chunks: list[bytes], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        raw, start = ids.tobytes(), 0
        for c, end in zip(chunks, (4 * ends).tolist()):
            self._memo[c] = raw[start:end]
            start = end + 4 * skip

    def _learn_words(self, words: list[bytes], ascii_only: bool) -> None:
        for at in range(0, len(words), 512):
            part = words[at:at + 512]
            text = b" ".join(part).decode("latin-1")
            if not ascii_only:
                text = text.translate(self._letters)
            ids = np.array(self._bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[ids]) + 1
            assert len(ends) == len(part)
            self._cut(part, ids, ends, 0)

    def _learn_others(self, chunks: list[bytes]) -> None:
        plain = [c for c in chunks if b"\0" not in c]
        for at in range(0, len(plain), 256):
            part = plain[at:at + 256]
            ids = np.array(self._ids(" \0 ".join(c.decode() for c in part)), "<u4")
            ends = np.append(np.flatnonzero(ids == self._mark), len(ids))
            assert len(ends) == len(part)
            self._cut(part, ids, ends, 1)
        for c in chunks:
            if b"\0" in c:
                self._memo[c] = self._raw(self._ids(c.decode()))

    def _learn(self, new: list[bytes]) -> None:
        memo, others, ascii_words, words, made = self._memo, [], set(), set(), []
        for c in new:
            if c.isalpha():  # letters of ASCII
                ascii_words.add(c)
                continue
            if c[-1] in b".,":
                word = c[:-1]
                if word.isalpha():
                    made.append((c, word, c[-1:].decode()))
                    if word not in memo:
                        ascii_words.add(word)
                    continue
            m = _PLAIN.fullmatch(c.decode())
            if m is None:
                others.append(c)
            else:
                word = m[1].lower().encode()
                made.append((c, word, m[2]))
                if word not in memo:
                    words.add(word)
        self._learn_others(others)
        self._learn_words(list(ascii_words), True)
        self._learn_words(list(words), False)
        for c, word, stop in made:
            memo[c] = memo[word] + self._stops[stop]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text.  Arrow splits the texts and numbers their distinct
        chunks, so that a chunk is looked up once however often it occurs."""
        memo = self._memo
        if len(memo) > CHUNK_MEMO:
            memo.clear()
        lower = pc.ascii_lower(texts.fill_null(""))  # normalisation lower-cases the other letters
        split = pc.ascii_split_whitespace(lower)
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        memo[b""] = b""  # before leading and after trailing white space
        self._learn([c for c in chunks if c not in memo])
        ids = pa.array([memo[c] for c in chunks], pa.large_binary()).take(numbered.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
        offsets = split.offsets.to_numpy()
        ends = at[offsets - offsets[0]].tolist() if len(ids) else [0] * len(offsets)
        raw = ids.buffers()[2] or pa.py_buffer(b"")
        return [raw.slice(lo, hi - lo).to_pybytes() for lo, hi in zip(ends, ends[1:])]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = max(1, batch.num_rows * TEXT_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                row, piece, length, crc, ids = [], [], [], [], []
                for i, raw in enumerate(enc.encode(part.column(1))):
                    raw += end
                    for p, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[lo:lo + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces ``(id, piece, start, length, ids_crc32[, ids])`` of at most
    ``capacity`` tokens.  A text is its ids by the tokenizer file ``path``,
    then ``end_id``; null or empty texts are the end id alone."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", slim.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return slim.mapInArrow(_pieces(path, end_id, capacity, with_ids), T.StructType(fields))


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, pieces, first
    sequence, offset).  The pieces of ranks first..first+n-1 go to as many
    sequences in a row, one each, at the same offset.  Bins of equal room are
    kept as intervals of sequences, so the number of steps depends on the
    capacity, not on the number of pieces."""
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    next_seq = 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if not room.setdefault(space, []):
                insort(order, space)
            room[space].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                space = order[at]
                first, bins = room[space].pop()
                if not room[space]:
                    order.pop(at)
            else:
                space, first = capacity, next_seq
                bins = -(-left // (capacity // length))
                next_seq += bins
            each = space // length
            full = min(bins, left // each)
            for k in range(each if full else 0):
                out.append((length, rank, full, first, capacity - space + k * length))
                rank += full
            left -= full * each
            give(space - each * length, first, full)
            if full < bins:
                some = min(left, each)
                for k in range(some):
                    out.append((length, rank, 1, first + full, capacity - space + k * length))
                    rank += 1
                left -= some
                give(space - some * length, first + full, 1)
                give(space, first + full + 1, bins - full - 1)
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.  Lengths are
    dealt in buckets, so a length that a third of all pieces have is ranked by
    many tasks; the buckets' first ranks come from their counts."""
    n = rows.count()
    buckets = max(1, -(-n // RANK_ROWS))
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_b").orderBy("id", "piece", "ids_crc32")
    numbered = keyed.withColumn("_k", F.row_number().over(own) - 1)
    return numbered.join(first, ["length", "_b"]).withColumn("rank", F.col("_first") + F.col("_k")).drop(
        "_b", "_k", "_first")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``
    and with ``with_ids`` the piece's ``ids`` (little-endian 32-bit).  Only
    documents over the capacity are cut.  Repeated rows are packed once each;
    null ids are packed like others; an empty table gives no rows.  The driver
    sees the histogram only, at most ``capacity`` rows."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, id_col, text_col, end_id, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan_slots(histogram, capacity),
                                  "length long, first_rank long, n long, first_sequence long, offset long")
    spread = stage(slots.withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("first_rank") / RANK_BLOCK), F.floor((F.col("first_rank") + F.col("n") - 1) / RANK_BLOCK)))),
        "slots")
    ranked = _ranked(cut).withColumn("_block", F.floor(F.col("rank") / RANK_BLOCK))
    placed = ranked.join(spread, ["length", "_block"]).filter("rank >= first_rank and rank < first_rank + n")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
                         "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from :func:`pack` with its ids: the pieces of each
    sequence, joined by offset.  A group holds at most ``capacity`` tokens; an
    empty table gives no rows."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
