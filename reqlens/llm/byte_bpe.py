"""Byte-level BPE encoding by a segment tree, and decoding.

A match of the split pattern is a row of bytes.  A segment tree over its byte
positions stores, for every range, the leftmost pair of least rank; its root is
the next merge.  A merge changes the pairs at its place, at the place that it
swallows and at the live neighbour before it: three point updates of
logarithmic depth.  Short matches are merged together, many trees a NumPy call;
long ones one by one.  Decoding is a DataFrame expression."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches

#: Texts' chunks whose ids a worker keeps, and the widest tree that is merged
#: together with others.
CHUNK_MEMO = 500_000
WIDE = 64
#: Leaves of the trees that are merged together.
LEAVES = 1 << 18

_END = np.int64(1) << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Encoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.ranks = read_ranks(path)
        self._find = regex.compile(pattern).findall
        self._base = max(self.ranks.values()) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self._base + b] = rank
        self._pairs = pairs
        self._keys = np.array(sorted(pairs), np.int64)
        self._vals = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._memo: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._base + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._vals[at], _END)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self._single[raw]
        place = np.arange(width)
        live = place < size[:, None]
        after = np.where(place + 1 < size[:, None], place + 1, width)
        after = np.concatenate([after, np.full((n, 1), width)], 1)      # column `width` is a sink
        before = np.concatenate([np.broadcast_to(place - 1, (n, width)), np.full((n, 1), -1)], 1).copy()
        tree = np.full((n, 2 * width), _END, np.int64)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        has = after[:, :width - 1] < width
        tree[:, width:2 * width - 1] = np.where(has & (rank < _END), rank * width + place[:-1], _END)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        ids = np.concatenate([ids, np.zeros((n, 1), np.int64)], 1)
        rows = np.flatnonzero(tree[:, 1] < _END)
        while len(rows):
            top = tree[rows, 1]
            at = top % width
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = top // width
            live[rows, gone] = False
            after[rows, at] = follow
            before[rows, follow] = at
            prior = before[rows, at]

            def put(r, i, value):
                node = i + width
                tree[r, node] = value
                node >>= 1
                while node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node >>= 1

            put(rows, gone, _END)
            rank = np.where(follow < width, self._rank(ids[rows, at], ids[rows, follow]), _END)
            put(rows, at, np.where(rank < _END, rank * width + at, _END))
            some = np.flatnonzero(prior >= 0)
            if len(some):
                r, i, j = rows[some], prior[some], at[some]
                rank = self._rank(ids[r, i], ids[r, j])
                put(r, i, np.where(rank < _END, rank * width + i, _END))
            rows = rows[tree[rows, 1] < _END]
        raw_ids = ids[:, :width][live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [raw_ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, piece: bytes) -> bytes:
        """The same for one long piece, with plain lists."""
        n, base, pairs, end = len(piece), self._base, self._pairs, int(_END)
        width = 1 << (n - 1).bit_length()
        ids = self._single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [end] * (2 * width)

        def pair(i: int) -> int:
            j = after[i]
            r = pairs.get(ids[i] * base + ids[j]) if j >= 0 else None
            return end if r is None else r * width + i

        for i in range(n):
            tree[width + i] = pair(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        while (top := tree[1]) < end:
            at = top % width
            gone = after[at]
            ids[at] = top // width
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            put(gone, end)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of byte strings, as little-endian 32-bit bytes.  A piece that is
        a token is that token, as the rank file's own library has it."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[k] = self._merge_one(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, which in by_width.items():
            step = max(1, LEAVES // width)
            for at in range(0, len(which), step):
                part = which[at:at + step]
                for k, ids in zip(part, self._merge_many([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text whose matches are those of the text: cut before
        single spaces, or the matches themselves where white space meets."""
        if _ODD_SPACE(text):
            return self._find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit bytes."""
        if len(self._memo) > CHUNK_MEMO:
            self._memo.clear()
        memo = self._memo
        split = [self._chunks(t or "") for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        missing = [c for c in new if c not in memo]
        matches = [[m.encode() for m in self._find(c)] for c in missing]
        distinct = list({m for ms in matches for m in ms})
        known = dict(zip(distinct, self.encode_pieces(distinct)))
        for c, ms in zip(missing, matches):
            memo[c] = b"".join([known[m] for m in ms])
        return [b"".join(map(memo.__getitem__, s)) for s in split]


#: Finds a space beside other white space.
_ODD_SPACE = re.compile(r" \s|\s ").search

_ENCODERS: dict[tuple[str, str], SegmentTreeBpe] = {}


def encoder(path: str, pattern: str) -> SegmentTreeBpe:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = SegmentTreeBpe(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row's whole text, by the
    rank file ``path`` and the split pattern, without special tokens.  Null and
    empty texts have no ids, repeated rows come out once each, other columns
    are ignored, an empty table gives no rows.  A narrow pass; very long texts
    take one row of memory."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = enc.encode(part.column(1).to_pylist())
                ends = np.cumsum([0] + [len(r) // 4 for r in raw])
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return slim.mapInArrow(run, T.StructType([T.StructField(id_col, slim.schema[id_col].dataType),
                                              T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(ids: Column, path: str) -> Column:
    """The bytes (binary) of an array of ids.  The vocabulary is one constant
    array with a character per byte (Latin-1), which the optimizer folds; the
    joined characters are the bytes.  An id outside the vocabulary is an error."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    table = F.split(F.lit("\u0100".join(t.decode("latin-1") for t in tokens)), "\u0100")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""), "ISO-8859-1")
