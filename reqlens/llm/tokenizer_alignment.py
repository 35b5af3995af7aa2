"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes
as which tokens of another, and how often over the corpus.

Both tokenisations tile the bytes of a text.  Every token points to the token
that overlaps it and reaches farthest to the right; a token that none overlaps
beyond its own end is terminal.  Doubling the pointers (a token takes its
pointer's pointer) leads every token to the terminal one of its group, which
labels the group.  All texts of a block are worked on as one array.

Corpus-wide counts of linked id pairs go by blocks of documents: a block names
its distinct pairs once, with the number of its documents that hold each, the
pairs are summed over blocks, and the sums come back to the block."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches, stage

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 3_000_000
#: Chunks between spaces whose ids a worker keeps.
CHUNK_MEMO = 400_000
#: A group with more links than this counts its distinct ids first.
WIDE_GROUP = 256
#: Bits of the second tokenizer's ids in a pair's code.
B_BITS = 20

#: Bits of an id pair's code.
CODE_BITS = 40



class ByteLevel:
    """A byte-level BPE of ``tokenizers``, with the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # their strings in texts are plain text
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {
            chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.widths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of space + text, as 32-bit numbers."""
        return [np.array(e.ids, "<i4").tobytes() for e in self._tok.encode_batch_fast(
            [" " + t for t in texts], add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """As :meth:`encode`, for chunks without spaces and without white space
        at their end: many are encoded as one text, in which each begins at a
        space, where matches of the split pattern begin.  The tokens' bytes tell
        which are whose."""
        out = []
        for at in range(0, len(chunks), 512):
            part = [" " + c for c in chunks[at:at + 512]]
            raw, = self.encode(["".join(part)[1:]])
            ends = np.cumsum(self.widths[np.frombuffer(raw, "<i4")])
            want = np.cumsum([len(c.encode()) for c in part])
            cuts = np.searchsorted(ends, want) + 1
            if len(ends) and ends[-1] == want[-1] and (ends[cuts - 1] == want).all():
                cuts = [0, *(4 * cuts).tolist()]
                out += [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
            else:
                out += self.encode([c[1:] for c in part])
        return out


class Pieces:
    """A ``sentencepiece`` model, with the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece
        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self._sp.is_byte(i) else p.replace("\u2581", " ").encode()
                       for i, p in enumerate(pieces)]
        self.widths = np.array([len(t) for t in self.tokens], np.int64)
        #: No piece goes on over a space, so words between single spaces are
        #: encoded as if each stood alone.
        self.by_words = not any("\u2581" in p.lstrip("\u2581") for p in pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<i4").tobytes() for ids in self._sp.encode(texts, num_threads=1)]


class Encoder:
    """Ids of texts by both tokenizers.  Where words stand between single
    spaces, both treat each with the space before it by itself: such chunks are
    encoded once and kept.  Texts with white space beside a space, with the
    piece model's own mark of a space, or with a chunk that either one does not
    give back, are encoded whole."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self._ids_a: dict[str, bytes] = {}
        self._ids_b: dict[str, bytes] = {}
        self._odd: set[str] = set()

    @staticmethod
    def _back(tok: ByteLevel | Pieces, raw: list[bytes], texts: list[str]) -> list[bool]:
        """Do the tokens of each text give back space + text?"""
        want = [b" " + t.encode("utf-8", "replace") for t in texts]
        ids = np.frombuffer(b"".join(raw), "<i4")
        ends = np.append(0, np.cumsum(tok.widths[ids]))[np.cumsum([len(r) // 4 for r in raw])] if raw else np.empty(0)
        if np.array_equal(ends, np.cumsum([len(w) for w in want])) and \
                b"".join(map(tok.tokens.__getitem__, ids.tolist())) == b"".join(want):
            return [True] * len(want)
        return [b"".join(tok.tokens[i] for i in np.frombuffer(r, "<i4").tolist()) == w for r, w in zip(raw, want)]

    def _learn(self, chunks: list[str]) -> None:
        plain = []
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace() or "\u2581" in c:
                self._odd.add(c)
            else:
                plain.append(c)
        ids_a, ids_b = self.a.encode_chunks(plain), self.b.encode(plain)
        for c, x, y, *same in zip(plain, ids_a, ids_b, self._back(self.a, ids_a, plain), self._back(self.b, ids_b, plain)):
            if all(same):
                self._ids_a[c], self._ids_b[c] = x, y
            else:
                self._odd.add(c)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both tokenisations of each text, empty where either one does not give
        the text back."""
        if len(self._ids_a) + len(self._odd) > CHUNK_MEMO:
            for kept in (self._ids_a, self._ids_b, self._odd):
                kept.clear()
        split = [t.split(" ") if t and self.b.by_words else [] for t in texts]
        seen = set()
        for s in split:
            seen.update(s)
        self._learn([c for c in seen if c not in self._ids_a and c not in self._odd])
        out: list = []
        for t, s in zip(texts, split):
            if s and self._odd.isdisjoint(s):
                out.append((b"".join(map(self._ids_a.__getitem__, s)), b"".join(map(self._ids_b.__getitem__, s))))
            elif t:
                x, y = self.a.encode([t]), self.b.encode([t])
                same = self._back(self.a, x, [t]) == self._back(self.b, y, [t]) == [True]
                out.append((x[0], y[0]) if same else (b"", b""))
            else:
                out.append((b"", b""))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path_a: str, path_b: str) -> Encoder:
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = Encoder(ByteLevel(path_a), Pieces(path_b))
    return _ENCODERS[path_a, path_b]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token of each token of two tilings of the same bytes, as
    numbers of B tokens, by pointer jumping.  ``ends_a`` and ``ends_b`` are the
    tokens' end offsets, ascending.

    Of tokens that end together, B's counts as farther right.  So an A token
    points to the B token that covers its last byte, and a B token to the A
    token that covers its last byte if that one ends later, else to itself."""
    n = len(ends_a)
    to_b = n + np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    to = np.concatenate([to_b, np.where(ends_a[to_a] > ends_b, to_a, own)]) if n else own
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n] - n, to[n:] - n
        to = farther


class Aligned:
    """The alignment of a block of texts: ids of A and B tokens, the document of
    each group, and each group's first tokens (one past the last at the end)."""

    def __init__(self, texts: list[str | None], encoder: Encoder):
        raw = encoder.encode([t or "" for t in texts])
        self.n_a, self.n_b = (np.array([len(r[k]) // 4 for r in raw], np.int64) for k in (0, 1))
        self.ids_a, self.ids_b = (np.frombuffer(b"".join([r[k] for r in raw]), "<i4").astype(np.int64) for k in (0, 1))
        wide = encoder.a.widths, encoder.b.widths
        last_a, last_b = terminals(np.cumsum(wide[0][self.ids_a]), np.cumsum(wide[1][self.ids_b]))
        ends = np.flatnonzero(np.diff(last_b, append=-1)) + 1  # past the last B token of each group
        self.first_b = np.append(0, ends)
        self.first_a = np.append(0, np.flatnonzero(np.diff(last_a, append=-1)) + 1)
        self.doc = np.searchsorted(np.cumsum(self.n_b), ends - 1, "right")
        self.group_a, self.group_b = np.diff(self.first_a), np.diff(self.first_b)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, len(self.n_a)).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, number of links), each pair of a document once."""
        many = self.group_a * self.group_b
        small = np.flatnonzero(many <= WIDE_GROUP)
        count = many[small]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        g = np.repeat(small, count)
        b = self.group_b[g]
        key = (self.doc[g] << CODE_BITS) | (self.ids_a[self.first_a[g] + at // b] << B_BITS) | self.ids_b[self.first_b[g] + at % b]
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        key, weight = key[new], np.diff(np.append(new, len(key)))
        wide = np.flatnonzero(many > WIDE_GROUP)
        if len(wide):
            keys, weights = [key], [weight]
            for k in wide:
                x, nx = np.unique(self.ids_a[self.first_a[k]:self.first_a[k + 1]], return_counts=True)
                y, ny = np.unique(self.ids_b[self.first_b[k]:self.first_b[k + 1]], return_counts=True)
                keys.append(((self.doc[k] << CODE_BITS) | (x[:, None] << B_BITS) | y).ravel())
                weights.append((nx[:, None] * ny).ravel())
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, np.concatenate(weights))
            weight = total
        return key >> CODE_BITS, key & ((1 << CODE_BITS) - 1), weight

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups ``a1,a2|b1;...`` in lower-case hex;
        '' without tokens."""
        strings, at_a, at_b = [], [], []
        for group, first, ids, mark in ((self.group_a, self.first_a, self.ids_a, "|"), (self.group_b, self.first_b, self.ids_b, ";")):
            last = np.zeros(len(ids), np.int64)
            last[first[1:] - 1] = 1
            size = int(ids.max(initial=0)) + 1
            table = np.array([f"{i}," for i in range(size)] + [f"{i}{mark}" for i in range(size)], object)
            strings.append(table[ids + last * size])
        # A tokens of a group, then its B tokens
        g_a, g_b = (np.repeat(np.arange(len(g)), g) for g in (self.group_a, self.group_b))
        at_a = np.arange(len(g_a)) + self.first_b[:-1][g_a]
        at_b = np.arange(len(g_b)) + self.first_a[1:][g_b]
        flat = np.empty(len(g_a) + len(g_b), object)
        flat[at_a], flat[at_b] = strings
        out, lo, parts = [], 0, flat.tolist()
        for n in (self.n_a + self.n_b).tolist():
            text = "".join(parts[lo:lo + n])
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
            lo += n
        return out


_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()),
    T.StructField("links", T.BinaryType()), T.StructField("n_pairs", T.LongType()),
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(T.LongType()))])
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()),
    ("links", pa.binary()), ("n_pairs", pa.int64()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), "<i4").astype(np.int64)


def _block_rows(block: int, ids: list, texts: list, encoder: Encoder) -> Iterator[pa.RecordBatch]:
    """A row per document, with its pairs as numbers of the block's distinct
    pairs and their links, and one row with those pairs."""
    al = Aligned(texts, encoder)
    doc, code, weight = al.links()
    codes, at, holders = np.unique(code, return_inverse=True, return_counts=True)
    groups, links = al.per_doc(np.ones(len(al.doc))), np.bincount(doc, weight, len(texts)).astype(np.int64)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    pairs, numbers, sizes = [], [], np.diff(cuts)
    for lo, hi in zip(cuts, cuts[1:]):
        pairs.append(_packed(np.diff(at[lo:hi], prepend=0)))
        numbers.append(_packed(weight[lo:hi]))
    n = len(texts)
    yield pa.RecordBatch.from_arrays([
        pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()),
        pa.array(al.n_a), pa.array(al.n_b), pa.array(groups), pa.array(links), pa.array(al.digests()),
        pa.array(pairs, pa.binary()), pa.array(numbers, pa.binary()), pa.array(sizes, pa.int64()),
        pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=_BLOCK_ARROW)
    yield pa.RecordBatch.from_pylist([{"block": block, "row": None, "codes": codes, "docs": holders}], schema=_BLOCK_ARROW)


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(path_a, path_b)
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                texts.append(None if raw is None else raw.decode("utf-8", "replace"))
                size += len(raw or b"")
                if size >= BLOCK_BYTES or len(ids) >= 50_000:
                    yield from _block_rows(block, ids, texts, enc)
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield from _block_rows(block, ids, texts, enc)
    return run


_RESULT = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    T.StructField("groups_sha256", T.StringType())])


def _scores(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The rows of a block with the corpus-wide counts of its pairs."""
    count = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, bool)
    number = pairs["number"].to_numpy()
    count[number], best[number] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for raw, links, n in zip(docs["pairs"].to_pylist(), docs["links"].to_pylist(), docs["n_pairs"].to_pylist()):
        at, weight = np.cumsum(_unpacked(raw, n)), _unpacked(links, n)
        n_best.append(int(weight[best[at]].sum()))
        total.append(int((weight * count[at]).sum()))
    return pa.table({**{c: docs[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()),
                     "groups_sha256": docs["groups_sha256"]})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: in how many documents ids a and b are linked, and
    whether that is the most of any pair of a."""
    each = blocks.filter("row is null").select(F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    sums = each.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.docs").alias("count"))
    a = F.shiftright("code", B_BITS)
    per_a = Window.partitionBy(a)  # at most as many pairs as B has ids
    return sums.select("code", a.alias("a"), F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "count",
                       (F.col("count") == F.max("count").over(per_a)).alias("best"))


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The aligned documents as staged blocks, which :func:`pair_counts` and
    :func:`link_scores` read."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stage(slim.mapInArrow(_blocks(path_a, path_b), _BLOCK), "alignment")


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document ``id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` (see :func:`align`)."""
    named = aligned.filter("row is null").select(F.col("block").alias("its_block"), F.posexplode("codes").alias("number", "code"))
    scored = named.join(counts.select("code", "count", "best"), "code").select("its_block", "number", "count", "best")
    rows = aligned.filter("row is not null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                                                    "pairs", "links", "n_pairs")
    return rows.groupBy("block").cogroup(scored.groupBy("its_block")).applyInArrow(_scores, _RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` (long), ``n_a`` and ``n_b`` (tokens),
    ``n_groups`` (parts between byte offsets where tokens of both end),
    ``n_links`` (pairs of an A and a B token of one group), ``n_best`` (links
    whose id pair is linked in as many documents as any pair of its A id),
    ``count_sum`` (those documents, summed over links), ``groups_sha256``.

    A is a byte-level BPE file of ``tokenizers`` applied to space + text, B a
    ``sentencepiece`` model that adds the space itself.  Null and empty texts,
    and texts that either one does not give back byte for byte, have no tokens.
    Repeated rows are documents each, null ids stay, other columns are ignored,
    an empty table gives no rows.  A very long text is a block of its own.  A
    pair that all documents hold has one row per block, not per document."""
    aligned = blocks(docs, path_a, path_b, id_col, text_col)
    return link_scores(aligned, pair_counts(aligned)).withColumnRenamed("id", id_col)
