"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its assistant texts are intersected with the token spans by binary
search.  Control strings inside texts are escaped, so the rendered text can be
read back to the same turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import require, small_batches

# The template's control strings (fixed values): around the texts of a role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE={}]", "[/ROLE]")
_INSIDE = r"/?s>|/?INST\]|<SYS>>|</SYS>>|ROLE=|/ROLE\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_INSIDE})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_INSIDE})")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\[/INST\]|<<SYS>>(.*?)<</SYS>>|\[ROLE=([^\]]*)\](.*?)\[/ROLE\]", re.S)
#: Characters of a conversation that are held at once; a longer one is given in
#: parts, cut between turns.
PART_CHARS = 4_000_000
#: What follows the last letter of a closing mark.
_TAIL = re.compile(r"[^\w\s]*\Z")


def escape(text: str) -> str:
    """Puts one more backslash into every control string."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text of (role, text) turns, and the spans of its assistant
    texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        at = m.end()
        assistant, user, system, name, other = m.groups()
        for role, body in (("assistant", assistant), ("user", user), ("system", system), (unquote(name or ""), other)):
            if body is not None:
                turns.append((role, unescape(body)))
    if at != len(formatted):
        raise ValueError(f"text outside turns at {at}")
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]], size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet an assistant text, and the parts of the text that these
    tokens cover inside the assistant spans.  ``offsets`` are (start, end) of
    tokens; both lists are sorted, so each token finds its spans by binary
    search.  A token over the edge of a span counts, clipped to the span."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool), []
    starts, ends = np.array(spans).T
    first = np.searchsorted(ends, offsets[:, 0], "right")
    behind = np.searchsorted(starts, offsets[:, 1], "left")
    hit = (first < behind) & (offsets[:, 1] > offsets[:, 0])
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, np.clip(offsets[hit, 0], 0, size), 1)
    np.add.at(cover, np.clip(offsets[hit, 1], 0, size), -1)
    cover = np.cumsum(cover)[:size] > 0
    out = []
    for lo, hi in spans:
        if lo == hi:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cover[lo:hi], [False]]).astype(np.int8)))
        out += [(lo + int(a), lo + int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return hit, out


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def _turns_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, int, list[tuple[str, str]], bool]]:
    """(conversation, part, turns, is there another part) of rows sorted by
    conversation and turn."""
    conv, part, held, chars, begun = None, 0, [], 0, False
    for batch in batches:
        for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if begun and (c != conv or chars >= most):
                yield conv, part, held, c == conv
                part, held, chars = (part + 1 if c == conv else 0), [], 0
            conv, begun = c, True
            held.append((role or "", text or ""))
            chars += len(text or "")
    if begun:
        yield conv, part, held, False


def encode_parts(tok, texts: Iterator[tuple[str, bool]]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Ids and offsets of the parts of one text, each with whether another part
    follows; joined, they are those of the text encoded at once.

    A part ends with a closing mark, letters and then signs, and the next one
    begins with the signs and letters of an opening mark.  The split pattern
    always ends a match between a letter and a sign, but may take the signs on
    both sides of the cut as one match.  So the signs at a part's end are
    encoded with the next part, where their offsets are below zero."""
    before = ""
    for text, more in texts:
        after = _TAIL.search(text)[0] if more else ""
        enc = tok.encode(before + text[:len(text) - len(after)], add_special_tokens=False)
        yield enc.ids, np.array(enc.offsets, np.int64).reshape(-1, 2) - len(before)
        before = after


def format_conversations(turns: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """``id_col, part, formatted, ids, loss, loss_spans`` per conversation:
    the rendered text, its token ids, one byte a token (1 under the loss), and
    the [start, end) places in ``formatted`` that lie under the loss.

    Rows go by turn, ties by role and text.  Null roles and texts are empty, a
    null id is a conversation of its own, repeated rows are repeated turns, an
    empty table gives no rows.  The rows of a conversation stream through one
    task in order; a conversation over ``part_chars`` is given in several parts, so
    memory is bounded however many turns it has.  Its parts' ids and masks, one
    after the other, are those of the whole conversation encoded once; a token
    over a cut stands at the beginning of the later part."""
    require(turns, id_col, turn_col, role_col, text_col)
    small_batches(turns.sparkSession)
    slim = turns.select(F.col(id_col).alias("c"), F.col(role_col).cast("string").alias("r"),
                        F.col(text_col).cast("string").alias("t"), F.col(turn_col).alias("n"))
    dealt = slim.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    kind = slim.schema["c"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        first = next(batches, None)
        if first is None:
            return
        key = first.schema.field(0).type

        def chain():
            yield first
            yield from batches

        rendered: list = []

        def texts() -> Iterator[tuple[str, bool]]:
            for conv, part, held, more in _turns_of(chain(), part_chars):
                text, spans = render(held)
                rendered[:] = [conv, part, text, spans]
                yield text, more

        for ids, offsets in encode_parts(tok, texts()):
            conv, part, text, spans = rendered
            hit, loss = loss_mask(offsets, spans, len(text))
            yield pa.RecordBatch.from_arrays([
                pa.array([conv], key), pa.array([part], pa.int32()), pa.array([text], pa.string()),
                pa.array([ids], pa.list_(pa.int32())), pa.array([hit.astype(np.uint8).tobytes()], pa.binary()),
                pa.array([[x for s in loss for x in s]], pa.list_(pa.int32()))],
                names=[id_col, "part", "formatted", "ids", "loss", "loss_spans"])

    return dealt.mapInArrow(run, T.StructType([
        T.StructField(id_col, kind), T.StructField("part", T.IntegerType()), T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss", T.BinaryType()),
        T.StructField("loss_spans", T.ArrayType(T.IntegerType()))]))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the output of :func:`format_conversations` alone:
    ``id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Parts follow each other in a partition, so the digests are streamed."""
    kind = formatted.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(s):
            return pa.RecordBatch.from_arrays([
                pa.array([s[0]], s[1]), pa.array([s[2]], pa.int64()), pa.array([s[3].hexdigest()]),
                pa.array([s[4]], pa.int64()), pa.array([s[5].hexdigest()]), pa.array([s[6]], pa.int64())],
                names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, part, text, spans in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if part == 0:
                    if state:
                        yield done(state)
                    state = [conv, batch.schema.field(0).type, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                state[2] += len(turns)
                state[3].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                # spans that touch are one assistant text, so unescape them as one
                for lo, hi in _joined(spans):
                    loss = unescape(text[lo:hi])
                    state[4] += len(loss)
                    state[5].update(loss.encode())
                state[6] += len(text)
        if state:
            yield done(state)

    return formatted.select(id_col, "part", "formatted", "loss_spans").mapInArrow(run, T.StructType([
        T.StructField(id_col, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())]))


def _joined(flat: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in zip(flat[::2], flat[1::2]):
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
