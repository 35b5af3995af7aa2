"""Near-duplicate documents by circulant MinHash, banding and exact checks.

1. One pass over the texts: the set of distinct word shingles, its digest, and
   a signature.  Two permutations of a universe of 2**32 cells make all
   coordinates: the first scatters the shingles, the second is shifted
   circularly by k for coordinate k.
2. Documents with equal sets become one class, found by their digest.
3. Classes that agree on a whole band share a bucket.  Every member is checked
   against the bucket's hub only (a star, linear in the bucket), and the
   confirmed links are contracted to components.
4. In buckets whose members still lie in several components, the pairs across
   components are compared too: pair by pair in small buckets, and in large
   ones between blocks of strays and of members, inside tasks of bounded size
   that give back the confirmed links only.  Pairs whose sketches agree five
   standard deviations below the threshold are left out there; a pair at the
   threshold is so with a probability below 3e-7.  No group is expanded to all
   its pairs.
5. Links are confirmed on the full shingle sets.

With 25 bands of 5 rows, a pair at a similarity of 0.85 shares no bucket with
probability 4e-7; with 28 bands of 4 rows, so does a pair at 0.8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import discard, require, small_batches, stage
from reqlens.llm.components import connected_components

BANDS, ROWS = 25, 5
#: What :func:`drop_near_duplicates` takes: a similarity of 0.8, and bands for it.
DROP = {"num": 80, "den": 100, "bands": 28, "rows": 4}
#: Buckets up to SMALL compare their unconnected members pair by pair; larger
#: ones are dealt in blocks of at most STRAYS by BLOCK members.
SMALL, STRAYS, BLOCK = 64, 256, 512
#: Words whose hash a worker keeps.
WORD_MEMO = 400_000

#: Any character that is part of a word.
NOT_BLANK = "[^\\x20\\x09-\\x0d]"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POLY = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHash()


def _mix64(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser, a permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _mix32(x: np.ndarray) -> np.ndarray:
    """Murmur's 32-bit finaliser in place, a permutation of the universe."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; empty without words."""
    ws = (text or b"").translate(_LOWER).split()
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, ws), np.uint64, n)
    k = min(n, size)
    acc = h[:n - k + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc *= _POLY
            acc += h[j:n - k + 1 + j]
        return np.unique(_mix64(acc + np.uint64(k)))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(coordinates, documents) minima of non-empty sets."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    with np.errstate(over="ignore"):
        cells = (_mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((coordinates, len(sets)), np.uint32)
        for k in range(coordinates):
            out[k] = np.minimum.reduceat(_mix32(cells + np.uint32(k)), starts)
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    with np.errstate(over="ignore"):
        keys = np.empty((sig.shape[1], bands), np.uint64)
        for b in range(bands):
            acc = np.full(sig.shape[1], b + 1, np.uint64)
            for r in range(rows):
                acc = _mix64(acc * _POLY + sig[b * rows + r])
            keys[:, b] = acc
    return keys.view(np.int64)


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sketch = [None] * len(sets), [None] * len(sets)
            for at in range(0, len(full), 256):
                part = full[at:at + 256]
                sig = signatures([sets[i] for i in part], bands * rows)
                low = np.ascontiguousarray(sig.T.astype(np.uint16))
                for i, k, s in zip(part, _band_keys(sig, bands, rows).tolist(), low):
                    keys[i], sketch[i] = k, s.tobytes()
            cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "n", "cls", "bands", "sketch"])
    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                names=["cls", "shingles"])
    return run


def _checker(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = (np.asarray([], bool), []) if not batch.num_rows else (batch.column(2), batch.column(3))
            ok = []
            for x, y in zip(xs, ys):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(_similar(x, y, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))
    return run


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return den * both >= num * (len(x) + len(y) - both)


def _small_pairs(least: int):
    """Pairs of different components in buckets of at most SMALL members, whose
    sketches agree on at least ``least`` coordinates."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[bytes, bytes]] = set()
        for _, g in pdf.groupby(["band", "key"], sort=False):
            sk = np.stack([np.frombuffer(s, np.uint16) for s in g["sketch"]])
            cls, comp = g["cls"].to_numpy(), pd.factorize(g["comp"])[0]
            for i in range(len(g) - 1):
                js = i + 1 + np.flatnonzero(comp[i + 1:] != comp[i])
                js = js[(sk[js] == sk[i]).sum(1) >= least]
                found.update((min(cls[i], cls[j]), max(cls[i], cls[j])) for j in js)
        return pd.DataFrame(sorted(found), columns=["a", "b"])
    return run


def _block_links(least: int, num: int, den: int):
    """Confirmed links between the strays of a block and the members of another
    block of the same bucket.  Each pair is looked at in the first band that it
    shares only, and not once a link has joined its components."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        for (band, _, _, _), g in pdf.groupby(["band", "key", "sb", "mb"], sort=False):
            stray = g["stray"].to_numpy()
            mine, rest = np.flatnonzero(stray), np.flatnonzero(~stray)
            if not len(mine) or not len(rest):
                continue
            sk = np.stack([np.frombuffer(s, np.uint16) for s in g["sketch"]])
            keys = np.stack([np.asarray(k, np.int64) for k in g["bands"]])
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            cls, comp = g["cls"].to_numpy(), pd.factorize(g["comp"])[0]
            for i in mine:
                js = rest[comp[rest] != comp[i]]
                js = js[(keys[js] == keys[i]).argmax(1) == band]
                agree = (sk[js] == sk[i]).sum(1)
                for j in js[np.argsort(-agree, kind="stable")][:int((agree >= least).sum())]:
                    if comp[i] != comp[j] and _similar(sets[i], sets[j], num, den):
                        found.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``
    (least id of the component), ``kept`` (the id is that least id).

    Texts link when ``den`` * intersection >= ``num`` * union of their shingle
    sets.  Null or blank texts have an empty set and stay alone.  Repeated rows
    come out once each.  A null id counts as larger than any other; a
    component of null ids only has a null ``component_id`` and is kept.
    Other columns are ignored; an empty table gives no rows."""
    judged, _ = _judged(docs, id_col, text_col, shingle, num, den, bands, rows)
    return judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                         F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int, bands: int,
            rows: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """One row per input row: ``id, n, cls, component_id, first``, and the
    staged tables that it reads.  ``first`` rows have the least (id, class) of
    their component, nulls last."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_field = T.StructField("id", slim.schema["id"].dataType)
    signed = stage(slim.mapInArrow(_signer(shingle, bands, rows), T.StructType([
        id_field, T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])), "signed")

    # one row per distinct set: its least id, and whether several rows share it
    reps = stage(signed.filter("cls is not null").groupBy("cls").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")), "classes")

    keyed = reps.select("cls", F.posexplode("bands").alias("band", "key"))
    crowded = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(keyed.join(crowded, ["band", "key"]), "members")
    # a bucket's hub: the member that meets most others in all its buckets,
    # such as the text that the others were copied from
    met = members.groupBy("cls").agg(F.sum("size").alias("met"))
    hubs = stage(members.join(met, "cls").groupBy("band", "key").agg(F.max(F.struct("met", "cls")).alias("h")).select(
        "band", "key", F.col("h.cls").alias("hub")), "hubs")

    def rep_sets(ends: DataFrame) -> DataFrame:
        """``(cls, shingles)`` of the classes ``ends(cls)``, from the texts."""
        ids = reps.join(ends, "cls", "left_semi").select(F.col("rep").alias("_rep")).distinct()
        return slim.join(ids, slim["id"].eqNullSafe(ids["_rep"]), "left_semi").select("text").mapInArrow(
            _setter(shingle), "cls binary, shingles binary").join(ends, "cls", "left_semi")

    def checked(pairs: DataFrame, label: str) -> DataFrame:
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        sets = stage(rep_sets(ends), "sets")
        one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        two = one.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        out = stage(two.select("a", "b", "sa", "sb").mapInArrow(_checker(num, den), "a binary, b binary").distinct(),
                    label)
        discard(sets)
        return out

    stars = stage(members.join(hubs, ["band", "key"]).filter("cls <> hub").select(
        F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct(), "stars")
    links = checked(stars, "links")
    comp = connected_components(links)

    # buckets of three or more whose members are not one component yet
    placed = members.filter("size > 2").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "band", "key", "cls", "size", F.coalesce("comp", "cls").alias("comp"))
    split = placed.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    left = stage(placed.join(split.select("band", "key"), ["band", "key"], "left_semi"), "left")
    # five standard deviations of the estimate below the threshold
    p, k = num / den, bands * rows
    least = int(k * (p - 5 * (p * (1 - p) / k) ** 0.5))
    small, large = left.filter(f"size <= {SMALL}"), left.filter(f"size > {SMALL}")
    n_small, n_large = small.count(), large.count()
    more = []
    marks = signed.filter("cls is not null").select("cls", "sketch", "bands")
    if n_small:
        sketches = marks.join(small.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(
            F.any_value("sketch").alias("sketch"))
        near = small.join(sketches, "cls").withColumn(
            "g", F.pmod(F.xxhash64("band", "key"), F.lit(max(1, n_small // 4000)))).groupBy("g").applyInPandas(
            _small_pairs(least), "a binary, b binary").distinct()
        new = stage(near.join(stars, ["a", "b"], "left_anti"), "near")
        more.append(checked(new, "more"))
        discard(new)
    if n_large:
        more.append(_large_links(large, hubs, marks, rep_sets, least, num, den))
    for found in more:
        links = links.unionByName(found)
    if more and not all(found.isEmpty() for found in more):
        comp = connected_components(links)

    # least id of each class that has company, and the class that stands for all
    shared = reps.join(comp.withColumnRenamed("node", "cls"), "cls", "left").filter(
        "copies > 1 or comp is not null").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    least_id = shared.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "cls")).alias("l"))
    named = stage(shared.join(least_id, "comp").select(
        "cls", F.col("l.rep").alias("component_id"), (F.col("cls") == F.col("l.cls")).alias("head"),
        F.lit(True).alias("found")), "named")
    discard(reps, members, hubs, stars, left)
    rows_out = signed.select("id", "n", "cls")
    joined = rows_out.filter("cls is not null").join(named, "cls", "left").select(
        "id", "n", "cls", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        (F.col("found").isNull() | (F.col("head") & F.col("id").eqNullSafe(F.col("component_id")))).alias("first"))
    alone = rows_out.filter("cls is null").select("id", "n", "cls", F.col("id").alias("component_id"),
                                                  F.lit(True).alias("first"))
    return joined.unionByName(alone), (signed, named)


def _large_links(large: DataFrame, hubs: DataFrame, marks: DataFrame, rep_sets, least: int, num: int, den: int) -> DataFrame:
    """Links inside large buckets between strays, which are not in the hub's
    component, and all members.  Both are dealt in blocks, and a task gets one
    block of each, so its size does not grow with the bucket."""
    head = large.join(hubs, ["band", "key"]).filter("cls = hub").select("band", "key", F.col("comp").alias("main"))
    told = large.join(head, ["band", "key"]).withColumn("stray", F.col("comp") != F.col("main"))
    strays = told.filter("stray").groupBy("band", "key").agg(F.count(F.lit(1)).alias("strays"))
    ends = large.select("cls").distinct()
    full = stage(marks.join(ends, "cls", "left_semi").groupBy("cls").agg(
        F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")).join(rep_sets(ends), "cls"), "full")
    dealt = stage(told.join(strays, ["band", "key"]).select(
        "band", "key", "cls", "comp", "stray", F.ceil(F.col("strays") / STRAYS).cast("int").alias("ns"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("nm")), "dealt")
    own = F.pmod(F.xxhash64("cls"), F.col("ns")).cast("int")
    seat = F.pmod(F.xxhash64("cls"), F.col("nm")).cast("int")
    left = dealt.filter("stray").select("band", "key", "cls", "comp", "stray", own.alias("sb"),
                                        F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"))
    right = dealt.select("band", "key", "cls", "comp", F.lit(False).alias("stray"),
                         F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("sb"), seat.alias("mb"))
    both = stage(left.unionByName(right), "blocks")
    tasks = max(1, both.count() // 1500)
    found = stage(both.join(full, "cls").withColumn(
        "g", F.pmod(F.xxhash64("band", "key", "sb", "mb"), F.lit(tasks))).groupBy("g").applyInPandas(
        _block_links(least, num, den), "a binary, b binary").distinct(), "more")
    discard(full, dealt, both)
    return found


def _class_of(shingle: int):
    """A text's class, as of :func:`_signer`; the text has words."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(shingle_set(t, shingle).tobytes())
                         for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         **options) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate group left,
    that of the least id.  All columns are returned as they came.  ``options``
    go to :func:`near_duplicates`; the defaults are those of DROP.

    Rows are judged by id and text: of rows with one id and equal shingle sets
    one stays, different texts of one id or without an id stay or go by their
    own group.  A null id counts as larger than any other.  Blank texts are in
    no group: one stays for each id, and all of those without an id."""
    judged, reads = _judged(docs, id_col, text_col, shingle, **(DROP | options))
    # ids that lose rows, or may: most documents have an id of their own and stay
    ids = stage(judged.groupBy(F.col("id").alias("_id")).agg(
        F.max(F.col("first").cast("int")).alias("_kept"), F.count(F.lit(1)).alias("_rows")).filter(
        "_kept = 0 or _rows > 1 or _id is null"), "verdict")
    gone = ids.filter("_kept = 0 and _id is not null").select("_id")
    many = ids.filter("_kept = 1 and _rows > 1 and _id is not null").select("_id")
    some, nulls = not many.isEmpty(), not ids.filter("_id is null").isEmpty()
    if not some and not nulls:
        discard(*reads)
        return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")

    first = judged.filter("first and cls is not null").select("id", "cls")
    mine = first.join(many, first["id"] == many["_id"], "left_semi")
    keys = stage((mine.unionByName(first.filter("id is null")) if nulls else mine).distinct(), "firsts")
    discard(*reads)
    named = ids.filter("_id is not null").select("_id")
    out = docs.join(named, docs[id_col] == named["_id"], "left_anti")
    told = docs.join(many, docs[id_col] == many["_id"], "left_semi")
    if nulls:
        out = out.filter(docs[id_col].isNotNull())
        told = told.unionByName(docs.filter(docs[id_col].isNull()))
    rows = told.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.struct("*").alias("row"))
    said = F.col("text").rlike(NOT_BLANK)
    texts = rows.filter(said).withColumn("cls", _class_of(shingle)("text")).alias("r").join(
        keys.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.cls") == F.col("k.cls")), "left_semi")
    blank = rows.filter(~said)
    kept = [texts.dropDuplicates(["id", "cls"]), blank.filter("id is not null").dropDuplicates(["id"])]
    if nulls:
        kept.append(blank.filter("id is null"))
    for part in kept:
        out = out.unionByName(part.select("row.*"))
    return out
