"""Exact top-k search by inner product with an M-tree.

Inner products become distances by one more coordinate: with M the largest norm
of a candidate, (a, sqrt(M^2 - |a|^2)) is the nearer to (q, 0), the larger q.a.
In this space the tree has routing objects (a bounded sample of the rows), and
under each of them pages of near rows with a centre, a covering radius and the
stored distances centre-parent and row-centre.  A search takes nodes best-first
and leaves out nodes, and the computation of distances, that the triangle
inequality excludes by stored distances alone.

The pages lie in shards, which range partitioning cuts by (routing object,
distance, row), so equal vectors spread too.  Inside a shard the rows of a
routing object are split by two far pivots, each row to the nearer one, down to
pages.  Queries travel in blocks: first to the shard that holds them, which
yields a bound for their k-th score, then to those other shards that the
distances to the routing objects do not exclude."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.common import require, small_batches, stage

#: Routing objects, rows of a page and of a shard, queries of a block, blocks of a task.
ROUTES, PAGE, SHARD, BLOCK, TASK_BLOCKS = 64, 128, 16_384, 256, 32
#: (shard, routing object) pairs up to which queries are held against all shards
#: before they travel: one or two a shard, so 10^10 vectors.
MAX_SUMMARY = 1_000_000
_PAGE_SCHEMA = ("shard int, route int, parent_distance double, radius double, least_id long, ids binary, rows binary, "
                "centre binary, vectors binary, distances binary")


def _slacks(q2: float, norm2: float) -> tuple[float, float]:
    """What rounding may do to a distance and to a score."""
    return 1e-7 + 1e-10 * float(np.sqrt(q2 + norm2)), 1e-6 + 1e-12 * (q2 + norm2)


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, or null for a vector that is null,
    empty, or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, ints)


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, :len(v)] = v
    return out


def _lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(1)))[:, None]], 1)


def _router(routes: np.ndarray, width: int, norm2: float):
    squares = (routes * routes).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _lifted(_matrix(b.column(1).to_pylist(), width), norm2)
            d2 = np.maximum(0.0, (v * v).sum(1)[:, None] + squares - 2 * v @ routes.T)
            near = d2.argmin(1)
            dist = np.sqrt(((v - routes[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.int32()), pa.array(dist)],
                                             names=["id", "v", "row", "route", "distance"])
    return run


def _pages_of(x: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of pages of at most PAGE rows: a set is split by two far
    pivots, each row to the nearer one, until it fits; rows at one point are cut
    as they come."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= PAGE:
            yield rows
            continue
        v = x[rows]
        first = v[((v - v.mean(0)) ** 2).sum(1).argmax()]
        to_first = ((v - first) ** 2).sum(1)
        second = v[to_first.argmax()]
        left = to_first <= ((v - second) ** 2).sum(1)
        if left.all():
            half = len(rows) // 2
            todo += [rows[:half], rows[half:]]
        else:
            todo += [rows[left], rows[~left]]


def _pager(routes: np.ndarray, width: int, norm2: float):
    """Pages of a shard from its rows, which come sorted by route and distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()

        def pages(route: int, ids: np.ndarray, rows: np.ndarray, vs: list) -> pa.RecordBatch:
            x, out = _lifted(_matrix(vs, width), norm2), []
            for own in _pages_of(x):
                v = x[own]
                centre = v[((v - v.mean(0)) ** 2).sum(1).argmin()]
                d = np.sqrt(((v - centre) ** 2).sum(1))
                out.append((shard, route, float(np.sqrt(((centre - routes[route]) ** 2).sum())), float(d.max()), int(ids[own].min()),
                            ids[own].tobytes(), rows[own].tobytes(), centre.tobytes(), np.ascontiguousarray(v[:, :width]).tobytes(),
                            d.tobytes()))
            return pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in _PAGE_SCHEMA.split(", ")]).astype(
                {"shard": "int32", "route": "int32"}), preserve_index=False)

        at, ids, rows, vs = None, [], [], []
        for b in batches:
            for i, v, row, route in zip(*[b.column(c).to_pylist() for c in range(4)]):
                if ids and (route != at or len(ids) == SHARD):
                    yield pages(at, np.array(ids, np.int64), np.array(rows, np.int64), vs)
                    ids, rows, vs = [], [], []
                at = route
                ids.append(i)
                rows.append(row)
                vs.append(v)
        if ids:
            yield pages(at, np.array(ids, np.int64), np.array(rows, np.int64), vs)
    return run


class ShardTree:
    """The part of the tree that lies in one shard."""

    def __init__(self, pages: pd.DataFrame, routes: np.ndarray, width: int, norm2: float):
        self.norm2 = norm2
        self.distances_computed = 0
        self.ids = [np.frombuffer(x, np.int64) for x in pages["ids"]]
        self.rows = [np.frombuffer(x, np.int64) for x in pages["rows"]]
        self.vectors = [np.frombuffer(x).reshape(-1, width) for x in pages["vectors"]]
        self.distances = [np.frombuffer(x) for x in pages["distances"]]
        self.centres = np.stack([np.frombuffer(x) for x in pages["centre"]])
        self.radius = pages["radius"].to_numpy()
        self.parent = pages["parent_distance"].to_numpy()
        self.least = pages["least_id"].to_numpy()
        route = pages["route"].to_numpy()
        self.nodes = [(routes[r], np.flatnonzero(route == r)) for r in np.unique(route)]
        self.reach = [float((self.parent[kids] + self.radius[kids]).max()) for _, kids in self.nodes]

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The best ``k`` (score, id) of the shard, without row ``own`` and
        scores under ``floor``; best first, ties to the smaller id."""
        lifted = np.append(q, 0.0)
        q2 = float(q @ q)
        near_by, about = _slacks(q2, self.norm2)
        exact = max(q2, self.norm2) < 2.0 ** 52       # sums of products are whole numbers of a double
        best: list[tuple[int, int]] = []      # heap of (score, -id), worst first

        def hopeless(nearest: float, least_id: int) -> bool:
            most = np.floor((q2 + self.norm2 - max(0.0, nearest - near_by) ** 2) / 2 + about)
            if most < floor:
                return True
            return len(best) == k and (most < best[0][0] or most == best[0][0] and least_id > -best[0][1])

        heap: list[tuple[float, bool, int, int, float]] = []      # bound, is page, least id, number, distance
        for n, (route, _) in enumerate(self.nodes):
            d = float(np.sqrt(((lifted - route) ** 2).sum()))
            self.distances_computed += 1
            heapq.heappush(heap, (max(0.0, d - self.reach[n]), False, 0, n, d))
        while heap:
            nearest, is_page, _, n, d = heapq.heappop(heap)
            if not is_page:
                kids = self.nodes[n][1]
                # stored parent distances first: pages that need no distance
                bound = np.abs(d - self.parent[kids]) - self.radius[kids]
                kids = kids[[not hopeless(b, -1 << 63) for b in bound]] if len(best) == k or floor > -np.inf else kids
                if len(kids):
                    dc = np.sqrt(((self.centres[kids] - lifted) ** 2).sum(1))
                    self.distances_computed += len(kids)
                    for p, x in zip(kids.tolist(), dc.tolist()):
                        low = max(0.0, x - self.radius[p])
                        if not hopeless(low, int(self.least[p])):
                            heapq.heappush(heap, (low, True, int(self.least[p]), p, x))
                continue
            if hopeless(nearest, int(self.least[n])):
                continue
            ids, rows, vectors = self.ids[n], self.rows[n], self.vectors[n]
            least = max(floor, best[0][0]) if len(best) == k else floor
            if least > -np.inf:
                # rows that the stored distance to the centre excludes
                limit = np.sqrt(max(0.0, q2 + self.norm2 - 2 * least + about)) + near_by
                near = np.abs(self.distances[n] - d) <= limit
                ids, rows, vectors = ids[near], rows[near], vectors[near]
            self.distances_computed += len(ids)
            scores = np.rint(vectors @ q).astype(np.int64) if exact else vectors.astype(np.int64) @ q.astype(np.int64)
            order = np.lexsort((ids, -scores))[:k + 1]
            for s, i, row in zip(scores[order].tolist(), ids[order].tolist(), rows[order].tolist()):
                if row == own or s < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


_FOUND = "query long, query_id long, id long, score long"


def _searcher(routes: np.ndarray, width: int, norm2: float, k: int):
    def run(pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(pages) and len(blocks):
            tree = ShardTree(pages, routes, width, norm2)
            for ids, rows, vectors, floors in zip(blocks["ids"], blocks["rows"], blocks["vectors"], blocks["floors"]):
                for i, row, q, f in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(rows, np.int64).tolist(),
                                        np.frombuffer(vectors).reshape(-1, width), np.frombuffer(floors)):
                    found += [(row, i, j, s) for s, j in tree.search(row, q, k, f)]
        return pd.DataFrame(found, columns=["query", "query_id", "id", "score"])
    return run


_BLOCK_SCHEMA = "block long, home int, ids binary, rows binary, vectors binary, floors binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]


def _block(number: int, home: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, floors: np.ndarray) -> list[pa.Array]:
    return [pa.array([number], pa.int64()), pa.array([home], pa.int32()),
            *[pa.array([np.ascontiguousarray(x).tobytes()]) for x in (ids, rows, v, floors)]]


def _blocker(width: int, every: int):
    """Query blocks of the pages of a partition, with their home shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, home = TaskContext.get().partitionId() << 33, [], None

        def out():
            ids, rows = (np.array(x, np.int64) for x in list(zip(*held))[:2])
            return pa.RecordBatch.from_arrays(_block(number, home, ids, rows, np.stack([v for _, _, v in held]),
                                                     np.full(len(ids), -np.inf)), names=_BLOCK_NAMES)

        for b in batches:
            for shard, ids, rows, vectors in zip(*[b.column(c).to_pylist() for c in range(4)]):
                ids, rows, v = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(vectors).reshape(-1, width)
                for k in np.flatnonzero(ids % every == 0):
                    if held and (home != shard or len(held) == BLOCK):
                        yield out()
                        number, held = number + 1, []
                    home = shard
                    held.append((int(ids[k]), int(rows[k]), v[k]))
        if held:
            yield out()
    return run


def _floors(k: int):
    """Query blocks of a home shard with the k-th score that it already has."""
    def run(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        kth = {i: g["score"].min() for i, g in found.groupby("query") if len(g) >= k}
        out = blocks.copy()
        out["floors"] = [np.array([kth.get(i, -np.inf) for i in np.frombuffer(x, np.int64).tolist()], float).tobytes()
                         for x in blocks["rows"]]
        return out[_BLOCK_NAMES]
    return run


class Summary:
    """For each shard and routing object in it, the least and the largest
    distance that a row may have to the routing object."""

    def __init__(self, rows: list[tuple[int, int, float, float]], routes: np.ndarray, norm2: float):
        self.shard, self.route = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.low, self.high = (np.array([r[k] for r in rows], float) for k in (2, 3))
        self.routes, self.norm2 = routes, norm2

    def wanted(self, v: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, numbers of the queries that it may hold a match for)."""
        lifted = np.concatenate([v, np.zeros((len(v), 1))], 1)
        d = np.sqrt(np.maximum(0.0, (lifted * lifted).sum(1)[:, None] + (self.routes * self.routes).sum(1) - 2 * lifted @ self.routes.T))
        q2 = (v * v).sum(1)
        room = q2 + self.norm2
        # the expanded square loses half of a double's digits
        limit = np.sqrt(np.maximum(0.0, room - 2 * np.maximum(floors, -room) + 1e-6 + 1e-12 * room)) + 1e-6 + 1e-7 * np.sqrt(room)
        near = d[:, self.route]
        may = np.maximum(self.low - near, near - self.high) <= limit[:, None]
        for shard in np.unique(self.shard):
            which = np.flatnonzero(may[:, self.shard == shard].any(1))
            if len(which):
                yield int(shard), which


def _travellers(width: int, summary: Summary):
    """Query blocks with the shards they go to, their home left out, cut to the
    queries that the shard may hold a match for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, home, ids, rows, vectors, floors in zip(*[b.column(c).to_pylist() for c in range(6)]):
                ids, rows, floors = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(floors)
                v = np.frombuffer(vectors).reshape(-1, width)
                for shard, own in summary.wanted(v, floors):
                    if shard != home:
                        yield pa.RecordBatch.from_arrays(
                            [*_block(number, home, ids[own], rows[own], v[own], floors[own]), pa.array([shard], pa.int32())],
                            names=[*_BLOCK_NAMES, "shard"])
    return run


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
          scale: float = 256.0) -> DataFrame:
    """``query_id, rank, id_col, score``: for every row whose id is divisible by
    ``every``, the ``k`` rows of the highest inner product (all, if fewer) of
    the vectors floor(scale * x), itself left out, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty or hold a null or
    non-finite component, take no part.  Rows that repeat an id are rows like
    others: each is a query if its id is, and a candidate of all but itself.
    Shorter vectors count as filled up with zeros.  Other columns are ignored;
    an empty table gives no rows."""
    require(rows, id_col, vector_col)
    spark = rows.sparkSession
    small_batches(spark)
    base = stage(rows.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"))
                 .filter("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("w")).first()
    n, norm2, width = facts["n"], float(facts["m"] or 0.0), facts["w"] or 1
    sample = base.orderBy(F.xxhash64("id"), "id", "v").limit(ROUTES).collect()      # ROUTES rows at most
    routes = _lifted(_matrix([r["v"] for r in sample], width), norm2) if sample else np.zeros((1, width + 1))

    routed = base.mapInArrow(_router(routes, width, norm2), "id long, v array<double>, row long, route int, distance double")
    shards = max(1, -(-n // SHARD))
    sorted_rows = routed.repartitionByRange(shards, "route", "distance", "row").sortWithinPartitions("route", "distance", "row")
    pages = stage(sorted_rows.select("id", "v", "row", "route").mapInArrow(_pager(routes, width, norm2), _PAGE_SCHEMA), "pages")
    blocks = stage(pages.select("shard", "ids", "rows", "vectors").mapInArrow(_blocker(width, every), _BLOCK_SCHEMA), "blocks")
    search = _searcher(routes, width, norm2, k)

    def run(sides: DataFrame, groups: int) -> DataFrame:
        """Searches ``sides`` (blocks with a ``shard``) in the shards; a task
        has one shard and TASK_BLOCKS blocks or so."""
        part = F.pmod(F.xxhash64("block"), F.lit(groups))
        dealt = pages.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return dealt.groupBy("shard", "part").cogroup(
            sides.withColumn("part", part).groupBy("shard", "part")).applyInPandas(
            lambda key, p, b: search(p, b), _FOUND)

    groups = max(1, blocks.count() // TASK_BLOCKS)
    at_home = stage(run(blocks.withColumn("shard", F.col("home")), 1), "home")
    homes = pages.select("shard", "ids", "rows").mapInArrow(_owner(every), "query long, home int")
    kept = at_home.join(homes, "query")
    tight = stage(blocks.groupBy("home").cogroup(kept.groupBy("home")).applyInPandas(_floors(k), _BLOCK_SCHEMA), "floors")
    found = at_home
    if shards > 1:
        ranges = pages.groupBy("shard", "route").agg(F.min(F.col("parent_distance") - F.col("radius")).alias("low"),
                                                     F.max(F.col("parent_distance") + F.col("radius")).alias("high"))
        known = ranges.limit(MAX_SUMMARY + 1).collect()
        if len(known) <= MAX_SUMMARY:
            away = stage(tight.mapInArrow(_travellers(width, Summary([tuple(r) for r in known], routes, norm2)),
                                          f"{_BLOCK_SCHEMA}, shard int"), "travellers")
            groups = max(1, -(-away.count() // (TASK_BLOCKS * shards)))
        else:
            away = tight.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        found = at_home.unionByName(run(away, groups))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {int(k)}").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _owner(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw, rows in zip(*[b.column(c).to_pylist() for c in range(3)]):
                rows = np.frombuffer(rows, np.int64)[np.frombuffer(raw, np.int64) % every == 0]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), shard, np.int32))],
                                                 names=["query", "home"])
    return run
