"""Exact top-k inner products by best-first search of M-trees.

Vectors are quantised to integers.  With M the greatest norm, ``x -> (x, sqrt(M^2 - |x|^2))`` and ``q -> (q, 0)``
turn inner products into Euclidean distances, ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``, so the largest products are
the nearest neighbours in a metric space.

* Equal vectors are held once, with their least ids (more can't enter a result).
* Vectors go to the cell of the nearest of at most ``cells`` pivots, within a cell over its size to the nearest of at
  most ``SUBCELLS`` pivots of its own, and what is still over its size is dealt out.  Each shard is an M-tree in pages:
  a page has its objects (routing objects or vectors) with their distances to the parent object and covering radii.
* A query visits a shard's pages in the order of their least possible distance.  An object is skipped unseen if its
  stored distance to the parent already rules it out, and a page if its covering ball does.
* Queries first visit their nearest shard; the score found there then rules out other cells, and shards of the cells
  left, as a whole.  Only the balls of the cells are collected and broadcast, a fixed number; those of shards meet the
  queries in a join by cell, and a tree is copied only for blocks of queries that visit it.

Bounds are computed with a margin for rounding; scores are integers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.blocks import batch, durable, pack, table, unpack

SCALE = 256
TOP = 5
SHARD = 4096
PAGE = 256
FAN = 16
QUERY_BLOCK = 20_000
#: Most pivots of all vectors (the only ones that are broadcast), and most of a cell's own.
CELLS = 1024
SUBCELLS = 256
_CELL, _SUB = 1 << 40, 1 << 24
_ROWS = 2048


def quantise(lists: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[bytes]]:
    """Which vectors take part, and each of those as little-endian 64-bit integers without trailing zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets, flat = np.asarray(lists.offsets, np.int64), lists.values
    x = np.asarray(flat.fill_null(np.nan), np.float64)
    finite = np.isfinite(x)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    start, end = offsets[:-1], offsets[1:]
    keep = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[end] == bad[start]))
    q = np.floor(scale * np.where(finite, x, 0.0)).astype("<i8")
    some = np.append(-1, np.flatnonzero(q))
    start = start[keep]
    end = np.maximum(some[np.searchsorted(some, end[keep]) - 1] + 1, start)  # after the last component that isn't 0
    raw = q.tobytes()
    return keep, [raw[8 * i : 8 * j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    m = np.zeros((len(raw), width), np.int64)
    for i, b in enumerate(raw):
        x = np.frombuffer(b, "<i8")
        m[i, : len(x)] = x
    return m


def _distance(x: np.ndarray, ax: np.ndarray, y: np.ndarray, ay: float) -> np.ndarray:
    """Distances of rows of ``x`` to ``y`` with the added components ``ax`` and ``ay``."""
    d = x - y
    return np.sqrt((d * d).sum(axis=1) + (ax - ay) ** 2)


class MTree:
    """Pages: ``kids`` (child page, or -1 for a vector), ``row`` of each object, distance to the parent object, radius."""

    def __init__(self, x: np.ndarray, top: float, page: int = PAGE, fan: int = FAN, seed: int = 1):
        self.x = x.astype(np.float64)
        self.norm2 = (self.x**2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(top - self.norm2, 0))
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rng = np.random.default_rng(seed)
        rows = np.arange(len(x))
        centre = int(_distance(self.x, self.extra, self.x.mean(axis=0), self.extra.mean()).argmin())
        self.root_row = centre
        self.root = self._build(rows, centre, page, fan, rng)
        self.radius = float(self._to(rows, centre).max())

    def _to(self, rows: np.ndarray, row: int) -> np.ndarray:
        return _distance(self.x[rows], self.extra[rows], self.x[row], self.extra[row])

    def _build(self, rows: np.ndarray, parent: int, page: int, fan: int, rng) -> int:
        if len(rows) <= page:
            self.pages.append((np.full(len(rows), -1), rows, self._to(rows, parent), np.zeros(len(rows))))
            return len(self.pages) - 1
        chosen = rng.choice(rows, min(fan, len(rows)), replace=False)
        near = np.stack([self._to(rows, int(c)) for c in chosen])
        at = near.argmin(axis=0)
        if (at == at[0]).all():  # nothing tells them apart: halves
            at = (np.arange(len(rows)) * 2 // len(rows)).astype(at.dtype)
        kids, objects, radii = [], [], []
        for i in np.unique(at):
            own = rows[at == i]
            centre = int(chosen[i])
            radii.append(float(near[i][at == i].max()))
            kids.append(self._build(own, centre, page, fan, rng))
            objects.append(centre)
        objects = np.array(objects)
        self.pages.append((np.array(kids), objects, self._to(objects, parent), np.array(radii)))
        return len(self.pages) - 1

    def nearest(self, q: np.ndarray, top: float, wanted: int, limit: float, own: np.ndarray | None) -> list[int]:
        """Rows of the ``wanted`` nearest vectors and all that tie with the last, within ``limit``; ``own``: how many of a row's ids count."""
        qn = float((q * q).sum())
        margin = 1e-9 * (1 + np.sqrt(qn + top))

        def dist(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(qn + top - 2 * (self.x[rows] @ q), 0))

        found: list[tuple[float, int]] = []
        bound = limit
        root = float(dist(np.array([self.root_row]))[0])
        heap = [(max(root - self.radius, 0.0), self.root, root)]
        while heap:
            low, page, dp = heapq.heappop(heap)
            if low > bound + margin:
                break
            kids, rows, to_parent, radius = self.pages[page]
            seen = np.abs(dp - to_parent) - radius <= bound + margin
            if not seen.any():
                continue
            rows, kids, radius = rows[seen], kids[seen], radius[seen]
            d = dist(rows)
            if kids[0] >= 0:
                for k, r, x in zip(kids.tolist(), radius.tolist(), d.tolist(), strict=True):
                    if x - r <= bound + margin:
                        heapq.heappush(heap, (max(x - r, 0.0), k, x))
            else:
                good = np.flatnonzero(d <= bound + margin)
                if len(good):
                    found += zip(d[good].tolist(), rows[good].tolist(), strict=True)
                    found.sort()
                    total = 0
                    for i, (x, row) in enumerate(found):
                        total += int(own[row]) if own is not None else 1
                        if total >= wanted:
                            bound = min(bound, x)
                            cut = i + 1
                            while cut < len(found) and found[cut][0] <= x + margin:
                                cut += 1
                            del found[cut:]
                            break
        return [row for _, row in found]


def _local(scale: int, keep: int):
    """Vectors of each batch, equal ones once with their least ids."""
    schema = pa.schema([("q", pa.binary()), ("ids", pa.list_(pa.int64())), ("norm2", pa.int64()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = quantise(b.column(1), scale)
            ids = b.column(0).to_pylist()
            of: dict[bytes, set[int]] = {}
            for i, r in zip(at.tolist(), raw, strict=True):
                if ids[i] is not None:
                    of.setdefault(r, set()).add(ids[i])
            q = list(of)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.binary()), pa.array([sorted(of[r])[:keep] for r in q], pa.list_(pa.int64())), pa.array([int((np.frombuffer(r, "<i8") ** 2).sum()) for r in q], pa.int64()), pa.array([len(r) // 8 for r in q], pa.int32())], schema=schema)

    return run, "q binary, ids array<long>, norm2 long, width int"


TREES = pa.schema([("shard", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64()), ("payload", pa.binary())])
TREES_SQL = "shard long, centre binary, radius double, payload binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])
FOUND_SQL = "query_id long, vec_id long, score long, shard long"


def _nearest(raw: list[bytes], pivots: list[bytes], width: int, top: float) -> np.ndarray:
    """For each vector the number of the nearest pivot."""
    p = _matrix(pivots, width).astype(float)
    pn = (p * p).sum(axis=1)
    extra = np.sqrt(np.maximum(top - pn, 0))
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(raw), _ROWS):
        x = _matrix(raw[i : i + _ROWS], width).astype(float)
        xn = (x * x).sum(axis=1)
        d = xn[:, None] + pn - 2 * (x @ p.T) + (np.sqrt(np.maximum(top - xn, 0))[:, None] - extra) ** 2
        out.append(d.argmin(axis=1))
    return np.concatenate(out)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width, top = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_nearest(b.column(0).to_pylist(), pivots, width, top))], ["q", "ids", "cell"])

    return run


PLACED = pa.schema([("q", pa.binary()), ("ids", pa.list_(pa.int64())), ("shard", pa.int64())])
PLACED_SQL = "q binary, ids array<long>, shard long"


def _refine(width: int, top: float):
    """A share of a large cell's vectors goes to the nearest of the cell's own pivots."""

    def run(key: tuple, own: pa.Table, pivots: pa.Table) -> pa.Table:
        if not own.num_rows:
            return table(PLACED, [])
        at = _nearest(own.column("q").to_pylist(), sorted(pivots.column("q").to_pylist()), width, top)
        return pa.Table.from_arrays([own.column("q"), own.column("ids"), pa.array(key[0].as_py() * _CELL + at * _SUB)], schema=PLACED)

    return run


def _build(width: int, top: float, page: int):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        raw, ids = got.column("q").to_pylist(), got.column("ids").to_pylist()
        order = sorted(range(len(raw)), key=raw.__getitem__)
        x = _matrix([raw[i] for i in order], width)
        t = MTree(x, top, page)
        size = np.array([len(p[0]) for p in t.pages])
        flat = [np.concatenate(c) for c in zip(*t.pages, strict=True)]
        n = np.array([len(ids[i]) for i in order])
        blob = pack(x.ravel(), n, np.array([v for i in order for v in ids[i]], np.int64), size, *flat, np.array([t.root, t.root_row]), np.array([t.radius]))
        return table(TREES, [(key[0].as_py(), x[t.root_row].astype("<i8").tobytes(), t.radius, blob)])

    return run


def _open(blob: bytes, width: int, top: float) -> tuple[MTree, np.ndarray, np.ndarray]:
    x, n, ids, size, kids, rows, to_parent, radius, root, r = unpack(blob)
    t = MTree.__new__(MTree)
    t.x = x.reshape(len(n), width).astype(float)
    cut = np.cumsum(size)[:-1]
    t.pages = list(zip(*(np.split(c, cut) for c in (kids, rows, to_parent, radius)), strict=True))
    t.root, t.root_row, t.radius = int(root[0]), int(root[1]), float(r[0])
    return t, n, ids


def _search(width: int, top: float, k: int):
    def run(key: tuple, trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not trees.num_rows or not queries.num_rows:
            return table(FOUND, [])
        t, n, ids = _open(trees.column("payload")[0].as_py(), width, top)
        begin = np.cumsum(n) - n
        found = []
        q = _matrix(queries.column("q").to_pylist(), width)
        for qid, v, least in zip(queries.column("query_id").to_pylist(), q, queries.column("least").to_pylist(), strict=True):
            f = v.astype(float)
            limit = np.inf if least is None else float(np.sqrt(max((f * f).sum() + top - 2.0 * least, 0)))
            hits = []
            for row in t.nearest(f, top, k + 1, limit, n):  # one more, for the query itself may be among them
                score = int(t.x[row].astype(np.int64) @ v)
                hits += [(-score, int(i)) for i in ids[begin[row] : begin[row] + n[row]] if i != qid]
            found += [(qid, i, -s, key[0].as_py()) for s, i in sorted(hits)[:k]]
        return table(FOUND, found)

    return run


ROUTED = pa.schema([("at", pa.int64()), ("query_id", pa.int64()), ("q", pa.binary()), ("least", pa.int64()), ("seen", pa.int64())])
ROUTED_SQL = "at long, query_id long, q binary, least long, seen long"


def _within(balls: tuple[list, list, list], queries, width: int, top: float, others: bool, shards: bool) -> list[tuple]:
    """Queries with the balls (names, centres, radii) that they visit: the nearest, or all that may hold as good a score, but for the shard already seen."""
    names, centres, radii = balls
    c, r = _matrix(centres, width).astype(float), np.array(radii)
    columns = [queries.column(x).to_pylist() for x in ("query_id", "q", "least", "seen")]
    out = []
    for i in range(0, len(columns[0]), _ROWS):
        qid, raw, least, seen = (x[i : i + _ROWS] for x in columns)
        q = _matrix(raw, width).astype(float)
        qn = (q * q).sum(axis=1)
        low = np.sqrt(np.maximum(qn[:, None] + top - 2 * (q @ c.T), 0)) - r
        if others:
            limit = np.array([np.inf if x is None else np.sqrt(max(n + top - 2.0 * x, 0)) for n, x in zip(qn.tolist(), least, strict=True)])
            rows, balls_ = np.nonzero(low <= (limit + 1e-9 * (1 + np.sqrt(qn + top)))[:, None])
        else:
            rows, balls_ = np.arange(len(q)), low.argmin(axis=1)
        out += [(names[j], qid[k], raw[k], least[k], seen[k]) for k, j in zip(rows.tolist(), balls_.tolist(), strict=True) if not shards or names[j] != seen[k]]
    return out


def _route(shared, others: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, width, top = shared.value
        for b in batches:
            yield batch(ROUTED, _within(balls, b, width, top, others, False))

    return run


def _route_in_cell(width: int, top: float, others: bool):
    def run(key: tuple, roots: pa.Table, queries: pa.Table) -> pa.Table:
        if not roots.num_rows or not queries.num_rows:
            return table(ROUTED, [])
        balls = tuple(roots.column(x).to_pylist() for x in ("shard", "centre", "radius"))
        return table(ROUTED, _within(balls, queries, width, top, others, True))

    return run


def _reach(shared):
    """How far a shard's ball reaches from its cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width, top = shared.value
        p = _matrix(pivots, width).astype(float)
        for b in batches:
            cell = np.asarray(b.column(0)) // _CELL
            x, y = _matrix(b.column(1).to_pylist(), width).astype(float), p[cell]
            extra = lambda v: np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
            d = np.sqrt(((x - y) ** 2).sum(axis=1) + (extra(x) - extra(y)) ** 2)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d + np.asarray(b.column(2)))], ["cell", "reach"])

    return run


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, every: int = 50, k: int = TOP, scale: int = SCALE, shard: int = SHARD, page: int = PAGE, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other vectors for each query (ids divisible by ``every``).

    Components become ``floor(scale * x)``; the score is their integer inner product, which must fit into 53 bits.
    Ties go to the smaller id. Vectors that are null or hold null or non-finite components, and null ids, take no
    part; shorter vectors count as padded with zeros; rows are told apart by id, and a repeated row counts once (of
    several valid vectors with one id all are candidates and the least is the query). An
    empty table gives an empty result; extra columns are ignored; vectors may be of any length.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    run, kinds = _local(scale, k + 1)
    parts = own.mapInArrow(run, kinds)
    base = durable(parts.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("norm2").alias("norm2"), F.first("width").alias("width")))
    n, top, width = base.agg(F.count(F.lit(1)), F.max("norm2"), F.max("width")).first()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width, top = max(width, 1), float(top)
    sc = spark.sparkContext
    pivots = [r["q"] for r in base.orderBy(F.xxhash64("q"), "q").select("q").limit(max(1, min(cells, -(-n // shard)))).collect()]  # a fixed number at most
    shared = sc.broadcast((pivots, width, top))
    shares = F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shares")
    assigned = durable(base.mapInArrow(_assign(shared), "q binary, ids array<long>, cell long"))
    assigned = assigned.join(assigned.groupBy("cell").agg(shares), "cell")
    large = assigned.where("shares > 1")
    placed = assigned.where("shares = 1").select("q", "ids", (F.col("cell") * _CELL).alias("shard"))
    few = F.least("shares", F.lit(SUBCELLS).cast("long"))
    inner = large.groupBy("cell", "shares", F.pmod(F.xxhash64("q", F.lit(1)), few).alias("class")).agg(F.min_by("q", F.struct(F.xxhash64("q", F.lit(2)), "q")).alias("q"))
    inner = inner.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    inner = inner.select(F.col("cell").alias("of_cell"), F.col("share").alias("of_share"), "q")
    dealt = large.withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares"))).groupBy("cell", "share")
    placed = durable(placed.unionByName(dealt.cogroup(inner.groupBy("of_cell", "of_share")).applyInArrow(_refine(width, top), PLACED_SQL)))
    placed = placed.join(placed.groupBy("shard").agg(shares), "shard").withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("q", F.lit(3)), F.col("shares")))
    trees = durable(placed.groupBy("shard").applyInArrow(_build(width, top, page), TREES_SQL))
    roots = trees.select(F.shiftright("shard", 40).alias("cell"), "shard", "centre", "radius")
    reach = trees.select("shard", "centre", "radius").mapInArrow(_reach(shared), "cell long, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).orderBy("cell").collect()
    balls = sc.broadcast((([r["cell"] for r in reach], [pivots[r["cell"]] for r in reach], [r["reach"] for r in reach]), width, top))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, q = quantise(b.column(1), scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(q, pa.binary())], ["query_id", "q"])

    valid = own.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(raw, "query_id long, q binary")
    queries = durable(valid.groupBy("query_id").agg(F.min("q").alias("q")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")

    def copies(of: DataFrame, asked: DataFrame, key: str):
        """Rows of ``of`` for each block of queries that goes to their ``key``."""
        return of.join(asked.select(F.col("at").alias(key), F.col("block").alias("for_block")).distinct(), key).groupBy(key, "for_block")

    def visit(asked: DataFrame, others: bool) -> DataFrame:
        """Scores found, with the shard that was visited."""
        cells_ = durable(asked.select("query_id", "q", "least", "seen").mapInArrow(_route(balls, others), ROUTED_SQL).select("*", block))
        inside = copies(roots, cells_, "cell").cogroup(cells_.groupBy("at", "block"))
        shards = durable(inside.applyInArrow(_route_in_cell(width, top, others), ROUTED_SQL).select("*", block))
        found = copies(trees.select("shard", "payload"), shards, "shard").cogroup(shards.groupBy("at", "block"))
        return found.applyInArrow(_search(width, top, k), FOUND_SQL)

    nothing = F.lit(None).cast("long")
    found = durable(visit(queries.select("query_id", "q", nothing.alias("least"), nothing.alias("seen")), False))
    least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"), F.first("shard").alias("seen"))
    found = found.unionByName(visit(queries.join(least, "query_id", "left"), True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_metric_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
