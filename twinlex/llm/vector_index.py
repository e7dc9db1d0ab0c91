"""Exact top-k search by inner product over an index of pivots and distances.

Every vector is keyed by its nearest pivot and its distance to it. A pivot's vectors, in order of distance, are cut into rings.
By the triangle inequality no vector of a ring is closer to a query than the ring's distances to the pivot allow, which bounds
its inner product; a query looks into the rings of the highest bounds first and leaves out those below its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common

#: Vectors that pivots and cuts between rings are fitted on, at most. All vectors are indexed.
SAMPLE = 8192
#: Pivots and rings of each, at most: the directory has so many rows at most, whatever the table.
PIVOTS, RINGS = 256, 32
#: Vectors that a ring should have at least, and those of a shelf, which is what a task compares with some queries, at most.
RING, SHELF = 256, 32_768
#: Queries that meet a shelf in one task.
QUERIES = 32_768
#: Rings that a query looks into first; each later round goes on to eight times as many.
FIRST, WIDER = 8, 8
#: Room for rounding in bounds, relative to the numbers that they are made of.
_SLACK = 1e-6


def quantized(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, vec): floor(scale * component) as little-endian 32-bit integers. Odd rows: see search()."""
    common.share_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = bad[ends] == bad[ends - n]
            whole = np.floor(scale * flat[np.repeat(good, n)])
            if len(whole) and np.abs(whole).max() >= 1 << 31:
                raise ValueError("components are too large for 32 bits")
            at = np.concatenate([[0], np.cumsum(n[good])]) * 4
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(whole.astype("<i4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), blobs], ["id", "vec"])

    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).mapInArrow(run, "id bigint, vec binary")


def dense(blobs: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A matrix of doubles of the vectors, shorter ones filled up with zeros."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks() if blobs.num_chunks != 1 else blobs.chunk(0)
    out = np.zeros((len(blobs), dim))
    n = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(blobs.to_pylist()), "<i4")
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


@dataclass
class Directory:
    """Pivots, the cuts between their rings, and of each ring the vectors, distances and largest squared length in it. Of bounded size."""

    pivots: np.ndarray
    cuts: np.ndarray
    dim: int
    rings: np.ndarray = None
    low: np.ndarray = None
    high: np.ndarray = None
    square: np.ndarray = None
    shelf: np.ndarray = None
    local: np.ndarray = None
    parts: np.ndarray = None

    @classmethod
    def fitted(cls, sample: np.ndarray, n: int) -> Directory:
        """Pivots as centres of the sample's nearest points, moved five times; cuts at equal shares of each one's distances."""
        many = int(np.clip(np.sqrt(n) / 4, 1, min(PIVOTS, len(sample))))
        rings = int(np.clip(n // (many * RING), 1, RINGS))
        pivots = sample[np.linspace(0, len(sample) - 1, many).astype(int)]
        for _ in range(5):
            own = cls(pivots, None, sample.shape[1]).distances(sample).argmin(axis=1)
            size = np.bincount(own, minlength=many)
            for d in range(sample.shape[1]):
                pivots[:, d] = np.where(size > 0, np.bincount(own, sample[:, d], many) / np.maximum(size, 1), pivots[:, d])
        apart = cls(pivots, None, sample.shape[1]).distances(sample)
        own = apart.argmin(axis=1)
        cuts = np.full((many, rings - 1), np.inf)
        for p in range(many):
            if len(own_d := np.sort(apart[own == p, p])):
                cuts[p] = own_d[np.arange(1, rings) * len(own_d) // rings]
        return cls(pivots, cuts, sample.shape[1])

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def ring_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's ring and its distance to the ring's pivot."""
        apart = self.distances(x)
        own = apart.argmin(axis=1)
        away = np.sqrt(((x - self.pivots[own]) ** 2).sum(axis=1))
        inner = (away[:, None] >= self.cuts[own]).sum(axis=1)
        return own * (self.cuts.shape[1] + 1) + inner, away

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and ring, what no inner product can exceed: (|q|^2 + |x|^2 - d^2) / 2 with the least distance d."""
        away = self.distances(q)[:, self.rings // (self.cuts.shape[1] + 1)]
        square = (q * q).sum(axis=1)[:, None] + self.square[None, :]
        room = _SLACK * np.sqrt(square + 1)
        least = np.maximum(np.maximum(away - self.high - room, self.low - away - room), 0)
        return (square - least * least) / 2 + _SLACK * (square + 1)

    def fill(self, rows: list) -> None:
        """Take in what the table's rings hold: rows (ring, n, low, high, square) in order of ring; rings come to shelves in that order."""
        self.rings, self.low, self.high, self.square = (np.array([r[i] for r in rows], kind) for i, kind in ((0, np.int64), (2, float), (3, float), (4, float)))
        n = np.array([r[1] for r in rows], np.int64)
        room = int(np.clip(n.sum() // 64, 1024, SHELF))
        self.parts = -(-n // room)
        self.shelf, self.local = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        shelf, held, local = 0, 0, 0
        for i, size in enumerate(n.tolist()):
            if held and held + size > room:
                shelf, held, local = shelf + 1, 0, 0
            self.shelf[i], self.local[i] = shelf, local
            held, local = held + size, local + 1
            if self.parts[i] > 1:  # several shelves of its own
                shelf, held, local = shelf + int(self.parts[i]), 0, 0


def _best(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k highest scores of each row, ties to the lower rank: score << 16 | 65535 - rank. Keys of absent scores are the least."""
    key = score << 16 | 65_535 - rank
    return -np.partition(-key, k - 1, axis=1)[:, :k] if key.shape[1] > k else key


_NONE = -(1 << 63) + 1


def compared(q: np.ndarray, floor: np.ndarray, wanted: np.ndarray, x: np.ndarray, ring: np.ndarray, rank: np.ndarray, bound: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """The best k keys (see _best) of each query over the rings it wants, or _NONE; x stands in order of ring.

    floor: the k-th score that a query has found elsewhere. A ring whose bound lies below what the query has by then is left out.
    """
    top = np.full((len(q), k), _NONE, np.int64)
    starts, sizes = common.runs_of(ring)
    largest = max((np.abs(m).max() for m in (q, x) if m.size), default=0)
    kind = np.float32 if largest * largest * q.shape[1] < 1 << 24 else np.float64 if largest * largest * q.shape[1] < 1 << 46 else None
    if kind is None:
        raise ValueError("inner products are too large for 46 bits")
    q, x = q.astype(kind), x.astype(kind)
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        r = int(ring[start])
        on = np.flatnonzero(wanted[:, r] & (bound[:, r] >= np.maximum(floor, np.where(top.min(axis=1) > _NONE, top.min(axis=1) >> 16, _NONE))))
        for i in range(0, len(on), step):
            who = on[i : i + step]
            for j in range(start, start + size, 4096):
                part = slice(j, min(j + 4096, start + size))
                found = _best((q[who] @ x[part].T).astype(np.int64), rank[part], k)
                both = np.concatenate([top[who], found], axis=1)
                top[who] = -np.partition(-both, k - 1, axis=1)[:, :k]
    return top


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k rows of the highest inner product for each row whose key is divisible by `every`.

    Components are floor(scale * x). Candidates are all rows but the query's own; ties go to the smaller key. Vectors that are
    null or hold nulls, NaN or infinities take no part, nor do rows without a key; shorter vectors count as filled up with zeros. Rows
    that repeat a key are queries and candidates each. Equal vectors are searched for and found as one: a table may consist of
    copies. Components beyond 32 bits after scaling, or products beyond 46, raise an error. Other columns aren't read; an empty
    table gives an empty result.
    """
    spark, most = rows.sparkSession, k + 1
    flat = common.stored(quantized(rows, key, vector, scale), "vectors")
    alike = Window.partitionBy("vec").orderBy("id")
    first = flat.withColumn("no", F.row_number().over(alike)).filter(F.col("no") <= most).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = common.stored(first.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.length("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(1, width // 4)
    asked = common.stored(flat.filter(F.col("id") % every == 0).join(classes.select("vec", "cid"), "vec").select(F.col("id").alias("query_id"), "cid"), "queries")
    sample = classes.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toArrow()
    directory = Directory.fitted(dense(sample.column("vec"), dim), n)
    fitted = spark.sparkContext.broadcast(directory)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(2), dim)
            ring, away = fitted.value.ring_of(x)
            yield pa.RecordBatch.from_arrays([pa.array(ring), pa.array(away), pa.array((x * x).sum(axis=1)), *batch.columns], ["ring", "away", "square", "cid", "least", "vec"])

    placed = classes.select("cid", F.col("ids")[0].alias("least"), "vec").mapInArrow(place, "ring bigint, away double, square double, cid bigint, least bigint, vec binary")
    index = common.stored(placed, "index")
    directory.fill(index.groupBy("ring").agg(F.count("*"), F.min("away"), F.max("away"), F.max("square")).orderBy("ring").collect())
    shelves = spark.createDataFrame([tuple(map(int, r)) for r in zip(directory.rings, directory.shelf, directory.local, directory.parts, strict=True)], "ring bigint, base bigint, local int, parts bigint")
    known = spark.sparkContext.broadcast(directory)
    queries = common.stored(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "vec"), "asked")
    groups = max(1, -(-queries.count() // QUERIES))
    shelved = index.join(F.broadcast(shelves), "ring").select((F.col("base") + F.pmod(F.xxhash64("cid"), "parts")).alias("shelf"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "local", "cid", "least", "vec")

    start, size, top = 0, FIRST, None
    while start < len(directory.rings):
        stop = start + size
        state = queries.withColumn("floor", F.lit(_NONE)) if top is None else queries.join(top.groupBy("cid").agg(F.when(F.count("*") >= most, F.min("score")).alias("floor")), "cid", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
        requests = common.stored(state.select("cid", "vec", "floor").mapInArrow(_asking(known, start, stop), "shelf bigint, cid bigint, vec binary, floor bigint, wanted binary, bound binary"), "requests")
        spread = requests.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int"))
        found = spread.groupby("shelf", "part").cogroup(shelved.groupby("shelf", "part")).applyInArrow(_meeting(dim, most), "cid bigint, score bigint, least bigint, other bigint")
        every_one = found if top is None else top.unionByName(found)
        ranked = Window.partitionBy("cid").orderBy(F.col("score").desc(), "least")
        top = common.stored(every_one.withColumn("no", F.row_number().over(ranked)).filter(F.col("no") <= most).drop("no"), "best")
        common.drop_stored(requests)
        start, size = stop, size * WIDER
    rows_of = top.join(classes.select(F.col("cid").alias("other"), "ids"), "other").select("cid", "score", "other", F.explode("ids").alias("id"))
    ranked = Window.partitionBy("cid").orderBy(F.col("score").desc(), "id")
    lists = rows_of.withColumn("no", F.row_number().over(ranked)).filter(F.col("no") <= most).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("no", "id", "score", "other"))).alias("top"))
    own = F.array_position(F.transform("top", lambda t: (t["other"] == F.col("cid")) & (t["id"] == F.col("query_id"))), F.lit(True))
    kept = F.slice(F.filter("top", lambda t, i: i + 1 != F.col("own")), 1, k)
    out = asked.join(lists, "cid").withColumn("own", own).select("query_id", F.posexplode(kept).alias("at", "t"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))


def _asking(known, start: int, stop: int):
    """For each query the rings that come from start to before stop in its order of bounds, if they may reach its floor, by shelf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d: Directory = known.value
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                floor = batch.column(2).to_numpy()
                bound = d.bounds(dense(batch.column(1), d.dim))
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                who = np.repeat(np.arange(len(order)), order.shape[1])
                ring = order.ravel()
                on = bound[who, ring] >= floor[who]
                who, ring = who[on], ring[on]
                who, ring = np.repeat(who, d.parts[ring]), np.repeat(ring, d.parts[ring])
                part = np.arange(len(ring)) - np.repeat(first := common.runs_of(who << 32 | ring)[0], np.diff(np.append(first, len(ring))))
                shelf = d.shelf[ring] + part
                order = np.lexsort((d.local[ring], shelf, who))
                who, ring, shelf = who[order], ring[order], shelf[order]
                starts, sizes = common.runs_of(who << 32 | shelf)
                cut = lambda values, kind: pa.array([v.astype(kind).tobytes() for v in np.split(values, starts[1:])][: len(starts)], pa.binary())  # noqa: B023, E731
                rows = batch.take(pa.array(who[starts]))
                yield pa.RecordBatch.from_arrays([pa.array(shelf[starts]), *rows.columns, cut(d.local[ring], "<i4"), cut(bound[who, ring], "<f8")], ["shelf", "cid", "vec", "floor", "wanted", "bound"])

    return run


def _meeting(dim: int, most: int):
    """Compares the queries of a group with its shelf."""

    def run(asking: pa.Table, shelf: pa.Table) -> pa.Table:
        shelf = shelf.sort_by([("local", "ascending"), ("least", "ascending")])
        ring, least = shelf.column("local").to_numpy().astype(np.int64), shelf.column("least").to_numpy()
        by_least = np.argsort(least, kind="stable")  # least ids differ between classes but for repeated keys
        rank = np.empty(len(least), np.int64)
        rank[by_least] = np.arange(len(least))
        if len(least) > 1 << 16:
            raise ValueError("a shelf has more than 65536 vectors")
        wanted, bounds = (b"".join(asking.column(c).to_pylist()) for c in ("wanted", "bound"))
        local, n = np.frombuffer(wanted, "<i4"), pc.binary_length(asking.column("wanted")).to_numpy() // 4
        rings = int(max(ring.max(initial=0), local.max(initial=0))) + 1
        who = np.repeat(np.arange(len(n)), n)
        want, bound = np.zeros((len(n), rings), bool), np.zeros((len(n), rings))
        want[who, local], bound[who, local] = True, np.frombuffer(bounds, "<f8")
        floor = asking.column("floor").to_numpy()
        top = compared(dense(asking.column("vec"), dim), floor, want, dense(shelf.column("vec"), dim), ring, rank, bound, most)
        who, at = np.nonzero((top > _NONE) & (top >> 16 >= floor[:, None]))
        keys = top[who, at]
        hit = by_least[65_535 - (keys & 65_535)]
        other = shelf.column("cid").to_numpy()
        return pa.table({"cid": asking.column("cid").to_numpy()[who], "score": keys >> 16, "least": least[hit], "other": other[hit]})

    return run
