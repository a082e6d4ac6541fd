"""Centroid clustering over zone maps: vectors in Hilbert order are cut into blocks, and a block's box leaves few centroids to compare.

The Hilbert curve runs through the dimensions of largest variance, so vectors of a block lie near each other. A block
keeps the least and the largest value of each dimension. No vector of it is nearer to a centroid than the box is, and
each is at most as far from it as the box's furthest corner: a centroid whose box distance exceeds another's corner
distance is out for the whole block. The rest are compared exactly, the block's vectors at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.shared import materialize
from beamframe.llm.vectors import group_sums, matrix, moved, summed, usable

AXES, BITS = 8, 8
#: Vectors of a block.
BLOCK = 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates under 2^bits) along the Hilbert curve, as a signed 64-bit number in curve order."""
    x = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        at, below = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            high = (x[i] & at) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint64(b)) & one, turn ^ ((one << np.uint64(b)) - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ turn) >> np.uint64(b)) & one)
    return (key ^ (one << np.uint64(63))).view(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids, ascending, that may be the nearest of some vector in the box low..high."""
    gap = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    reach = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())


def assign(points: np.ndarray, few: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of points among the centroids numbered few, ascending; ties to the smaller number."""
    steps = points[:, None, :] - centroids[few]
    distance = (steps * steps).sum(axis=2)
    at = distance.argmin(axis=1)
    return few[at], distance[np.arange(len(points)), at]


def _extent(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    n, low, high, total, square = 0, np.full(dims, 1 << 62), np.full(dims, -(1 << 62)), np.zeros(dims), np.zeros(dims)
    for batch in batches:
        q = matrix(batch["v"], dims, scale)
        if len(q):
            n, low, high = n + len(q), np.minimum(low, q.min(axis=0)), np.maximum(high, q.max(axis=0))
            total, square = total + q.sum(axis=0), square + (q.astype(float) ** 2).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(dims), np.full(dims, n), low, high, total.astype(float), square)], ["d", "n", "low", "high", "total", "square"])


def _keyed(batches: Iterator[pa.RecordBatch], dims: int, scale: int, axes: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q = matrix(batch["v"], dims, scale)
        cells = np.stack([(q[:, d] - low) * (1 << BITS) // (high - low + 1) for d, low, high in axes], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, BITS)), batch["vec_id"], pa.ListArray.from_arrays(np.arange(0, q.size + 1, dims, dtype=np.int32), pa.array(q.ravel().astype(np.int32)))], ["place", "vec_id", "q"])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its rows' vec_ids, the vectors end to end, and the box."""
    for batch in batches:
        q = matrix(batch["q"], dims)
        at = list(range(0, len(q), BLOCK))
        parts = [q[i : i + BLOCK] for i in at]
        lists = lambda rows, kind: pa.array([list(r) for r in rows], pa.list_(kind))
        ids = [batch["vec_id"].slice(i, BLOCK).to_pylist() for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(batch["vec_id"].type)), lists([p.ravel().tolist() for p in parts], pa.int32()), lists([p.min(axis=0).tolist() for p in parts], pa.int32()), lists([p.max(axis=0).tolist() for p in parts], pa.int32())], ["ids", "q", "low", "high"])


def zone_blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """Written table of blocks (ids, q, low, high) of vectors (vec_id, v) in Hilbert order.

    Equal vectors are dealt on by vec_id, so a vector that a third of the rows hold fills as many blocks as it needs.
    """
    extent = kept.select("v").mapInArrow(lambda b: _extent(b, dims, scale), "d long, n long, low long, high long, total double, square double")
    spread = F.sum("square") / F.sum("n") - F.pow(F.sum("total") / F.sum("n"), 2)
    rows = extent.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"), spread.alias("spread")).collect()
    axes = [(r["d"], r["low"], r["high"]) for r in sorted(rows, key=lambda r: (-r["spread"], r["d"]))[:AXES]] or [(0, 0, 0)]
    kind = dict(kept.dtypes)["vec_id"]
    keyed = kept.mapInArrow(lambda b: _keyed(b, dims, scale, axes), f"place long, vec_id {kind}, q array<int>")
    ordered = keyed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return materialize(ordered.mapInArrow(lambda b: _blocks(b, dims), f"ids array<{kind}>, q array<int>, low array<int>, high array<int>"), "blocks")


def _assigned(batches: Iterator[pa.RecordBatch], dims: int, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, points, centroid, distance) of each block."""
    for batch in batches:
        low, high = matrix(batch["low"], dims), matrix(batch["high"], dims)
        for i in range(batch.num_rows):
            points = np.asarray(batch["q"][i].values, dtype=np.int64).reshape(-1, dims)
            yield batch["ids"][i].values, points, *assign(points, candidates(low[i], high[i], centroids), centroids)


def _sums(batches: Iterator[pa.RecordBatch], dims: int, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for _, points, at, _ in _assigned(batches, dims, centroids):
        n, s = group_sums(points, at, k)
        counts, sums = counts + n, sums + s
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in (held, counts[held], *sums[held].T)], ["cluster", "n", *[f"s{j}" for j in range(dims)]])


def _labelled(batches: Iterator[pa.RecordBatch], dims: int, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, _, at, distance in _assigned(batches, dims, centroids):
        yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for each usable vector, and the final centroids (whole numbers).

    Dropped: vectors that are null, that hold null, NaN or infinite components, or that have not dims components. A row
    without vec_id is clustered but starts no cluster; where no row has one, nothing is clustered. Repeated rows are rows
    of their own; rows of one vec_id start clusters in the order of their components. Fewer rows than k give as many
    clusters; an empty table gives no rows. Ties go to the smaller number. A component of 2^27 / scale or more raises an
    error. Columns other than vec_id and vec are not read, so their names don't matter; texts are not read either.
    """
    kept = vectors.where(usable(vec, dims)).select("vec_id", F.col(vec).alias("v"))
    floor = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    draw = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id IS NOT NULL").select(draw.alias("h"), floor.alias("q")).orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long"
    if not first:
        return kept.sparkSession.createDataFrame([], schema), centroids
    blocks = zone_blocks(kept, dims, scale)
    for _ in range(rounds):
        now = centroids
        rows = summed(blocks.mapInArrow(lambda b, now=now: _sums(b, dims, now), ", ".join(["cluster long", "n long", *[f"s{j} long" for j in range(dims)]])), ["cluster"], dims).collect()
        counts, sums = np.zeros(len(now), np.int64), np.zeros((len(now), dims), np.int64)
        for r in rows:
            counts[r[0]], sums[r[0]] = r[1], r[2:]
        centroids = moved(now, counts, sums)
    return blocks.mapInArrow(lambda b: _labelled(b, dims, centroids), schema), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; rows as in cluster()."""
    found, centroids = cluster(vectors, **options)
    found = materialize(found, "clusters")
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    each = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    return found.select(
        "vec_id", "cluster", "distance", each([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), each([digest(c) for c in centroids], "string").alias("centroid_sha256")
    )
