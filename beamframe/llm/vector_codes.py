"""Compression of vectors to short codes: product quantization whose nearest entries are found by slice-and-intersect bitmasks.

For each dimension a codebook's entries are sorted by coordinate, and a prefix mask at each place of that order tells
which entries stand before it. The entries within a radius of a point in one dimension are the difference of two prefix
masks; ANDed over the dimensions they are the entries of the cube around the point. A cube as wide as the distance of any
entry holds all entries that are as near, so after the initial radius one wider cube is enough and the result is exact.
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

#: Points whose pairs with entries are expanded at once.
BLOCK = 1024


class SliceMasks:
    """The nearest of k entries (k x w whole numbers) for points."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.k, self.w = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        words = -(-self.k // 64)
        own = np.zeros((self.k, words), np.uint64)
        own[np.arange(self.k), np.arange(self.k) // 64] = np.uint64(1) << (np.arange(self.k) % 64).astype(np.uint64)
        self.prefix = np.zeros((self.w, self.k + 1, words), np.uint64)
        for d in range(self.w):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]], axis=0)
        self.all = np.bitwise_or.reduce(own, axis=0)
        # the initial radius: half of the entries have another one in such a cube
        apart = np.abs(entries[:, None, :] - entries[None, :, :]).max(axis=2)
        apart[np.arange(self.k), np.arange(self.k)] = np.iinfo(np.int64).max
        self.radius = max(1, int(np.median(apart.min(axis=1)))) if self.k > 1 else 1

    def inside(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no further than radius from each point in any dimension."""
        found = np.broadcast_to(self.all, (len(points), len(self.all))).copy()
        for d in range(self.w):
            low = np.searchsorted(self.sorted[d], points[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], points[:, d] + radius, "right")
            found &= self.prefix[d][high] ^ self.prefix[d][low]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each point; among equally near ones the lower index."""
        parts = [self._nearest(points[i : i + BLOCK]) for i in range(0, len(points), BLOCK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        seen = np.zeros((len(points), len(self.all)), np.uint64)
        open_, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        while len(open_):
            mask = self.inside(points[open_], radius)
            fresh = mask & ~seen[open_]
            seen[open_] = mask
            row, entry = np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little").nonzero()
            distance = np.zeros(len(row), np.int64)
            for d in range(self.w):
                step = points[open_[row], d] - self.entries[entry, d]
                distance += step * step
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                least = np.minimum.reduceat(distance, first)
                hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[first, len(row)])))
                hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # pairs of a row stand by index
                p, e, x = open_[row[hit]], entry[hit], distance[hit]
                better = (x < best[p]) | ((x == best[p]) & (e < at[p]))
                at[p[better]], best[p[better]] = e[better], x[better]
            near = best[open_]
            done = near <= radius * radius
            known = near < np.iinfo(np.int64).max
            radius = np.where(known, np.ceil(np.sqrt(np.where(known, near, 0).astype(float))).astype(np.int64) + 1, radius * 2)[~done]
            open_ = open_[~done]
        return at, best


def _parts(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(x) for x in np.split(vectors, parts, axis=1)]


def partial_sums(batches: Iterator[pa.RecordBatch], codebooks: list[np.ndarray], scale: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, s0, ...): what a task's vectors add to the entries nearest to them."""
    masks = [SliceMasks(c) for c in codebooks]
    k, w = codebooks[0].shape
    counts, sums = np.zeros((len(masks), k), np.int64), np.zeros((len(masks), k, w), np.int64)
    for batch in batches:
        for p, points in enumerate(_parts(matrix(batch["v"], w * len(masks), scale), len(masks))):
            if len(points):
                n, s = group_sums(points, masks[p].nearest(points)[0], k)
                counts[p] += n
                sums[p] += s
    part, entry = counts.nonzero()
    columns = [part, entry, counts[part, entry], *sums[part, entry].T]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["part", "entry", "n", *[f"s{j}" for j in range(w)]])


def coded(batches: Iterator[pa.RecordBatch], codebooks: list[np.ndarray], scale: int) -> Iterator[pa.RecordBatch]:
    masks = [SliceMasks(c) for c in codebooks]
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [m.nearest(p) for m, p in zip(masks, _parts(matrix(batch["v"], codebooks[0].shape[1] * len(masks), scale), len(masks)), strict=True)]
        codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
        error = np.sum([f[1] for f in found], axis=0)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def fit_codebooks(kept: DataFrame, dims: int, parts: int, size: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Codebooks (size x dims / parts) after the given rounds; only entries and their sums, bounded by parts * size, reach the driver."""
    floor = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    first = kept.where("vec_id IS NOT NULL").select("vec_id", floor.alias("q")).orderBy("vec_id", "q").limit(size).collect()
    codebooks = _parts(np.array([r["q"] for r in first], np.int64).reshape(len(first), dims), parts)
    w = dims // parts
    schema = ", ".join(["part long", "entry long", "n long", *[f"s{j} long" for j in range(w)]])
    for _ in range(rounds if first else 0):
        now = codebooks
        rows = summed(kept.select("v").mapInArrow(lambda batches, now=now: partial_sums(batches, now, scale), schema), ["part", "entry"], w).collect()
        counts, sums = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), w), np.int64)
        for r in rows:
            counts[r[0], r[1]], sums[r[0], r[1]] = r[2], r[3:]
        codebooks = [moved(c, counts[p], sums[p]) for p, c in enumerate(codebooks)]
    return codebooks


def compress(vectors: DataFrame, dims: int = 64, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, vec: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) for each usable vector, and the codebooks.

    Dropped: vectors that are null, that hold null, NaN or infinite components, or that have not dims components (an
    empty vector is one of these). A row without vec_id is coded but starts no codebook; where no row has one, nothing is
    coded. Repeated rows are rows of their own; rows of one vec_id start codebooks in the order of their components. Fewer
    rows than size give as many entries; an empty table gives no rows. Ties go to the lower entry. A component of 2^27 /
    scale or more raises an error, as distances would not fit. Columns other than vec_id, label and vec are not read, so
    their names don't matter; texts are not read either. size is 256 at most, as an index has two hex digits.
    """
    if dims % parts or not 0 < size <= 256:
        raise ValueError("parts must divide dims, and size is 1 to 256")
    kept = vectors.where(usable(vec, dims)).select("vec_id", "label", F.col(vec).alias("v"))
    codebooks = fit_codebooks(kept, dims, parts, size, rounds, scale)
    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not len(codebooks[0]):
        return kept.sparkSession.createDataFrame([], schema), codebooks
    return kept.mapInArrow(lambda batches: coded(batches, codebooks, scale), schema), codebooks


def decode(code: str, codebooks: list[np.ndarray]) -> np.ndarray:
    """The whole numbers a code stands for."""
    return np.concatenate([c[i] for c, i in zip(codebooks, bytes.fromhex(code), strict=True)])


def fingerprint(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256; rows as in compress().

    Sums are built before anything meets: a label that a third of the rows carry is one row of sums for each task. The
    join on labels is Spark's own, by broadcast where the written sums are small, else a sort-merge join whose hot labels
    adaptive execution splits.
    """
    codes, codebooks = compress(vectors, **options)
    codes = materialize(codes, "codes")
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "own")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
