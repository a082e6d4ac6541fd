"""Exact similarity join on word shingles, by signature trees.

1. Each text becomes its set of distinct shingle hashes; texts with equal sets form a class, and one row stands for it.
2. Shingles are ranked by how common their bucket is (one count for each of BUCKETS buckets: a sketch of fixed size),
   rare ones first. Two sets with Jaccard >= t must share one of their first |x| - ceil(t |x|) + 1 shingles, so the
   rows that share such a shingle meet in a block. Blocks with the same rows are kept once.
3. In each block every row is compared with the block's least row; links join components, and blocks that lie in one
   component are finished.
4. The other blocks get signature trees: leaves are rows with a bitmap and a size, nodes hold OR-combined bitmaps and
   size ranges. Pairs of nodes are descended together and dropped when their greatest possible overlap is below what
   the sizes need. Bitmaps are as wide as their sets need, with a tree for each width; trees of different widths meet
   with the wider bitmaps folded. Large blocks are split into parts, each pair of parts being a task. Remaining pairs
   of different components are compared exactly, and components are joined again.

Joins on a shingle or on a block's least row are salted: a key is dealt to a task for every SALT of its rows, the other
side of the join being repeated as often.

Null, empty or word-less texts are empty sets and link with nothing; texts of any length are read whole. Rows with one
doc_id are one document, which links where any of its texts does (each row keeps its own n_shingles). A null doc_id is no
document: such a row gets the component of the rows with an id and an equal set, else a null. Of equal sets the least
doc_id stands for all. An empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm import textbatch as tb
from beamframe.llm.components import components
from beamframe.llm.shared import materialize, tidy

#: Fixed sizes: of the sketch of shingle counts, of a row's bitmap (a power of two from FEW_BITS to MOST_BITS, two bits a shingle
#: or more between these), of a tree's leaves, and rows of a block that one task takes.
BUCKETS = 1 << 18
FEW_BITS = 2048
MOST_BITS = 1 << 16
LEAF = 8
PART = 2048
#: Rows of a key that one task of a join takes.
SALT = 512
#: Pairs whose ids (16 bytes each) are broadcast to find their texts, keys that are broadcast to salt a join; with more, texts or rows are shuffled to them.
MOST_BROADCAST = 1_000_000


def _sets(batch: pa.RecordBatch, column: str, words: int):
    data, offsets = tb.utf8(batch.column(column))
    for first, last in tb.runs(offsets):
        own = data[offsets[first] : offsets[last]]
        yield first, last, *tb.shingle_sets(own, offsets[first : last + 1] - offsets[first], words)


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of texts fall into each bucket: BUCKETS numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, h in _sets(batch, "text", words):
                total += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        block = total.reshape(-1, 256)
        used = np.flatnonzero(block.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tolist() for x in block[used]], pa.list_(pa.int64()))], ["block", "n"])

    rows = docs.select("text").mapInArrow(tidy(count), "block int, n array<long>").groupBy("block").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(256)]).collect()  # BUCKETS / 256 rows
    out = np.zeros((BUCKETS // 256, 256), np.int64)
    for r in rows:
        out[r[0]] = r[1:]
    return out.ravel()


def bitmap(h: np.ndarray) -> bytes:
    """One bit for each hash; the wider its set, the wider."""
    width = min(max(FEW_BITS, 1 << (2 * len(h) - 1).bit_length()), MOST_BITS) if len(h) else FEW_BITS
    bits = np.zeros(width, np.uint8)
    bits[(h >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with `to` words: parts of a wider one are OR-combined."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), bits.shape[1] // to, to), axis=1)


def signatures(docs: DataFrame, t: tuple[int, int], words: int) -> DataFrame:
    """doc_id, n (set size), fp (of the set), bits (bitmap), prefix (shingles that a partner must share)."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(bucket_counts(docs, words).astype(np.uint64))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.minimum(counts.value, np.uint64((1 << 32) - 1))
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, bounds, h in _sets(batch, "text", words):
                rank = (common[(h % np.uint64(BUCKETS)).astype(np.int64)] << np.uint64(32)) | (h >> np.uint64(32))
                n = np.diff(bounds)
                fps, maps, prefixes = [], [], []
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(tb.mix(h), out=sums[0, 1:])
                np.cumsum(tb.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
                fp = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                for i in range(last - first):
                    a, b = bounds[i], bounds[i + 1]
                    k = int(n[i]) - -(-t[0] * int(n[i]) // t[1]) + 1 if n[i] else 0
                    own = h[a:b]
                    prefixes.append((own[np.argpartition(rank[a:b], k - 1)[:k]] if k < len(own) else own).astype(np.int64))
                    maps.append(bitmap(own))
                    fps.append(fp[:, i].tobytes() + int(n[i]).to_bytes(4, "little"))
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(make), "doc_id long, n long, fp binary, bits binary, prefix array<long>")


class Tree:
    """A signature tree over rows ordered by size: nodes are slices of that order, halved down to leaves."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.bits = n, bits  # bitmaps of one width
        self.slack = n - np.bitwise_count(bits).sum(1, dtype=np.int64)  # elements beyond the first in their bit
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, a: int, b: int) -> tuple:
        """(OR of bitmaps, least size, greatest size, greatest slack) of rows a..b."""
        if (a, b) not in self.nodes:
            self.nodes[a, b] = (np.bitwise_or.reduce(self.bits[a:b], axis=0), int(self.n[a:b].min()), int(self.n[a:b].max()), int(self.slack[a:b].max()))
        return self.nodes[a, b]


def need(total, t: tuple[int, int]):
    """Least overlap that sets of these sizes together need: o / (total - o) >= t."""
    return -(-t[0] * total // (t[0] + t[1]))


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Of pairs of sets with sizes n, m and bitmaps x, y of one width: those that may overlap enough."""
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return most >= need(n + m, t)


def traverse(x: Tree, y: Tree, t: tuple[int, int], label_x: np.ndarray, label_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y with different labels that may overlap enough; same: x is y, each pair once."""
    out_x, out_y, todo = [], [], [(0, len(x.n), 0, len(y.n))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = (v.ravel() for v in np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij"))
            keep = label_x[i] != label_y[j]
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            ok = may_link(x.n[i], y.n[j], x.bits[i], y.bits[j], t)
            out_x.append(i[ok])
            out_y.append(j[ok])
            continue
        p, q = x.node(a, b), y.node(c, d)
        most = min(p[2], q[2], int(np.bitwise_count(p[0] & q[0]).sum()) + min(p[3], q[3]))
        if most < need(p[1] + q[1], t) or (label_x[a] == label_y[c] and (label_x[a:b] == label_x[a]).all() and (label_y[c:d] == label_y[c]).all()):
            continue
        if b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
            if same and (a, b) == (c, d):
                todo[-2:] = [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return (np.concatenate(out_x), np.concatenate(out_y)) if out_x else (np.zeros(0, int), np.zeros(0, int))


def by_width(bits: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width, in 64-bit words: the rows with such bitmaps, and these."""
    own = bits.to_pylist()
    words = np.array([len(b) // 8 for b in own], np.int64)
    rows = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    return {w: (r, np.frombuffer(b"".join(own[k] for k in r), np.uint64).reshape(len(r), w)) for w, r in rows.items()}


def trees(n: np.ndarray, bits: pa.Array) -> list[tuple[int, np.ndarray, Tree]]:
    """A signature tree for each width of bitmaps: (width, its rows, tree)."""
    return [(w, rows, Tree(n[rows], own)) for w, (rows, own) in by_width(bits).items()]


def tree_pairs(x: list, y: list, t: tuple[int, int], label_x: np.ndarray, label_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """traverse() over trees of all widths; same: x is y, each pair once."""
    out_x, out_y = [], []
    for u, rows_x, left in x:
        for v, rows_y, right in y:
            if same and v < u or t[1] * min(left.n[-1], right.n[-1]) < t[0] * max(left.n[0], right.n[0]):
                continue  # each pair of widths once, and none whose sizes lie too far apart
            one, other = (Tree(k.n, folded(k.bits, min(u, v))) if w > min(u, v) else k for w, k in ((u, left), (v, right)))
            i, j = traverse(one, other, t, label_x[rows_x], label_y[rows_y], same and u == v)
            out_x.append(rows_x[i])
            out_y.append(rows_y[j])
    return (np.concatenate(out_x), np.concatenate(out_y)) if out_x else (np.zeros(0, int), np.zeros(0, int))


def _spread(keys: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(keys) if rows <= MOST_BROADCAST else keys


def _dealt(rows: DataFrame, sizes: DataFrame, key: str, by: str) -> DataFrame:
    """rows with `salt`, by a hash of column `by`: as many salts as sizes (key, rows) asks for, 0 for keys of few rows."""
    large = materialize(sizes.where(F.col("rows") > SALT).select(key, _salts(F.col("rows")).alias("__salts")), "large_keys")
    dealt = rows.join(_spread(large, large.count()), key, "left")
    return dealt.withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")


def _salts(rows: Column) -> Column:
    return F.ceil(rows / SALT).cast("int")


def _repeated(keys: DataFrame) -> DataFrame:
    """keys (with a column rows) once for each salt of theirs."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("rows")) - 1)))


def _salted_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with a salt for their a, the rows of each a)."""
    sizes = materialize(pairs.groupBy("a").agg(F.count("*").alias("rows")), "pair_sizes")
    return _dealt(pairs, sizes, "a", "b"), sizes


def _possible(pairs: DataFrame, reps: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave room for the overlap that they need."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    dealt, sizes = _salted_pairs(pairs)
    joined = dealt.join(_repeated(side("a").join(sizes, "a")), ["a", "salt"]).join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, y = (by_width(part.column(c)) for c in ("bits_a", "bits_b"))
                n, m = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                ok = np.zeros(len(n), bool)
                for u, (rows_x, bits_x) in x.items():
                    for v, (rows_y, bits_y) in y.items():
                        both, i, j = np.intersect1d(rows_x, rows_y, assume_unique=True, return_indices=True)
                        ok[both] = may_link(n[both], m[both], folded(bits_x[i], min(u, v)), folded(bits_y[j], min(u, v)), t)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(tidy(bound), "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, t: tuple[int, int], words: int) -> DataFrame:
    """Of pairs (a, b) those that link. Sets are made again from the texts of the rows concerned only, and only b's set travels, to a task of a's."""
    pairs = materialize(pairs, "candidates")
    few = pairs.count() <= MOST_BROADCAST
    dealt, sizes = _salted_pairs(pairs)
    asked = materialize(dealt.groupBy(F.col("b").alias("doc_id")).agg(F.collect_list(F.struct("a", "salt")).alias("to")), "asked")  # at most a partner for each shingle in front
    hubs = materialize(sizes.select(F.col("a").alias("doc_id"), _salts(F.col("rows")).alias("salts")), "hubs")

    def met(own: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(own) if few else own, "doc_id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = batch.column("to").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for first, last, bounds, h in _sets(batch, "text", words):
                rows = [(x["a"], x["salt"], ids[i], h[bounds[i - first] : bounds[i - first + 1]].tobytes()) for i in range(first, last) for x in to[i]]
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 1024]], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["a", "salt", "b", "y"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, bounds, h in _sets(batch, "text", words):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("salts").slice(first, last - first), pa.array([h[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["a", "salts", "x"])

    sent = met(asked).select("doc_id", "text", "to").mapInArrow(tidy(send), "a long, salt int, b long, y binary")
    held = met(hubs).select("doc_id", "text", "salts").mapInArrow(tidy(keep), "a long, salts int, x binary")
    held = held.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                same.append(both > 0 and t[1] * both >= t[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return materialize(sent.join(held, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long").distinct(), "links")


def similar_groups(docs: DataFrame, t: tuple[int, int] = (80, 100), words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach (its own without links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(signatures(docs, t, words), "signatures")
    sets = made.where("n > 0").select("doc_id", "n", "fp")
    classes = materialize(sets.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    classed = _dealt(sets, classes, "fp", "doc_id").join(_repeated(classes), ["fp", "salt"]).select("doc_id", "n", "fp", F.coalesce("rep", "doc_id").alias("rep"))
    member = materialize(classed.unionByName(made.where("n = 0").select("doc_id", "n", "fp", F.col("doc_id").alias("rep"))), "members")
    first = member.where("n > 0 AND doc_id = rep").select("doc_id", "fp").distinct()
    reps = materialize(made.join(first, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]).drop("fp"), "representatives")
    # documents with several texts tie the classes of these
    several = member.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("doc_id")
    tied = member.where("n > 0 AND doc_id != rep").join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    # blocks: shingles that two or more rows have in front; equal blocks once
    heads = reps.select("doc_id", F.explode("prefix").alias("token"))
    shared = materialize(heads.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "shared")
    met = materialize(_dealt(heads, shared, "token", "doc_id").join(_repeated(shared), ["token", "salt"]).select("token", "salt", "rows", "doc_id"), "met")
    found = met.groupBy("token").agg(F.first("rows").alias("rows"), F.min("doc_id").alias("hub"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(7))).alias("x"))
    blocks = found.groupBy("rows", "hub", "s", "x").agg(F.min("token").alias("token")).select("token", "rows", "hub")
    inside = materialize(met.drop("rows").join(_repeated(blocks), ["token", "salt"]).select("token", "salt", "rows", "hub", "doc_id"), "inside")

    stars = materialize(inside.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = _verified(_possible(stars, reps, t), docs, t, words).union(tied)
    label = materialize(components(links), "labels")

    # blocks with rows of more than one component
    named = inside.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("rows").alias("rows")).where("lo != hi AND rows > 2").select("token", "rows")
    rest = materialize(named.join(_repeated(mixed).drop("rows"), ["token", "salt"], "left_semi"), "rest").join(reps.select("doc_id", "n", "bits"), "doc_id")
    parts = F.ceil(F.col("rows") / PART).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    sides = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    tasks = rest.select("token", "doc_id", "label", "n", "bits", own.alias("part"), F.explode(sides).alias("p")).select("token", "p.i", "p.j", "part", "doc_id", "label", "n", "bits")

    def pairs(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        i, j = frame.column("i")[0].as_py(), frame.column("j")[0].as_py()
        part, ids, label = (frame.column(c).to_numpy() for c in ("part", "doc_id", "label"))
        n, bits = frame.column("n").to_numpy(), frame.column("bits").combine_chunks()
        x, y = (np.flatnonzero(part == k) for k in (i, j))
        of_x = trees(n[x], bits.take(pa.array(x)))
        of_y = of_x if i == j else trees(n[y], bits.take(pa.array(y)))
        a, b = tree_pairs(of_x, of_y, t, label[x], label[y], i == j)
        a, b = ids[x][a], ids[y][b]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    more = tasks.groupBy("token", "i", "j").applyInArrow(pairs, "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    more = materialize(more, "pairs")
    links = links.union(_verified(more, docs, t, words))
    label = materialize(components(links), "labels")
    return member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
