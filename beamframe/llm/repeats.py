"""Exact repeated byte strings across a corpus: sparse prefix doubling over ranked positions.

Suffix-array deduplication by prefix doubling ranks positions by their first h bytes, then by pairs of ranks h apart,
until a rank is unique or h reaches the threshold. Ranking every position moves many times the corpus per round, so
positions are ranked where they can differ only:

1. Rank at h = length / 4, of anchors: in every window of `length` bytes the position with the least fingerprint of h
   bytes. Equal windows have the same anchor, so windows fall into segments (runs with one anchor), and a segment whose
   anchor's rank is unique repeats nowhere. Fingerprints of 64 bits serve as ranks; Spark groups (rank, position) pairs.
2. Rank of whole segments (anchor and content, 128 bits): equal segments repeat as a whole.
3. Rank at h = length, for segments that share an anchor but not all of their content: each of their windows has
   the pair of two 64-bit fingerprints as its rank. Anchors with at most HOT contents are settled in the task that holds
   them, more frequent ones window by window in Spark.

Bytes under any window whose rank is not unique are removed. Texts are UTF-8 bytes, a null is empty; matches stay within
a text; overlapping and same-text repeats count; texts shorter than `length` keep all. Repeated rows are texts of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm import textbatch as tb
from beamframe.llm.shared import materialize, tidy

#: Contents of one anchor that one task settles; texts up to which a list of segments is broadcast (about 100 bytes each).
HOT = 4096
MOST_BROADCAST = 200_000
#: Windows that a task ranks at once, if more than one anchor has them; an anchor has at most HOT contents of at most `length` windows.
WINDOWS = 1 << 17
_POSITIONS = 20  # bits of a segment's number of windows


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): file and place in it are ids of rows that any later read finds again."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place")]
    try:
        placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place)
    except AnalysisException:  # not a plain table: it is written once
        placed = materialize(narrow, "texts").select("doc_id", "text", *place)
    files = sorted(r[0] for r in placed.select("path").distinct().collect())  # a row for each file
    number = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(files)), "file long, path string"))
    return placed.join(number, "path").select("doc_id", "text", F.shiftleft("file", 36).bitwiseOR(F.col("place")).alias("row"))


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text number, first window, windows, anchor's fingerprint, content's fingerprint) of each segment."""
    gram = max(1, length // 4)
    n, wide = len(data), length - gram + 1
    if n < length:
        return None
    prefix = tb.prefix_hash(data)
    at = np.arange(n - gram + 1)
    prints = tb.span_hash(prefix, at, at + gram)
    low = np.uint64(max(24, int(n).bit_length()))
    value = (prints >> low << low) | at.astype(np.uint64)
    padded = np.full(-(-len(value) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    steps = np.zeros(count + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - length + 1
    full = last > first
    np.add.at(steps, first[full], 1)
    np.add.at(steps, last[full], -1)
    inside = np.cumsum(steps[:-1]) > 0
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])]
    # windows of the next text never share an anchor with this one, but touching texts of one window each may be neighbours
    new[first[full]] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], count]
    keep = inside[start]
    start, end = start[keep], end[keep]
    text = np.searchsorted(offsets, start, "right") - 1
    content = tb.span_hash(prefix, start, end - 1 + length) ^ tb.mix(anchor[start] - start)
    return text, start - offsets[text], end - start, prints[anchor[start]], content


def find_repeats(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): rows has doc_id, text and a row id; ranges has row, start, end of windows' bytes that repeat."""
    if length >= 1 << _POSITIONS:
        raise ValueError(f"length must be below {1 << _POSITIONS}")
    texts = _rows(docs)
    mask = (1 << _POSITIONS) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column("text"))
            rows = batch.column("row").to_numpy()
            for first, last in tb.runs(offsets):
                found = segments(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], length)
                if found is not None:
                    text, start, windows, anchor, content = found
                    columns = [anchor.view(np.int64), content.view(np.int64), rows[first:last][text], start << _POSITIONS | windows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "c", "row", "at"])

    segs = texts.select("text", "row").mapInArrow(tidy(emit), "h long, c long, row long, at long")
    ranks = materialize(segs.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1").select("h", F.expr("lo = hi").alias("pure")), "ranks")
    alive = materialize(segs.join(ranks, "h"), "alive")

    contents = materialize(alive.where("NOT pure").groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("row", "at")).alias("w")), "contents")
    often = contents.groupBy("h").agg(F.count("*").alias("contents"))
    asked = contents.join(often, "h").select("h", "c", "w.row", "w.at", (F.col("contents") > HOT).alias("hot"))
    asked = materialize(asked.groupBy("row").agg(F.collect_list(F.struct("h", "c", "at", "hot")).alias("segs")), "asked")  # a text's own segments
    few = asked.count() <= MOST_BROADCAST

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, own in zip(batch.column("text"), batch.column("segs"), strict=True):
                text = text.as_buffer().to_pybytes()
                for s in own.as_py():
                    start = s["at"] >> _POSITIONS
                    for to, v in zip(out, (s["h"], s["c"], s["at"] & mask, s["hot"], text[start : start + (s["at"] & mask) + length - 1]), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["h", "c", "n", "hot", "bytes"])

    cuts = materialize(texts.join(F.broadcast(asked) if few else asked, "row").select("text", "segs").mapInArrow(tidy(excerpts), "h long, c long, n long, hot boolean, bytes binary"), "cuts")

    def windows(h: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        """(segment, place, fingerprint, fingerprint) of each window."""
        own = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[own] + place
        one, two = (tb.span_hash(tb.prefix_hash(data, k), at, at + length) for k in (0, 1))
        return own, place, one ^ tb.mix(h.view(np.uint64))[own], two

    def settled(frames: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(frames).combine_chunks()
        h, c, n = (table.column(x).to_numpy() for x in ("h", "c", "n"))
        raw = table.column("bytes").to_pylist()
        offsets = np.cumsum([0, *map(len, raw)])
        own, place, one, two = windows(h, n, np.frombuffer(b"".join(raw), np.uint8), offsets)
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        hit = np.zeros(len(own), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        edge = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (own[1:] != own[:-1])])
        stop = np.flatnonzero(hit & np.r_[~hit[1:] | (own[1:] != own[:-1]), True])
        yield pa.RecordBatch.from_arrays([pa.array(h[own[edge]]), pa.array(c[own[edge]]), pa.array(place[edge]), pa.array(place[stop])], ["h", "c", "a", "b"])

    def whole_anchors(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        h, n = batch.column("h").to_numpy(), np.r_[0, np.cumsum(batch.column("n").to_numpy())]
        ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1 if len(h) else []
        first = last = 0
        for end in map(int, ends):
            if last > first and n[end] - n[first] > WINDOWS:
                yield first, last
                first = last
            last = end
        if last > first:
            yield first, last

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by h: all but the last h of a batch are complete
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut == 0 and held and held[-1].column("h")[-1].as_py() == h[0]:
                held.append(batch)
                continue
            if held:  # the anchor that an earlier batch began
                end = int(np.searchsorted(h, held[0].column("h")[0].as_py(), "right"))
                yield from settled([*held, batch.slice(0, end)])
                batch, cut = batch.slice(end), cut - end
            for first, last in whole_anchors(batch.slice(0, cut)):
                yield from settled([batch.slice(first, last - first)])
            held = [batch.slice(cut)]
        if held:
            yield from settled(held)

    cold = cuts.where("NOT hot").select("h", "c", "n", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(settle), "h long, c long, a long, b long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            h, c, n = (batch.column(x).to_numpy() for x in ("h", "c", "n"))
            raw = batch.column("bytes").to_pylist()
            own, place, one, two = windows(h, n, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own]), pa.array(place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["h", "c", "a", "one", "two"])

    each = cuts.where("hot").select("h", "c", "n", "bytes").mapInArrow(tidy(single), "h long, c long, a long, one long, two long")
    twice = each.groupBy("one", "two").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    warm = each.join(twice, ["one", "two"]).select("h", "c", "a", F.col("a").alias("b"))

    start, count = F.shiftright("at", _POSITIONS), F.col("at").bitwiseAND(mask)
    whole = alive.join(contents.where("k > 1").select("h", "c"), ["h", "c"], "left_semi").where("NOT pure").select("row", "at").union(alive.where("pure").select("row", "at"))
    part = alive.where("NOT pure").join(cold.union(warm), ["h", "c"]).select("row", (start + F.col("a")).alias("start"), (start + F.col("b") + length).alias("end"))
    ranges = whole.select("row", start.alias("start"), (start + count - 1 + length).alias("end")).union(part)
    return texts, ranges


def remove_repeats(docs: DataFrame, length: int = 200, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 [, kept: the bytes that stay]."""
    texts, ranges = find_repeats(docs, length)
    gathered = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))  # of one text
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_kept

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, spans, at, removed = [], 0, 0, 0
                if own.is_valid:
                    pairs = np.stack([own.values.field("start").to_numpy(), own.values.field("end").to_numpy()], 1)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    fresh = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
                    for a, b in zip(pairs[fresh, 0].tolist(), reach[np.r_[fresh[1:] - 1, len(pairs) - 1]].tolist(), strict=True):
                        kept.append(data[at:a])
                        spans, removed, at = spans + 1, removed + b - a, b
                kept.append(data[at:])
                rest = b"".join(kept)
                for to, v in zip(out, (doc_id, len(data), removed, spans, hashlib.sha256(rest).hexdigest(), *[rest] * with_kept), strict=False):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(out, schema, strict=True)], [n for n, _ in schema])

    return texts.join(gathered, "row", "left").select("doc_id", "text", "ranges").mapInArrow(tidy(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
