"""Best-fit packing of tokenized documents into sequences, planned on a histogram of lengths.

1. Each document's ids are cut into pieces (full ones, the first may be shorter); a task numbers its pieces of each length.
2. The histogram of lengths (at most `size` rows) goes to the driver, where best fit, longest first, deals out slots:
   runs of sequences which all take a piece of one length at one offset. Only counts are planned, no documents.
3. A piece's rank within its length is its number in its task plus the counts of the tasks before (a join on task and
   length); the rank picks the slot. No task gathers a length, however many pieces have it.

A null or empty text is the end id alone; texts of any length are whole, in pieces. Repeated rows, null and equal doc_ids
are packed as they come; which of equally long pieces gets which slot follows the order of tasks and rows. An empty table
gives no rows. Only doc_id and text are read, so other columns may have any name. Texts are encoded in runs of bounded
bytes (a longer text alone), which bounds a worker's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.llm import textbatch as tb
from beamframe.llm.encode import CACHE, Encoder
from beamframe.llm.shared import materialize, tidy

#: Words that a worker keeps where it gives them back when a task ends.
FEW = 100_000


def plan_best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) for counts of pieces by length: longest first, fullest sequence that fits first."""
    room: dict[int, list[list[int]]] = {}  # by space left: [first sequence, number]
    runs, fresh = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = min((r for r in room if r >= length), default=size)
            each = fit // length
            if fit in room:
                first, have = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            else:
                first, have = fresh, -(-left // each)
                fresh += have
            whole = min(have, left // each)
            rest, more = have - whole, left - whole * each
            if rest and whole < have and more:  # one sequence takes what is left over
                for k in range(more):
                    runs.append((length, rank + whole * each + k, 1, first + whole, size - fit + k * length))
                room.setdefault(fit - more * length, []).append([first + whole, 1])
                if rest > 1:
                    room.setdefault(fit, []).append([first + whole + 1, rest - 1])
                used = left
            else:
                if rest:
                    room.setdefault(fit, []).append([first + whole, rest])
                used = whole * each
            if whole:
                for k in range(each):
                    runs.append((length, rank + k * whole, whole, first, size - fit + k * length))
                room.setdefault(fit - each * length, []).append([first, whole])
            rank, left = rank + used, left - used
        room.pop(0, None)
    return runs


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of `size`, the first may be shorter."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return [(0, first)] * bool(first) + [(s, size) for s in range(first, length, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, with_ids: bool, free: bool = False) -> DataFrame:
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("number", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder.of(tokenizer, FEW if free else CACHE), TaskContext.get().partitionId(), {}
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for first, last in tb.runs(tb.utf8(batch.column(1))[1]):
                part, rows = batch.slice(first, last - first), []
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    raw += end
                    for k, (start, length) in enumerate(cut(len(raw) // 4, size)):
                        own = raw[4 * start : 4 * (start + length)]
                        number = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc_id, k, start, length, zlib.crc32(own), task, number, *[np.frombuffer(own, "<i4")] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])
        if free:
            Encoder.give_back(tokenizer)

    return df.mapInArrow(tidy(encode), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = False, free: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]. free: workers keep few words, and give them and the tokenizer back when a task ends, for jobs that go on with other work."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, tokenizer, size, end_id, with_ids, free), "pieces")
    counts = materialize(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = np.array(plan_best_fit(histogram, size), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            found = {"sequence_id": pa.array(run[:, 3] + rank - run[:, 1]), "offset": pa.array(run[:, 4])}
            yield pa.RecordBatch.from_arrays([found.get(n) if n in found else batch.column(n) for n in names], names)

    ranked = made.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("number"))
    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
