"""Token ids as binary files: one concatenated id array a shard, document ends as an Elias-Fano sequence.

File: ids (little-endian, 2 bytes each if the vocabulary allows, else 4), then the Elias-Fano parts of the documents'
ends and of their doc_ids, then a JSON footer and its length (8 bytes). An Elias-Fano sequence of n values below u keeps
floor(log2(u/n)) low bits of each, and the rest in unary; every 64th one's place is kept for select.

Documents are dealt to shards by ranges of doc_id, so a shard holds a bounded run of the order and no task sees more
than one shard. A file is written under a name of its own and moved in place: a task that runs twice does no harm.
A null or empty text has only the end id; texts of any length are whole; null doc_ids come first; repeated doc_ids stay
separate documents in any order; an empty table gives no files and no rows; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.llm.encode import Encoder
from beamframe.llm.shared import filesystem

SELECT_EVERY = 64


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.bits, self.low, self.high, self.places = n, bits, low, high, places

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, most = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i: from the nearest kept place on, the ones in the unary part are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        seen = -int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: at % 8].sum())
        step = 16
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + step], bitorder="little"))
            if seen + len(ones) > left:
                place = byte * 8 + int(ones[left - seen])
                break
            seen, byte = seen + len(ones), byte + step
        value = place - i
        for b in range(self.bits):
            k = i * self.bits + b
            value_bit = (int(self.low[k // 8]) >> (k % 8)) & 1
            low = value_bit << b if b == 0 else low | value_bit << b
        return (value << self.bits) | (low if self.bits else 0)

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values a..b-1: the unary part is read between the kept places around them, nothing before or after."""
        if a >= b:
            return np.zeros(0, np.int64)
        at = int(self.places[a // SELECT_EVERY])
        after = -(-b // SELECT_EVERY)
        stop = int(self.places[after]) // 8 + 1 if after < len(self.places) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : stop], bitorder="little")) + at // 8 * 8
        first = int(np.searchsorted(ones, at)) + a % SELECT_EVERY
        high = ones[first : first + b - a] - np.arange(a, b)
        from_bit, to_bit = a * self.bits, b * self.bits
        low = np.unpackbits(self.low[from_bit // 8 : -(-to_bit // 8)], bitorder="little")[from_bit % 8 :][: to_bit - from_bit]
        return (high << self.bits) + low.reshape(b - a, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.places.tobytes()]

    @classmethod
    def of_parts(cls, n: int, bits: int, low: bytes, high: bytes, places: bytes) -> EliasFano:
        return cls(n, bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(places, "<u4"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) and return one row for each file: path, shard, n_docs, n_ids. Runs once the result is acted on."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = df.repartitionByRange(shards, "doc_id") if shards else df.repartitionByRange("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(tokenizer), TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        narrow = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        end = np.array(end_id, "<u4").tobytes()
        lengths, doc_ids, temp, sink = [], [], f"{root}/.{shard}-{uuid.uuid4().hex}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(temp)
            doc_ids += batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 512):
                raw = [x + end for x in encoder.encode(texts[at : at + 512])]
                lengths += [len(x) // 4 for x in raw]
                ids = b"".join(raw)
                sink.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
        if sink is None:
            return
        nulls = sum(x is None for x in doc_ids)
        known = np.array(doc_ids[nulls:], np.int64)
        floor = int(known[0]) if len(known) else 0
        sequences = {"ends": EliasFano.build(np.cumsum(lengths)), "doc_ids": EliasFano.build(known - floor)}
        footer = {"version": 1, "width": 2 if narrow else 4, "n_docs": len(lengths), "n_ids": int(sum(lengths)), "nulls": nulls, "floor": floor, "parts": {}}
        for name, seq in sequences.items():
            parts = seq.parts()
            footer["parts"][name] = {"n": seq.n, "bits": seq.bits, "sizes": [len(x) for x in parts]}
            for x in parts:
                sink.write(x)
        text = json.dumps(footer).encode()
        sink.write(text + len(text).to_bytes(8, "little"))
        sink.close()
        path = f"{root}/ids-{shard:06d}.bin"
        fs.move(temp, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [footer["n_docs"]], "n_ids": [footer["n_ids"]]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return df.sortWithinPartitions(F.asc_nulls_first("doc_id")).mapInArrow(write, "shard long, path string, n_docs long, n_ids long")


def open_token_file(folder: str, path: str):
    """(source, footer, {"ends": EliasFano, "doc_ids": EliasFano}): ids are read from the open source as needed."""
    fs, _ = filesystem(folder)
    source = fs.open_input_file(path)
    size = source.size()
    source.seek(size - 8)
    length = int.from_bytes(source.read(8), "little")
    source.seek(size - 8 - length)
    footer = json.loads(source.read(length))
    source.seek(footer["n_ids"] * footer["width"])
    found = {name: EliasFano.of_parts(x["n"], x["bits"], *[source.read(k) for k in x["sizes"]]) for name, x in footer["parts"].items()}
    return source, footer, found


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files in manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids]."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                source, footer, found = open_token_file(folder, path)
                ends, known, nulls, n = found["ends"], found["doc_ids"], footer["nulls"], footer["n_docs"]
                source.seek(0)
                before = 0
                for at in range(0, n, 4096):
                    last = min(n, at + 4096)
                    b = ends.select_range(at, last)
                    a = np.r_[before, b[:-1]]
                    doc_ids = [None] * max(0, nulls - at) + (known.select_range(max(at - nulls, 0), max(last - nulls, 0)) + footer["floor"]).tolist()
                    raw = np.frombuffer(source.read(int(b[-1] - before) * footer["width"]), f"<u{footer['width']}").astype("<u4")
                    each = [raw[s - before : e - before] for s, e in zip(a, b, strict=True)]
                    columns = [doc_ids[: last - at], (a + base).tolist(), (b - a).tolist(), [zlib.crc32(x) for x in each]] + [[x.astype(np.int32) for x in each]] * with_ids
                    before = int(b[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])
                source.close()

    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
