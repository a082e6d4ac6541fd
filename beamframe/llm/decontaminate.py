"""Benchmark passages in texts, up to a budget of edits, by q-gram lemma filtering over diagonal bands.

Texts and items are normalized (A-Z lowered, each run of white space one space). An item of m characters that occurs in
a text with at most k = m * rate edits shares at least m - q + 1 - k q of its q-grams with that place, and all of them
on diagonals (place in the text less place in the item) that lie within k of each other. So:

1. q-grams of the items form an index: sorted 64-bit hashes with item and place. It is broadcast while it has at most
   MOST_BROADCAST entries, else items are dealt to so many passes over the texts, each with an index within the bound.
2. A text's q-grams are looked up in the index all at once. Hits are counted in bands of diagonals, 2k wide and
   overlapping by half, so the diagonals of an occurrence lie in one band wholly; bands under the lemma's bound fall.
3. What remains is verified by edit distance in the band: the item against the text, free ends in the text, diagonals
   of the band only. A region counts if its distance is at most k.

Short items, whose bound would be below one, take the longest q-grams for which it isn't: q = m / (k + 1), rounded down,
so every item is found within its budget whatever its length. Items with the same q share one index.

Result: one row for each (document, item) with the best region, of equally good ones any. Null or empty texts and items
match nothing; a null item_id or doc_id is returned as it is; repeated rows are judged one by one; texts of any length are
searched whole; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm import textbatch as tb
from beamframe.llm.shared import tidy

Q = 8
RATE = 0.1
MOST_BROADCAST = 4_000_000
_SPACE = re.compile(r"\s+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalize(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").translate(_LOWER)).strip(" ")


def normalized_places(text: str) -> tuple[str, np.ndarray]:
    """The normalized text and, for each of its characters, the place in text (and one more for the end)."""
    out, at, last = [], [], 0
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(" ")
            at.append(np.array([last]))
        out.append(m.group().translate(_LOWER))
        at.append(np.arange(m.start(), m.end()))
        last = m.end()
    return "".join(out), np.concatenate([*at, [last]]) if at else np.zeros(1, int)


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams of code points, put together by doubling."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, out, at = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if q & size:
            part = h[at : at + n]
            out = part.copy() if out is None else out * np.uint64(0x9E3779B97F4A7C15) + part
            at += size
        if 2 * size > q:
            return out
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) ** np.uint64(size) + h[size:]
        size *= 2


def slots(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)


_BLANK = np.zeros(0x3002, bool)
_BLANK[[i for i in range(0x3001) if chr(i).isspace()]] = True
_END = "\U0010fffe"


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best place in text on diagonals low..high (place in text less place in item), or None over `most` edits."""
    width, big = high - low + 1, len(item) + len(text) + 1
    diag = np.arange(low, high + 1)
    cost = np.where((diag >= 0) & (diag <= len(text)), 0, big)  # row 0: free start
    origin = diag.copy()
    steps = np.arange(width)
    for i in range(1, len(item) + 1):
        j = diag + i
        ok = (j >= 1) & (j <= len(text))
        near = np.where(ok, text[np.clip(j - 1, 0, len(text) - 1)] != item[i - 1], 1)
        swap = np.where(ok, cost + near, big)
        drop, drop_from = np.r_[cost[1:] + 1, big], np.r_[origin[1:], 0]
        new = np.minimum(swap, drop)
        source = np.where(swap <= drop, origin, drop_from)
        new = np.where((j >= 0) & (j <= len(text)), new, big)
        run = np.minimum.accumulate(new - steps)  # insertions along the row
        best = run + steps
        lead = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
        cost, origin = np.where((j >= 0) & (j <= len(text)), best, big), source[lead]
        if i % 8 == 0 and cost.min() > most:
            return None
    k = int(np.argmin(cost))
    if cost[k] > most:
        return None
    return int(cost[k]), int(max(origin[k], 0)), int(diag[k] + len(item))


class Grams:
    """The q-grams of those items that are searched by this q: sorted hashes with item (its number among all) and place."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, count: int):
        self.q = q
        hashes = [grams(p, q) for _, p in items]
        self.item = np.repeat(np.array([k for k, _ in items], np.int64), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])
        self.hash = np.concatenate(hashes)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.seen = np.zeros(1 << 20, bool)  # quick refusal of most q-grams
        self.seen[slots(self.hash)] = True
        self.count = count

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, row of the index) of each q-gram that the index has."""
        at = np.flatnonzero(self.seen[slots(h)])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        return np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def candidates(self, p: np.ndarray, owner: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Numbers of texts that have as many q-grams of some item, on any diagonals, as the item's bound asks for."""
        at, row = self.hits(grams(p, self.q))
        # an item's q-gram counts once in a text for each place in the item
        pair = np.unique(owner[at] * np.int64(len(self.hash)) + row)
        text, item = pair // len(self.hash), self.item[pair % len(self.hash)]
        both, count = np.unique(text * self.count + item, return_counts=True)
        return both[count >= bound[both % self.count]] // self.count


class Index:
    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        self.ids = [i for i, _ in items]
        self.points = [points(t) for _, t in items]
        sizes = np.array([len(p) for p in self.points], np.int64)
        self.budget = (sizes * rate).astype(np.int64)
        own = np.minimum(q, np.maximum(1, sizes // (self.budget + 1)))
        self.bound = np.maximum(1, sizes - own + 1 - self.budget * own)
        self.parts = [Grams([(int(i), self.points[i]) for i in np.flatnonzero(own == k)], int(k), len(items)) for k in np.unique(own)[::-1]]

    def candidates(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text may hold some item: all texts at once."""
        texts = [t or "" for t in texts]
        p = points(_END.join([*texts, ""]))
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        blank = _BLANK[np.minimum(p, 0x3001)]
        keep = np.r_[True, ~(blank[1:] & blank[:-1])] if len(p) else blank
        p, owner, blank = p[keep], owner[keep], blank[keep]
        p = np.where(blank, np.uint32(32), np.where((p >= 65) & (p <= 90), p + np.uint32(32), p))
        out = np.zeros(len(texts), bool)
        for part in self.parts:
            out[part.candidates(p, owner, self.bound)] = True
        return out

    @staticmethod
    def _exact(whole: bytes, item: np.ndarray) -> int:
        """The first place of item in a text given as 4 bytes a character, or -1."""
        own = item.tobytes()
        i = whole.find(own)
        while i >= 0 and i % 4:
            i = whole.find(own, i + 1)
        return i // 4 if i >= 0 else -1

    def search(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best region of each item that the text holds."""
        found: dict[int, tuple] = {}
        whole = text.tobytes()
        for part in self.parts:
            at, row = part.hits(grams(text, part.q))
            if not len(at):
                continue
            item, place = part.item[row], part.place[row]
            diagonal = at - place
            wide = np.maximum(self.budget[item], 1)
            # the item's own places count once in a band, however often the text repeats them
            bands = [np.stack([item, diagonal // wide - s, place], 1) for s in (0, 1)]
            keys = np.unique(np.concatenate(bands), axis=0)
            first = np.flatnonzero(np.r_[True, (keys[1:, :2] != keys[:-1, :2]).any(1)])
            count = np.diff(np.r_[first, len(keys)])
            good = np.flatnonzero(count >= self.bound[keys[first, 0]])
            k = 0
            while k < len(good):
                item, band = (int(v) for v in keys[first[good[k]], :2])
                last = band
                while k + 1 < len(good) and keys[first[good[k + 1]], 0] == item and keys[first[good[k + 1]], 1] <= last + 2:  # overlapping bands are one region
                    k, last = k + 1, int(keys[first[good[k + 1]], 1])
                k += 1
                if item in found and found[item][0] == 0:
                    continue
                at = self._exact(whole, self.points[item])
                if at >= 0:
                    found[item] = (0, at, at + len(self.points[item]))
                    continue
                w, budget = int(max(self.budget[item], 1)), int(self.budget[item])
                low, high = band * w - budget, (last + 2) * w - 1 + budget
                region = text[max(0, low) : max(0, high + len(self.points[item]) + 1)]
                best = banded_distance(self.points[item], region, low - max(0, low), high - max(0, low), budget) if len(region) else None
                if best is not None and (item not in found or best[0] < found[item][0]):
                    found[item] = (best[0], best[1] + max(0, low), best[2] + max(0, low))
        return [(k, *v) for k, v in sorted(found.items())]


def _indexes(benchmark: DataFrame, q: int, rate: float):
    """Broadcast indexes that together hold all items."""
    spark = benchmark.sparkSession
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    passes = max(1, -(-total // MOST_BROADCAST))
    for k in range(passes):
        own = b if passes == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        items = [(r.item_id, normalize(r.text)) for r in own.collect()]  # about MOST_BROADCAST characters
        yield spark.sparkContext.broadcast(Index([x for x in items if x[1]], q, rate))


def _likely(index: Index, keys, texts: list):
    """(key, text) of candidates, by runs of about RUN_BYTES characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < tb.RUN_BYTES):
            size += len(texts[end] or "")
            end += 1
        for i in np.flatnonzero(index.candidates(texts[at:end])).tolist():
            if texts[at + i]:
                yield keys[at + i], texts[at + i]
        at = end


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end (characters of the text as it is)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searching(index):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = index.value
            for batch in batches:
                rows = []
                for doc_id, text in _likely(found, batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits = found.search(points(normalize(text)))
                    if hits:
                        place = normalized_places(text)[1]
                        for k, e, s, t in hits:
                            s = min(s, len(place) - 1)
                            rows.append((doc_id, found.ids[k], e, int(place[s]), int(place[t - 1]) + 1 if t > s else int(place[s])))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start", "end"])

        return search

    parts = [narrow.mapInArrow(tidy(searching(index)), "doc_id long, item_id long, edits long, start long, end long") for index in _indexes(benchmark, q, rate)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs less the rows whose text holds a passage: a filter in place, nothing is shuffled."""

    def clean(index, at: int):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                bad = {i for i, t in _likely(index.value, range(len(texts)), texts) if index.value.search(points(normalize(t)))}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        return keep

    for index in _indexes(benchmark, q, rate):
        docs = docs.mapInArrow(tidy(clean(index, docs.columns.index("text"))), docs.schema)
    return docs
