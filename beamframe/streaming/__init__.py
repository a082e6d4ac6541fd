"""Streaming forms: matching out-of-order sources, moving averages and scans with state, incremental bins."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beamframe.operators.correlate import correlate, latest, newest_value
from beamframe.operators.stats import bin_index, scan_step


def correlate_stream(raw: DataFrame, sources: list[str], watermark: str = "2 seconds", window: str = "10 seconds", ties: str = "last") -> DataFrame:
    """Default form, one key a train: trains of which all sources arrived before the watermark passed their window, with the newest value of each (correlate.newest_value). Scales out; late rows are dropped by event time."""
    own = raw.where(F.col("source").isin(sources)).withWatermark("ts", watermark)
    wide = own.groupBy(F.window("ts", window), "train_id").agg(*[newest_value(raw, s, ties) for s in sources], *[F.count_if(F.col("source") == s).alias(f"__{i}") for i, s in enumerate(sources)])
    return wide.where(" AND ".join(f"__{i} > 0" for i in range(len(sources)))).select("train_id", *[F.col(f"`{s}`") for s in sources])


#: Rows that the exact matcher sorts in memory at once.
SORTED = 500_000


def sorted_blocks(frames: Iterator[pd.DataFrame], columns: list[str], most: int | None = None) -> Iterator[np.ndarray]:
    """Rows of whole numbers in the order of the first column, in blocks. At most about `most` rows are in memory: sorted runs go to a file of the task and are merged from there."""
    most = most or SORTED
    by_first = lambda rows: rows[np.argsort(rows[:, 0], kind="stable")]
    with tempfile.TemporaryFile() as file:
        runs, waiting, n, end = [], [], 0, 0
        for frame in frames:
            waiting.append(frame[columns].to_numpy("int64"))
            n += len(frame)
            if n >= most:
                by_first(np.concatenate(waiting)).tofile(file)
                runs.append((end, end := end + n))
                waiting, n = [], 0
        rest = by_first(np.concatenate(waiting)) if waiting else np.empty((0, len(columns)), "int64")
        if not runs:
            yield rest
            return
        file.flush()
        width = 8 * len(columns)

        def read(at: int, n: int) -> np.ndarray:
            file.seek(at * width)
            return np.frombuffer(file.read(n * width), "int64").reshape(-1, len(columns))

        step = max(1, most // (len(runs) + 1))
        held = [(read(a, min(step, b - a)), a + min(step, b - a), b) for a, b in runs] + [(rest, 0, 0)]
        while any(len(rows) for rows, _, _ in held):
            # what is not above the last row of any run that goes on in the file comes next
            bound = min((rows[-1, 0] for rows, a, b in held if a < b), default=None)
            cuts = [len(rows) if bound is None else int(np.searchsorted(rows[:, 0], bound, "right")) for rows, _, _ in held]
            yield by_first(np.concatenate([rows[:k] for (rows, _, _), k in zip(held, cuts, strict=True)]))
            left = [(rows[k:], a, b) for (rows, a, b), k in zip(held, cuts, strict=True)]
            held = [(read(a, min(step, b - a)), a + min(step, b - a), b) if not len(rows) and a < b else (rows, a, b) for rows, a, b in left]


class _Matcher(StatefulProcessor):
    """Exact rule on IDs: when a train completes, trains inserted before it are dropped; over `cache` trains the oldest goes.

    A micro-batch is sorted in runs on disk, and what ends goes out block by block, so memory does not grow with it.
    """

    def __init__(self, sources: list[str], cache: int):
        self.sources, self.cache = sources, cache

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "train_id long", "place long, mask long")
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows, timer_values):
        held = dict(sorted(((k[0], list(v)) for k, v in self.seen.iterator()), key=lambda x: x[1][0]))
        place = self.next.get()[0] if self.next.exists() else 0
        full = (1 << len(self.sources)) - 1
        columns = ["train_id", "complete", "reason"]
        for part in sorted_blocks(rows, ["seq", "train_id", "bit"]):
            out = []
            for t, bit in zip(part[:, 1].tolist(), part[:, 2].tolist(), strict=True):
                if t not in held:
                    held[t], place = [place, 0], place + 1
                held[t][1] |= bit
                if held[t][1] == full:
                    mine = held.pop(t)[0]
                    old = []
                    for k, v in held.items():  # in the order of their places
                        if v[0] > mine:
                            break
                        old.append(k)
                    out += [(t, True, "")] + [(k, False, self._why(held.pop(k)[1])) for k in old]
                elif len(held) > self.cache:
                    k = next(iter(held))
                    out.append((k, False, self._why(held.pop(k)[1])))
            yield pd.DataFrame(out, columns=columns)
        self.seen.clear()
        for k, v in held.items():
            self.seen.updateValue((int(k),), (int(v[0]), int(v[1])))
        self.next.update((int(place),))

    def _why(self, mask: int) -> str:
        missing = [s for i, s in enumerate(self.sources) if not mask >> i & 1]
        return f"Not found: {len(missing)} out of {len(self.sources)}: {missing[0]}" if missing else ""

    def close(self) -> None:
        pass


def correlate_stream_exact(arrivals: DataFrame, sources: list[str], cache: int = 20) -> DataFrame:
    """Exact one-key form on (seq, train_id, source): train_id, complete, reason. IDs only; payloads are joined afterwards."""
    bit = F.create_map(*[F.lit(v) for i, s in enumerate(sources) for v in (s, 1 << i)])[F.col("source")]
    own = arrivals.where(F.col("source").isin(sources)).select(F.lit(0).alias("one"), "seq", "train_id", bit.cast("long").alias("bit"))
    return own.groupBy("one").transformWithStateInPandas(_Matcher(sources, cache), "train_id long, complete boolean, reason string", "append", "none")


class _Average(StatefulProcessor):
    def __init__(self, w: int, key: str, order: str, col: str):
        self.w, self.key, self.order, self.col = w, key, order, col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, m double")

    def handleInputRows(self, key, rows, timer_values):
        n, m = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        frame = pd.concat(list(rows)).sort_values(self.order)
        for t, x in zip(frame[self.order], frame[self.col].astype(float), strict=True):
            n = min(n + 1, self.w)
            m = x if n == 1 else m + (x - m) / n
            out.append((key[0], t, m))
        self.state.update((int(n), float(m)))
        yield pd.DataFrame(out, columns=[self.key, self.order, "avg"])

    def close(self) -> None:
        pass


def moving_average_stream(df: DataFrame, key: str, order: str, col: str, w: int) -> DataFrame:
    """key, order, avg. Put a version column into key to reset: a new version has fresh state."""
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(_Average(w, key, order, col), f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, avg double", "append", "none")


class _Scan(StatefulProcessor):
    def __init__(self, resolution: float, min_count: int, key: str, order: str, x: str, y: str):
        self.resolution, self.min_count, self.key, self.order, self.x, self.y = resolution, min_count, key, order, x, y

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "x double, n long, y double, s double, point long")

    def handleInputRows(self, key, rows, timer_values):
        state, point = None, 0
        if self.state.exists():
            *state, point = self.state.get()
            state = list(state)
        out = {}
        frame = pd.concat(list(rows)).sort_values(self.order)
        for a, b in zip(frame[self.x].astype(float), frame[self.y].astype(float), strict=True):
            before = state
            state, opened = scan_step(state, a, b, self.resolution)
            if opened and before is not None and before[1] >= self.min_count:
                point += 1
            if state[1] >= self.min_count:
                half = 0.5 * (state[3] / state[1]) ** 0.5
                out[point] = (key[0], point, state[0], state[2], state[2] - half, state[2] + half, int(state[1]))
        self.state.update((float(state[0]), int(state[1]), float(state[2]), float(state[3]), int(point)))
        yield pd.DataFrame(list(out.values()), columns=[self.key, "point", "x", "y_avg", "y_min", "y_max", "count"])

    def close(self) -> None:
        pass


def scan_points_stream(df: DataFrame, key: str, order: str, x: str, y: str, resolution: float, min_count: int = 2) -> DataFrame:
    """Updated points (key, point, ...) of each micro-batch; the newest row of a point counts."""
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(_Scan(resolution, min_count, key, order, x, y), f"`{key}` {kind}, point long, x double, y_avg double, y_min double, y_max double, count long", "update", "none")


def bin_stream(df: DataFrame, x: str, fom: str, n: int, lo: float, hi: float, mode: str = "average", version: str | None = None) -> DataFrame:
    """bin, count, stat with a fixed range, as a streaming aggregate; a new version (a column) is a fresh history."""
    own = df.withColumn("bin", bin_index(F.col(x), F.lit(float(lo)), F.lit(float(hi)), n)).where("bin IS NOT NULL")
    keys = [version, "bin"] if version else ["bin"]
    return own.groupBy(*keys).agg(F.count("*").alias("count"), (F.avg(fom) if mode == "average" else F.sum(fom)).alias("stat"))


def histogram_stream(df: DataFrame, col: str, n: int, lo: float, hi: float) -> DataFrame:
    return df.withColumn("bin", bin_index(F.col(col), F.lit(float(lo)), F.lit(float(hi)), n)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))


def latest_per_batch(sink):
    """For foreachBatch: hand on only the newest train of each micro-batch (a slow consumer drops the rest)."""
    return lambda batch, batch_id: sink(latest(batch), batch_id)


def available_sources_stream(raw: DataFrame, ttl: str = "2 seconds") -> DataFrame:
    """source, last_ts per window of ttl: a source without rows in the newest window has expired."""
    return raw.withWatermark("ts", ttl).groupBy(F.window("ts", ttl), "source").agg(F.max("ts").alias("last_ts"), F.max_by("train_id", "ts").alias("last_train"))


def with_status(df: DataFrame, checks: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, dropped(train_id, operator, reason)): each check is a column that is true on error; a train fails on its first."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks.items()])
    marked = df.withColumn("__reason", reason)
    return marked.where("__reason IS NULL").drop("__reason"), marked.where("__reason IS NOT NULL").select("train_id", F.lit("check").alias("operator"), F.col("__reason").alias("reason"))


__all__ = ["correlate", "correlate_stream", "correlate_stream_exact", "moving_average_stream", "scan_points_stream", "bin_stream", "histogram_stream", "latest_per_batch", "available_sources_stream", "with_status"]
