"""Streams with state for each key: trains matched with timers, sources that expire, averages with resets, bounded histories.

Every operator keys its state by what the work is dealt by (a source, a key, or a bucket of many trains), so it scales with
the keys; nothing passes through one group. Timers run on event time: the watermark, not the clock, decides, so a replay gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UTC_MS = "CAST(unix_millis({}) AS BIGINT)"


#: Parts that trains or keys are dealt to by hash; the state and the rows of a micro-batch of one part are worked on at once.
BUCKETS = 128


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")


class _Trains(StatefulProcessor):
    """Newest value of each source of the trains of one bucket; a train ends when it is complete, or when its time is over.

    The state is a row of arrays: the trains with the end of their time and whether they went out already, and the values
    held for those that did not. One timer stands at the least end. Steps are on whole arrays, as a call into the state
    for each train would cost more than the work on it.
    """

    def __init__(self, sources: list[str], wait_ms: int):
        self.sources, self.wait_ms = sources, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "train array<long>, ends array<long>, over array<boolean>, of array<long>, source array<int>, ms array<long>, seq array<long>, value array<double>")
        self.timer = handle.getValueState("timer", "at long")

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        row = self.held.get() if self.held.exists() else [[]] * 8
        trains = pd.DataFrame({"train": np.array(row[0], "int64"), "ends": np.array(row[1], "int64"), "over": np.array(row[2], bool)})
        values = pd.DataFrame({"train": np.array(row[3], "int64"), "source": np.array(row[4], "int32"), "ms": np.array(row[5], "int64"), "seq": np.array(row[6], "int64"), "value": np.array(row[7], "float64")})
        return trains, values

    def _store(self, trains: pd.DataFrame, values: pd.DataFrame) -> None:
        known = self.timer.get()[0] if self.timer.exists() else None
        least = int(trains["ends"].min()) if len(trains) else None
        if least != known:
            if known is not None:
                self.handle.deleteTimer(known)
                self.timer.clear()
            if least is not None:
                self.handle.registerTimer(least)
                self.timer.update((least,))
        if len(trains):
            self.held.update(tuple([trains[c].tolist() for c in trains.columns] + [values[c].tolist() for c in values.columns]))
        else:
            self.held.clear()

    def _rows(self, trains: np.ndarray, values: pd.DataFrame) -> pd.DataFrame:
        """What goes out for trains (ascending): a value for each source, and the first missing one as the reason."""
        own = values[values["train"].isin(trains)]
        at = np.searchsorted(trains, own["train"].to_numpy()), own["source"].to_numpy()
        grid, have = np.full((len(trains), len(self.sources)), np.nan), np.zeros((len(trains), len(self.sources)), bool)
        grid[at], have[at] = own["value"].to_numpy(), True
        n = (~have).sum(axis=1)
        reasons = [f"Not found: {k} out of {len(self.sources)}: {self.sources[i]}" if k else "" for k, i in zip(n.tolist(), have.argmin(axis=1).tolist(), strict=True)]
        return pd.DataFrame({"train_id": trains, "complete": n == 0, "reason": reasons, **{s: grid[:, i] for i, s in enumerate(self.sources)}})

    def handleInputRows(self, key, rows, timerValues):
        trains, values = self._load()
        frame = pd.concat([f[["train_id", "source", "ms", "seq", "scalar"]] for f in rows]).set_axis(["train", "source", "ms", "seq", "value"], axis=1)
        frame = frame[~frame["train"].isin(trains.loc[trains["over"], "train"])]  # emitted already; what comes after changes nothing
        if not len(frame):
            return
        # a train's time runs from its first row
        first = frame[~frame["train"].isin(trains["train"])].groupby("train", as_index=False)["ms"].min()
        trains = pd.concat([trains, pd.DataFrame({"train": first["train"], "ends": first["ms"] + self.wait_ms, "over": False})], ignore_index=True)
        values = pd.concat([values, frame.astype(dict(values.dtypes))])[::-1].sort_values(["train", "source", "ms", "seq"], kind="stable").drop_duplicates(["train", "source"], keep="last")
        n = values.groupby("train").size()
        done = n.index.to_numpy()[(n == len(self.sources)).to_numpy()]  # ascending
        out = self._rows(done, values)
        trains["over"] |= trains["train"].isin(done)
        self._store(trains, values[~values["train"].isin(done)])
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        trains, values = self._load()
        due = (trains["ends"] <= expiredTimerInfo.getExpiryTimeInMs()) | (trains["ends"] < timerValues.getCurrentWatermarkInMs())
        gone = np.sort(trains.loc[due & ~trains["over"], "train"].to_numpy())
        self.timer.clear()  # it has fired
        self._store(trains[~due], values[~values["train"].isin(gone)])
        if len(gone):
            yield self._rows(gone, values)

    def close(self) -> None:
        pass


def match_trains(raw: DataFrame, sources: list[str], wait_ms: int, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """(train_id, complete, reason, <a column for each source>) of a stream (train_id, source, ts, seq, scalar).

    A train goes out at once when it is complete, with the newest value of each source at that time; one that is not
    complete wait_ms after its first row goes out with the reason and what it has. A row behind the watermark is late: it
    is dropped, and its train ends with a reason. Trains are dealt to buckets; a train's part of a bucket's state is cleared
    when its time is over.
    """
    number = F.create_map(*[F.lit(v) for i, s in enumerate(sources) for v in (s, i)])[F.col("source")]
    own = raw.where(F.col("source").isin(sources) & F.col("train_id").isNotNull()).select("train_id", number.alias("source"), "ts", "seq", F.col("scalar").cast("double").alias("scalar")).withWatermark("ts", watermark)
    own = own.withColumn("ms", F.expr(UTC_MS.format("ts"))).withColumn("__bucket", _bucket("train_id", buckets))
    schema = "train_id long, complete boolean, reason string, " + ", ".join(f"`{s}` double" for s in sources)
    return own.groupBy("__bucket").transformWithStateInPandas(_Trains(sources, wait_ms), schema, "append", "EventTime")


class _Source(StatefulProcessor):
    """When a source was seen last, with one timer that moves along."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, train_id long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["ms", "train_id"])
        known = tuple(self.last.get()) if self.last.exists() else None
        last, out = known, []
        for ms, train in zip(frame["ms"], frame["train_id"], strict=True):
            row = (int(ms), int(train))
            if last is not None and row <= last:
                continue
            if last is not None and row[0] - last[0] > self.ttl_ms:  # silent that long, and back before a timer saw it
                out.append((key[0], False, *last))
            last = row
        if last == known:
            return
        if known is not None:
            self.handle.deleteTimer(known[0] + self.ttl_ms)
        self.last.update(last)
        self.handle.registerTimer(last[0] + self.ttl_ms)
        yield pd.DataFrame([*out, (key[0], True, *last)], columns=["source", "available", "last_ms", "last_train"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], False, int(last[0]), int(last[1]))], columns=["source", "available", "last_ms", "last_train"])

    def close(self) -> None:
        pass


def source_changes(raw: DataFrame, ttl_ms: int, watermark: str) -> DataFrame:
    """(source, available, last_ms, last_train) whenever a source shows itself and when it has been silent for ttl_ms.

    The newest row of a source is its state; what has expired leaves no state behind and may come back.
    """
    own = raw.select("source", "train_id", "ts").withWatermark("ts", watermark).withColumn("ms", F.expr(UTC_MS.format("ts")))
    return own.groupBy("source").transformWithStateInPandas(_Source(ttl_ms), "source string, available boolean, last_ms long, last_train long", "append", "EventTime")


class _Averaged(StatefulProcessor):
    """Moving average of vectors of one key, begun anew by a command or by another signature."""

    def __init__(self, w: int, key: str, order: str):
        self.w, self.key, self.order = w, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, signature string, m array<double>")

    def handleInputRows(self, key, rows, timerValues):
        n, signature, m = self.state.get() if self.state.exists() else (0, "", [])
        m, out = list(m), []
        frame = pd.concat(list(rows)).sort_values([self.order, "reset"], ascending=[True, False], kind="stable")
        for at, reset, kind, vec in zip(frame[self.order], frame["reset"], frame["signature"], frame["vec"], strict=True):
            if reset:
                n, m = 0, []
                continue
            own = f"{kind}/{len(vec)}"
            if own != signature:
                n, m, signature = 0, [], own
            n = min(n + 1, self.w)
            m = [float(x) for x in vec] if n == 1 else [a + (float(x) - a) / n for a, x in zip(m, vec, strict=True)]
            out.append((key[0], at, n, m))
        self.state.update((int(n), signature, m))
        yield pd.DataFrame(out, columns=[self.key, self.order, "n", "avg"])

    def close(self) -> None:
        pass


def average_with_resets(data: DataFrame, commands: DataFrame, key: str, order: str, w: int) -> DataFrame:
    """(key, order, n, avg): running averages of vec over data (key, order, signature, vec), begun anew

    - at each command (key, order), which counts before data of the same order;
    - when the signature (say, analysis type and source) or the length of the vector changes.
    Both streams go through one state for each key, in the order of `order` within a micro-batch.
    """
    kinds = dict(data.dtypes)
    own = data.select(key, order, F.lit(False).alias("reset"), F.coalesce(F.col("signature").cast("string"), F.lit("")).alias("signature"), F.col("vec").cast("array<double>").alias("vec"))
    asked = commands.select(key, order, F.lit(True).alias("reset"), F.lit("").alias("signature"), F.array().cast("array<double>").alias("vec"))
    both = own.unionByName(asked)
    return both.groupBy(key).transformWithStateInPandas(_Averaged(w, key, order), f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, n long, avg array<double>", "append", "none")


class _Rings(StatefulProcessor):
    """The n newest rows of each key of one bucket, as a row of arrays; steps are on whole arrays, as in _Trains."""

    def __init__(self, n: int, key: str, order: str, value: str):
        self.n, self.names = n, [key, order, value]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "key array<string>, at array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues):
        held = self.rows.get() if self.rows.exists() else [[]] * 3
        before = pd.DataFrame({"key": np.array(held[0], object), "at": np.array(held[1], "int64"), "value": np.array(held[2], "float64"), "new": False})
        fresh = pd.concat([f[self.names] for f in rows]).set_axis(["key", "at", "value"], axis=1).astype({"key": object, "at": "int64", "value": "float64"})
        both = pd.concat([before, fresh.assign(new=True)], ignore_index=True)
        codes = pd.factorize(both["key"], use_na_sentinel=False)[0]
        order = np.lexsort((~both["at"].to_numpy(), codes))  # newest first; of equal ones the first to come
        both, codes = both.iloc[order], codes[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        kept = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) < self.n
        left = both[kept]
        self.rows.update(([None if pd.isna(k) else k for k in left["key"]], left["at"].tolist(), left["value"].tolist()))
        new = both["new"].to_numpy()
        out = pd.concat([both[kept & new].assign(change=1), both[~kept & ~new].assign(change=-1)]).drop(columns="new")
        if len(out):
            yield out.set_axis([*self.names, "change"], axis=1)

    def close(self) -> None:
        pass


def last_n_stream(df: DataFrame, key: str, order: str, value: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """(key, order, value, change): what enters (+1) and leaves (-1) the n newest rows of each key.

    Each micro-batch gives its changes only; a row that comes and goes within one gives none. Rows whose changes add up
    to 1 are the history (see history_of); the state is n rows a key. Keys are dealt to buckets and must have a form as text
    that can be cast back.
    """
    own = df.select(_bucket(key, buckets), F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    out = own.groupBy("__bucket").transformWithStateInPandas(_Rings(n, key, order, value), f"`{key}` string, `{order}` long, `{value}` double, change long", "append", "none")
    return out.withColumn(key, F.col(key).cast(dict(df.dtypes)[key]))


def history_of(changes: DataFrame) -> DataFrame:
    """The rows that all changes together leave."""
    cols = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*cols).agg(F.sum("change").alias("change")).where("change > 0").select(*[F.col(f"`{c}`") for c in cols])
