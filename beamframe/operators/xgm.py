"""Pulse-energy monitors: averaged control values and averaged pulse intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.operators.filters import filter_pulses, filter_trains, slice_pulses
from beamframe.operators.stats import moving_average


def xgm_control(df: DataFrame, w: int, ranges: dict[str, tuple[float, float]], keys: tuple[str, ...] = (), order: str = "train_id") -> DataFrame:
    """Each column of ranges gets <column>_avg, its moving average; trains are kept by the raw values, not the averages."""
    for c in ranges:
        df = moving_average(df, list(keys), [order], c, w).withColumnRenamed("avg", f"{c}_avg")
    for c, (lo, hi) in ranges.items():
        df = filter_trains(df, c, lo, hi)
    return df


def xgm_pulse(df: DataFrame, col: str, w: int, lo: float, hi: float, start=None, stop=None, step=None) -> DataFrame:
    """(train_id, pulse, col): sliced, averaged pulse by pulse over trains (avg), and masked by the average (kept)."""
    own = slice_pulses(df, start, stop, step)
    return filter_pulses(moving_average(own, ["pulse"], ["train_id"], col, w), "avg", lo, hi)
