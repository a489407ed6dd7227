"""Exits of many entries by sparse tables and a doubling search.

A stop falls at the first bar whose low is under (1 - stop) times the highest high since
the entry.  For a run of bars that an entry's peak enters, that is decided by three numbers
of the run: its highest high, its lowest low, and whether it holds an event by itself (a
stop under its own highs, or a dead cross).  Tables of these for all runs of 1, 2, 4, ...
bars take a logarithm of the hold per bar, and every entry skips runs without an event from
the longest down, all entries at once.

Bars of an instrument are cut into ranges of ``RANGE``, each with the bars after it that its
entries can reach, so one instrument spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 4096
REASONS = np.array(["max_hold", "dead_cross", "trailing_stop"])
_FOUND = "ticker string, i long, n long, next_open double, next_close double, fired array<int>, exits array<struct<exit_i:long,exit_price:double,reason:string>>, ends array<struct<i:long,close:double>>"


def first_events(high: np.ndarray, low: np.ndarray, dead: np.ndarray, entry: np.ndarray, hold: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entry: the bar of its exit, the stop's price there (or NaN), and the reason's
    number.  A hold's end, or the last bar, is an exit; the entry bar's own dead cross is
    none; the stop comes before the dead cross.  NaN highs and lows count as missing."""
    n, keep = len(high), 1 - stop
    tops, lows = [np.where(np.isnan(high), -np.inf, high)], [np.where(np.isnan(low), np.inf, low)]
    event, wide = [(lows[0] <= tops[0] * keep) | dead], 1
    while 2 * wide <= min(hold, n):
        top, under, inside = tops[-1], lows[-1], event[-1]
        event.append(inside[:-wide] | inside[wide:] | (under[wide:] <= top[:-wide] * keep))
        tops.append(np.maximum(top[:-wide], top[wide:]))
        lows.append(np.minimum(under[:-wide], under[wide:]))
        wide *= 2
    last = np.minimum(entry + hold, n - 1)
    peak = tops[0][entry]
    at_once = lows[0][entry] <= peak * keep
    at = np.where(at_once, entry, entry + 1)
    for level in reversed(range(len(tops))):
        size = 1 << level
        k = np.flatnonzero(~at_once & (at + size - 1 <= last))
        p = at[k]
        k = k[~event[level][p] & ~(lows[level][p] <= peak[k] * keep)]
        peak[k] = np.maximum(peak[k], tops[level][at[k]])
        at[k] += size
    found = at <= last
    at = np.where(found, at, last)
    peak = np.where(found, np.maximum(peak, tops[0][at]), peak)
    hit = found & (lows[0][at] <= peak * keep)
    return at, np.where(hit, peak * keep, np.nan), np.where(hit, 2, np.where(found & dead[at] & (at > entry), 1, 0))


def _lists(values: pa.Array, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width), pa.int32()), values)


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def _search(stops: list[float], holds: list[int]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        col = lambda c: rows.column(c).to_numpy()
        i = col("i")
        wanted = np.flatnonzero(col("own") & (i < col("n") - 2) & (np.asarray(rows.column("fired").combine_chunks().value_lengths()) > 0))
        high, low, open_, close = (np.asarray(rows.column(c).to_pandas(), float) for c in ("high", "low", "open", "close"))
        entry, each = wanted + 1, []
        for stop in stops:
            at, price, why = first_events(high, low, col("dead"), entry, holds[-1], stop)
            each.append((i[at], np.where(why == 2, np.fmin(open_[at], price), close[at]), REASONS[why]))
        whole = lambda k: np.stack([x[k] for x in each], axis=1).ravel() if len(wanted) else np.zeros(0)
        found = pa.StructArray.from_arrays([pa.array(whole(0), pa.int64()), _numbers(whole(1)), pa.array(whole(2).tolist(), pa.string())], names=["exit_i", "exit_price", "reason"])
        last = np.minimum(entry[:, None] + np.array(holds), len(i) - 1).ravel()
        ends = pa.StructArray.from_arrays([pa.array(i[last], pa.int64()), _numbers(close[last])], names=["i", "close"])
        kept = rows.take(pa.array(wanted, pa.int64())).select(["ticker", "i", "n", "next_open", "next_close", "fired"])
        kept = kept.set_column(5, "fired", kept.column("fired").cast(pa.list_(pa.int32())))
        return kept.append_column("exits", _lists(found, len(stops))).append_column("ends", _lists(ends, len(holds)))

    return run


def search_exits(frame: DataFrame, stops: list[float], holds: list[int], span: int = RANGE) -> DataFrame:
    """ticker, i, n, next_open, next_close, fired, exits, ends for every bar with a next one
    to enter at and a ``fired`` array that is not empty.

    ``exits`` has the event of the longest of ``holds`` (in order) for each stop: exit_i,
    exit_price, reason; ``ends`` the last bar of each hold and its close.  ``i`` numbers the
    bars of an instrument without gaps.
    """
    dead = F.coalesce(F.col("macd") < F.col("signal"), F.lit(False)).alias("dead")
    bars = frame.select("ticker", "i", "n", "open", "high", "low", "close", dead, "next_open", "next_close", "fired")
    here = F.floor(F.col("i") / span)
    reach = holds[-1] + 2
    # A bar also belongs to the ranges before its own whose entries reach it.
    ranges = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - reach) / span)), here)
    dealt = bars.withColumn("range", F.explode(ranges)).withColumn("own", F.col("range") == here)
    return dealt.groupBy("ticker", "range").applyInArrow(_search(stops, holds), _FOUND)
