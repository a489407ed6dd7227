"""Rules on the latest bar of every instrument, kept up to date as bars arrive.

The state of an instrument is the smoothed means at its last settled bar, the last 62
settled bars, and the bars that the watermark has not passed.  Nothing older is read again:
a bar costs the same however long its instrument is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.functions.rules import PRESETS, rule
from barloom.operators.trades import least_history
from barloom.sources.bars import normalise

#: Bars that the longest look back of an indicator needs: a mean of 60, two bars ago.
RING = 62
PRICES = ("open", "high", "low", "close", "volume")
_BAR = "us double, open double, high double, low double, close double, volume double, macd double, signal double"
_MEANS = "settled long, known double, ema12 double, ema26 double, signal double"
_INDICATORS = ("macd", "signal", "macd_1", "signal_1", "close_1", "ma5", "ma10", "ma20", "ma60", "ma20_1", "ma20_2", "ma60_1", "ma60_2", "vol20", "vol20_prev", "high40_prev", "high40_prev2", "high60_prev", "atr14", "rsi14")
_OUT = "ticker string, us long, i long, " + ", ".join(f"{c} double" for c in PRICES + _INDICATORS) + ", gc boolean, gc_prev5 int"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _smoothed(before: float, values: np.ndarray, span: int) -> np.ndarray:
    """The recursion goes on from ``before``, or starts at the first value where that is NaN."""
    return pd.Series(np.append(before, values)).ewm(span=span, adjust=False).mean().to_numpy()[1:]


def _walk(means: tuple, bars: np.ndarray) -> np.ndarray:
    """Fills macd and signal of bars that follow ``means``; returns known, ema12, ema26, signal."""
    _, known, ema12, ema26, signal = means
    closes = pd.Series(np.append(known, bars[:, 4])).ffill().to_numpy()[1:]
    fast, slow = _smoothed(ema12, closes, 12), _smoothed(ema26, closes, 26)
    bars[:, 6] = fast - slow
    bars[:, 7] = _smoothed(signal, bars[:, 6], 9)
    return np.column_stack([closes, fast, slow, bars[:, 7]])


def _merged(pending: np.ndarray, new: np.ndarray, after: float) -> np.ndarray:
    """Bars in order of time, later than ``after``.  Of bars of one time that of the later
    batch counts; of several in one batch the largest by open, high, low, close, volume."""
    both = np.vstack([pending, new])
    late = np.arange(len(both)) >= len(pending)
    both = both[order := np.lexsort((*(both[:, k] for k in range(5, 0, -1)), late, both[:, 0]))]
    last = np.append(both[1:, 0] != both[:-1, 0], True) if len(order) else np.zeros(0, bool)
    return both[last & (both[:, 0] > after)]


def _indicators(tail: np.ndarray) -> dict[str, float]:
    """The indicators of the last of up to RING bars, NaN where a bar or value is missing."""
    size = len(tail)
    _, _, high, low, close, volume, macd, signal = tail.T

    def over(agg, values: np.ndarray, n: int, back: int = 0) -> float:
        end = len(values) - back
        return agg(values[end - n : end]) if end >= n else np.nan

    at = lambda values, back: values[size - 1 - back] if size > back else np.nan
    before = np.append(np.nan, close[:-1])
    ranges = np.fmax.reduce([high - low, np.abs(high - before), np.abs(low - before)])
    steps = np.diff(close)
    gain, loss = over(np.mean, np.maximum(steps, 0.0), 14), over(np.mean, -np.minimum(steps, 0.0), 14)
    crossed = (macd[:-1] < signal[:-1]) & (macd[1:] > signal[1:])
    out = {"macd": macd[-1], "signal": signal[-1], "macd_1": at(macd, 1), "signal_1": at(signal, 1), "close_1": at(close, 1)}
    out |= {f"ma{n}": over(np.mean, close, n) for n in (5, 10, 20, 60)}
    out |= {f"ma{n}_{k}": over(np.mean, close, n, k) for n in (20, 60) for k in (1, 2)}
    out |= {"vol20": over(np.mean, volume, 20), "vol20_prev": over(np.mean, volume, 20, 1)}
    out |= {"high40_prev": over(np.max, high, 40, 1), "high40_prev2": over(np.max, high, 40, 2), "high60_prev": over(np.max, high, 60, 1)}
    out |= {"atr14": over(np.mean, ranges, 14), "rsi14": 100 - 100 / (1 + gain / loss) if loss else np.nan}
    return out | {"gc": bool(crossed[-1:].any()), "gc_prev5": int(crossed[-6:-1].any())}


class LastBar(StatefulProcessor):
    """One row per instrument and batch with bars of it: its latest bar with indicators."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.means = handle.getValueState("means", _MEANS)
        self.ring = handle.getListState("ring", _BAR)
        self.pending = handle.getListState("pending", _BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = lambda state: np.array(list(state.get()), float).reshape(-1, 8)
        new = np.vstack([f[["us", *PRICES]].to_numpy(float) for f in rows])
        new = np.hstack([new, np.full((len(new), 2), np.nan)])
        means = self.means.get() if self.means.exists() else (0, np.nan, np.nan, np.nan, np.nan)
        ring = bars(self.ring)
        pending = _merged(bars(self.pending), new, ring[-1, 0] if len(ring) else -np.inf)
        if not len(pending):  # all of them too late
            return
        carried = _walk(means, pending)
        last = pending[-1]
        row = {"ticker": key[0], "us": int(last[0]), "i": means[0] + len(pending) - 1} | dict(zip(PRICES, last[1:6], strict=True))
        yield pd.DataFrame([row | _indicators(np.vstack([ring, pending[-RING:]])[-RING:])])
        done = int(np.searchsorted(pending[:, 0], timerValues.getCurrentWatermarkInMs() * 1000, side="right"))
        if done:
            self.means.update((means[0] + done, *map(float, carried[done - 1])))
            self.ring.put(_rows(np.vstack([ring, pending[:done]])[-RING:]))
        if done < len(pending):
            self.pending.put(_rows(pending[done:]))
        else:
            self.pending.clear()

    def close(self) -> None:
        pass


def _rows(bars: np.ndarray) -> list[tuple]:
    return [tuple(map(float, b)) for b in bars]


def latest_indicators(bars: DataFrame, late: str = "2 hours") -> DataFrame:
    """The indicator columns of each instrument's latest bar, whenever bars of it arrive.

    Bars may arrive in any order within ``late``; a bar of a time that is still open
    replaces the one before; older ones than the last settled bar are dropped.  A null
    price or volume makes null what looks at it, but for smoothed means, where a missing
    close counts as the one before.  Bars without instrument or time are dropped; more
    columns are ignored.
    """
    at = F.col("bar_ts").cast("timestamp")
    rows = normalise(bars).where(F.col("ticker").isNotNull() & F.col("bar_ts").isNotNull()).select("ticker", at.alias("at"), F.unix_micros(at).alias("us"), *PRICES)
    found = rows.withWatermark("at", late).groupBy("ticker").transformWithStateInPandas(LastBar(), _OUT, "Update", "EventTime")
    return found.withColumns({"bar_ts": F.timestamp_micros("us").cast("timestamp_ntz"), "next_open": F.lit(None).cast("double"), "next_close": F.lit(None).cast("double")}).drop("us")


def latest_rules(latest: DataFrame, vol_mult: float, max_hold: int) -> DataFrame:
    """ticker, i, bar_ts, close and a flag per rule, false with too few bars."""
    fires = [F.when(F.col("i") + 1 >= least_history(max_hold), rule(p, vol_mult)).otherwise(False).alias(p) for p in PRESETS]
    return latest.select("ticker", "i", "bar_ts", "close", *fires)


def run_latest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what has arrived, writes each batch to its own folder of ``path``, and stops.

    A batch that runs again after a failure replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark: SparkSession = rows.sparkSession
    key, provider = _PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, provider)  # read when the query starts
    try:
        return rows.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    finally:
        spark.conf.set(key, before)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Of each instrument the row of the latest batch that had one."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy("ticker").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "ticker")), "batch").alias("row"))
    return latest.select("ticker", "row.*").drop("batch")
