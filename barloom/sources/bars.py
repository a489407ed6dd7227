"""Price bars: one long table, ordered within an instrument by the position ``i``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import finite

#: Column names of the domestic market's data, and of normalised bars.
ALIASES = {"날짜": "bar_ts", "시가": "open", "고가": "high", "저가": "low", "종가": "close", "거래량": "volume", "Date": "bar_ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
REQUIRED = ("ticker", "bar_ts", "open", "high", "low", "close", "volume")


def normalise(raw: DataFrame) -> DataFrame:
    """Renames known columns and fixes types; a missing column is an error.  NaN and
    infinite prices and volumes become null, which no rule takes for a number."""
    named = raw.withColumnsRenamed({old: new for old, new in ALIASES.items() if old in raw.columns})
    if missing := [c for c in REQUIRED if c not in named.columns]:
        raise ValueError(f"bars lack the columns {missing}")
    prices = [finite(F.col(c).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return named.select(F.col("ticker").cast("string").alias("ticker"), F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), *prices)


def positioned(bars: DataFrame) -> DataFrame:
    """Adds ``i`` (from 0) and ``n`` (bars of the instrument), in one shuffle by instrument."""
    own = Window.partitionBy("ticker")
    return bars.withColumns({"i": (F.row_number().over(own.orderBy("bar_ts")) - 1).cast("long"), "n": F.count("*").over(own)})


def read_bars(spark: SparkSession, path: str, tickers: DataFrame | None = None, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    """Bars of a Parquet table, limited to dates and instruments by pushed-down filters.

    ``days`` counts back from ``end``, or from the latest bar on or before it: a date
    without bars falls back to the last one that has some.
    """
    bars = normalise(spark.read.parquet(path))
    if end is not None:
        bars = bars.where(F.col("bar_ts") <= F.lit(end).cast("timestamp_ntz"))
    if days is not None:
        bars = last_days(bars, days)
    if start is not None:
        bars = bars.where(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if tickers is None else bars.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def last_days(bars: DataFrame, days: int) -> DataFrame:
    """The bars of so many days back from the latest one."""
    last = bars.agg(F.max("bar_ts").alias("last"))
    return bars.crossJoin(F.broadcast(last)).where(F.col("bar_ts") >= F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("last")  # one row


def bars_from_events(events: DataFrame, every: str = "hour") -> DataFrame:
    """Bars of an event table: each event type is an instrument, its standardised log
    values are steps of a price walk, and every hour is a bar.

    The walk is a running sum in two levels: within an hour, and over the hours before.
    Mean, deviation and totals all come from one row per instrument and hour, so events are
    read twice and no window holds more than an hour's events or a row per hour.
    """
    ticks = events.select("event_type", "event_id", "ts", "value", F.log(1 + F.col("value")).alias("log"), F.date_trunc(every, "ts").cast("timestamp_ntz").alias("bar_ts"))
    hours = ticks.groupBy("event_type", "bar_ts").agg(F.count("log").alias("n"), F.avg("log").alias("mean"), F.var_pop("log").alias("var"))
    whole = Window.partitionBy("event_type")
    hours = hours.withColumn("mu", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    spread = F.col("n") * (F.col("var") + (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu")))
    hours = hours.withColumn("sd", F.sqrt(F.sum(spread).over(whole) / F.sum("n").over(whole)))
    step = lambda log: 0.01 * ((log - F.col("mu")) / F.col("sd"))
    before = whole.orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("event_type", "bar_ts", "mu", "sd", F.coalesce(F.sum(F.col("n") * step(F.col("mean"))).over(before), F.lit(0.0)).alias("level"))
    inside = Window.partitionBy("event_type", "bar_ts").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ticks = ticks.join(hours, ["event_type", "bar_ts"]).withColumn("price", F.round(100 * F.exp(F.col("level") + F.sum(step(F.col("log"))).over(inside)), 2))
    return bars_from_ticks(ticks, "price", F.struct("ts", "event_id"), "event_type")


def bars_from_ticks(ticks: DataFrame, price: str, order: Column, ticker: str) -> DataFrame:
    """Open, high, low, close and volume of each instrument and ``bar_ts``."""
    return ticks.groupBy(F.col(ticker).alias("ticker"), "bar_ts").agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.round(F.sum("value"), 2).alias("volume"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned bars of the ``events`` table."""
    return positioned(bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
