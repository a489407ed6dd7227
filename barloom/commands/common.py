"""Flags and inputs that the programs share."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.indicators import indicator_frame
from barloom.sources import tickers
from barloom.sources.bars import bars_from_events, last_days, positioned, read_bars


def parser(about: str, limit: int) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=about)
    # Names and defaults of flags.
    out.add_argument("--input", required=True, help="Parquet bars, or with --events an event table")
    out.add_argument("--events", action="store_true", help="make hourly bars of events")
    out.add_argument("--market", default="KOSPI")
    out.add_argument("--days", type=int, default=365)
    out.add_argument("--limit", type=int, default=limit, help="most instruments, 0 for all")
    out.add_argument("--as-of-date", default="", help="last day, yyyyMMdd or yyyy-MM-dd; else the latest bar")
    out.add_argument("--tickers-csv", default="", help="instruments where there is no membership")
    out.add_argument("--membership", default="", help="Parquet of date, ticker, ord")
    return out


def as_of(args: argparse.Namespace) -> str | None:
    day = args.as_of_date.strip()
    return f"{day[:4]}-{day[4:6]}-{day[6:]}" if len(day) == 8 and day.isdigit() else day or None


def instruments(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """ticker and ord of the instruments asked for; None for all that have bars."""
    listed = tickers.strict_tickers(tickers.read_csv(spark, args.tickers_csv), "line") if args.tickers_csv else None
    limit = args.limit or None
    if args.membership:
        day = as_of(args)
        rows = spark.read.parquet(args.membership)
        if day is None:
            day = str(rows.agg(F.max("date")).first()[0])
        return tickers.resolve(rows, day, listed, limit)
    return listed if listed is None or limit is None else listed.orderBy("ord", "ticker").limit(limit)


def names(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    return tickers.lenient_tickers(tickers.read_csv(spark, args.tickers_csv), "line").select("ticker", "name") if args.tickers_csv else None


def frame(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The indicator frame of the bars asked for; an error if there are none."""
    wanted, end = instruments(spark, args), as_of(args)
    end = f"{end} 23:59:59.999999" if end and len(end) == 10 else end
    if args.events:
        bars = bars_from_events(spark.read.parquet(args.input))
        bars = last_days(bars if end is None else bars.where(F.col("bar_ts") <= F.lit(end).cast("timestamp_ntz")), args.days)
        bars = bars if wanted is None else bars.join(wanted.select("ticker"), "ticker", "left_semi")
    else:
        bars = read_bars(spark, args.input, wanted, end=end, days=args.days)
    if not bars.take(1):
        raise SystemExit(f"{args.input}: no bars for these instruments and days")
    return indicator_frame(positioned(bars))


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()
