"""Instrument lists, logs, messages, streams, and the entry module."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom.operators import reports, scanners
from barloom.operators.indicators import indicator_frame
from barloom.sources import sinks, tickers
from barloom.sources.bars import event_bars, read_bars
from barloom.sources.strategy import QUANT
from barloom.streaming.bars import run_available, stream_bars

SF = "/root/testdata/sf0.001"


def test_strict_and_lenient_lists(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("code,Name\n5930,A\n 005930.0 ,B\n,\nABC,C\n1234567,D\n35720.0,\n")
    rows = tickers.read_csv(spark, str(path))
    strict = tickers.strict_tickers(rows, "line").orderBy("ord")
    assert [r["ticker"] for r in strict.collect()] == ["005930", "035720"]
    lenient = tickers.lenient_tickers(rows.withColumnRenamed("Name", " NAME "), "line").orderBy("ord")
    assert [(r["ticker"], r["name"]) for r in lenient.collect()] == [("005930", "A"), ("ABC", "C"), ("1234567", "D"), ("035720", "035720")]
    with pytest.raises(ValueError):
        tickers.lenient_tickers(spark.range(1), "id")


def test_members_and_listings(spark):
    days = spark.createDataFrame([("2024-01-02", "A"), ("2024-01-05", "B"), ("2024-02-01", "C")], "date string, ticker string").withColumn("date", F.to_date("date"))
    assert [r["ticker"] for r in tickers.members_as_of(days, "2024-01-10").collect()] == ["B"]
    assert tickers.members_as_of(days, "2023-12-01").count() == 0
    rows = spark.createDataFrame([("K", k, str(k)) for k in range(5)] + [("S", k, str(k)) for k in range(3)], "market string, ord int, ticker string")
    assert tickers.listing(rows, {"K": 2}).count() == 5


def test_messages():
    assert reports.split_message("ab\ncd\nef", 5) == ["ab\ncd", "ef"]
    assert reports.split_message("ab\n" + "x" * 25 + "\ncd", 10) == ["ab", "x" * 10, "x" * 10, "xxxxx\ncd"]
    assert reports.split_message("", 10) == []


def test_sections_logs_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("000001", "Bee", 12.4), ("000002", None, 7.5)], "ticker string, name string, close double")
    text = reports.section("T", QUANT, reports.named(rows, None)).first()["text"]
    assert text.endswith("000002 (000002) close=8\nBee (000001) close=12") or text.endswith("000002 (000002) close=7\nBee (000001) close=12")
    assert reports.section("T", QUANT, reports.named(rows, None).limit(0)).first()["text"].endswith("No signal today.")
    names = spark.createDataFrame([("000002", "Sea")], "ticker string, name string")
    assert {r["name"] for r in reports.named(rows, names).collect()} == {"Bee", "Sea"}
    frame = indicator_frame(event_bars(spark, SF))
    log = reports.selection_log(scanners.hits(scanners.diagnose(frame), "trend", last_only=False), "trend")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * log.count() > 0
    ranking = spark.createDataFrame([("x", None, 2.0)], "config string, profit_factor double, score double")
    assert json.loads(sinks.best_strategy(ranking).first()["json"]) == {"config": "x", "profit_factor": None, "score": 2.0}
    sinks.export_ranking(ranking, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert not sinks.best_effort(lambda: 1 / 0, "it") and sinks.best_effort(lambda: None, "it")


def test_log_prices_as_sql_writes_them(spark):
    prices = [1128165082568768895320064.0, 4503599627370497.5, 209046551853.36, 0.125, 1.005, 2.675, 0.0, -0.001, None]
    rows = spark.createDataFrame([(str(k), dt.datetime(2024, 1, 2), p) for k, p in enumerate(prices)], "ticker string, bar_ts timestamp_ntz, close double")
    got = [r["close"] for r in reports.selection_log(rows, "m").orderBy("ticker").collect()]
    assert got == [duckdb.execute("SELECT format('{:.2f}', ?::DOUBLE)", [p]).fetchone()[0] for p in prices]


def test_reader_falls_back_to_the_last_bars(spark, tmp_path):
    bars = event_bars(spark, SF).withColumnsRenamed({"bar_ts": "날짜", "close": "종가"})
    bars.write.parquet(str(tmp_path / "b"))
    last = bars.agg(F.max("날짜")).first()[0]
    got = read_bars(spark, str(tmp_path / "b"), end=str(last.replace(year=last.year + 1)), days=2, tickers=bars.limit(1).select("ticker"))
    assert 0 < got.count() and got.agg(F.max("bar_ts")).first()[0] <= last


def test_scanner_stages_shrink(spark):
    rows = scanners.diagnose(indicator_frame(event_bars(spark, "/root/testdata/sf0.01")))
    c = scanners.diagnostic_counts(rows).first()
    assert c["trend_len_ok"] >= c["trend_vol_ok"] >= c["trend_ma_ok"] >= c["trend_atr_ok"] == c["trend_final"] > 0
    assert c["power_len_ok"] >= c["power_vol_ok"] >= c["power_candle_ok"] >= c["power_breakout_ok"] == c["power_final"] > 0


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round("value", 2).alias("price"), "value")
    ticks.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    run_available(stream, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    order = F.struct("ts", "event_id")
    batch = ticks.groupBy("ticker", F.date_trunc("hour", "ts").alias("bar_ts")).agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))
    want = {(r["ticker"], r["bar_ts"]): (r["open"], r["close"]) for r in batch.collect()}
    got = {(r["ticker"], r["bar_ts"]): (r["open"], r["close"]) for r in seen}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_section_for_every_day(spark):
    rows = spark.createDataFrame([("000001", "2020-01-02", 5.0), ("000002", "2020-01-02", 6.0), ("000001", "2020-01-03", 7.0)], "ticker string, date string, close double")
    days = spark.createDataFrame([("2020-01-02",), ("2020-01-03",), ("2020-01-03",), ("2020-01-04",)], "date string")
    got = {r["date"]: r["text"].split("\n\n")[1] for r in reports.daily_sections("T", QUANT, reports.named(rows, None), days).collect()}
    assert got == {"2020-01-02": "000001 (000001) close=5\n000002 (000002) close=6", "2020-01-03": "000001 (000001) close=7", "2020-01-04": "No signal today."}
    queries = __spark_entry__.queries()
    n = queries["strategy_section"](spark, SF).count()
    assert n > 1 and queries["message_chunks"](spark, SF).select("ident").distinct().count() == n


def test_members_on_many_days(spark):
    membership = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-01-01", "B", 2), ("2024-01-10", "C", 1), (None, "X", 9)], "date string, ticker string, ord long").withColumn("date", F.to_date("date"))
    days = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2024-01-09",), ("2024-01-10",), ("2024-01-24",), ("2024-01-25",), (None,), ("2024-01-10",)], "day string")
    listed = spark.createDataFrame([("F", 7)], "ticker string, ord long")
    got = sorted((str(r["day"]), str(r["date"]), r["ticker"], r["ord"]) for r in tickers.members_by_day(membership, days, listed).collect())
    first, second = [("2024-01-01", "A", 1), ("2024-01-01", "B", 2)], [("2024-01-10", "C", 1)]
    want = [("2023-12-31", "2023-12-17", "F", 7), *((d, *m) for d in ("2024-01-01", "2024-01-09") for m in first), *((d, *m) for d in ("2024-01-10", "2024-01-24") for m in second), ("2024-01-25", "2024-01-11", "F", 7)]
    assert got == sorted(want)
    for day in ("2024-01-09", "2024-01-24", "2024-01-25"):  # as for one day at a time
        one = sorted((str(r["date"]), r["ticker"], r["ord"]) for r in tickers.resolve(membership, day, listed).collect())
        assert one == [g[1:] for g in got if g[0] == day]
    assert tickers.members_by_day(membership.limit(0), days).count() == 0


def test_last_days_of_events(spark):
    from argparse import Namespace

    from barloom.commands import common

    args = Namespace(input=f"{SF}/events.parquet", events=True, days=5, limit=0, as_of_date="", tickers_csv="", membership="")
    got = common.frame(spark, args).agg(F.min("bar_ts"), F.max("bar_ts")).first()
    whole = event_bars(spark, SF).agg(F.min("bar_ts"), F.max("bar_ts")).first()
    assert got[1] == whole[1] and (got[1] - got[0]).days <= 5 and got[0] > whole[0]
