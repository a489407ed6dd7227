"""Stored bars, strategies as files, and logs by run."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.commands import detect
from barloom.operators import scanners
from barloom.operators.indicators import indicator_frame
from barloom.sources import sinks
from barloom.sources.bars import bars_from_events, positioned
from barloom.sources.store import write_store
from barloom.sources.strategy import StrategyConfig, load_strategy, read_strategies

SF = "/root/testdata/sf0.001"


def test_windows_over_a_store_do_not_shuffle(spark, tmp_path):
    bars = bars_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    stored = write_store(bars, "stored_bars", str(tmp_path / "store"), buckets=4)
    frame = indicator_frame(positioned(stored))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    whole = lambda df: sorted(map(str, df.select("ticker", "i", F.round("macd", 9), F.round("ma20", 9), "gc", "high40_prev").collect()))
    assert whole(frame) == whole(indicator_frame(positioned(bars)))
    write_store(bars.where("false"), "stored_bars", str(tmp_path / "store"), buckets=4)
    assert spark.table("stored_bars").count() == 0


def test_strategy_files(spark, tmp_path):
    files = {
        "default": "{}",
        "partial": json.dumps({"entry_set": "strict_union", "stop_pct": "0.2", "max_hold": 7, "other": [1], "score": None}, indent=2),
        "number": '{"stop_pct": "x"}',
        "nested": '{"stop_pct": {"a": 1}}',
        "flag": '{"macd_zero_filter": "true"}',
        "null": '{"days": null}',
        "rule": '{"entry_set": "nope"}',
        "list": "[1]",
        "broken": '{"days": 3',
        "twice": '{"days": 3, "days": 4}',
        "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"].rsplit("/", 1)[1][:-5]: r for r in read_strategies(spark, str(tmp_path)).collect()}
    reasons = {name: got[name]["reason"] if name in got else "no row" for name in files}
    bad = "no JSON object"
    assert reasons.pop("empty") in (bad, "no row")  # Spark makes no split of an empty file
    assert reasons == {"default": None, "partial": None, "number": "bad field stop_pct", "nested": "bad field stop_pct", "flag": "bad field macd_zero_filter", "null": "bad field days", "rule": "unknown rule", "list": bad, "broken": bad, "twice": bad}
    for name in ("default", "partial"):
        row = got[name].asDict()
        assert StrategyConfig(**{k: v for k, v in row.items() if k not in ("path", "reason")}) == load_strategy(str(tmp_path / f"{name}.json"))
    assert all(v is None for k, v in got["number"].asDict().items() if k not in ("path", "reason"))


def test_a_run_that_runs_again_leaves_one_set_of_rows(spark, tmp_path):
    bars = f"{tmp_path}/bars"
    bars_from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet")).write.parquet(bars)
    last = spark.read.parquet(bars).agg(F.max("bar_ts")).first()[0]
    args = ["--input", bars, "--strategy", f"{tmp_path}/none.json", "--output", f"{tmp_path}/m", "--log", f"{tmp_path}/log"]
    detect.main(args)
    once = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").collect()))
    detect.main(args)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").collect())) == once
    assert (tmp_path / "log" / f"run={last.date()}").is_dir()
    log = spark.createDataFrame([("2024-01-05", "A", "m", "1.00")], "date string, ticker string, method string, close string")
    sinks.replace_log(log, f"{tmp_path}/own", "a")
    sinks.replace_log(log.union(log), f"{tmp_path}/own", "b")
    failing = log.withColumn("close", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_log(failing, f"{tmp_path}/own", "c")
    assert spark.read.parquet(f"{tmp_path}/own").groupBy("run").count().orderBy("run").collect() == [("a", 1), ("b", 2)]
    sinks.replace_log(log.where("false"), f"{tmp_path}/own", "b")  # nothing selected any more
    assert spark.read.parquet(f"{tmp_path}/own").count() == 1
    with pytest.raises(ValueError):
        sinks.replace_log(log, f"{tmp_path}/own", "../x")


def test_counts_of_the_job_that_writes_the_hits(spark, tmp_path):
    flagged = scanners.diagnose(indicator_frame(positioned(bars_from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet")))))
    for last_only in (True, False):
        found, seen = scanners.observed_hits(flagged, last_only)
        found.write.parquet(f"{tmp_path}/hits-{last_only}")
        rows = flagged.where("i = n - 1") if last_only else flagged
        want = scanners.diagnostic_counts(rows).first().asDict() | {"bars": rows.count()}
        assert seen.get == want
        for s in ("breakout", "trend", "power"):
            assert spark.read.parquet(f"{tmp_path}/hits-{last_only}").where(f"scanner = '{s}'").count() == want[f"{s}_final"]
    found, seen = scanners.observed_hits(flagged.where("false"))
    assert found.count() == 0 and seen.get["bars"] == 0
