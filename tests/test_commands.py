"""The three programs over small files, and the file that links them."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.commands import detect, optimize
from barloom.commands import surge as surge_command
from barloom.functions.rules import PRESETS, rule
from barloom.functions.windows import all_finite
from barloom.operators import reports, scanners, trades
from barloom.operators.indicators import indicator_frame
from barloom.sources import tickers
from barloom.sources.bars import normalise, positioned
from barloom.sources.strategy import StrategyConfig, config_table, grid, load_strategy
from tests.test_engine import walk


@pytest.fixture(scope="module")
def raw():
    return pd.concat([walk(s, 260, f"{s:06d}", 0.002, 0.04) for s in range(1, 6)], ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, raw, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('bars')}/bars"
    spark.createDataFrame(raw).write.parquet(path)
    return path


def test_optimise_then_detect_by_file(spark, bars, tmp_path):
    out = tmp_path / "reports"
    optimize.main(["--input", bars, "--entry-sets", "macd_gc,trend_breakout40_macd", "--stop-pcts", "0.05,0.1", "--max-holds", "5,10", "--vol-mults", "1.0", "--macd-zero-filters", "false", "--fee-bp", "1", "--slip-bp", "2", "--min-trades", "3", "--market", "TEST", "--days", "365", "--output-dir", str(out)])
    ranking = pd.read_csv(out / "strategy_ranking.csv", encoding="utf-8-sig")
    assert list(ranking.columns) == list(trades.SUMMARY) and len(ranking) > 4 and ranking["score"].is_monotonic_decreasing
    assert (ranking["trade_count"] == ranking["trailing_stop_count"] + ranking["dead_cross_count"] + ranking["max_hold_count"]).all()
    best, cfg = json.loads((out / "best_strategy.json").read_text()), load_strategy(str(out / "best_strategy.json"))
    assert best["score"] == ranking["score"][0] == cfg.score
    assert (cfg.market, cfg.days, cfg.fee_bp, cfg.slip_bp) == ("TEST", 365, 1.0, 2.0) and cfg.entry_set == ranking["entry_set"][0]
    csv = tmp_path / "t.csv"
    csv.write_text("ticker,name\n1,First\n2,Second\n1,First\n")
    detect.main(["--input", bars, "--strategy", str(out / "best_strategy.json"), "--output", f"{tmp_path}/m", "--log", f"{tmp_path}/log", "--tickers-csv", str(csv)])
    text = spark.read.parquet(f"{tmp_path}/m").orderBy("chunk").first()["text"]
    assert text.startswith(f"[BEST] {cfg.entry_set}\nentry={cfg.entry}") and "[QUANT SURGE] quant_surge_common" in text
    detect.main(["--input", bars, "--strategy", f"{tmp_path}/none.json", "--output", f"{tmp_path}/m2"])
    text = spark.read.parquet(f"{tmp_path}/m2").orderBy("chunk").first()["text"]
    assert "[SUMMARY]\ninstruments=5" in text and "[DIAG - Power]" in text
    surge_command.main(["--input", bars, "--output", str(tmp_path / "a.json")])
    doc = json.loads((tmp_path / "a.json").read_text())
    assert list(doc["targets"]) == ["surge_5_8", "surge_10_12", "surge_10_15"] and len(doc["targets"]["surge_5_8"]["feature_lift"]) == 11
    check = doc["quant_surge_validation"]
    assert check["strategy"]["entry_set"] == "quant_surge_common" and set(check["backtest"]) == set(trades.SUMMARY) and isinstance(check["live_candidates"], list)
    with pytest.raises(SystemExit):
        optimize.main(["--input", bars, "--as-of-date", "19990101", "--output-dir", str(out)])


def test_short_holds_are_read_from_the_longest_path(spark, raw):
    frame = indicator_frame(positioned(normalise(spark.createDataFrame(raw)))).cache()
    configs = list(grid(entry_set=["macd_gc", "trend_high95_macd"], stop_pct=[0.03, 0.1], max_hold=[2, 7, 20], vol_mult=[1.0], macd_zero_filter=[False]))
    both = {tuple(r) for r in trades.simulate(frame, configs).drop("buy", "ret").collect()}
    alone = {tuple(r) for c in configs for r in trades.simulate(frame, [c]).drop("buy", "ret").collect()}
    assert both == alone and len(both) > 200


def test_rules_do_not_fire_on_nan_or_infinity(spark, raw):
    for column in ("volume", "open", "high"):
        for value in (float("nan"), float("inf"), float("-inf")):
            hurt = raw.copy()
            at = np.arange(len(hurt)) % 9 == 4
            hurt.loc[at, column] = value
            missing = raw.copy()
            missing.loc[at, column] = None
            fires = [indicator_frame(positioned(normalise(spark.createDataFrame(x)))).select("ticker", "i", *[rule(p, 1.2).alias(p) for p in PRESETS]).toPandas() for x in (hurt, missing)]
            a, b = (f.sort_values(["ticker", "i"]).reset_index(drop=True) for f in fires)
            assert a.equals(b)
            if column == "volume":
                for t, own in a.groupby("ticker"):
                    where = own["i"].isin(np.flatnonzero(at[(int(t) - 1) * 260 : int(t) * 260]))
                    assert not own.loc[where, ["gc_today_vol", "strict_union", "trend_high95_macd"]].to_numpy().any()
    got = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0)], "a double, b double").select(all_finite("a", "b").alias("ok"))
    assert [r["ok"] for r in got.collect()] == [True, False, False, False]


def test_a_missing_close_counts_as_the_one_before(spark, raw):
    hurt = raw[raw["ticker"] == "000001"].copy()
    hurt.loc[hurt.index[[0, 10, 11, 90]], "close"] = float("nan")
    got = indicator_frame(positioned(normalise(spark.createDataFrame(hurt)))).orderBy("i").toPandas()
    want = hurt["close"].ffill().ewm(span=12, adjust=False).mean()
    np.testing.assert_allclose(got["ema12"].astype(float).to_numpy()[1:], want.to_numpy()[1:], rtol=1e-9)


def test_summary_fields_and_ranks(spark):
    rows = [("A", 0, "trailing_stop", 0.05), ("A", 5, "dead_cross", -0.02), ("B", 3, "max_hold", 0.03)]
    configs = [StrategyConfig(), StrategyConfig(stop_pct=0.2)]
    found = spark.createDataFrame([(c.name, *r) for c in configs for r in rows], "config string, ticker string, i long, reason string, ret double")
    got = trades.rank(trades.summarise(trades.evaluate_portfolio(found), config_table(spark, configs)), min_trades=3).collect()
    assert [r["stop_pct"] for r in got] == [0.1, 0.2]  # equal results keep the grid's order
    assert (got[0]["trade_count"], got[0]["active_tickers"], got[0]["profit_factor"], got[0]["win_rate_pct"]) == (3, 2, 4.0, 66.67)


def test_batches_membership_and_last_bars(spark, raw):
    items = ["a" * 1500, "b" * 1400, "c" * 200, "d" * 4000, "e"]
    assert reports.batch_items(items) == ["a" * 1500 + "\n\n" + "b" * 1400 + "\n\n", "c" * 200 + "\n\n", "d" * 4000 + "\n\n", "e\n\n"] and reports.batch_items([]) == []
    rows = spark.createDataFrame([("2024-01-05", "000001", 2), ("2024-01-05", "000002", 1)], "date string, ticker string, ord int").withColumn("date", F.to_date("date"))
    listed = tickers.strict_tickers(spark.createDataFrame([("7", 1), ("x", 2)], "ticker string, line long"), "line")
    assert [r["ticker"] for r in tickers.resolve(rows, "2024-01-10", listed, 1).collect()] == ["000002"]
    late = tickers.resolve(rows, "2024-03-15", listed).collect()
    assert [(str(r["date"]), r["ticker"]) for r in late] == [("2024-03-01", "000007")]
    frame = indicator_frame(positioned(normalise(spark.createDataFrame(raw)))).cache()
    flagged = scanners.diagnose(frame)
    for s in reports.SCANNERS:
        every = scanners.hits(flagged, s, last_only=False)
        assert scanners.hits(flagged, s).count() == every.where("i = 259").count()
    text = reports.scan_report(flagged.where("i < 0"), run_at="now").first()["text"]
    assert "Nothing passed today." in text and "data of: N/A" in text and "instruments=0" in text
