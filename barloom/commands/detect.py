"""The day's signals: of the best strategy and the surge strategy, else of the three scanners.

Messages are written as Parquet (ident, chunk, text); the selections go to a log, once per run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.commands import common
from barloom.operators import reports, scanners, trades
from barloom.sources import sinks
from barloom.sources.strategy import QUANT, StrategyConfig, load_strategy_or_none


def _strategy(frame: DataFrame, title: str, tag: str, cfg: StrategyConfig, names: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    found = reports.named(trades.live_signals(frame, cfg), names)
    log = found.select("date", "ticker", F.lit(f"{tag}:{cfg.entry_set}").alias("method"), reports.two_decimals("close").alias("close"))
    return reports.section(title, cfg, found), log


def main(argv: list[str] | None = None) -> None:
    parser = common.parser(__doc__, limit=0)
    parser.set_defaults(days=500)
    parser.add_argument("--strategy", default="reports/best_strategy.json")
    parser.add_argument("--output", default="reports/messages")
    parser.add_argument("--log", default="", help="Parquet folder of selections by run")
    parser.add_argument("--run", default="", help="key of the run in the log, by default the day of the latest bar; the same key replaces its rows")
    args = parser.parse_args(argv)
    spark = common.session("detect")
    frame, names = common.frame(spark, args).cache(), common.names(spark, args)
    best = load_strategy_or_none(args.strategy)
    if best is not None:
        parts = [_strategy(frame, "BEST", "BEST", best, names), _strategy(frame, "QUANT SURGE", "QUANT", QUANT, names)]
        text = parts[0][0].select(F.col("text").alias("a")).crossJoin(parts[1][0].select(F.col("text").alias("b"))).select(F.concat_ws("\n\n", "a", "b").alias("text"))  # one row each
        logs = [log for _, log in parts]
    else:
        flagged = scanners.diagnose(frame)
        text = reports.scan_report(flagged, names, args.tickers_csv or args.input)
        logs = [reports.selection_log(scanners.hits(flagged, s), s) for s in reports.SCANNERS]
    reports.message_chunks(text.select(F.lit("daily").alias("ident"), "text")).write.mode("overwrite").parquet(args.output)
    if args.log:
        run = args.run or str(frame.agg(F.max("bar_ts")).first()[0].date())
        sinks.best_effort(lambda: sinks.replace_log(reduce(DataFrame.unionByName, logs), args.log, run), "the selection log")
    print(f"Saved messages to {args.output}")


if __name__ == "__main__":
    main()
