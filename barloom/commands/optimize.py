"""Ranks a grid of strategies and keeps the best: strategy_ranking.csv, best_strategy.json."""

from __future__ import annotations

from pathlib import Path

from barloom.commands import common
from barloom.operators import trades
from barloom.sources import sinks
from barloom.sources.strategy import GRID, config_table, grid, parse_list

#: Names of flags, and what they vary.
_AXES = (("entry-sets", "entry_set", str), ("stop-pcts", "stop_pct", float), ("max-holds", "max_hold", int), ("vol-mults", "vol_mult", float), ("entries", "entry", str), ("macd-zero-filters", "macd_zero_filter", bool))


def main(argv: list[str] | None = None) -> None:
    parser = common.parser(__doc__, limit=80)
    for flag, axis, _ in _AXES:
        parser.add_argument(f"--{flag}", default=",".join(str(v).lower() for v in GRID[axis]))
    parser.add_argument("--fee-bp", type=float, default=5.0)
    parser.add_argument("--slip-bp", type=float, default=5.0)
    parser.add_argument("--min-trades", type=int, default=8)
    parser.add_argument("--top-n", type=int, default=10)
    parser.add_argument("--output-dir", default="reports")
    args = parser.parse_args(argv)
    axes = {axis: parse_list(getattr(args, flag.replace("-", "_")), kind) for flag, axis, kind in _AXES}
    configs = list(grid(**axes, market=[args.market], days=[args.days], fee_bp=[args.fee_bp], slip_bp=[args.slip_bp]))
    spark = common.session("optimize")
    evaluated = trades.evaluate_portfolio(trades.simulate(common.frame(spark, args), configs))
    ranking = trades.rank(trades.summarise(evaluated, config_table(spark, configs)), min_trades=args.min_trades).select(*trades.SUMMARY).cache()
    if not ranking.take(1):
        raise SystemExit(f"none of {len(configs)} configurations has {args.min_trades} trades or more")
    out = Path(args.output_dir)  # fixed values: the names of its two files
    out.mkdir(parents=True, exist_ok=True)
    sinks.export_ranking(ranking, str(out / "strategy_ranking.csv"))
    sinks.write_text(sinks.best_strategy(ranking), str(out / "best_strategy.json"))
    ranking.show(args.top_n, truncate=False)
    print(f"Saved to {out}")


if __name__ == "__main__":
    main()
