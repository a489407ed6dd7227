"""Which features come before large rises, and how the strategy built on them does."""

from __future__ import annotations

from pathlib import Path

from barloom.commands import common
from barloom.operators import surge
from barloom.sources import sinks
from barloom.sources.strategy import QUANT


def main(argv: list[str] | None = None) -> None:
    parser = common.parser(__doc__, limit=20)
    parser.add_argument("--output", default="reports/quant_surge_analysis.json")
    args = parser.parse_args(argv)
    spark = common.session("surge")
    frame = common.frame(spark, args).cache()
    check = surge.strategy_validation(frame, QUANT, common.names(spark, args))
    path = Path(args.output)
    path.parent.mkdir(parents=True, exist_ok=True)
    sinks.write_text(surge.analysis_document(surge.feature_frame(frame), check), str(path))
    print(f"{path}: features and the strategy's check are written")


if __name__ == "__main__":
    main()
