"""Writers: rankings, the best strategy, analyses, selection logs."""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ranking(ranking: DataFrame, path: str) -> None:
    """One header and all rows in rank order, as CSV files of a folder."""
    ranking.write.mode("overwrite").option("header", True).csv(path)


def export_ranking(ranking: DataFrame, path: str) -> None:
    """All rows as one CSV file with a byte-order mark, for spreadsheets.

    Rows arrive one partition at a time; there are as many as the grid was given.
    """
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(ranking.columns)
        writer.writerows(ranking.toLocalIterator())


def best_strategy(ranking: DataFrame) -> DataFrame:
    """The first ranked row as JSON; missing values are null."""
    return ranking.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_text(document: DataFrame, path: str) -> None:
    """The one value of a one-row DataFrame as a file."""
    Path(path).write_text(document.first()[0], encoding="utf-8")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def replace_log(log: DataFrame, path: str, run: str) -> None:
    """The log's rows of one run, in place of those that the run wrote before.

    A run is a folder ``run=...`` of the log: one job writes it and files appear when that
    job commits, so a run that dies leaves no rows, and one that runs again no second set.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError(f"not a run's key: {run!r}")
    log.write.mode("overwrite").parquet(f"{path}/run={run}")


def best_effort(write: Callable[[], None], what: str) -> bool:
    """Runs a writer whose failure must not stop the job; tells whether it worked."""
    try:
        write()
    except Exception:
        logging.getLogger(__name__).warning("%s was not written", what, exc_info=True)
        return False
    return True
