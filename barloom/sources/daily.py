"""A data source of bars in one file per instrument and day, good and bad ones.

Files lie in ``<folder>/ticker=<name>/day=<yyyy-mm-dd>/``, as CSV or Parquet, with the
columns of bars or their foreign names.  Filters on ``ticker`` and ``day`` reach the source:
only folders that can match are listed and read.  A file that is empty, broken or lacks a
column does not fail the scan: it gives one row with its ``reason`` and no bar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from barloom.functions.windows import finite
from barloom.sources.bars import ALIASES

_PRICES = ("open", "high", "low", "close", "volume")
_SCHEMA = "ticker string, day date, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, path string, reason string"
_ARROW = pa.schema([("ticker", pa.string()), ("day", pa.date32()), ("bar_ts", pa.timestamp("us")), *((p, pa.float64()) for p in _PRICES), ("path", pa.string()), ("reason", pa.string())])
#: Bytes and files of one task; a task has a file at least, and reads one at a time.
TASK_BYTES, TASK_FILES = 64 << 20, 256


@dataclass
class Files(InputPartition):
    """Files of one task: (path, ticker, day)."""

    files: list[tuple[str, str | None, dt.date | None]]


def _value(folder: str, name: str) -> str | None:
    """What ``name=value`` says; Spark writes null as a word of its own."""
    found = unquote(folder.rsplit("/", 1)[-1].removeprefix(f"{name}="))
    return None if found == "__HIVE_DEFAULT_PARTITION__" else found


def _day(folder: str) -> dt.date | None:
    found = _value(folder, "day")
    try:
        return None if found is None else dt.date.fromisoformat(found)
    except ValueError as bad:
        raise ValueError(f"not a day: {folder}") from bad


def _allows(kept: list[Filter], name: str, value: object) -> bool:
    """Whether a row with this value can pass all kept filters on the column."""
    tests = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, GreaterThan: lambda f: value > f.value, GreaterThanOrEqual: lambda f: value >= f.value, LessThan: lambda f: value < f.value, LessThanOrEqual: lambda f: value <= f.value}
    own = [f for f in kept if f.attribute == (name,)]
    return all(value is not None and tests[type(f)](f) for f in own)


def _bars(data: bytes, path: str) -> pa.Table:
    """The bars in a file; an error that says what is wrong with it."""
    if not data.strip():
        raise ValueError("empty")
    try:
        # A header that no line feed ends is not read as one.
        raw = pa.parquet.read_table(pa.BufferReader(data)) if path.endswith(".parquet") else pa.csv.read_csv(pa.BufferReader(data + b"\n"))
    except (pa.ArrowException, OSError) as bad:
        raise ValueError("broken") from bad
    named = {ALIASES.get(c, c): k for k, c in enumerate(raw.column_names)}
    if missing := [c for c in ("bar_ts", *_PRICES) if c not in named]:
        raise ValueError(f"lacks {', '.join(missing)}")
    if not raw.num_rows:
        raise ValueError("empty")
    try:
        stamp = raw.column(named["bar_ts"])
        stamp = stamp.cast(pa.timestamp("us"), safe=False) if not pa.types.is_timestamp(stamp.type) or stamp.type.tz is None else pc.local_timestamp(stamp).cast(pa.timestamp("us"), safe=False)
        return pa.table({"bar_ts": stamp, **{p: raw.column(named[p]).cast(pa.float64()) for p in _PRICES}})
    except (pa.ArrowException, ValueError) as bad:
        raise ValueError("a value has the wrong type") from bad


class DailyBarReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self._folder, self._kept = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of ticker and day with a value are decided by folders alone."""
        for f in filters:
            known = type(f) in (EqualTo, In) if f.attribute == ("ticker",) else type(f) in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) if f.attribute == ("day",) else False
            if known:
                self._kept.append(f)
            else:
                yield f

    def _listed(self) -> Iterator[tuple[str, str | None, dt.date | None, int]]:
        fs, root = pa.fs.FileSystem.from_uri(self._folder)
        tickers = [i.path for i in fs.get_file_info(pa.fs.FileSelector(root)) if i.type == pa.fs.FileType.Directory]
        for folder in sorted(t for t in tickers if "ticker=" in t.rsplit("/", 1)[-1] and _allows(self._kept, "ticker", _value(t, "ticker"))):
            days = [i.path for i in fs.get_file_info(pa.fs.FileSelector(folder)) if i.type == pa.fs.FileType.Directory]
            for day in sorted(d for d in days if _allows(self._kept, "day", _day(d))):
                for info in sorted(fs.get_file_info(pa.fs.FileSelector(day)), key=lambda i: i.path):
                    if info.type == pa.fs.FileType.File and info.base_name[0] not in "._":
                        yield info.path, _value(folder, "ticker"), _day(day), info.size

    def partitions(self) -> list[Files]:
        """Neighbouring files together, up to so many bytes and files a task."""
        out, size = [], 0
        for path, ticker, day, own in self._listed():
            if not out or size + own > TASK_BYTES or len(out[-1].files) >= TASK_FILES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, ticker, day))
            size += own
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self._folder)
        for path, ticker, day in partition.files:
            with fs.open_input_stream(path, compression=None) as stream:
                data = stream.read()  # a file that cannot be fetched is an error, and the task runs again
            try:
                bars, reason = _bars(data, path), None
            except ValueError as bad:
                bars, reason = pa.table({"bar_ts": pa.nulls(1, pa.timestamp("us")), **{p: pa.nulls(1, pa.float64()) for p in _PRICES}}), str(bad)
            n = bars.num_rows
            whole = [pa.repeat(pa.scalar(ticker, pa.string()), n), pa.repeat(pa.scalar(day, pa.date32()), n), *bars.columns, pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(pa.scalar(reason, pa.string()), n)]
            yield from pa.Table.from_arrays(whole, schema=_ARROW).to_batches()


class DailyBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_bars"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DailyBarReader:
        return DailyBarReader(self.options["path"])


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, day, bar_ts, prices, volume, path, reason of all files under ``folder``.

    Bars have no reason; a bad file is one row with a reason and neither time nor prices.
    NaN and infinite numbers become null, as in other bars.  A ticker or day of a folder may
    be null.  A folder without files gives no rows; one that does not exist is an error.
    This switches on filters for Python data sources in the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DailyBars)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{quote(folder)}"
    rows = spark.read.format("daily_bars").load(uri)
    return rows.withColumns({p: finite(F.col(p)) for p in _PRICES})
