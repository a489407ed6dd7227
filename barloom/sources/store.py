"""A bar table that is already split and sorted by instrument, and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Files of a store: as many tasks read it at once; a session with more instruments wants more.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a session in one process may
    name none; a temporary folder is set there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def write_store(bars: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes bars bucketed by instrument, each bucket sorted by instrument and time, and
    returns the table.  Windows by instrument over it need no shuffle."""
    placed = bars.repartition(buckets, "ticker").sortWithinPartitions("ticker", "bar_ts")
    placed.write.mode("overwrite").option("path", path).bucketBy(buckets, "ticker").sortBy("ticker", "bar_ts").saveAsTable(table)
    return bars.sparkSession.table(table)
