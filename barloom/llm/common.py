"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.  Only a session in one process
    (tests, a laptop) may name none; a temporary folder is set there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-"))
    return context.getCheckpointDir()


#: The open blocks of ``scratch``, for each thread its own: queries may run side by side.
_scratch = threading.local()


def _blocks() -> list[list[str]]:
    if not hasattr(_scratch, "blocks"):
        _scratch.blocks = []
    return _scratch.blocks


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once and kept as a table in the shared checkpoint folder.

    Unlike a checkpoint, which Spark takes for endlessly large, a table has a known size:
    joins with it need no runtime filters, broadcast what is small, and small files are
    read together.
    """
    return written_at(df, compression)[1]


def written_at(df: DataFrame, compression: str | None = None, by: str | None = None) -> tuple[str, DataFrame]:
    """The table's path and its rows, for tables that go before the result is read.  ``by``
    is a column whose values have a folder each, so that they can go one after another."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    for open_block in _blocks():
        open_block.append(path)
    df.write.parquet(path, partitionBy=by, compression=compression)
    read = df.sparkSession.read
    return path, (read.schema(df.schema) if by else read).parquet(path)  # without rows there is no folder to tell columns


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread made by ``written`` inside the block when it ends.

    A result has to be stored before that: its plan reads them.
    """
    _blocks().append([])
    try:
        yield
    finally:
        for path in _blocks().pop():
            delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table up to which it is broadcast; beyond that, joins shuffle.
BROADCAST_ROWS = 200_000


def small_side(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few columns, marked for broadcast if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= most else table


def keep_rows(docs: DataFrame, marks: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``docs`` that ``marks(doc_id, mark, keep)`` keeps, one for each doc_id
    and mark; ``marks`` has a row for every row.

    Only rows that go, or repeat, are looked up: if these are few, no text is shuffled.
    """
    rows = docs.withColumn("__mark", mark)
    per = marks.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__m")).agg(F.max("keep").alias("__keep"), F.count("*").alias("__copies"))
    listed = written(per.where("not __keep or __copies > 1"))
    same = rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__mark"] == F.col("__m"))
    out = rows.join(small_side(listed), same, "left_anti")
    again = listed.where("__keep")
    if again.take(1):
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "__mark"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


#: A key with more than this share of all rows is a hub.
HUB_SHARE = 1e-3


def join_hubs(rows: DataFrame, per: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """``rows`` joined with ``per``, which has one row per ``key`` and their ``count``.

    Rows of hubs are joined where they are: there are at most 1 / HUB_SHARE hubs, so these
    are broadcast whatever the input.  All other keys are shuffled, and none of them has
    more than that share.  Both sides are read twice and should be written tables.
    """
    total = per.agg(F.sum(count)).first()[0] or 0
    key = [key] if isinstance(key, str) else key
    hubs = F.broadcast(per.where(F.col(count) > total * HUB_SHARE))
    far = rows.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(per.where(F.col(count) <= total * HUB_SHARE), key)
    return rows.join(hubs, key).unionByName(far)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def count_parts(spark: SparkSession, total: int, part_bytes: int) -> int:
    """Parts of ``part_bytes``, so that a part is as large at any size of the input."""
    return max(partitions(spark), -(-total // part_bytes))


def by_part(shipped: DataFrame, n_parts: int) -> GroupedData:
    """Rows grouped by ``part``, a number below ``n_parts``: every part is a task of its
    own, where a hash of the number would give some tasks several parts by chance."""
    return shipped.repartitionById(n_parts, F.col("part")).groupBy("part")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows dealt to ranges of ``order``, with the number of their range as ``bucket``.

    Windows by bucket and key hold one range at most, however many rows a key has; what
    lies before a range is carried in from one row per key and bucket.
    """
    return written(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("bucket", F.spark_partition_id()))
