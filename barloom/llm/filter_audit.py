"""How document filters interact: what each of them removes in every order.

1.  One pass over the texts gives each row a mask of the filters that fail on it alone, its
    length in code points and hashes of successive blocks of its text.
2.  Copies are found by refining a partition of the rows: by length, then by one block after
    another.  After every split, classes of one row are dropped; a class is a row in a
    grouped table, and rows of large classes are joined with it where they are.
3.  The texts of the rows that survive all blocks are grouped by the texts themselves, one
    copy a task and text.  Of equal texts all but those of the smallest doc_id are marked.
4.  Masks are counted by part; all orders of the filters are read off these counts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import join_hubs, small_side, text_or_empty, written
from barloom.llm.textarrays import buffer_of, distinct_words, pieces, slices, words

FILTERS = "ABCDE"
#: Bytes of a text's first block, and by how much each next block ends later.
FIRST_BLOCK, GROWTH = 64, 16
_HASH = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_START = np.ones(256, bool)  # bytes that start a code point
_START[0x80:0xC0] = False


def block_hashes(data: bytes) -> bytes:
    """A hash of each block of a text, one after another."""
    out, at, end = [], 0, FIRST_BLOCK
    while at < len(data):
        out.append(hashlib.blake2b(data[at:end], digest_size=_HASH).digest())
        at, end = end, end * GROWTH
    return b"".join(out)


def text_marks(texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Per text: the mask of filters A to D, code points, block hashes."""
    buf, offsets = buffer_of(texts)
    for i, j in slices(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, doc = words(part, off)
        known, which = distinct_words(part, start, end)
        n_words = np.bincount(doc, minlength=j - i)
        pairs = np.unique(doc * max(1, len(known)) + which)
        n_distinct = np.bincount(pairs // max(1, len(known)), minlength=j - i)
        total = lambda flag: np.diff(np.r_[0, np.cumsum(flag[part], dtype=np.int64)][off])
        points = total(_START)
        mask = (n_words < 100) | (100 * n_distinct < 80 * n_words) * 2 | (100 * total(_UPPER) > 10 * points) * 4 | (total(_SYMBOLS) > 0) * 8
        raw = part.tobytes()
        for k in range(j - i):
            yield int(mask[k]), int(points[k]), block_hashes(raw[off[k] : off[k + 1]])


_MARKS = "doc_id long, part string, mark long, mask int, points long, blocks binary"


def _marked(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch)):
            mask, points, blocks = zip(*text_marks(b.column("text")), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("mark"), pa.array(mask, pa.int32()), pa.array(points, pa.int64()), pa.array(blocks, pa.binary())], names=["doc_id", "part", "mark", "mask", "points", "blocks"])

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.xxhash64(text_or_empty()).alias("mark"), "text")
    return rows.mapInArrow(run, _MARKS)


def refine(rows: DataFrame) -> DataFrame:
    """The rows whose length and blocks some other row shares."""
    most = rows.agg(F.max(F.length("blocks"))).first()[0] or 0
    left = rows
    for n in range(0, most + _HASH, _HASH):
        left = left.withColumn("prefix", F.substring("blocks", 1, n))
        classes = written(left.groupBy("points", "prefix").agg(F.count("*").alias("members")).where("members > 1"))
        left = written(join_hubs(left, classes, ["points", "prefix"], "members").drop("members", "prefix"))
    return left


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose text some row with a smaller doc_id has.  ``rows`` is a written table
    of marks; a missing doc_id is neither smaller nor larger than any."""
    left = refine(rows)
    wanted = written(left.select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "points", "blocks").distinct())
    wanted = small_side(wanted)
    texts = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("mark"))
    this_row = texts["doc_id"].eqNullSafe(wanted["w_id"]) & (texts["mark"] == wanted["w_mark"])
    # Equal texts meet in a task first: one copy of a text leaves it, however many there are.
    first = texts.join(wanted, this_row).groupBy("points", "blocks", "text").agg(F.min("doc_id").alias("first_id"), F.min("mark").alias("mark"), F.count("*").alias("members"))
    first = written(first.groupBy("points", "blocks", "mark").agg(F.min("first_id").alias("first_id"), F.count("*").alias("texts"), F.sum("members").alias("members")))
    same = join_hubs(left, first.where("texts = 1").drop("texts"), ["points", "blocks", "mark"], "members").drop("members")
    out = same.where(F.col("doc_id") > F.col("first_id")).drop("first_id")
    if (odd := first.where("texts > 1")).take(1):  # different texts with all hashes alike
        odd_rows = left.join(odd.select("points", "blocks", "mark"), ["points", "blocks", "mark"], "left_semi")
        own = odd_rows.select("doc_id", "mark").distinct().withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"})
        each = texts.join(own, texts["doc_id"].eqNullSafe(own["w_id"]) & (texts["mark"] == own["w_mark"])).select("doc_id", "mark", "text")
        least = each.groupBy("text").agg(F.min("doc_id").alias("first_id"))
        late = each.join(least, "text").where(F.col("doc_id") > F.col("first_id")).groupBy("doc_id", "mark").agg(F.count("*").alias("late"))
        # Rows of one doc_id whose different texts share all hashes are told apart by count.
        many = odd_rows.join(late, ["doc_id", "mark"])
        place = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("part", "mask"))
        out = out.unionByName(many.withColumn("place", place).where("place <= late").drop("place", "late"))
    return out


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, the bits of the filters before it)."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append((name, step, 1 << k, before))
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: 120 orders of 5 steps for every part of ``docs``.

    ``docs`` has doc_id, text and lang; ``labels`` has doc_id, quality and toxic, of which
    any 1 counts, however often a doc_id is labelled.  A null or empty text fails A (it has
    no words) and none of B to D; a null lang is the part with the empty name, as is an
    empty one.  A row without a doc_id is neither a copy nor the first of others, and has
    no labels; rows that repeat a doc_id and its text are no copies of each other.  Texts
    may be of any length; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(_marked(docs))
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good = 1 or toxic = 1")
    known = small_side(written(known))
    late = written(copies(docs, rows).select("doc_id", "part", "mask"))
    keys = ["part", "mask", "good", "toxic"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = lambda df, sign: df.join(known, "doc_id", "left").groupBy("part", "mask", zero("good"), zero("toxic")).agg((F.count("*") * sign).alias("n"))
    # A copy moves from its mask to the same one with E.
    moved = counted(late, 1)
    bit = 1 << FILTERS.index("E")
    cells = counted(rows, 1).unionByName(moved.withColumn("n", -F.col("n"))).unionByName(moved.withColumn("mask", F.col("mask").bitwiseOR(F.lit(bit))))
    cells = cells.groupBy(*keys).agg(F.sum("n").alias("n"))
    by_mask = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # At most 32 masks a part.
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(_orders())], "k int, filter_order string, step int, bit int, before int"))  # 600 rows
    each = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(_orders()) - 1)))).join(steps, "k")

    def total(test, value=lambda x: x["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, x: s + F.when(test(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    own, before = F.col("bit"), F.col("before")
    here = lambda m: has(m, own) & ~has(m, before)
    orders = len(_orders()) // len(FILTERS)
    return each.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m, own.bitwiseOR(before))).alias("kept"), total(here).alias("removed"), total(lambda m: has(m, own) & has(m, before)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"), total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # A filter is the first of k failing ones in a k-th of all orders.
        total(lambda m: has(m, own), lambda x: x["n"] * orders / F.bit_count(x["mask"])).alias("shapley"),
    )
