"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Within its source the documents stand in key
order; key ranges ("buckets", as many as the source needs) are summed first, so the
prefix sum of a document is the sum of the buckets before its own plus a running sum
inside its bucket.  No task ever holds more than one bucket of a source, however large
the source is.  Whole epochs repeat all documents of a source; the rest of its budget
takes documents in key order and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CLASS, WORD_CLASS, text_or_empty, word_count, written

#: Documents that one key range of a source holds on average.
BUCKET_ROWS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Targets of the sources of ``sizes(source, size)``.

    ``share`` of all sizes is dealt by weight; what a source gets beyond ``max_epochs``
    times its size goes to the others by weight, until none is above.  The level at
    which that ends is found without a loop: sources sorted by capacity per weight are
    full up to the first one that the remaining amount no longer fills.  One row per
    source; ties and nulls count as sources of their own, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    per = per.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # Full sources come first in this order; the level is that of the first source not filled by it.
    per = per.withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    per = per.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def random_key(ident: Column, text: Column, seed: int) -> Column:
    """A hash-random key as 32 hexadecimal digits; rows without an identifier have one by
    their text, so that they are dealt to all buckets as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.md5(F.encode(text, "UTF-8")))))


def _taken(rows: DataFrame, weights, max_epochs: float, share: float, bucket_rows: int) -> DataFrame:
    """``rows(source, size, key, ...)`` with source_size, target and ``taken``."""
    targets = written(source_targets(rows, weights, max_epochs, share))
    budget = F.round("target").cast("long")
    targets = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).alias("n_buckets"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    keyed = rows.join(targets, rows["source"].eqNullSafe(targets["s"])).withColumn("bucket", F.floor(unit * F.col("n_buckets")).cast("long"))
    sums = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    placed = keyed.join(sums, keyed["s"].eqNullSafe(sums["s2"]) & (keyed["bucket"] == sums["b2"]))
    ties = [c for c in ("text_hash", "row") if c in rows.columns]
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return placed.withColumn("part", part).select(*rows.columns, "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes of the document, repeats
    counted: a whole number of epochs, and of the document at the cut a part.  The sum of
    a source is its target rounded to a word.  Null text has size 0; a null source is a
    source; repeated rows each count; an empty table gives no rows.  Other columns are
    ignored, texts may be of any length.
    """
    rows = docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), random_key(F.col("doc_id"), text_or_empty(), seed).alias("key"))
    return _taken(written(rows), weights, max_epochs, share, bucket_rows).drop("key")


def apply_mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, the one at a cut shortened.

    Rows keep their columns; ``n_chars`` follows the text.  Documents without words are
    not part of any budget and stay once.  Rows are numbered in a written copy, so that
    each of several equal ones gets what the mix takes of it and no more.
    """
    columns = docs.columns
    numbered = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.monotonically_increasing_id().alias("row")))
    text = F.coalesce("doc.text", F.lit(""))
    rows = numbered.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), word_count(text).alias("size"), random_key(F.col("doc.doc_id"), text, seed).alias("key"), F.xxhash64(text).alias("text_hash"))
    taken = _taken(written(rows), weights, max_epochs, share, bucket_rows).where("taken > 0 or size = 0").select("row", "size", "taken")
    both = numbered.join(taken, "row")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    both = both.withColumn("mix_words", F.explode(copies))
    pieces = F.regexp_extract_all("doc.text", F.lit(f"{SPACE_CLASS}*{WORD_CLASS}+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("mix_words")), "")
    is_cut = F.col("mix_words") > 0
    changed = {"text": F.when(is_cut, cut).otherwise(F.col("doc.text"))}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(is_cut, F.length(cut).cast("long")).otherwise(F.col("doc.n_chars"))
    return both.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns))
