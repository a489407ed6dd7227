"""Importance resampling towards a target distribution, with an exact draw.

1.  One pass counts the hashed features of the corpus and of the target texts in arrays of
    ``buckets`` numbers, one array a task; the log ratio of the two smoothed distributions
    is a gain per bucket.
2.  A second pass scores every text: the array of gains is indexed by the text's buckets.
    No text is shuffled.  A row's key is (score plus Gumbel noise of its doc_id, doc_id).
3.  The k-th key is found by radix selection: the key's digits of 16 bits are counted from
    the first on, each time among the rows that agree with the digits found so far, so the
    driver sees at most 65,536 counts a round.
4.  Only rows up to that key are sorted by ranges and ranked, by counts per range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ranged, written
from barloom.llm.textarrays import LOWER, buffer_of, distinct_words, pieces, slices, words

BUCKETS = 10000
NGRAM = 1
LEAST_WORDS = 20
SHARE_PCT = 10
SEED = "2024"

#: Bytes of words: digits, letters after lower-casing, and all of characters beyond ASCII.
IS_SEPARATOR = np.ones(256, bool)
IS_SEPARATOR[ord("0") : ord("9") + 1] = False
IS_SEPARATOR[ord("a") : ord("z") + 1] = False
IS_SEPARATOR[128:] = False

_DIGIT = 16


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS, ngram: int = NGRAM) -> Iterator[tuple[np.ndarray, int]]:
    """The buckets of each text's features, repeats counted, and its number of words.

    A feature is a run of 1 to ``ngram`` words joined by a space; its bucket is the crc32
    of its UTF-8 bytes modulo ``buckets``.
    """
    buf, offsets = buffer_of(texts)
    for i, j in slices(offsets):
        part, off = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        start, end, doc = words(part, off, IS_SEPARATOR)
        known, which = distinct_words(part, start, end)
        hashed = np.array([zlib.crc32(w) % buckets for w in known], np.int64)
        single = hashed[which] if len(which) else np.zeros(0, np.int64)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            lo, hi = cut[k], cut[k + 1]
            out = [single[lo:hi]]
            for n in range(2, ngram + 1):
                own = which[lo:hi]
                out.append(np.array([zlib.crc32(b" ".join(known[w] for w in own[p : p + n])) % buckets for p in range(len(own) - n + 1)], np.int64))
            yield np.concatenate(out), int(hi - lo)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """Features per bucket over all texts: an array of a fixed size, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in (piece for batch in batches for piece in pieces(batch)):
            for own, _ in feature_buckets(b.column("text"), buckets, ngram):
                total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed source share)."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the sha256 of seed and doc_id; a missing doc_id
    counts as the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (piece for batch in batches for piece in pieces(batch)):
            found = [(len(at), n, int(own[at].sum()) // len(at) if len(at) else 0) for at, n in feature_buckets(b.column("text"), len(own), ngram)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in found], pa.int64()) for k in range(3))], names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _digits() -> list[Column]:
    """The key's digits, most significant first: score descending, doc_id ascending with
    null last, then the row's number, which tells repeated rows apart."""
    sign = F.lit(-(2**63)).cast("long")
    rising = lambda c: F.coalesce(F.col(c), F.lit(0)).bitwiseXOR(sign)
    falling = F.bitwise_not(F.col("score").bitwiseXOR(sign))
    cut = lambda c: [F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << _DIGIT) - 1)) for s in range(64 - _DIGIT, -1, -_DIGIT)]
    return [*cut(falling), F.col("doc_id").isNull().cast("long"), *cut(rising("doc_id")), *cut(rising("row"))]


def select_kth(rows: DataFrame, k: int) -> list[int]:
    """The digits of the k-th smallest key (k from 1), or so many of the first ones as are
    enough: at most k keys start with these or smaller ones, and exactly k do."""
    digits, prefix, rest = _digits(), [], k
    ends = rows.agg(*(f(d) for d in digits for f in (F.min, F.max))).first()
    for at, digit in enumerate(digits):
        if ends[2 * at] == ends[2 * at + 1]:  # the same for all rows
            prefix.append(ends[2 * at])
            continue
        same = rows
        for d, value in zip(digits, prefix, strict=False):
            same = same.where(d == value)
        counts = sorted((r["d"], r["n"]) for r in same.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if rest <= n:
                break
            rest -= n
        prefix.append(value)
        if rest == n:
            break
    return prefix


def _up_to(prefix: list[int]) -> Column:
    """Whether a key's first digits are at most ``prefix``."""
    out = F.lit(True)
    for d, value in reversed(list(zip(_digits(), prefix, strict=False))):
        out = (d < value) | ((d == value) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, least_words: int = LEAST_WORDS, share_pct: int = SHARE_PCT, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    ``target`` is a table with a column ``text``.  Of the rows with ``least_words`` words or
    more, floor(share_pct % of them) with the highest scores are drawn and ranked from 1 on;
    all others have a null rank.  Ties go to the smaller doc_id, a missing one last; rows
    that repeat a doc_id are drawn one by one.  A null, empty or blank text has no features
    and weight 0.  Texts may be of any length; other columns are ignored; an empty table
    gives no rows, and without target texts all gains are those of an empty target.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, ngram), bucket_counts(target, buckets, ngram))
    rows = written(scored(docs, gains, ngram, seed).withColumn("row", F.monotonically_increasing_id()))
    fit = rows.where(F.col("n_words") >= least_words)
    k = fit.count() * share_pct // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & _up_to(select_kth(fit, k))
    order = [F.col("falling"), F.col("no_id"), F.col("doc_id"), F.col("row")]
    placed = ranged(rows.where(drawn).withColumns({"falling": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "falling", "no_id", "doc_id", "row")
    # One count a range: as many as there are partitions.
    before, at = {}, 0
    for bucket, n in sorted((r["bucket"], r["n"]) for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()):
        before[bucket], at = at, at + n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(list(before.items()), "bucket int, before long"))
    rank = (F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) + F.col("before")).cast("long")
    return placed.join(offsets, "bucket").select(*shown, rank.alias("rank")).unionByName(rows.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))
