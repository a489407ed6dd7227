"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is a pair of polynomials modulo two 31-bit primes.  It
composes: fingerprint(ab) = fingerprint(a) + base**len(a) * fingerprint(b).  Texts above
``chunk_chars`` are cut into chunks that are dealt to all tasks, hashed in parallel and
combined by that rule; shorter ones are one chunk and never leave their task.

Equal fingerprints only nominate.  Every document of a group is compared with the group's
first document chunk by chunk, so a comparison holds two chunks at a time.  The few that
differ (a collision) are grouped by their text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import BROADCAST_ROWS, SPACE_CLASS, keep_rows, partitions, small_side, text_or_empty, written
from barloom.llm.textarrays import buffer_of

PRIMES = (2147483647, 2147483629)
BASES = (1103515245 % PRIMES[0], 69069069)
CHUNK_CHARS = 1 << 18
#: Characters of chunks that leave a task at once.
HELD_CHARS = 1 << 24
#: Members of a group that one copy of the group's first text serves.
MEMBERS_PER_COPY = 256
_power_tables: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    t = _power_tables.get((base, prime))
    if t is None or len(t) < n:
        t = np.ones(max(n, 4096), np.uint64)
        have = 1
        while have < len(t):  # doubling: base**(have + k) = base**have * base**k
            more = min(have, len(t) - have)
            t[have : have + more] = t[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
            have += more
        _power_tables[base, prime] = t
    return t


def fingerprint(data: np.ndarray, base: int, prime: int) -> int:
    """sum of (byte + 1) * base**k modulo prime; blocks keep every sum below 2**64."""
    total, block = 0, 1 << 20
    for at in range(0, len(data), block):
        part = data[at : at + block].astype(np.uint64) + np.uint64(1)
        value = int(np.dot(part, _power_table(base, prime, len(part))[: len(part)])) % prime
        total = (total + value * pow(base, at, prime)) % prime
    return total


def combine(parts: list[tuple[int, int, int]], primes=PRIMES, bases=BASES) -> tuple[int, int, int]:
    """(length, h1, h2) of a text from those of its consecutive chunks."""
    length, h = 0, [0, 0]
    for n, *own in parts:
        h = [(h[k] + own[k] * pow(bases[k], length, primes[k])) % primes[k] for k in (0, 1)]
        length += n
    return length, h[0], h[1]


def _hash_chunks(primes, bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = buffer_of(b.column("chunk"))
            own = [[fingerprint(buf[s:e], base, prime) for s, e in zip(off[:-1], off[1:], strict=True)] for base, prime in zip(bases, primes, strict=True)]
            kept = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(off), pa.int64()), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64())], names=[*b.schema.names[:-1], "n_bytes", "h1", "h2"])

    return run


def normalised(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_replace(text_or_empty(), SPACE_CLASS + "+", " ").alias("norm"))


def _chunks(rows: DataFrame, chunk_chars: int, *keys: str) -> DataFrame:
    """A row per chunk, the empty text as one empty chunk.  A text is cut in one pass."""
    rows = rows.select(*keys, "norm")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm, at, no, held, size = b.column("norm"), [], [], [], 0

            def made():
                cols = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
                return pa.RecordBatch.from_arrays([*cols, pa.array(no, pa.int32()), pa.array(held, pa.string())], names=[*keys, "chunk_no", "chunk"])

            for k in range(b.num_rows):
                text = norm[k].as_py()
                for i in range(0, max(1, len(text)), chunk_chars):
                    at.append(k)
                    no.append(i // chunk_chars)
                    held.append(text[i : i + chunk_chars])
                    size += len(held[-1])
                    if size > HELD_CHARS:
                        yield made()
                        at, no, held, size = [], [], [], 0
            if at:
                yield made()

    return rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, primes=PRIMES, bases=BASES) -> DataFrame:
    """doc_id, text_sha256, n_bytes, h1, h2 of every row's normalised text."""
    rows = normalised(docs).withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
    small = rows.where(F.length("norm") <= chunk_chars).select("doc_id", "text_sha256", F.col("norm").alias("chunk"))
    small = small.mapInArrow(_hash_chunks(primes, bases), "doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long")
    # Repeated rows of one huge text count once here and are expanded again below.
    huge = rows.where(F.length("norm") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    parts = _chunks(huge, chunk_chars, "row", "doc_id", "text_sha256").repartition(partitions(docs.sparkSession), "row", "chunk_no")
    parts = parts.mapInArrow(_hash_chunks(primes, bases), "row long, doc_id long, text_sha256 string, chunk_no int, n_bytes long, h1 long, h2 long")
    lists = parts.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "n_bytes", "h1", "h2"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [combine([(p["n_bytes"], p["h1"], p["h2"]) for p in ps], primes, bases) for ps in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3))], names=["doc_id", "text_sha256", "n_bytes", "h1", "h2"])

    return small.unionByName(lists.mapInArrow(run, "doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long"))


def exact_duplicates(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, members_per_copy: int = MEMBERS_PER_COPY, primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their normalised forms are (white space runs as one space, null
    as the empty text).  The smallest doc_id of a group stays; rows without a doc_id come
    last, and of rows that repeat a doc_id and its text one stays.  An empty table gives
    no rows; other columns are ignored.  A group of any size is split over many tasks:
    its first text is copied once for every ``members_per_copy`` members.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs, chunk_chars, primes, bases))
    key = ["n_bytes", "h1", "h2"]
    # Rows that repeat a doc_id and its text are one entry with a count.
    entries = prints.groupBy("doc_id", *key, "text_sha256").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256"))
    groups = entries.groupBy(*key).agg(first.alias("first"), F.count("*").alias("entries"), F.sum("copies").alias("size"))
    multi = groups.where("entries > 1").select(*key, F.col("first.doc_id").alias("first_id"), F.col("first.text_sha256").alias("first_sha"), "size", F.ceil(F.col("entries") / members_per_copy).cast("int").alias("n_salts"))
    single = groups.where("entries = 1").select(F.col("first.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.col("first.text_sha256").alias("text_sha256"), "n_bytes", F.col("size").alias("copies"))
    multi = written(multi)

    named = [F.col(c).alias(f"g_{c}") for c in key]
    members = entries.join(multi.select(*named, "first_id", "first_sha", "n_salts"), [F.col(c) == F.col(f"g_{c}") for c in key]).select("doc_id", "text_sha256", *key, "copies", "first_id", "first_sha", F.pmod(F.xxhash64("doc_id", "text_sha256"), "n_salts").cast("int").alias("salt"), "n_salts")
    members = written(members)
    wanted = members.select(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha"), *key, "salt", "n_salts", (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_sha256") == F.col("first_sha"))).alias("is_first"))
    wanted = written(wanted)
    some = docs
    if wanted.count() <= BROADCAST_ROWS:  # few enough to leave other texts where they are, unread
        ids = F.broadcast(wanted.select("m_id").distinct())
        some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["m_id"]), "left_semi")
    texts = normalised(some).withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))
    wanted = small_side(wanted)
    text_of = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["m_id"]) & (texts["sha"] == wanted["m_sha"]))
    chunk_rows = written(_chunks(text_of, chunk_chars, "m_id", "m_sha", *key, "salt", "n_salts", "is_first"))
    theirs = chunk_rows.where(~F.col("is_first"))
    firsts = chunk_rows.where("is_first").dropDuplicates([*key, "chunk_no"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    firsts = firsts.select(*named, F.col("salt").alias("g_salt"), F.col("chunk_no").alias("g_chunk_no"), F.col("chunk").alias("g_chunk"))
    # Left: a chunk that the first text does not have is a difference.
    compared = theirs.join(firsts, [F.col(c) == F.col(f"g_{c}") for c in (*key, "salt", "chunk_no")], "left")
    verdict = compared.groupBy("m_id", "m_sha", *key).agg(F.min(F.coalesce(F.col("chunk") == F.col("g_chunk"), F.lit(False))).alias("same"))
    verdict = written(verdict)
    v = verdict.select("m_id", F.col("m_sha"), *named, "same")
    judged = members.join(v, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha")) & (F.col("h1") == F.col("g_h1")) & (F.col("h2") == F.col("g_h2")), "left")
    judged = written(judged.select("doc_id", "text_sha256", *key, "copies", "first_id", F.coalesce("same", F.lit(True)).alias("same")))
    sizes = judged.where("same").groupBy(*key, "first_id").agg(F.sum("copies").alias("group_size"))
    same = judged.where("same").join(sizes.select(*named, "group_size"), [F.col(c) == F.col(f"g_{c}") for c in key])
    same = same.select("doc_id", F.col("first_id").alias("keep_id"), "group_size", "text_sha256", "n_bytes", "copies")
    # Collisions: the text itself is the key.
    odd = judged.where("not same").select(F.col("doc_id").alias("o_id"), F.col("text_sha256").alias("o_sha"), "n_bytes", "copies").dropDuplicates(["o_id", "o_sha"])
    other = texts.dropDuplicates(["doc_id", "sha"]).join(odd, texts["doc_id"].eqNullSafe(odd["o_id"]) & (texts["sha"] == odd["o_sha"])) if _any(odd) else None
    out = single.unionByName(same)
    if other is not None:
        by_text = other.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).withColumnRenamed("norm", "t")
        out = out.unionByName(other.join(by_text, other["norm"] == by_text["t"]).select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), "n_bytes", "copies"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_bytes")


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def drop_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one."""
    marks = exact_duplicates(docs, **how).select("doc_id", F.col("text_sha256").alias("mark"), F.col("kept").alias("keep"))
    return keep_rows(docs, marks, F.sha2(F.encode(F.regexp_replace(text_or_empty(), SPACE_CLASS + "+", " "), "UTF-8"), 256))
