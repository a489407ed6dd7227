"""Repeated substrings by blocks of windows, found through a cover of sample positions.

A byte goes when a string of ``length`` bytes that covers it also starts earlier.

1.  A cover picks sample positions.  It is set by content (the least hash of ``GRAM`` bytes
    in a window of ``length`` bytes), so two equal windows have their sample at the same
    distance from the start, wherever they stand.
2.  Samples get names, hashes of the sample and of its context, the context being all
    windows that hang on it.  Windows whose samples have one name are tied, and the first
    of them is kept, without a look at the bytes.
3.  Only windows whose sample occurs in several contexts go on.  They are dealt to buckets
    by content, and one bucket is sorted at a time, by leading bytes and then by a name of
    the whole window.

This is the difference-cover construction with two changes, both for the sake of the bytes
it ships.  An arithmetic cover gives a common distance for any two positions, but ships a
share of 1/sqrt(period) of all positions, this one about 1 in 35.  And names, unlike ranks,
need no order among different strings: a removal only asks which strings are equal, so no
string of 100 bytes is ever shipped to be sorted.  Names have 124 bits from polynomials
modulo two primes (96 in step 3, beside 32 leading bits); texts are not read again to
compare.

Every task first sorts what it has itself and ships only the first window of each tie, so
a passage in a third of all documents is one row per batch.  A sample that is in many
contexts within one batch (a common line in all kinds of surroundings) is not shipped by
each document either: its windows go straight to step 3, where they are dealt by content.
Text moves once, to its spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_part, count_parts, written
from barloom.llm.textarrays import Key, buffer_of, draw_key, gram_hashes, mix, pieces, prefix_sums, slices, span_hashes

LENGTH = 100
GRAM = 32

#: Contexts of a sample within a batch from which on it is known to be common.
COMMON = 16
#: Bytes of text per part: a part's records are about as large.
PART_BYTES = 16 << 20

_SPAN = np.dtype([("start", "<u4"), ("stop", "<u4")])
#: A row is known by its doc_id and a hash of its text, in the order of ties.
_ROW = np.dtype([("null", "u1"), ("id", "<i8"), ("hash", "<i8")])
_SHIPPED = "part int, rows binary, recs binary, asked binary"
_FOUND = "part int, covered binary, asked binary"
_HEAD = ("u1", "<i8", "<i8", "<u4")  # null, doc_id, hash, number of records
_SAMPLE = ("<u8", "<u8", "<u4", "u1")  # sample, context, first window, further windows
_SUFFIX = ("<u4", "<u8", "<u4", "u1")  # leading bytes, rank, start, nothing


def _packed(columns, kinds: tuple[str, ...]) -> bytes:
    """Columns one after another, numbers over 8 bits as differences: shuffles compress it."""
    n = len(columns[0])
    return b"".join((n.to_bytes(8, "little"), *(np.diff(np.asarray(c).astype(k), prepend=np.zeros(1, k)).astype(k).tobytes() for c, k in zip(columns, kinds, strict=True))))


def _unpacked(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for own, k in zip(parts, kinds, strict=True):
            own.append(np.cumsum(np.frombuffer(blob, k, n, at), dtype=k))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in parts]


def cover(part: np.ndarray, off: np.ndarray, length: int, gram: int, key: Key):
    """First and last window of each sample, the sample's hash, and that of its context."""
    n = len(part)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(part, key)
    grams = gram_hashes(sums, gram, key)
    least = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    wide, size = length - gram + 1, 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: size - wide], least[wide - size :])
    inside = np.ones(n - length + 1, bool)
    for end in off[1:-1].tolist():  # windows do not cross texts
        inside[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(inside)
    sample = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.r_[True, (sample[1:] != sample[:-1]) | (at[1:] != at[:-1] + 1)]
    lo, hi = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    sample = sample[new]
    shape = (sample - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
    return lo, hi, span_hashes(sums, sample, sample + gram, key), mix(span_hashes(sums, lo, hi + length, key) ^ shape)


def _first(row, high, low, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by tie class and then by place, the marks of each class's first, and of
    those that start elsewhere than it (rows that repeat a doc_id and its text are one)."""
    order = np.lexsort((start, row["hash"], row["id"], row["null"], low, high))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    h, w = high[order], low[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
    of = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return order, first, (row[order] != row[of]) | (start[order] != start[of])


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values starts and ends."""
    cut = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
    return list(zip(cut[:-1], cut[1:], strict=True)) if len(row) else []


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[tuple, bytes]:
    """Per row its spans, joined where they overlap or touch."""
    order = np.lexsort((start, row["hash"], row["id"], row["null"]))
    row, start, stop = row[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    out = {}
    for lo, hi in _runs(row):
        s, e = start[lo:hi], np.maximum.accumulate(stop[lo:hi])
        new = np.r_[True, s[1:] > e[:-1]]
        spans = np.zeros(int(new.sum()), _SPAN)
        spans["start"], spans["stop"] = s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
        out[row[lo].item()] = spans.tobytes()
    return out


def _batch(rows: list[tuple[int, bytes, bytes, bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["part", "rows", "recs", "asked"])


def _identity(b: pa.RecordBatch) -> np.ndarray:
    ids = b.column("doc_id")
    out = np.zeros(b.num_rows, _ROW)
    out["null"], out["id"], out["hash"] = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(), b.column("hash").to_numpy()
    return out


def _by_home(spans: dict[tuple, bytes], n_parts: int) -> dict[int, bytes]:
    """Spans by the part that gathers those of a row: row, number of spans, spans."""
    out: dict[int, list[bytes]] = {}
    for row, own in spans.items():
        out.setdefault((row[1] ^ row[2]) % n_parts, []).append(np.array(row, _ROW).tobytes() + (len(own) // 8).to_bytes(8, "little") + own)
    return {p: b"".join(x) for p, x in out.items()}


def _from_home(blobs: list[bytes | None]) -> dict[tuple, bytes]:
    """The joined spans of every row."""
    rows, spans, size = [np.zeros(0, _ROW)], [np.zeros(0, _SPAN)], _ROW.itemsize
    for blob in blobs:
        at = 0
        while blob and at < len(blob):
            n = int.from_bytes(blob[at + size : at + size + 8], "little")
            rows.append(np.repeat(np.frombuffer(blob, _ROW, 1, at), n))
            spans.append(np.frombuffer(blob, _SPAN, n, at + size + 8))
            at += size + 8 + 8 * n
    every = np.concatenate(spans)
    return _merged(np.concatenate(rows), every["start"], every["stop"])


def _gathered(table: pa.Table) -> pa.Table:
    covered, asked = (_from_home(table.column(c).to_pylist()) for c in ("covered", "asked"))
    rows = sorted({*covered, *asked})
    ids, hashes = pa.array([None if null else i for null, i, _ in rows], pa.int64()), pa.array([h for _, _, h in rows], pa.int64())
    return pa.table({"c_id": ids, "c_hash": hashes, "covered": pa.array([covered.get(r) for r in rows], pa.binary()), "asked": pa.array([asked.get(r) for r in rows], pa.binary())})


def _ship_samples(n_parts: int, length: int, gram: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch)):
            rows = _identity(b)
            buf, offsets = buffer_of(b.column("text"))
            parts = []
            for i, j in slices(offsets):
                off = offsets[i : j + 1] - offsets[i]
                lo, hi, sample, context = cover(buf[offsets[i] : offsets[j]], off, length, gram, key)
                doc = np.searchsorted(off, lo, "right") - 1
                parts.append((doc + i, sample, context, lo - off[doc], hi - lo))
            if not parts:
                continue
            owner, sample, context, start, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Samples are least hashes, so they are spread anew over the parts.
            yield from _shipped(n_parts, rows, owner, sample, context, start, more, mix(sample), length, _SAMPLE, True)

    return run


def _shipped(n_parts, rows, owner, high, low, start, more, by, length, kinds, common) -> Iterator[pa.RecordBatch]:
    """What a batch ships: the first of each tie to the part of its class, and the spans of
    all others, which are known to go, to the parts of their rows.  Of a ``common`` sample
    two records tell its part that it has several contexts; its windows are asked for."""
    order, first, elsewhere = _first(rows[owner], high, low, start)
    keep, again = order[first], order[~first & elsewhere]
    covered = _by_home(_merged(rows[owner[again]], start[again], start[again] + more[again] + length), n_parts)
    asked: dict[int, bytes] = {}
    if common and len(keep):
        new = np.r_[True, high[keep][1:] != high[keep][:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(keep)])
        place = np.arange(len(keep)) - np.repeat(np.flatnonzero(new), size)
        many = np.repeat(size, size) >= COMMON
        asked = _by_home(_merged(rows[owner[keep[many]]], start[keep[many]], start[keep[many]] + more[keep[many]] + 1), n_parts)
        keep = keep[~many | (place < 2)]
    part = (by[keep] >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    turn = np.lexsort((owner[keep], part))
    keep, part = keep[turn], part[turn].astype(np.int64)
    out = [(p, covered.get(p, b""), b"", asked.get(p)) for p in sorted({*covered, *asked})]
    for lo, hi in _runs(part):
        own = keep[lo:hi]
        who, count = np.unique(owner[own], return_counts=True)
        head = rows[who]
        out.append((int(part[lo]), _packed((head["null"], head["id"], head["hash"], count), _HEAD), _packed((high[own], low[own], start[own], more[own]), kinds), None))
    if out:
        yield _batch(out)


def _sorted_bucket(length: int, kinds: tuple[str, ...], n_parts: int, ask: bool):
    """Sorts a bucket.  All but the first of a tie are covered; with ``ask``, firsts whose
    sample has other contexts as well are named for the next round."""

    def run(table: pa.Table) -> pa.Table:
        heads, recs = table.column("rows").to_pylist(), table.column("recs").to_pylist()
        null, ident, hashes, count = _unpacked([h for h, r in zip(heads, recs, strict=True) if r], _HEAD)
        high, low, start, more = _unpacked([r for r in recs if r], kinds)
        row = np.zeros(len(count), _ROW)
        row["null"], row["id"], row["hash"] = null, ident, hashes
        row, start = np.repeat(row, count), start.astype(np.int64)
        order, first, elsewhere = _first(row, high, low, start)
        again, firsts = order[~first & elsewhere], order[first]
        covered = _by_home(_merged(row[again], start[again], start[again] + more[again] + length), n_parts)
        asked: dict[int, bytes] = {}
        if ask and len(firsts):
            same = np.r_[False, high[firsts][1:] == high[firsts][:-1], False]
            several = firsts[same[1:] | same[:-1]]
            asked = _by_home(_merged(row[several], start[several], start[several] + more[several] + 1), n_parts)
        known = [(h, a, p) for h, r, a, p in zip(heads, recs, table.column("asked").to_pylist(), table.column("part").to_pylist(), strict=True) if not r]
        homes = sorted({*covered, *asked})
        return pa.table({
            "part": pa.array([p for _, _, p in known] + homes, pa.int32()), "covered": pa.array([h for h, _, _ in known] + [covered.get(p) for p in homes], pa.binary()),
            "asked": pa.array([a for _, a, _ in known] + [asked.get(p) for p in homes], pa.binary()),
        })

    return run


def _ship_suffixes(n_parts: int, length: int, key: Key):
    """The asked windows of each text, as leading bytes and the rank of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch)):
            rows = _identity(b)
            buf, offsets = buffer_of(b.column("text"))
            parts = []
            for k, blob in enumerate(b.column("asked").to_pylist()):
                part, spans = buf[offsets[k] : offsets[k + 1]], np.frombuffer(blob, _SPAN)
                many = spans["stop"].astype(np.int64) - spans["start"]
                at = np.repeat(spans["start"] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                lead = np.zeros(len(at), np.uint64)
                for i in range(min(4, length)):
                    lead = lead << np.uint64(8) | part[at + i].astype(np.uint64)
                parts.append((np.full(len(at), k), lead, span_hashes(prefix_sums(part, key), at, at + length, key), at))
            if not parts:
                continue
            owner, lead, rank, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from _shipped(n_parts, rows, owner, lead, rank, start, np.zeros(len(start), np.int64), mix(rank ^ lead), length, _SUFFIX, False)

    return run


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _remove(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                buf, offsets = buffer_of(b.column("text"))
                spans, kept = [], []
                for k, (blobs, copy) in enumerate(zip(b.column("covered").to_pylist(), b.column("copy").to_pylist(), strict=True)):
                    text = buf[offsets[k] : offsets[k + 1]]
                    if copy > 1 and len(text) >= length:  # all of it stands in the first copy
                        blobs = [np.array([(0, len(text))], _SPAN).tobytes()]
                    if not blobs:
                        spans.append([])
                        kept.append(text.tobytes())
                        continue
                    every = np.concatenate([np.frombuffer(x, _SPAN) for x in blobs])
                    own = np.frombuffer(_merged(np.zeros(len(every), _ROW), every["start"], every["stop"])[0, 0, 0], _SPAN)
                    edges = np.zeros(len(text) + 1, np.int8)
                    edges[own["start"]] += 1
                    edges[own["stop"]] -= 1
                    spans.append([{"start": s, "stop": e} for s, e in own.tolist()])
                    kept.append(text[np.cumsum(edges[:-1], dtype=np.int8) == 0].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans, kept.

    ``spans`` are the maximal byte ranges that went, ``kept`` the bytes that are left, which
    may end inside a character.  "Earlier" means a smaller doc_id, or an earlier start in
    one document; different texts of one doc_id count in the order of a hash, rows that
    repeat a doc_id and its text one after the other, and rows without a doc_id come last.
    Null and empty texts, and texts shorter than ``length`` bytes, lose nothing.  Texts may
    be of any length below 4 GB.  Other columns are ignored; an empty table gives no rows.
    """
    spark, gram, key = docs.sparkSession, min(gram, length), draw_key()
    # Rows are known by what they hold, not by a number that another scan may give anew.
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    sizes = written(texts.groupBy(F.col("doc_id").alias("d_id"), F.col("hash").alias("d_hash")).agg(F.count("*").alias("copies"), F.sum(F.octet_length("text")).alias("bytes")))
    n_parts = count_parts(spark, sizes.agg(F.sum("bytes")).first()[0] or 0, PART_BYTES)
    row_spans = "c_id long, c_hash long, covered binary, asked binary"
    samples = texts.mapInArrow(_ship_samples(n_parts, length, gram, key), _SHIPPED)
    ranked = by_part(samples, n_parts).applyInArrow(_sorted_bucket(length, _SAMPLE, n_parts, True), _FOUND)
    found = written(by_part(ranked, n_parts).applyInArrow(_gathered, row_spans))
    this_row = texts["doc_id"].eqNullSafe(F.col("c_id")) & (texts["hash"] == F.col("c_hash"))
    asked = found.where("asked is not null").select("c_id", "c_hash", "asked")
    suffixes = texts.join(asked, this_row).select("doc_id", "text", "hash", "asked").mapInArrow(_ship_suffixes(n_parts, length, key), _SHIPPED)
    more = by_part(suffixes, n_parts).applyInArrow(_sorted_bucket(length, _SUFFIX, n_parts, False), _FOUND)
    more = by_part(more, n_parts).applyInArrow(_gathered, row_spans)
    both = found.unionByName(more).where("covered is not null")
    covered = both.groupBy("c_id", "c_hash").agg(F.collect_list("covered").alias("covered"))
    placed = texts.join(covered, this_row, "left").select("doc_id", "hash", "text", "covered")
    again = sizes.where("copies > 1")
    columns = ["doc_id", "text", "covered", "copy"]
    if not again.take(1):
        return placed.withColumn("copy", F.lit(1)).select(*columns).mapInArrow(_remove(length), _RESULT)
    repeats = placed["doc_id"].eqNullSafe(again["d_id"]) & (placed["hash"] == again["d_hash"])
    once = placed.join(again, repeats, "left_anti").withColumn("copy", F.lit(1))
    several = placed.join(again, repeats).dropDuplicates(["doc_id", "hash"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return once.select(*columns).unionByName(several.select(*columns)).mapInArrow(_remove(length), _RESULT)
