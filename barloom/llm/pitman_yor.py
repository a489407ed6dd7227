"""Language-model scores by a hierarchical Pitman-Yor model.

A token's context is the whole word before it (a restaurant of level 3).  Its parent is that
word's last two bytes (level 2), whose parent is the last byte (level 1), whose parent is
the root (level 0) over a uniform base.  So there is a restaurant for every word of the
corpus; those of levels 0 to 2 are at most 65,793.

1.  Contexts are counted.  The commonest (at most ``TOP_CONTEXTS``) are known to all tasks by
    number; all others are rare and go by their key.
2.  Training tokens are counted by word and context, first in each task, then by word.
3.  Counts are dealt to parts by word, those of rare contexts by context first, where the
    words that follow are counted.  A part is one row of packed arrays with all contexts of
    its words, so that a dish's seating on all levels is in one place.
4.  A Gibbs sweep draws the number of tables of every dish in every restaurant given all
    else: for up to ``EXACT`` customers from the exact conditional (generalised Stirling
    numbers times the weights of new tables), beyond that the other customers are seated
    in steps in which a new table's probability hardly changes.  Restaurants' totals and
    the parents' probabilities are those of the sweep before; totals are two numbers a
    restaurant, summed by Spark and sent to all tasks.  Tables of rare contexts are summed
    by context and told to the parts of their words, for contexts in which several dishes
    have a choice; in all others the tables beside such a dish never change.
5.  Predictive probabilities are averaged over the samples.  Tokens of the commonest pairs
    (at most ``TOP_PAIRS``) are scored where the text is; all others go to the part of their
    word, those of rare contexts by way of their context's totals.  A part adds up its tokens
    of a text, and the sums come back packed, to 2**-36.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import delete_table, written, written_at
from barloom.llm.textarrays import LOWER, buffer_of, mix, pieces, slices, words

FOLDS = 10
BURN_IN, SAMPLES = 1, 2
#: Concentration of every restaurant.
STRENGTH = 1.0
#: Customers of a dish that are seated by an exact draw.
EXACT = 64
#: Share of the customers so far that are seated in one step after those.
STEP = 16
#: Commonest word-context pairs that are sent to all tasks: about 40 MB.
TOP_PAIRS = 1 << 20
#: Commonest contexts that are sent to all tasks: about 16 MB.
TOP_CONTEXTS = 1 << 19
#: Contexts whose tables are summed as one array.
_CHUNK = 1 << 13
#: Tokens that a part counts, at most as many word-context pairs: about 30 bytes each while it
#: is drawn.
PART_PAIRS = 1 << 20
_SLICE, _PIECE = 1 << 20, 1 << 23
#: Numbers of a draw's array.
_DRAWN = 1 << 17
CONTEXTS = (1, 256, 65536)
_TAIL, _HASH = np.uint64(0xFFFF), np.uint64(0x7FFFFFFFFFFF0000)
SMOOTH = 0.1
#: Tokens that a part scores at once.
_SCORED = 1 << 17
#: Texts whose sums come back from parts together, as a power of two.
_TEXTS = 12
#: Bits behind the point of sums on their way back.
_FRACTION = 36


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def word_key(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of words: up to 8 bytes one to one within a length, up to 16 by two numbers of 8
    bytes, longer ones by ``word_key``."""
    size = end - start
    eight = np.r_[buf, np.zeros(24 - len(buf) % 8, np.uint8)].view("<u8")
    kept = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

    def load(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        k, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (eight[k] >> bits | eight[k + 1] << np.uint64(1) << np.uint64(63) - bits) & kept[np.minimum(n, 8)]

    key = mix(load(start, size) ^ mix(size.astype(np.uint64)))
    two = np.flatnonzero(size > 8)
    key[two] = mix(key[two] + mix(load(start[two] + 8, size[two] - 8)))
    many = np.flatnonzero(size > 16)
    if len(many):
        raw = buf.tobytes()
        key[many] = [word_key(raw[a:b]) for a, b in zip(start[many].tolist(), end[many].tolist(), strict=True)]
    return key


#: The token that ends a text: no word holds a space.
END = np.uint64(word_key(b" "))


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: word keys, contexts and text numbers of all tokens in order.  A
    context is 47 bits of the key of the word before and, in its lowest bytes, that word's
    end; 0 where no word is before."""
    buf, offsets = buffer_of(texts)
    for i, j in slices(offsets, _SLICE):
        part, off = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        start, end, doc = words(part, off)
        keys = word_keys(part, start, end)
        at = np.arange(len(start)) + doc
        n = len(start) + j - i
        key, ctx = np.full(n, END), np.zeros(n, np.uint64)
        if len(start):
            key[at] = keys
            last = part[end - 1].astype(np.uint16) | np.where(end - start > 1, part[np.maximum(end - 2, 0)], 0).astype(np.uint16) << np.uint16(8)
            ctx[at + 1] = keys & _HASH | last  # a text's first token has no word before it
        owner = np.repeat(np.arange(i, j), np.bincount(doc, minlength=j - i) + 1)
        yield key, ctx, owner


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (piece for batch in batches for piece in pieces(batch, most=_PIECE)):
        got = [c for _, c, _ in tokens(b.column("text"))]
        if got:
            ctx, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(n.astype(np.int64))], names=["ctx", "n"])


def turned(ctx: np.ndarray) -> np.ndarray:
    """The end of the word in front, so numbers of contexts with one end are neighbours."""
    return (ctx & _TAIL) << np.uint64(47) | ctx >> np.uint64(16)


class Index:
    """Where values are in a list of hashes: by their first bits, then step by step."""

    def __init__(self, listed: np.ndarray) -> None:
        self.order = np.argsort(listed, kind="stable")
        self.listed = np.r_[listed[self.order], np.uint64(0)]
        bits = max(1, len(listed).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.listed[:-1] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the list as it was given, and whether the value is there."""
        at = self.first[(asked >> self.shift).view(np.int64)]
        here = self.listed[at]
        there, left = here == asked, np.flatnonzero(here < asked)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.order)]
            here = self.listed[at[left]]
            there[left] = here == asked[left]
            left = left[here < asked[left]]
        there &= at < len(self.order)
        return (self.order[np.minimum(at, len(self.order) - 1)] if len(self.order) else np.zeros(len(asked), np.int64)), there


def spread(ctx: np.ndarray) -> np.ndarray:
    """A context with its hash in front."""
    return ctx << np.uint64(1)


def index_of(keys: np.ndarray) -> Index:
    """An index of the common contexts, by ``spread``."""
    return Index(spread(decoded(keys, -1 - np.arange(len(keys)))))


def coded(common: Index, ctx: np.ndarray) -> np.ndarray:
    """Contexts as codes: -1 - number of a common one, the context itself of a rare one."""
    at, there = common.find(spread(ctx))
    return np.where(there, -1 - at, ctx.view(np.int64))


def decoded(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
    own = code.astype(np.int64).view(np.uint64)
    if not len(keys):
        return own
    key = keys[np.maximum(0, -1 - code)]
    return np.where(code < 0, key << np.uint64(16) & _HASH | key >> np.uint64(47), own)


def _merged(w: np.ndarray, code: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs and their sums, in no order."""
    own = _pair_hash(w, code)
    order = np.argsort(own)
    first = _runs(own[order])
    return w[order][first], code[order][first], *(np.add.reduceat(x[order], first) if len(w) else x for x in sums)


def _pair_hash(w: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(mix(w) + code.view(np.uint64))


def part_of(w: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts are ranges of word keys."""
    return ((w >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes; runs of the first one's values take room once."""
    first = _runs(columns[0])
    runs = np.diff(np.r_[first, len(columns[0])])
    raw = b"".join(_planes(np.ascontiguousarray(x).astype("<i8", copy=False)) for x in (columns[0][first], runs, *columns[1:]))
    return np.array([len(columns[0]), len(first)]).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked_columns(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    out = [[np.zeros(0, np.int64)] for _ in range(columns)]
    for x in blobs:
        n, runs = np.frombuffer(x[:16], np.int64).tolist()
        sizes = [runs, runs, *[n] * (columns - 1)]
        raw, at = pa.decompress(x[16:], 8 * sum(sizes), "zstd", asbytes=True), np.cumsum([0, *sizes]) * 8
        own = [_from_planes(raw[a:b], "<i8") for a, b in zip(at[:-1], at[1:], strict=True)]
        for k, values in enumerate([np.repeat(own[0], own[1]), *own[2:]]):
            out[k].append(values)
    return [np.concatenate(x) for x in out]


def _dealt(n_parts: int, lead: np.ndarray, *others: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Parts, and what goes to each as one row of arrays by ``lead``."""
    order = np.argsort(lead)
    lead, others = lead[order], [x[order] for x in others]
    part = part_of(lead, n_parts)
    cuts = np.r_[_runs(part), len(lead)]
    return [int(part[a]) for a in cuts[:-1]], [_packed(lead[a:b].view(np.int64), *(x[a:b] for x in others)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_BLOBS = pa.schema([("part", pa.int64()), ("blob", pa.binary()), ("rare", pa.binary())])
_BLOBS_SQL = "part long, blob binary, rare binary"


def _rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Rows with some of a schema's columns, the others null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _count(shared, n_parts: int, rare_parts: int) -> Callable:
    """Counts of pairs: those of common contexts by word, of rare ones by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = index_of(shared.value)
        for b in (piece for batch in batches for piece in pieces(batch, most=_PIECE)):
            got = list(tokens(b.column("text")))
            if not got:
                continue
            w, ctx = (np.concatenate([x[k] for x in got]) for k in (0, 1))
            del got
            w, code, n = _merged(w, coded(common, ctx), np.ones(len(w), np.int64))
            del ctx
            rare = code >= 0
            for name, (part, blobs) in (("blob", _dealt(n_parts, w[~rare], code[~rare], n[~rare])), ("rare", _dealt(rare_parts, spread(code[rare].view(np.uint64)), w[rare].view(np.int64), n[rare]))):
                yield _rows_of(_BLOBS, part=part, **{name: blobs})

    return run


def _with_followers(n_parts: int) -> Callable:
    """Deals pairs of rare contexts to their words, with the number of words that follow the
    context, and whether several of them have more than one customer."""

    def run(table: pa.Table) -> pa.Table:
        ctx, w, n = _unpacked_columns(table.column("rare").to_pylist(), 3)
        w, ctx, n = _merged(w.view(np.uint64), ctx, n)
        _, which, d = np.unique(ctx, return_inverse=True, return_counts=True)
        shared = np.bincount(which, n > 1, len(d)) > 1
        part, blobs = _dealt(n_parts, w, (ctx.view(np.uint64) >> np.uint64(1)).view(np.int64), n, d[which], shared[which])
        return pa.Table.from_batches([_rows_of(_BLOBS, part=part, rare=blobs)])

    return run


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


_STATE = "part long, w binary, pairs binary, tail binary, code binary, n binary, d binary, shared binary, t3 binary, t2 binary, t1 binary, t0 binary, kept binary, sizes binary, ones array<long>, twos array<long>"
_KINDS = {"w": "<u8", "pairs": "<u4", "tail": "<u2", "code": "<i8", "n": "<i8", "d": "<i4", "shared": "u1", "t3": "<i4", "t2": "<i4", "t1": "<i4", "t0": "<i4", "kept": "<i4"}
#: Those that tell of shared contexts.
_TOLD = ("code", "shared", "t3")
#: Those that scores need.
_KEPT = ("w", "pairs", "tail", "code", "n", "kept")
LEVELS = 4


@dataclass
class Part:
    """The dishes of a part.  Pairs are ordered by word, last byte, byte before it and code,
    so the dishes of levels 2 and 1 are runs of pairs and words are runs of those.  ``d`` is
    how many words follow a rare context, where a draw asks for it; ``shared`` is 1 if a
    draw asks for it at other words too."""

    w: np.ndarray
    pairs: np.ndarray
    tail: np.ndarray
    code: np.ndarray
    n: np.ndarray
    d: np.ndarray
    shared: np.ndarray
    t3: np.ndarray
    t2: np.ndarray
    t1: np.ndarray
    t0: np.ndarray
    kept: np.ndarray

    def __post_init__(self) -> None:
        self.word = np.repeat(np.arange(len(self.w)), self.pairs)
        self.first2 = _runs(self.word.astype(np.int64) << 16 | self.tail)
        self.of2 = np.repeat(np.arange(len(self.first2)), np.diff(np.r_[self.first2, len(self.tail)]))
        self.word2, self.ctx2 = self.word[self.first2], self.tail[self.first2]
        last = self.ctx2 & np.uint16(0xFF)
        self.first1 = _runs(self.word2.astype(np.int64) << 8 | last)
        self.of1 = np.repeat(np.arange(len(self.first1)), np.diff(np.r_[self.first1, len(self.ctx2)]))
        self.word1, self.ctx1 = self.word2[self.first1], last[self.first1]
        self.first0 = _runs(self.word1)

    def customers(self, t3: np.ndarray, t2: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of levels 2, 1 and 0: the tables of the levels above."""
        return tuple(np.add.reduceat(t.astype(np.int64), first) for t, first in ((t3, self.first2), (t2, self.first1), (t1, self.first0)))

    def sizes(self) -> tuple[int, ...]:
        return len(self.code), len(self.ctx2), len(self.ctx1), len(self.w)

    def samples(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Tables of levels 3 to 0 of every sample."""
        sizes = self.sizes()
        for own in self.kept.reshape(-1, sum(sizes)):
            yield tuple(np.split(own, np.cumsum(sizes)[:-1]))


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes, ...: high bytes that hardly change take no room."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _read(row: dict) -> Part:
    sizes = np.frombuffer(row["sizes"], "<i8")
    return Part(**{k: _from_planes(pa.decompress(row[k], int(n), "zstd", asbytes=True) if k in row else b"", kind) for (k, kind), n in zip(_KINDS.items(), sizes, strict=True)})


def _fields(p: Part) -> dict:
    """Compressed here, not only in the file: Spark holds many rows of a table at once."""
    raw = {k: _planes(np.ascontiguousarray(getattr(p, k), kind)) for k, kind in _KINDS.items()}
    return {k: pa.compress(x, "zstd", asbytes=True) for k, x in raw.items()} | {"sizes": np.array([len(x) for x in raw.values()], "<i8").tobytes()}


def _pack(keys) -> Callable:
    """One row of a part's counts, every dish at one table."""

    def run(table: pa.Table) -> pa.Table:
        w, code, n = _unpacked_columns(table.column("blob").drop_null().to_pylist(), 3)
        w, code, n = _merged(w.view(np.uint64), code, n)
        rare = _unpacked_columns(table.column("rare").drop_null().to_pylist(), 5)
        d, shared = (np.r_[np.zeros(len(w), np.int64), x] for x in rare[3:])
        w, code, n = np.r_[w, rare[0].view(np.uint64)], np.r_[code, rare[1]], np.r_[n, rare[2]]
        tail = (decoded(keys.value, code) & _TAIL).astype(np.uint16)
        known, which = np.unique(w, return_inverse=True)
        order = np.argsort(-code)
        order = order[np.argsort((which << 16 | (tail & np.uint16(0xFF)).astype(np.int64) << 8 | tail >> np.uint16(8))[order], kind="stable")]
        code, tail, n, d, shared = code[order], tail[order], n[order], d[order], shared[order]
        none = np.zeros(0, np.int32)
        p = Part(known, np.bincount(which), tail, code, n, np.where(n > 1, d, 0), np.where(n > 1, shared, 0), np.ones(len(w), np.int32), none, none, none, none)
        p.t2, p.t1, p.t0 = (np.ones(k, np.int32) for k in p.sizes()[1:])
        counts = (*reversed(p.customers(p.t3, p.t2, p.t1)), n)
        row = {"part": table.column("part")[0].as_py(), **_fields(p), "ones": [int((c == 1).sum()) for c in counts], "twos": [int((c == 2).sum()) for c in counts]}
        return pa.Table.from_pylist([row], schema=_state_schema())

    return run


def _state_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in _KINDS), ("sizes", pa.binary()), ("ones", pa.list_(pa.int64())), ("twos", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Totals:
    """Customers and tables of every restaurant by level, and the base's probability.  Those
    of level 3 are the common contexts ``keys``, turned and in order."""

    keys: np.ndarray
    customers: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    discounts: tuple[float, ...]
    base: float
    strength: float = STRENGTH

    def back(self, level: int) -> np.ndarray:
        """The share that each restaurant leaves to its parent."""
        return (self.strength + self.discounts[level] * self.tables[level]) / (self.strength + self.customers[level])

    def own(self, level: int, c: np.ndarray, t: np.ndarray, ctx) -> np.ndarray:
        """The share of dishes with c customers at t tables in restaurants ``ctx``."""
        return (c - self.discounts[level] * t) / (self.strength + self.customers[level][ctx])

    def below(self, p: Part, t3, t2, t1, t0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each word at the root, and of each dish of levels 1 and 2."""
        c2, c1, c0 = p.customers(t3, t2, t1)
        p0 = self.own(0, c0, t0, 0) + self.back(0)[0] * self.base
        p1 = self.own(1, c1, t1, p.ctx1) + self.back(1)[p.ctx1] * p0[p.word1]
        return p0, p1, self.own(2, c2, t2, p.ctx2) + self.back(2)[p.ctx2] * p1[p.of1]

    def of_contexts(self, code: np.ndarray, c: np.ndarray | None = None, t: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of contexts by code; those of rare ones as given, else none."""
        none = np.zeros(len(code))
        c, t = (none if c is None else c), (none if t is None else t)
        if not len(self.keys):
            return c, t
        at = np.maximum(0, -1 - code)
        return np.where(code < 0, self.customers[3][at], c), np.where(code < 0, self.tables[3][at], t)


_stirling: dict[float, np.ndarray] = {}


def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log of the weight of all seatings of c customers at t tables, for c, t up to n."""
    if d not in _stirling:
        s = np.full((n + 1, n + 2), -np.inf)
        s[1, 1] = 0.0
        t = np.arange(n + 2)
        for c in range(1, n):
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = np.where((t >= 1) & (t <= c), np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + s[c]
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay[1:])
        _stirling[d] = s
    return _stirling[d]


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the tables of all ``others`` in their
    restaurants and the parents' probabilities."""
    t = np.ones(len(c), np.int64)
    s = log_stirling(d)
    few = np.minimum(c, EXACT)
    u = rng.random(len(c))
    width, low = 2, 1
    while low < EXACT:
        own = np.flatnonzero((few > low) & (few <= width))
        j = np.arange(1, width + 1)
        for at in range(0, len(own), max(1, _DRAWN // width)):
            k = own[at : at + max(1, _DRAWN // width)]
            logit = np.cumsum(np.log(strength + d * (others[k][:, None] + (j - 1))), axis=1)
            logit += s[:, 1 : width + 1][few[k]] + j * np.log(parent[k])[:, None]
            logit -= logit.max(axis=1, keepdims=True)
            mass = np.cumsum(np.exp(logit), axis=1)
            t[k] = 1 + (mass < (u[k] * mass[:, -1])[:, None]).sum(axis=1)
        low, width = width, width * 2
    at = np.flatnonzero(c > EXACT)
    seated = few[at].astype(np.int64)
    while len(at):
        step = np.minimum(np.maximum(1, seated // STEP), c[at] - seated)
        new = (strength + d * (others[at] + t[at])) * parent[at]
        t[at] += rng.binomial(step, np.clip(new / (seated - d * t[at] + new), 0.0, 1.0))
        seated = seated + step
        more = seated < c[at]
        at, seated = at[more], seated[more]
    return t


def sweep(p: Part, totals: Totals, rng: np.random.Generator, keep: bool, told: tuple[np.ndarray, np.ndarray] | None = None) -> Part:
    """New tables of all dishes of a part, leaves first.  ``told`` has shared contexts in order,
    and how many tables they have beyond one for each word that follows; others have none."""
    p0, p1, p2 = totals.below(p, p.t3, p.t2, p.t1, p.t0)
    others = lambda level, ctx, t: np.maximum(totals.tables[level][ctx] - t, 0.0)
    d, a = totals.discounts, totals.strength
    t3 = np.ones(len(p.n), np.int64)
    at = np.flatnonzero(p.n > 1)  # one customer sits at one table
    common = p.code[at] < 0
    beside = np.maximum(p.d[at] - 1.0, 0.0)
    if told is not None:
        asks = np.flatnonzero(p.shared[at])
        where, there = _found(told[0], p.code[at[asks]])
        beside[asks[there]] += told[1][where[there]] - (p.t3[at[asks[there]]] - 1)
    beside[common] = others(3, -1 - p.code[at][common], p.t3[at][common])
    t3[at] = draw_tables(p.n[at], beside, p2[p.of2[at]], d[3], a, rng)
    c2 = np.add.reduceat(t3, p.first2)
    t2 = draw_tables(c2, others(2, p.ctx2, p.t2), p1[p.of1], d[2], a, rng)
    c1 = np.add.reduceat(t2, p.first1)
    t1 = draw_tables(c1, others(1, p.ctx1, p.t1), p0[p.word1], d[1], a, rng)
    c0 = np.add.reduceat(t1, p.first0)
    t0 = draw_tables(c0, others(0, np.zeros(len(c0), int), p.t0), np.full(len(c0), totals.base), d[0], a, rng)
    kept = np.concatenate([p.kept, t3, t2, t1, t0]) if keep else p.kept
    return Part(p.w, p.pairs, p.tail, p.code, p.n, p.d, p.shared, t3, t2, t1, t0, kept)


def _sweep(shared, seed: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ctx, more = _unpacked_columns(row.pop("told", None) or [], 2)
                order = np.argsort(ctx)
                # Seeded by part and sweep: a task that runs again draws the same.
                p = sweep(_read(row), shared.value, np.random.default_rng([seed, row["part"]]), keep, (ctx[order], more[order]))
                yield pa.RecordBatch.from_pylist([row | _fields(p)], schema=_state_schema())

    return run


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for b in batches:
        for k in range(b.num_rows):
            yield _read(b.slice(k, 1).to_pylist()[0])


def _ask_shared(rare_parts: int) -> Callable:
    """Tables beyond the first of dishes in shared contexts, by context, with the dish's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                p = _read(row)
                at = np.flatnonzero(p.shared)
                part, blobs = _dealt(rare_parts, spread(p.code[at].view(np.uint64)), p.t3[at] - 1, np.full(len(at), row["part"]))
                yield _rows_of(_BLOBS, part=part, blob=blobs)

    return run


def _tell_shared(table: pa.Table) -> pa.Table:
    """Sums by context, for every part that asks; contexts without such tables are left out,
    for a part takes these for 0."""
    ctx, more, asks = _unpacked_columns(table.column("blob").to_pylist(), 3)
    own, which = np.unique((ctx.view(np.uint64) >> np.uint64(1)).view(np.int64), return_inverse=True)
    tables = np.zeros(len(own), np.int64)
    np.add.at(tables, which, more)
    some = tables[which] > 0
    asks, which = np.divmod(np.unique(asks[some] * len(own) + which[some]), max(1, len(own)))
    cuts = np.r_[_runs(asks), len(asks)]
    blobs = [_packed(own[which[a:b]], tables[which[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_batches([_rows_of(_BLOBS, part=asks[cuts[:-1]], blob=blobs)])


def _shared_tables(state: DataFrame, rare_parts: int) -> tuple[str, DataFrame]:
    """What parts are told of the last sweep's tables in shared contexts, a row a part.  A
    written table, so Spark knows whether to broadcast it or to shuffle the state to it."""
    asked = state.select("part", *_TOLD, "sizes").mapInArrow(_ask_shared(rare_parts), _BLOBS_SQL)
    told = asked.groupBy("part").applyInArrow(_tell_shared, _BLOBS_SQL)
    return written_at(told.groupBy("part").agg(F.collect_list("blob").alias("told")), "none")


def _sums(n_keys: int) -> Callable:
    """Tables by level and restaurant and the number of words, as chunks of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n_words = [np.zeros(k, np.int64) for k in (*CONTEXTS, n_keys)], 0
        below = np.zeros(CONTEXTS[2], np.int64)
        for p in _parts_of(batches):
            common = p.code < 0
            for level, ctx, t in ((3, -1 - p.code[common], p.t3[common]), (2, p.ctx2, p.t2), (1, p.ctx1, p.t1), (0, np.zeros(len(p.w), int), p.t0)):
                np.add.at(tables[level], ctx, t)
            np.add.at(below, p.tail, p.t3)
            n_words += len(p.w)
        for level, own in (*enumerate(tables), (4, below), (5, np.array([n_words]))):
            for at in range(0, len(own), _CHUNK):
                if own[at : at + _CHUNK].any():
                    yield pa.RecordBatch.from_pylist([{"level": level, "chunk": at // _CHUNK, "n": pa.compress(_planes(own[at : at + _CHUNK]), "zstd", asbytes=True), "size": len(own[at : at + _CHUNK])}], schema=_SUMS)

    return run


_SUMS = pa.schema([("level", pa.int32()), ("chunk", pa.int32()), ("n", pa.binary()), ("size", pa.int32())])


def _unpacked(row: dict) -> np.ndarray:
    return _from_planes(pa.decompress(row["n"], row["size"] * 8, "zstd", asbytes=True), "<i8")


def _add_chunks(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    return pa.Table.from_pylist([rows[0] | {"n": pa.compress(_planes(sum(_unpacked(r) for r in rows)), "zstd", asbytes=True)}], schema=_SUMS)


def _totals(state: DataFrame, keys: np.ndarray, customers: np.ndarray, discounts: tuple[float, ...], strength: float) -> Totals:
    out = [np.zeros(k) for k in (*CONTEXTS, len(keys), CONTEXTS[2], 1)]
    # At most three numbers a restaurant of levels 0 to 2, and one a common context.
    form = "level int, chunk int, n binary, size int"
    for r in state.mapInArrow(_sums(len(keys)), form).groupBy("level", "chunk").applyInArrow(_add_chunks, form).collect():
        out[r["level"]][r["chunk"] * _CHUNK :][: r["size"]] = _unpacked(r.asDict())
    tables = tuple(out[:LEVELS])
    last = np.bincount(np.arange(CONTEXTS[2]) & 0xFF, tables[2], CONTEXTS[1])
    return Totals(keys, (np.array([tables[1].sum()]), last, out[4], customers), tables, discounts, 1.0 / (out[5][0] + 1), strength)


@dataclass(frozen=True)
class Model:
    """The written state, the totals of every sample, and the number of parts."""

    state: DataFrame
    totals: tuple[Totals, ...]
    n_parts: int
    n_tokens: int
    n_words: int
    #: Parts of the contexts that are not among the common ones, 0 if there are none.
    rare: int = 0
    #: Where the state is.
    path: str = ""


def common_contexts(per: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The commonest contexts, as many as fit into ``most`` with all of equal count, and
    whether there are others.  These are what all tasks know by number; the others teach,
    are drawn and score in the same way, by their key."""
    listed = sorted(((r["n"], r["contexts"]) for r in per.groupBy("n").agg(F.count("*").alias("contexts")).collect()), reverse=True)
    size, least = 0, None
    for n, contexts in listed:  # fewer than the square root of twice the tokens
        size += contexts
        if size > most:
            break
        least = n
    chosen = per.where(F.lit(False) if least is None else F.col("n") >= least)
    return chosen.toArrow(), size > most


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffles of jobs that have ended go when the JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, part_pairs: int = PART_PAIRS, top_contexts: int = TOP_CONTEXTS) -> Model:
    """The model of all texts of ``docs`` that are not held out."""
    taught = docs.where(~held_out(F.col("doc_id"))).select("text")
    spark = docs.sparkSession
    before, per = written_at(taught.mapInArrow(_count_contexts, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n")))
    n_tokens = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common, rare = common_contexts(per, top_contexts)
    delete_table(spark, before)
    keys = turned(common.column("ctx").to_numpy().view(np.uint64))
    order = np.argsort(keys)
    keys, customers = keys[order], common.column("n").to_numpy()[order].astype(float)
    n_parts, shared = max(1, -(-n_tokens // part_pairs)), spark.sparkContext.broadcast(keys)
    rare_parts = -(-(n_tokens - int(customers.sum())) // part_pairs) if rare else 0
    before, counts = written_at(taught.mapInArrow(_count(shared, n_parts, max(1, rare_parts)), _BLOBS_SQL), "none")
    whole = counts.where("blob is not null")
    if rare:
        whole = whole.unionByName(counts.where("rare is not null").groupBy("part").applyInArrow(_with_followers(n_parts), _BLOBS_SQL))
    path, state = written_at(whole.groupBy("part").applyInArrow(_pack(shared), _STATE), "none")
    shared.destroy()  # every node keeps a copy on its disk
    delete_table(spark, before)
    del counts, whole
    forget_shuffles(spark)
    seen = state.agg(*(F.sum(F.get(c, F.lit(k))) for c in ("ones", "twos") for k in range(LEVELS))).first()
    # A discount as in Kneser-Ney smoothing, from dishes of one and of two customers.
    discounts = tuple(min(0.95, max(0.05, (seen[k] or 0) / max(1, (seen[k] or 0) + 2 * (seen[LEVELS + k] or 0)))) for k in range(LEVELS))
    totals, kept = _totals(state, keys, customers, discounts, strength), []
    for k in range(burn_in + samples):
        gone, shared = [path], spark.sparkContext.broadcast(totals)
        if rare and k:  # all dishes of the first seating have one table
            at, told = _shared_tables(state, rare_parts)
            state = state.join(told, "part", "left")
            gone.append(at)
        path, state = written_at(state.mapInArrow(_sweep(shared, k, k >= burn_in), _STATE), "none")
        shared.destroy()
        for before in gone:
            delete_table(spark, before)
        if len(gone) > 1:
            forget_shuffles(spark)
        totals = _totals(state, keys, customers, discounts, strength)
        if k >= burn_in:
            kept.append(totals)
    return Model(state, tuple(kept), n_parts, n_tokens, round(1 / totals.base) - 1, rare_parts, path)


class Lookup:
    """Averaged probabilities of the words of a part, or of any set of words."""

    def __init__(self, p: Part, totals: tuple[Totals, ...], n_words: int, n_tokens: int) -> None:
        self.p, self.w, self.totals, self.back = p, p.w, totals, [(t.back(2), t.back(1)) for t in totals]
        self.count = np.add.reduceat(p.n, np.r_[0, np.cumsum(p.pairs)[:-1]].astype(np.int64)) if len(p.w) else np.zeros(0, np.int64)
        self.base = np.log10((np.r_[self.count, 0] + SMOOTH) / (n_tokens + SMOOTH * (n_words + 1)))
        own = _pair_hash(p.w[p.word], p.code) if len(p.w) else np.zeros(0, np.uint64)
        self.pair, self.common = Index(own), index_of(totals[0].keys)
        turned = (p.ctx2 & np.uint16(0xFF)).astype(np.int64) << 8 | p.ctx2 >> np.uint16(8)
        self.dish2 = p.word2.astype(np.int64) << 16 | turned
        self.dish1 = p.word1.astype(np.int64) << 8 | p.ctx1
        self.p0, self.p1, self.p2, self.t3 = [], [], [], []
        for t, drawn in zip(totals, p.samples() if len(p.w) else [None] * len(totals), strict=True):
            p0, p1, p2 = (np.zeros(0),) * 3 if drawn is None else t.below(p, *drawn)
            # A word that training has not seen has what the root leaves to the base.
            self.p0.append(np.r_[p0, t.back(0)[0] * t.base])
            self.p1.append(p1)
            self.p2.append(p2)
            self.t3.append(np.zeros(0) if drawn is None else drawn[0])

    def score(self, w: np.ndarray, ctx: np.ndarray, rare: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: whether its word is known, and the two log10 probabilities.  ``rare``
        has customers and, for every sample, tables of the contexts that are not common."""
        ctx = ctx.astype(np.uint64)
        return self.score_codes(w, coded(self.common, ctx), (ctx & _TAIL).astype(np.uint16), rare)

    def score_codes(self, w: np.ndarray, code: np.ndarray, tail: np.ndarray, rare: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here, full = self.pair.find(_pair_hash(w, code))
        if len(self.w):
            full &= (self.p.code[here] == code) & (self.w[self.p.word[here]] == w)
        word = np.full(len(w), len(self.w))
        word[full] = self.p.word[here[full]]
        new, seen = np.flatnonzero(~full), here[full]
        if len(self.w):
            at = np.minimum(np.searchsorted(self.w, w[new]), len(self.w) - 1)
            word[new] = np.where(self.w[at] == w[new], at, len(self.w))
        known, ends = word < len(self.w), tail[new]
        last = (ends & np.uint16(0xFF)).astype(np.int64)
        two, has2 = _found(self.dish2, word[new] << 16 | last << 8 | (ends >> np.uint16(8)))
        one, has1 = _found(self.dish1, word[new] << 8 | last)
        has2, has1 = has2 & known[new], has1 & known[new]
        out = np.zeros(len(w))
        for k, (t, p0, p1, p2, t3, (back2, back1)) in enumerate(zip(self.totals, self.p0, self.p1, self.p2, self.t3, self.back, strict=True)):
            beneath = back1[last] * p0[word[new]]
            beneath[has1] = p1[one[has1]]
            beneath *= back2[ends]
            beneath[has2] = p2[two[has2]]
            below = np.empty(len(w))
            below[new], below[full] = beneath, p2[self.p.of2[seen]]
            c, tables = t.of_contexts(code, *((rare[0], rare[1 + k]) if rare else ()))
            below *= (t.strength + t.discounts[3] * tables) / (t.strength + c)
            below[full] += (self.p.n[seen] - t.discounts[3] * t3[seen]) / (t.strength + c[full])
            out += below / len(self.totals)
        return known, self.base[word], np.log10(out)


def _found(listed: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in an ordered list, and whether it is there."""
    if not len(listed):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(listed, asked), len(listed) - 1)
    return at, listed[at] == asked


def _joined(parts: list[Part], samples: int) -> Part:
    """Several parts as one, their words in order."""
    if len(parts) == 1:
        return parts[0]
    w = np.concatenate([np.zeros(0, np.uint64), *(p.w for p in parts)])
    if not len(w):
        none = np.zeros(0, np.int32)
        return Part(w, none, none.astype(np.uint16), none.astype(np.int64), *[none] * 8)
    join = lambda arrays, of: np.concatenate(arrays)[np.argsort(rank[np.concatenate(of)], kind="stable")]
    rank = np.empty(len(w), np.int64)
    rank[np.argsort(w, kind="stable")] = np.arange(len(w))
    base = np.r_[0, np.cumsum([len(p.w) for p in parts])[:-1]].astype(np.int64)
    of = [[x + b for x, b in zip(xs, base, strict=True)] for xs in ([p.word for p in parts], [p.word2 for p in parts], [p.word1 for p in parts], [np.arange(len(p.w)) for p in parts])]
    drawn = [list(p.samples()) for p in parts]
    kept = [join([d[s][level] for d in drawn], own) for s in range(samples) for level, own in enumerate(of)]
    place = {"w": 3, "pairs": 3, "tail": 0, "code": 0, "n": 0, "d": 0, "shared": 0, "t3": 0, "t2": 1, "t1": 2, "t0": 3}
    return Part(**{k: join([getattr(p, k) for p in parts], of[level]) for k, level in place.items()}, kept=np.concatenate(kept))


def common_pairs(model: Model, known, top_pairs: int = TOP_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, base scores and scores of the commonest pairs with common contexts: all of a
    count, while they are at most ``top_pairs``."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts_of(batches):
            n, many = np.unique(p.n[p.code < 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(many.astype(np.int64))], names=["n", "pairs"])

    size, least = 0, None
    for n, pairs in sorted(((r["n"], r["pairs"]) for r in model.state.mapInArrow(histogram, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs")).collect()), reverse=True):
        size += pairs
        if size > top_pairs:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n_words, n_tokens = known.value
        for p in _parts_of(batches):
            at = np.flatnonzero((p.n >= least) & (p.code < 0))
            if len(at):
                w, score = p.w[p.word[at]], np.zeros(len(at))
                for t, drawn in zip(totals, p.samples(), strict=True):
                    c, tables = t.of_contexts(p.code[at])
                    below = (t.strength + t.discounts[3] * tables) / (t.strength + c) * t.below(p, *drawn)[2][p.of2[at]]
                    score += (below + (p.n[at] - t.discounts[3] * drawn[0][at]) / (t.strength + c)) / len(totals)
                score = np.log10(score)
                count = np.add.reduceat(p.n, np.r_[0, np.cumsum(p.pairs)[:-1]].astype(np.int64))
                base = np.log10((count[p.word[at]] + SMOOTH) / (n_tokens + SMOOTH * (n_words + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(w, p.code[at]).view(np.int64)), pa.array(base), pa.array(score)], names=["pair", "base", "score"])

    found = model.state.mapInArrow(take, "pair long, base double, score double").toArrow()
    pair = found.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(pair, kind="stable")
    return pair[order], found.column("base").to_numpy()[order], found.column("score").to_numpy()[order]


_LOCAL = "doc_id long, n_tokens long, n_known long, base double, score double, row long, part long, blob binary, rare binary"
_ASKED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("row", pa.int64()), *_BLOBS])


def _score_local(shared, n_parts: int, rare_parts: int) -> Callable:
    """Rows of three kinds: a text's sums over tokens of common pairs, other tokens of common
    contexts by word, and tokens of rare contexts by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pair_base, pair_score, keys = shared.value
        pair, common = Index(pair), index_of(keys)
        row = TaskContext.get().partitionId() << 33
        for b in (piece for batch in batches for piece in pieces(batch, most=_PIECE)):
            many, known, base, score, far = [], [], [], [], []
            for w, ctx, owner in tokens(b.column("text")):
                code = coded(common, ctx)
                at, own = pair.find(_pair_hash(w, code))
                own &= code < 0
                first, of, at = int(owner[0]), owner[own] - owner[0], at[own]
                n = int(owner[-1]) - first + 1
                many.append(np.bincount(owner - first, minlength=n))
                known.append(np.bincount(of, minlength=n))
                for out, values in ((base, pair_base), (score, pair_score)):
                    out.append(np.bincount(of, values[at], n))
                far.append((w[~own], code[~own], row + owner[~own]))
            if b.num_rows:
                yield _rows_of(_ASKED, doc_id=b.column("doc_id"), n_tokens=np.concatenate(many), n_known=np.concatenate(known), base=np.concatenate(base).astype(float), score=np.concatenate(score).astype(float), row=row + np.arange(b.num_rows))
                w, code, of = (np.concatenate(x) for x in zip(*far, strict=True))
                rare = code >= 0
                for name, (part, blobs) in (("blob", _dealt(n_parts, w[~rare], code[~rare], of[~rare])), ("rare", _dealt(rare_parts, spread(code[rare].view(np.uint64)), w[rare].view(np.int64), of[rare]))):
                    yield _rows_of(_ASKED, part=part, **{name: blobs})
                row += b.num_rows

    return run


def _rare_tables(rare_parts: int) -> Callable:
    """Customers and tables of rare contexts, pair by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts_of(batches):
            at = np.flatnonzero(p.code >= 0)
            part, blobs = _dealt(rare_parts, spread(p.code[at].view(np.uint64)), p.n[at], *(t[0][at] for t in p.samples()))
            yield _rows_of(_BLOBS, part=part, blob=blobs)

    return run


def _with_totals(n_parts: int, samples: int) -> Callable:
    """Deals tokens of rare contexts to their words, with their context's customers and tables,
    0 where training has not seen it."""

    def run(table: pa.Table) -> pa.Table:
        ctx, w, row = _unpacked_columns(table.column("rare").drop_null().to_pylist(), 3)
        own, *sums = _unpacked_columns(table.column("blob").drop_null().to_pylist(), 2 + samples)
        order = np.argsort(own)
        first = _runs(own[order])
        at, there = _found(own[order][first], ctx)
        of = [np.where(there, np.add.reduceat(x[order], first)[at], 0) if len(own) else np.zeros(len(ctx), np.int64) for x in sums]
        part, blobs = _dealt(n_parts, w.view(np.uint64), (ctx.view(np.uint64) >> np.uint64(1)).view(np.int64), row, *of)
        return pa.Table.from_batches([_rows_of(_BLOBS, part=part, rare=blobs)])

    return run


_SENT = pa.schema([("texts", pa.int64()), ("bits", pa.int32()), ("blob", pa.binary())])
_SENT_SQL = "texts long, bits int, blob binary"


def _score_far(shared):
    """Sums of a part's tokens by text, packed for the texts of every range of row numbers."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        totals, n_words, n_tokens = shared.value
        parts = [_read(r) for r in state.to_pylist()]
        if not asked.num_rows:
            return pa.Table.from_pylist([], schema=_SENT)
        look = Lookup(_joined(parts, len(totals)), totals, n_words, n_tokens)
        w, code, row = _unpacked_columns(asked.column("blob").drop_null().to_pylist(), 3)
        alone = _unpacked_columns(asked.column("rare").drop_null().to_pylist(), 4 + len(totals))
        rare = [np.r_[np.zeros(len(w)), x] for x in alone[3:]]
        w, code, row = np.r_[w, alone[0]].view(np.uint64), np.r_[code, alone[1]], np.r_[row, alone[2]]
        tail, got = (decoded(totals[0].keys, code) & _TAIL).astype(np.uint16), []
        for a in range(0, len(w), _SCORED):
            at = slice(a, a + _SCORED)
            got.append(look.score_codes(w[at], code[at], tail[at], [x[at] for x in rare]))
        known, base, score = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(row, kind="stable")
        first = _runs(row[order])
        row, known, base, score = row[order][first], *(np.add.reduceat(x[order], first) for x in (known.astype(np.int64), base, score))
        # Bits of a sum behind these would not compress; only sums beyond 2**26 keep fewer.
        bits = min(_FRACTION, 62 - int(np.ceil(np.log2(1 + max(-base.min(), -score.min())))))
        fixed = [np.rint(np.ldexp(x, bits)).astype(np.int64) for x in (base, score)]
        cuts = np.r_[_runs(row >> _TEXTS), len(row)]
        blobs = [_packed(np.zeros(b - a, np.int64), *(x[a:b] for x in (row, known, *fixed))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_batches([_rows_of(_SENT, texts=row[cuts[:-1]] >> _TEXTS, bits=np.full(len(blobs), bits), blob=blobs)])

    return run


def _add_sums(table: pa.Table) -> pa.Table:
    got = []
    for bits, blob in zip(table.column("bits").to_pylist(), table.column("blob").to_pylist(), strict=True):
        _, row, known, base, score = _unpacked_columns([blob], 5)
        got.append((row, known, np.ldexp(base.astype(float), -bits), np.ldexp(score.astype(float), -bits)))
    row, known, base, score = (np.concatenate(x) for x in zip(*got, strict=True))
    own, which = np.unique(row, return_inverse=True)
    add = lambda x: np.bincount(which, x, len(own))
    return pa.table({"row": own, "n_known": add(known).astype(np.int64), "base": add(base), "score": add(score)})


def score_texts(docs: DataFrame, top_pairs: int = TOP_PAIRS, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Tokens are words in lower case (A-Z) and one end a text; a null, empty or blank text
    has the end alone.  ``base_score`` is a smoothed unigram model's log10 probability of
    the text, ``score`` this model's.  Rows without a doc_id are held out; repeated rows
    teach as often as they stand there.  Texts may be of any length; other columns are
    ignored; an empty table gives no rows.  Without training texts every token has the base
    probability.  Runs agree but for the last digits of sums.
    """
    spark = docs.sparkSession
    model = train(docs, **how)
    n_tokens = model.n_tokens
    known = spark.sparkContext.broadcast((model.totals, model.n_words, model.n_tokens))
    shared = spark.sparkContext.broadcast((*common_pairs(model, known, top_pairs), model.totals[0].keys))
    rare_parts = max(1, model.rare)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = F.expr("CASE WHEN n_tokens IS NOT NULL THEN 'text' WHEN blob IS NOT NULL THEN 'common' ELSE 'rare' END")
    before, local = written_at(texts.mapInArrow(_score_local(shared, model.n_parts, rare_parts), _LOCAL).withColumn("kind", kind), "none", "kind")
    shared.destroy()
    state = model.state.select("part", *_KEPT, "sizes")
    far = {k: local.where(F.col("kind") == k).select("part", "blob", "rare") for k in ("common", "rare")}
    sums = written(local.where("kind = 'text'").select("row", "doc_id", "n_tokens", "n_known", "base", "score"))
    rare = far["rare"].unionByName(model.state.mapInArrow(_rare_tables(rare_parts), _BLOBS_SQL))
    at, told = written_at(rare.groupBy("part").applyInArrow(_with_totals(model.n_parts, len(model.totals)), _BLOBS_SQL), "none")
    delete_table(spark, f"{before}/kind=rare")
    del rare
    forget_shuffles(spark)
    asked = far["common"].unionByName(told)
    sent = written(asked.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(_score_far(known), _SENT_SQL), "none")
    known.destroy()
    for path in (before, at, model.path):
        delete_table(spark, path)
    del local, state, far, told, asked, model
    forget_shuffles(spark)
    both = sums.unionByName(sent.groupBy("texts").applyInArrow(_add_sums, "row long, n_known long, base double, score double"), allowMissingColumns=True)
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
