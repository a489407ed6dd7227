"""Numpy kernels over the byte buffer of an Arrow string column.

A batch of texts is one ``uint8`` array and the offsets of its texts, so words, word
hashes and window hashes of all texts come from a few array operations.  A span's hash is
a pair of polynomials modulo two 31-bit primes, followed by a mixing step.  (Modulo a power
of two, any base gives the Thue-Morse word and its complement one hash.)

The bases and the salt are a key that every run draws anew, so texts cannot be made to
collide: two different spans of n bytes have one hash in a share of at most (n / 2**31)**2
of all keys, whatever the spans are.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SALT = 0x9E3779B97F4A7C15
_PRIMES = (2147483647, 2147483629)
_tables: dict[tuple[int, int, bool], np.ndarray] = {}
#: Values of a sum whose terms are below 2**39.
_UNREDUCED = 1 << 24

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Texts are worked through in slices of about this many bytes.
SLICE_BYTES = 1 << 20
#: What a task holds of texts at once, as far as it keeps what it makes of them.
PIECE_BYTES = 1 << 23


@dataclass(frozen=True)
class Key:
    """What hashes of one run depend on: a base per prime, and a salt."""

    bases: tuple[int, int]
    salt: int


def draw_key() -> Key:
    return Key(tuple(2 + secrets.randbelow(p - 3) for p in _PRIMES), secrets.randbits(64))


def _powers(key: Key, which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**k (or base**-k) modulo a prime for k < n, kept and extended as longer texts come."""
    t = _tables.get((which, key.bases[which], inverse))
    if t is None or len(t) < n:
        prime = _PRIMES[which]
        base = pow(key.bases[which], -1, prime) if inverse else key.bases[which]
        if t is None and len(_tables) >= 4:  # those of an earlier run in a worker that is used again
            _tables.clear()
        t = np.ones(max(n, SLICE_BYTES + 1), np.uint64)
        have = 1
        while have < len(t):  # base**(have + k) = base**have * base**k
            more = min(have, len(t) - have)
            t[have : have + more] = t[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
            have += more
        _tables[which, key.bases[which], inverse] = t
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, null as empty, and its n+1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"" if kind == pa.large_binary() else "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if where is not None and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    """Gives back what Arrow keeps of freed buffers: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of whole texts that hold about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE_BYTES):
    """Slices of whole rows of a batch whose texts hold about ``most`` bytes."""
    length = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, j in slices(np.r_[0, np.cumsum(length, dtype=np.int64)], most):
        yield batch.slice(i, j - i)


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words end where their text ends."""
    inside = ~separator[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(buf)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def distinct_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words among spans of ``buf``, and which of them each span is."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    own = buf[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    off = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(own))]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def prefix_sums(values: np.ndarray, key: Key) -> tuple[np.ndarray, np.ndarray]:
    """Per prime P with P[e] - P[s] = sum of (values[k] + 1) * base**k for s <= k < e, not
    reduced: the differences fit into 64 bits."""
    out = []
    for which, prime in enumerate(_PRIMES):
        terms = (values.astype(np.uint64) + np.uint64(1)) * _powers(key, which, len(values))[: len(values)]
        if len(values) > _UNREDUCED:
            terms %= np.uint64(prime)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append(sums)
    return tuple(out)


def gram_hashes(sums: tuple[np.ndarray, np.ndarray], gram: int, key: Key) -> np.ndarray:
    """A cheaper hash, of one polynomial, of the ``gram`` bytes at every place: enough to
    choose places by."""
    p, n = np.uint64(_PRIMES[0]), len(sums[0])
    return mix((sums[0][gram:] - sums[0][:-gram]) % p * _powers(key, 0, n, True)[: n - gram] % p + np.uint64(_SALT))


def span_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, key: Key) -> np.ndarray:
    """A hash of each span, the same wherever the span stands."""
    parts = []
    for which, prime in enumerate(_PRIMES):
        p = np.uint64(prime)
        parts.append((sums[which][end] - sums[which][start]) % p * _powers(key, which, len(sums[which]), True)[start] % p)
    spread = mix((parts[0] << np.uint64(32) | parts[1]) + np.uint64(_SALT) * (end - start).astype(np.uint64))
    return mix(spread ^ np.uint64(key.salt))


def shingle_hashes(word: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their text numbers.

    A text of fewer words gives its whole word sequence as one shingle; one without
    words gives none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.cumsum(counts) - counts
    total = len(word)
    salt = [np.uint64(pow(_SALT, 3 + 2 * k, 1 << 64)) for k in range(n)]
    if total >= n:
        h = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            h += word[k : total - n + 1 + k] * salt[k]
        whole = doc[: total - n + 1] == doc[n - 1 :]
        h, owner = mix(h[whole]), doc[: total - n + 1][whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] += word[firsts[short[has]] + k] * salt[k]
        h = np.concatenate([h, mix(extra + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short.astype(owner.dtype)])
    return h, owner
