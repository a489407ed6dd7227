"""Secret scans: fixed patterns, and a randomness test battery for everything else.

Candidate tokens are runs of at least 20 letters, digits and ``+/_-``; ``=`` ends a run, and
up to two at its end belong to it.  For each the encoding is inferred (the smallest alphabet that holds its symbols),
and four statistics are taken: chi-squared of the symbol counts against a uniform
alphabet, a runs test of symbols above and below the alphabet's middle, one of runs of
upper case, lower case, digits and others (names have few), and the lag-one serial
correlation.  Without digits the share of upper case is a fifth.  Their p-values under
"random" are exact up to 64 symbols (the serial correlation's by its exact moments), since
20 symbols over 64 cells are far from any limit, and are combined by Bonferroni.

What is reported is decided per encoding and length class (a power of two) from the
histogram of -log10 of the combined p-values of all different tokens, kept at a fixed size.
Random tokens have small values, names large ones, and the fewer the smaller: below the
mode of names their density rises.  So the names among tokens up to a cut are at most as
dense as the tokens in a window behind it, and (1 + tokens in the window) / (widths of the
window over the cut's) bounds them.  The last cut at which this is at most ``q`` of the
tokens up to it decides; windows are 1, 2, 4, 8, 16 and 20 times as wide.  So the share of
names among *reported* tokens is controlled; where names look as random as secrets do,
nothing is reported.  A lone token can be reported, since the widest window may be empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # maximal runs
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

#: name, alphabet, and the least length at which the battery has power.
ALPHABETS = (
    ("hex", "0123456789abcdef", 24),
    ("HEX", "0123456789ABCDEF", 24),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", 24),
    ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
)
_SETS = [(name, frozenset(a), {c: k for k, c in enumerate(a)}, least) for name, a, least in ALPHABETS]
#: Bins of -log10(p), 0.05 wide.
BIN, BINS = 0.05, 400


def infer_encoding(token: str):
    """The first alphabet that holds all symbols, or None."""
    symbols = set(token)
    return next((x for x in _SETS if symbols <= x[1]), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


#: Up to this length p-values are exact; longer tokens have enough symbols for the limits.
EXACT = 64
#: The least p-value that the exact tables resolve.
LEAST_P = 1e-12


@lru_cache(maxsize=1024)
def square_tail(n: int, a: int) -> np.ndarray:
    """P(sum of squared counts >= s), for n uniform symbols out of a, by s.

    The counts' generating function is the a-th power of sum x**c y**(c*c) / c!; it is
    taken at roots of unity for y, and the coefficient of x**n by the recurrence of powers
    of series.
    """
    m = n * n + 1
    y = np.exp(-2j * np.pi * np.arange(m) / m)
    f = [y ** (c * c % m) / math.factorial(c) for c in range(n + 1)]
    g = [np.ones(m, complex)]
    for k in range(1, n + 1):
        g.append(sum((a * j - (k - j)) * f[j] * g[k - j] for j in range(1, k + 1)) / k)
    share = np.fft.ifft(g[n]).real * math.exp(math.lgamma(n + 1) - n * math.log(a))
    return np.maximum.accumulate(np.cumsum(np.maximum(share, 0)[::-1]))[::-1]


def uniformity(counts: np.ndarray) -> float:
    """The p-value of chi-squared against a uniform alphabet."""
    n, a = int(counts.sum()), len(counts)
    squares = int((counts * counts).sum())
    if n <= EXACT:
        return float(min(1.0, max(LEAST_P, square_tail(n, a)[squares])))
    chi, k = squares * a / n - n, a - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=65536)
def runs_test(n1: int, n2: int, runs: int) -> float:
    """The two-sided p-value of a number of runs of n1 and n2 symbols in random order."""
    n = n1 + n2
    if n > EXACT:
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        return _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    if not n1 or not n2:
        return 1.0  # their order says nothing

    def ways(r: int) -> int:
        k = r // 2
        if r % 2:
            return math.comb(n1 - 1, k) * math.comb(n2 - 1, k - 1) + math.comb(n1 - 1, k - 1) * math.comb(n2 - 1, k)
        return 2 * math.comb(n1 - 1, k - 1) * math.comb(n2 - 1, k - 1)

    total = math.comb(n, n1)
    low = sum(ways(r) for r in range(2, runs + 1)) / total
    high = sum(ways(r) for r in range(runs, n + 1)) / total
    return min(1.0, 2 * min(low, high))


_GROUPS = (str.isupper, str.islower, str.isdigit)


def _group(c: str) -> int:
    return next((k for k, of in enumerate(_GROUPS) if of(c)), len(_GROUPS))


@lru_cache(maxsize=4096)
def few_changes(n: int, shares: tuple[float, ...]) -> np.ndarray:
    """P(at most c places where the group changes), for n symbols of groups with these
    shares, by c."""
    share = np.array(shares)
    at = np.zeros((len(share), n))  # by the last symbol's group and the changes so far
    at[:, 0] = share
    for _ in range(n - 1):
        moved = np.zeros_like(at)
        moved[:, 1:] = (at.sum(axis=0) - at)[:, :-1]
        at = share[:, None] * (at + moved)
    return np.cumsum(at.sum(axis=0))


def change_test(token: str, alphabet: str) -> float:
    """The p-value of so few changes between upper case, lower case, digits and others."""
    groups = [_group(c) for c in token]
    own = Counter(map(_group, alphabet))
    if len(own) > 2 and 2 not in groups:  # letters alone
        own.pop(2)
    if len(own) < 2:
        return 1.0
    shares = tuple(own[g] / sum(own.values()) for g in sorted(own))
    changes = sum(a != b for a, b in zip(groups, groups[1:], strict=False))
    if len(token) <= 4 * EXACT:
        return float(min(1.0, max(LEAST_P, few_changes(len(token), shares)[changes])))
    # Changes at neighbouring places depend on each other.
    two, three = sum(x**2 for x in shares), sum(x**3 for x in shares)
    n = len(token) - 1
    var = n * two * (1 - two) + 2 * (n - 1) * (three - two**2)
    z = (changes + 0.5 - n * (1 - two)) / math.sqrt(var)
    return max(LEAST_P, 0.5 * math.erfc(-z / math.sqrt(2)))


@lru_cache(maxsize=65536)
def binomial_test(k: int, n: int, share: float) -> float:
    """The two-sided p-value of k out of n."""
    if n > EXACT:
        return _normal_tail((k - n * share) / math.sqrt(n * share * (1 - share)))
    own = [math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(n + 1)]
    return min(1.0, 2 * min(sum(own[: k + 1]), sum(own[k:])))


def serial_test(x: np.ndarray) -> float:
    """The two-sided p-value of the lag-one correlation, by its mean and variance in
    samples of this length."""
    n, d = len(x), x - x.mean()
    ss = float((d * d).sum())
    if not ss:
        return 1.0
    r = float((d[1:] * d[:-1]).sum()) / ss
    return _normal_tail((r + 1 / n) / math.sqrt((n - 2) ** 2 / (n * n * (n - 1))))


def battery(token: str) -> tuple[str, float, bool] | None:
    """Encoding, combined p-value under "random", and whether the test has power."""
    token = token.rstrip("=")
    found = infer_encoding(token)
    if found is None:
        return None
    name, alphabet, at, least = found
    codes = np.array([at[c] for c in token])
    n, a = len(codes), len(alphabet)
    high = codes >= a / 2
    p = [uniformity(np.bincount(codes, minlength=a)), runs_test(int(high.sum()), int((~high).sum()), 1 + int((high[1:] != high[:-1]).sum())), serial_test(codes.astype(float)), change_test(token, alphabet)]
    if a >= 62 and not any(c.isdigit() for c in token):
        p.append(binomial_test(sum(c.isupper() for c in token), n, 26 / (a - 10)))
    return name, max(1e-20, min(1.0, len(p) * min(p))), n >= least and len(set(token)) >= min(10, a // 2)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _class(length: int) -> int:
    return length.bit_length()


def _number(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(p) / BIN))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base string, base_sha256 string, candidates array<struct<start:int,stop:int,encoding:string,length_class:int,bin:int,power:boolean,token:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("encoding", pa.string()), ("length_class", pa.int32()), ("bin", pa.int32()), ("power", pa.bool_()), ("token", pa.int64())]))
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            found = []
            # Of all base spans that start before a run ends, whether the furthest reaches it.
            starts = sorted(x for x, _, _ in spans)
            reach = list(accumulate((y for _, y in sorted((x, y) for x, _, y in spans)), max, initial=-1))
            for m in RUN.finditer(text):
                s, e = m.span()
                if reach[bisect_left(starts, e)] <= s and (got := battery(m[0])):
                    found.append({"start": s, "stop": e, "encoding": got[0], "length_class": _class(len(m[0].rstrip("="))), "bin": _bin(got[1]), "power": got[2], "token": _number(m[0])})
            n = [sum(k == kind for _, k, _ in spans) for kind in KINDS[:3]]
            base = _join(spans)
            rows.append((*n, base, hashlib.sha256(base.encode()).hexdigest(), found))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], names=[c.split()[0] for c in _SCHEMA.split(", ")])


#: Widths of the windows behind a cut, in widths of the cut.
WINDOWS = (1, 2, 4, 8, 16, 20)
#: The last cut that is tried: p-values of 0.05 and more.  Beyond it lie at most a twentieth
#: of random tokens, and more and more names.
LAST_CUT = 26


def cuts(tokens: dict[tuple[str, int, int], int], q: float) -> dict[tuple[str, int], int]:
    """Per encoding and length class how many bins are reported, where there are some.

    ``tokens`` counts different tokens by (encoding, length class, bin); bin 0 is the most
    random.
    """
    groups: dict[tuple[str, int], np.ndarray] = {}
    for (encoding, cls, b), n in tokens.items():
        groups.setdefault((encoding, cls), np.zeros(BINS, np.int64))[b] += n
    out = {}
    for group, counts in groups.items():
        upto = np.append(0, np.cumsum(counts))
        for cut in range(LAST_CUT, 0, -1):
            behind = [(1 + upto[cut + k * cut] - upto[cut]) / k for k in WINDOWS if cut + k * cut <= BINS]
            if min(behind) <= q * upto[cut]:
                out[group] = cut
                break
    return out


def scan_secrets(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` has the base spans and those of the battery ("random"), as
    kind:start:end by start, then kind.  Null text counts as empty and has no spans, texts
    may be of any length; rows may repeat or lack a doc_id and each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA))
    # At most one row per encoding (8), length class (32) and bin (400), whatever the input.
    tokens = rows.select(F.explode("candidates").alias("c")).where("c.power").select("c.encoding", "c.length_class", "c.bin", "c.token").distinct().groupBy("encoding", "length_class", "bin").count().collect()
    limit = cuts({tuple(r)[:3]: r[3] for r in tokens}, q)
    chosen = F.filter("candidates", lambda c: F.lit(False))
    if limit:
        table = F.create_map(*[F.lit(x) for (encoding, cls), b in sorted(limit.items()) for x in (f"{encoding}:{cls}", b)])
        last = lambda c: F.element_at(table, F.concat(c["encoding"], F.lit(":"), c["length_class"].cast("string")))
        chosen = F.filter("candidates", lambda c: c["power"] & F.coalesce(c["bin"] < last(c), F.lit(False)))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("kind"), F.split(s, ":")[2].cast("int").alias("stop")))
    more = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["stop"].alias("stop")))
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"))
