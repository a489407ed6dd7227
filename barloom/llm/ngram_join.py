"""N-gram Jaccard self-join by prefix trees of globally ordered shingle sets.

1.  Every text becomes a set of shingle hashes; equal sets are one class.
2.  A set can only link if three quarters of its shingles stand in other sets of a fitting
    size.  Document frequencies of all shingles are counted for that: a task ships its
    shingles as packed arrays, one row per batch and range of hashes, and gets counts back.
3.  The sets that remain are ordered globally: shingles of few sets first, then those of
    ``HEAVY`` or more.  Two linked sets share a shingle in the first quarter of that order,
    which joins sets to candidate groups.
4.  Each candidate group is stored in a path-compressed trie.  A set walks the trie level
    by level; the overlap with a node's path is shared by all sets below it, and a subtree
    is cut off when the shingles that remain on both sides cannot reach the threshold for
    the shortest set below it.  Groups above ``BLOCK`` sets or ``BLOCK_BYTES`` are split
    into bands of size, of which only neighbours can link, and bands into blocks; a task
    walks one pair of blocks.

Pairs are never emitted: a walk yields the number of a set's links and the smallest set it
is connected with; connected components of those give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_part, count_parts, join_hubs, keep_rows, written
from barloom.llm.components import components
from barloom.llm.textarrays import LOWER, Key, buffer_of, draw_key, mix, pieces, prefix_sums, release_memory, shingle_hashes, slices, span_hashes, words

WORDS = 5
#: Linked: DEN * intersection >= NUM * (size + size), which is 3/4 of the union.
NUM, DEN = 3, 7
#: Sets that hold a shingle from which on it comes last in the global order.
HEAVY = 32
#: Sets, and bytes of shingles, in a block of a candidate group.
BLOCK = 256
BLOCK_BYTES = 8 << 20
#: Sets whose sizes differ by more than this factor (over 4/3) cannot link.
BAND = 1.34
#: Bytes of text per part of the count: a part's shingles are about as large.
PART_BYTES = 16 << 20
#: Bytes of text whose shingles are made at once.
PIECE = 4 << 20
#: Slices of a part's hashes that are sorted one after the other.
SLICES = 8


def shingle_sets(texts: pa.Array, key: Key, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = buffer_of(texts)
    for i, j in slices(offsets):
        part, off = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        start, end, doc = words(part, off)
        h, owner = shingle_hashes(span_hashes(prefix_sums(part, key), start, end, key), doc, j - i, n)
        if len(owner) and (np.diff(owner) < 0).any():
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(h[cut[k] : cut[k + 1]])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64))


def _ranges(tokens: np.ndarray, n_parts: int) -> np.ndarray:
    """The range of hashes that a token is in."""
    return ((tokens >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


_SHIPPED = "part int, runs binary, tokens binary, docs binary"
_RUN = np.dtype([("key", "<i8"), ("n", "<u4"), ("count", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("text", "<i8")])


def _pack(part: int, runs=b"", tokens=b"", docs=b"") -> dict:
    return {"part": part, "runs": runs, "tokens": tokens, "docs": docs}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = (("part", pa.int32()), ("runs", pa.binary()), ("tokens", pa.binary()), ("docs", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])


def _deal(keys: list[tuple[int, int]], sets: list[np.ndarray], n_parts: int, kind) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, runs, tokens): the sorted sets cut at the borders of hash ranges."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    part = _ranges(tokens, n_parts)
    order = np.argsort(part, kind="stable")
    tokens, owner, part = tokens[order], owner[order], part[order]
    cut = np.searchsorted(part, np.arange(n_parts + 1))
    key, size = np.array([k for k, _ in keys], np.int64), np.array([n for _, n in keys], np.uint32)
    for p in range(n_parts):
        lo, hi = cut[p], cut[p + 1]
        if lo == hi:
            continue
        own, count = np.unique(owner[lo:hi], return_counts=True)
        runs = np.zeros(len(own), _RUN)
        runs["key"], runs["n"], runs["count"] = key[own], size[own], count
        yield p, runs.tobytes(), tokens[lo:hi].astype(kind).tobytes()


def _ship(n_parts: int, n: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch, most=PIECE)):
            seen: dict[tuple[int, int, int], np.ndarray] = {}
            docs = np.zeros(b.num_rows, _DOC)
            ids = b.column("doc_id")
            docs["id"], docs["null"], docs["text"] = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), b.column("text_hash").to_numpy()
            for k, s in enumerate(shingle_sets(b.column("text"), key, n)):
                k1, k2 = set_key(s)
                docs["n"][k], docs["k1"][k], docs["k2"][k] = len(s), k1, k2
                if len(s):
                    seen[k1, k2, len(s)] = s  # copies within a piece ship once
            home = np.mod(docs["k1"] ^ docs["text"], n_parts)
            out = [_pack(int(p), docs=docs[home == p].tobytes()) for p in np.unique(home)]
            # 32 bits of a hash besides its range: a clash only makes a candidate more.
            out += [_pack(p, r, t) for p, r, t in _deal([(k1, n) for k1, _, n in seen], list(seen.values()), n_parts, "<u4")]
            if out:
                yield _rows(out)
            del out, seen
            release_memory()

    return run


def _fitting(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of rows sorted by token and size: which ones have a neighbour of that token whose
    size allows a link.  A set's nearest sizes stand beside it."""
    size = size.astype(np.int64)
    next_fits = (token[1:] == token[:-1]) & (4 * size[:-1] >= 3 * size[1:])
    fits = np.zeros(len(token), bool)
    fits[:-1] |= next_fits
    fits[1:] |= next_fits
    return fits


def _unpacked(rows: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, runs and the run of each token, of everything shipped to a part."""
    runs = np.concatenate([np.zeros(0, _RUN), *(np.frombuffer(x, _RUN) for x in rows.column("runs").to_pylist())])
    tokens = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in rows.column("tokens").to_pylist())])
    return tokens, runs, np.repeat(np.arange(len(runs), dtype=np.int32), runs["count"])


_COUNTED = "doc_id long, text_hash long, n long, k1 long, k2 long, found long, heavy binary"


def _count(heavy: int):
    def run(rows: pa.Table) -> pa.Table:
        docs = np.concatenate([np.zeros(0, _DOC), *(np.frombuffer(x, _DOC) for x in rows.column("docs").to_pylist())])
        tokens, runs, of = _unpacked(rows, "<u4")
        parts = []
        for k in range(SLICES):
            at = np.flatnonzero(tokens % SLICES == k)
            token, key, size = tokens[at], runs["key"][of[at]], runs["n"][of[at]]
            order = np.lexsort((key, size, token))
            token, key, size = token[order], key[order], size[order]
            same = np.zeros(len(token), bool)  # a set that several batches shipped
            same[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1]) & (size[1:] == size[:-1])
            token, key, size = token[~same], key[~same], size[~same]
            fits = _fitting(token, size)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
            often = np.repeat(np.diff(np.r_[first, len(token)]), np.diff(np.r_[first, len(token)])) >= heavy
            parts.append((token[fits], key[fits], size[fits], often[fits]))
        token, key, size, often = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((token, size, key))
        token, key, size, often = token[order], key[order], size[order], often[order]
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])]) if len(key) else np.zeros(0, int)
        stop = np.r_[start[1:], len(key)].astype(int) if len(start) else start
        none = [None] * len(docs)
        blobs = [token[s:e][often[s:e]].astype("<u4").tobytes() for s, e in zip(start, stop, strict=True)]
        d = len(start)
        return pa.table({
            "doc_id": pa.array([*np.where(docs["null"], None, docs["id"]), *[None] * d], pa.int64()), "text_hash": pa.array([*docs["text"].tolist(), *[None] * d], pa.int64()),
            "n": pa.array([*docs["n"].tolist(), *size[start].tolist()], pa.int64()), "k1": pa.array([*docs["k1"].tolist(), *key[start].tolist()], pa.int64()), "k2": pa.array([*docs["k2"].tolist(), *[None] * d], pa.int64()),
            "found": pa.array([*none, *(stop - start).tolist()], pa.int64()), "heavy": pa.array([*none, *blobs], pa.binary()),
        })

    def with_part(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = run(rows)
        del rows
        release_memory()
        # A blob of heavy shingles starts with its range.
        mark = np.array([key[0].as_py()], "<u4").tobytes()
        return out.set_column(6, "heavy", pa.array([None if x is None else mark + x if x else b"" for x in out.column("heavy").to_pylist()], pa.binary()))

    return with_part


def _order(s: np.ndarray, heavy: list[bytes], n_parts: int) -> np.ndarray:
    """The set in the global order: light shingles, then heavy ones, each by hash."""
    marks = [np.frombuffer(x, "<u4") for x in heavy if x]
    if not marks:
        return s
    often = np.concatenate([x[1:].astype(np.uint64) | np.uint64(x[0]) << np.uint64(32) for x in marks])
    own = (s & np.uint64(0xFFFFFFFF)) | _ranges(s, n_parts).astype(np.uint64) << np.uint64(32)
    last = np.isin(own, often)
    return np.concatenate([s[~last], s[last]])


def prefix_length(n: int) -> int:
    """So many first shingles of a set: every linked set has one of them among its own."""
    return n - -(-3 * n // 4) + 1


_SET = "cid long, n long, copies long, shingles binary"


def _ordered_sets(n_parts: int, n: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch, most=PIECE)):
            want, heavy = zip(b.column("k1").to_pylist(), b.column("n").to_pylist(), strict=True), b.column("heavy").to_pylist()
            rows = [(k, _order(s, heavy[k], n_parts)) for k, (s, w) in enumerate(zip(shingle_sets(b.column("text"), key, n), want, strict=True)) if (set_key(s)[0], len(s)) == w]
            at = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cid").take(at), b.column("n").take(at), b.column("copies").take(at), pa.array([s.astype("<u8").tobytes() for _, s in rows], pa.binary())], names=["cid", "n", "copies", "shingles"])
            del rows
            release_memory()

    return run


def _ship_prefixes(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column("cid").to_pylist(), b.column("n").to_pylist(), strict=True))
            sets = [np.sort(np.frombuffer(x, "<u8", prefix_length(n))) for x, (_, n) in zip(b.column("shingles").to_pylist(), keys, strict=True)]
            out = [_pack(p, r, t) for p, r, t in _deal(keys, sets, n_parts, "<u8")]
            if out:
                yield _rows(out)

    return run


def _edges(rows: pa.Table) -> pa.Table:
    """Sets of fitting sizes that follow each other under a shingle, as few as connect them."""
    token, runs, of = _unpacked(rows, "<u8")
    key, size = runs["key"][of], runs["n"][of]
    order = np.lexsort((key, size, token))
    token, key, size = token[order], key[order], size[order].astype(np.int64)
    fits = (token[1:] == token[:-1]) & (4 * size[:-1] >= 3 * size[1:]) & (key[1:] != key[:-1])
    pairs = np.unique(np.stack([key[:-1][fits], key[1:][fits]]), axis=1) if len(key) else np.zeros((2, 0), np.int64)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs.T.tolist():
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    star = [(x, root(x)) for x in list(up)]
    return pa.table({"a": pa.array([a for a, _ in star], pa.int64()), "b": pa.array([b for _, b in star], pa.int64())})


class Trie:
    """A path-compressed trie of sets of small integers, its nodes by level.

    ``tokens`` holds the labels of all edges; ``low`` and ``high`` are the shortest and the
    longest set below a node, ``depth`` is the length of its path.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        names = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=names.__getitem__)
        nodes: list[list] = [[-1, 0, 0, 0, -1]]  # parent, set, from, to, set that ends here
        stack = [0]
        last = None
        for k in order:
            s = sets[k]
            same = 0
            if last is not None:
                m = min(len(s), len(last))
                differs = np.flatnonzero(s[:m] != last[:m])
                same = int(differs[0]) if len(differs) else m
            while len(stack) > 1 and nodes[stack[-1]][2] >= same:
                stack.pop()
            top = nodes[stack[-1]]
            if top[3] > same:  # the last edge splits where the sets part
                nodes.append([top[0], top[1], top[2], same, -1])
                top[0], top[2] = len(nodes) - 1, same
                stack[-1] = len(nodes) - 1
            nodes.append([stack[-1], k, same, len(s), k])
            stack.append(len(nodes) - 1)
            last = s
        level = [0] * len(nodes)
        children: list[list[int]] = [[] for _ in nodes]
        for v, node in enumerate(nodes):
            if node[0] >= 0:
                children[node[0]].append(v)
        queue, at = [0], 0
        while at < len(queue):
            v = queue[at]
            at += 1
            for c in children[v]:
                level[c] = level[v] + 1
                queue.append(c)
        place = np.empty(len(nodes), np.int64)
        place[queue] = np.arange(len(queue))
        self.first = np.cumsum([1, *(len(children[v]) for v in queue)])[:-1]
        self.count = np.array([len(children[v]) for v in queue])
        parts = [sets[nodes[v][1]][nodes[v][2] : nodes[v][3]] if v else np.zeros(0, np.int64) for v in queue]
        lengths = np.array([len(p) for p in parts])
        self.tokens = np.concatenate(parts)
        self.stop = np.cumsum(lengths)
        self.start = self.stop - lengths
        self.depth = np.array([nodes[v][3] for v in queue])
        self.ends = np.array([nodes[v][4] for v in queue])
        self.last = np.array([int(p[-1]) if len(p) else 0 for p in parts])
        far = np.iinfo(np.int64).max
        self.low = np.where(self.ends >= 0, self.depth, far)
        self.high = np.where(self.ends >= 0, self.depth, 0)
        for v in reversed(range(1, len(queue))):
            p = place[nodes[queue[v]][0]]
            self.low[p] = min(self.low[p], self.low[v])
            self.high[p] = max(self.high[p], self.high[v])

    def walk(self, x: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The stored sets that link with ``x``; ``flags`` is a zero array over all tokens."""
        n = len(x)
        flags[x] = 1
        sums = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum(flags[self.tokens], out=sums[1:])
        gain = sums[self.stop] - sums[self.start]
        left = n - np.searchsorted(x, self.last, "right")
        flags[x] = 0
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            done = self.ends[node] >= 0
            hit = done & (DEN * overlap >= NUM * (n + self.depth[node]))
            found.append(self.ends[node[hit]])
            many = self.count[node]
            base = np.repeat(self.first[node] - np.r_[0, np.cumsum(many)[:-1]], many)
            child = base + np.arange(len(base))
            overlap = np.repeat(overlap, many) + gain[child]
            best = overlap + np.minimum(left[child], self.high[child] - self.depth[child])
            live = DEN * best >= NUM * (n + self.low[child])
            node, overlap = child[live], overlap[live]
        return np.concatenate(found)


def link_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (copies counted), and a label shared by connected sets.

    Sets ``left`` walk the trie of sets ``right``.  Where both are the same, every pair is
    met from either side; where they are two blocks, from one side.
    """
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    freq = np.bincount(ids)
    rank = np.empty(len(freq), np.int64)
    rank[np.argsort(-freq, kind="stable")] = np.arange(len(freq))
    cut = np.cumsum([0, *map(len, sets)])
    own = [np.sort(rank[ids[cut[k] : cut[k + 1]]]) for k in range(len(sets))]
    trie = Trie([own[k] for k in right])
    links, label, flags = np.zeros(len(sets), np.int64), np.arange(len(sets)), np.zeros(len(freq), np.int8)
    one = left is right
    for k in left:
        hits = right[trie.walk(own[k], flags)]
        hits = hits[hits != k]
        links[k] += copies[hits].sum()
        if not one:
            links[hits] += copies[k]
        labels = np.unique(label[np.append(hits, k)])
        if len(labels) > 1:
            label[np.isin(label, labels[1:])] = labels[0]
    return links, label


def _walk_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("cid")
    cid, copies, side = rows.column("cid").to_numpy(), rows.column("copies").to_numpy(), rows.column("side").to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
    if len(sets) == 1:
        return pa.table({"cid": cid, "root": cid, "links": np.zeros(1, np.int64)})
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links, label = link_sets(sets, left, left, copies) if not len(right) else link_sets(sets, left, right, copies) if len(left) else (np.zeros(len(cid), np.int64), np.arange(len(cid)))
    return pa.table({"cid": cid, "root": cid[label], "links": links})


def _blocks(near: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The sets of candidate groups, dealt to the tasks that walk them: root, band, pair,
    i, j, side, cid, copies, shingles.

    A small group is one task.  A large one is cut into bands of size and those into
    blocks; a set meets the blocks of its own band (``pair`` 0) and, as side 0 or 1, those
    of the next or the band before (``pair`` 1).
    """
    sized = written(near.join(sets.select(F.col("cid").alias("node"), "n"), "node").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")))
    bands = sized.groupBy("root", "band").agg(F.count("*").alias("members"), F.sum(8 * F.col("n")).alias("bytes"))
    blocks = lambda members, size: F.greatest(F.lit(1), F.ceil(members / block), F.ceil(size / BLOCK_BYTES)).cast("int")
    listed = bands.groupBy("root").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.collect_list(F.struct("band", blocks(F.col("members"), F.col("bytes"))))).alias("blocks"))
    # Bands of a group: at most the logarithm of the longest set.
    listed = written(listed.select("root", "members", F.when(blocks(F.col("members"), F.col("bytes")) > 1, F.col("blocks")).alias("blocks")))
    rows = join_hubs(sized, listed, "root", "members")
    small = rows.where("blocks is null").select("node", "root", F.lit(0).alias("band"), F.lit(0).alias("pair"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    of = lambda step: F.coalesce(F.element_at("blocks", F.col("band") + step), F.lit(0))
    large = rows.where("blocks is not null").withColumn("mine", F.pmod(F.xxhash64("node"), of(0)).cast("int"))
    spot = lambda band, pair, i, j, side: F.struct(band.alias("band"), F.lit(pair).alias("pair"), i.alias("i"), j.alias("j"), side.alias("side"))
    mine, band, zero, one = F.col("mine"), F.col("band"), F.lit(0), F.lit(1)
    upto = lambda count: F.when(count > 0, F.sequence(zero, count - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto(of(0)), lambda x: spot(band, 0, F.least(mine, x), F.greatest(mine, x), (mine > x).cast("int")))
    above = F.transform(upto(of(1)), lambda x: spot(band, 1, mine, x, zero))
    below = F.transform(upto(of(-1)), lambda x: spot(band - 1, 1, x, mine, one))
    large = large.select("node", "root", F.explode(F.concat(own, above, below)).alias("p")).select("node", "root", "p.*")
    dealt = small.unionByName(large)
    return dealt.join(sets, dealt["node"] == sets["cid"]).select("root", "band", "pair", "i", "j", "side", "cid", "copies", "shingles")


def jaccard_classes(docs: DataFrame, n: int = WORDS, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links, group_size,
    text_hash, stays.

    Texts are lower-cased (A-Z) and cut into words; a text of fewer than ``n`` words is one
    shingle; an empty, blank or null text has none, links with nothing and is its own
    component.  Rows link when 3/4 of the union of their sets is common.  Repeated texts
    link with each other; a null doc_id never is a component's smallest unless all are
    null.  ``n_links`` counts linked rows, ``group_size`` the component's rows, and ``stays`` marks
    the row that stands for its component.  Texts may be of any length; an empty table gives
    no rows; other columns are ignored.
    """
    spark, key = docs.sparkSession, draw_key()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = count_parts(spark, total, PART_BYTES)
    shipped = texts.mapInArrow(_ship(n_parts, n, key), _SHIPPED)
    counted = written(by_part(shipped, n_parts).applyInArrow(_count(heavy), _COUNTED))
    rows = counted.where("found is null").select("doc_id", "text_hash", "n", "k1", "k2")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(best.alias("first"), F.count("*").alias("copies"))
    classes = written(classes.select("k1", "k2", "n", "copies", "first", F.monotonically_increasing_id().alias("cid")))
    active = counted.where("found is not null").groupBy("k1", "n").agg(F.sum("found").alias("found"), F.collect_list("heavy").alias("heavy")).where("4 * found >= 3 * n").drop("found")
    wanted = classes.join(active, ["k1", "n"]).select("cid", "k1", "n", "copies", "heavy", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"]) & (texts["text_hash"] == wanted["first_hash"])).drop("doc_id", "text_hash", "first_id", "first_hash")
    sets = written(chosen.mapInArrow(_ordered_sets(n_parts, n, key), _SET).dropDuplicates(["cid"]))
    near = components(by_part(sets.mapInArrow(_ship_prefixes(n_parts), _SHIPPED), n_parts).applyInArrow(_edges, "a long, b long"))
    dealt = _blocks(near, sets, block)
    walked = written(dealt.groupBy("root", "band", "pair", "i", "j").applyInArrow(_walk_group, "cid long, root long, links long"))
    linked = components(walked.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = walked.groupBy("cid").agg(F.sum("links").alias("links"))
    full = classes.join(linked.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    full = written(full.select("k1", "k2", "n", "copies", "root", "first", F.coalesce("links", F.lit(0)).alias("links")))
    per = written(full.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("group_size"), F.count("*").alias("entries")))
    full = written(join_hubs(full, per, "root", "entries").select("k1", "k2", "n", "copies", "least", "group_size", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    out = join_hubs(rows.where("n > 0"), full, ["k1", "k2", "n"], "copies")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "n_links", "group_size", "text_hash", stays.alias("stays"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = rows.where("n = 0").select("doc_id", zero.alias("n_shingles"), F.col("doc_id").alias("component_id"), zero.alias("n_links"), one.alias("group_size"), "text_hash", F.lit(True).alias("stays"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one
    with the smallest doc_id (null last, then by a hash of the text), and one of rows that
    are equal in both.  Texts without words all stay."""
    marks = jaccard_classes(docs, **how).select("doc_id", F.col("text_hash").alias("mark"), F.col("stays").alias("keep"))
    return keep_rows(docs, marks, F.xxhash64("text"))
