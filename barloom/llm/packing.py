"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids once; only lengths and checksums travel on.  Pieces are dealt to
blocks of bounded size, and each block is evolved on several islands with their own
seeds.  A chromosome is a list of bins: crossover injects whole well-filled bins of the
other parent, drops the bins that hold the same documents, and puts displaced documents
back by best fit.  After every epoch each island's elite migrates to the other islands of
its block; the best solution of a block wins.

The emptiest sequences of neighbouring blocks are then opened and evolved again together,
level by level, so that a block's last sequences need not stay half empty.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
#: Blocks whose emptiest sequences are packed again together, and how many of each.
FAN, LOOSE = 16, 64
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    ``path`` is a tokenizer file (.json); the file of its ranks beside it (.tiktoken) gives
    the same ids by a faster program.  A text on which that program gives up (its regular
    expression has a depth limit) is encoded from the first file.  With ``special`` a
    special token's literal in a text is that token, as the file has it by itself, else
    ordinary text; the first file encodes such texts too.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.fast = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import tiktoken
            from public_tokenizers import PATTERN

            pairs = (line.split() for line in ranks.read_bytes().splitlines() if line)
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(k) for t, k in pairs}, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.literals):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            except BaseException as gave_up:
                if type(gave_up).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str | None = None, special: bool = False) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    key = str(path), special
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 of every document; null text is empty.

    ``row`` tells repeated rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, special=True)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            ident, keys = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            for k, text in enumerate(b.column("text")):
                ids = ids_of(text.as_py() or "") + end
                rows += [(keys[k], ident[k], i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, _PIECES)


class Bins:
    """Bins under best fit: a bit per amount of room finds the tightest bin at once."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def open(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - used)
        self._list(len(self.room) - 1)

    def _list(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.mask |= 1 << r

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.open([item], size)
            return
        r = (fits & -fits).bit_length() - 1 + size
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.mask ^= 1 << r
        self.items[b].append(item)
        self.room[b] = r - size
        self._list(b)


def best_fit(sizes: list[int], order: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for own in start:
        bins.open(own, sum(sizes[i] for i in own))
    for i in order:
        bins.put(i, sizes[i])
    return bins.items


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square fill (unevenly filled bins are easier to empty)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """``a`` with whole well-filled bins of ``b``."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    take = full[: max(1, len(full) * 3 // 4)]
    injected = [list(x) for x in take if rng.random() < 0.5]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    # The emptiest bins are opened up as well: their documents may fill others.
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    weak = len(kept) // 20
    displaced += [i for x in kept[:weak] for i in x]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, injected + kept[weak:])


def evolve(sizes: list[int], capacity: int, seed: int, migrants: list[list[list[int]]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best bins found.

    The population starts from the migrants, best fit by falling size, and best fit in
    orders with more and more chance in them.  A generation is two crossovers; the search
    ends before its last one only where the bins are as few as their sum allows.
    """
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [[list(x) for x in m] for m in migrants]
    rate = lambda x: fitness(sizes, x, capacity)
    people.append(best_fit(sizes, order, capacity))
    while len(people) < population:
        chance = len(people) / population
        people.append(best_fit(sizes, sorted(order, key=lambda i: -sizes[i] * (1 - chance * rng.random())), capacity))
    people.sort(key=rate, reverse=True)
    for _ in range(generations):
        mother, father = rng.sample(range(len(people)), 2)
        child = crossover(sizes, people[0], people[max(mother, father)], capacity, rng)
        other = crossover(sizes, people[mother], people[father], capacity, rng)
        people = sorted([*people, child, other], key=rate, reverse=True)[:population]
        if len(people[0]) <= least:
            break
    return people[0]


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, "<i4")
    for b, own in enumerate(bins):
        out[own] = b
    return out


def _bins(labels: np.ndarray) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(labels.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


_SOLUTION = "block long, island int, n_bins int, fit double, labels binary"
_PLACED = _PIECES + ", block long, bin int, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is its ids and an end id; one above ``capacity`` is cut into full
    pieces, the first may be shorter.  Sequences hold at most ``capacity`` ids without
    gaps.  Null and empty texts are their end id, texts may be of any length; rows may
    repeat or lack a doc_id; other columns are ignored; an empty table gives no rows.
    """
    pieces = written(token_pieces(docs, capacity, tokenizer))
    return pack_pieces(pieces, capacity, block_pieces, islands, epochs)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Places in sequences for ``pieces``, as ``token_pieces`` gives them."""
    n_blocks = max(1, -(-pieces.count() // block_pieces))
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("row", "doc_id", "piece"), F.lit(n_blocks))).withColumn("was", F.lit(-1).cast("long"))
    parts, level = [], 0
    while True:
        placed = written(_solve(rows, capacity, islands, epochs))
        sequence = (F.lit(level << 56).cast("long") + F.shiftleft("block", 24) + F.col("bin")).alias("sequence_id")
        shown = ["doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset"]
        if n_blocks == 1:
            parts.append(placed.select(*shown))
            return reduce(DataFrame.unionByName, parts)
        used = placed.groupBy("block", "bin").agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
        place = F.row_number().over(Window.partitionBy("block").orderBy("used", "bin"))
        loose = written(used.withColumn("place", place).where(F.col("place") <= LOOSE).select("block", "bin"))
        parts.append(placed.join(loose, ["block", "bin"], "left_anti").select(*shown))
        again = placed.join(loose, ["block", "bin"]).withColumn("was", F.shiftleft("block", 24) + F.col("bin"))
        rows = again.withColumn("block", F.floor(F.col("block") / FAN)).select(*rows.columns)
        n_blocks, level = -(-n_blocks // FAN), level + 1


def _solve(rows: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """``rows`` with the bin and offset that their block's best island gives them."""
    keys = ["length", "row", "piece"]
    lean = rows.select("block", *keys, "was").withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))

    def solve(key, items: pd.DataFrame, elites: pd.DataFrame | None, epoch: int) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"block": [], "island": [], "n_bins": [], "fit": [], "labels": []})
        items = items.sort_values(keys)
        sizes, was = items["length"].tolist(), items["was"].to_numpy()
        guests = [] if elites is None else [_bins(np.frombuffer(x, "<i4")) for x in elites.sort_values("island")["labels"]]
        if not guests and was[0] >= 0:
            guests = [_bins(was)]  # opened sequences as they were
        best = evolve(sizes, capacity, zlib.crc32(f"{int(key[0])}:{int(key[1])}:{epoch}".encode()), guests)
        return pd.DataFrame({"block": [int(key[0])], "island": [int(key[1])], "n_bins": [len(best)], "fit": [fitness(sizes, best, capacity)[1]], "labels": [_labels(best, len(sizes)).tobytes()]})

    def later(epoch: int):
        return lambda key, items, elites: solve(key, items, elites, epoch)

    found = lean.groupBy("block", "island").applyInPandas(lambda key, items: solve(key, items, None, 0), _SOLUTION)
    for epoch in range(1, epochs):
        # Each island's elite goes to every island of its block.
        found = written(found)
        visits = found.withColumn("to", F.explode(F.array(*map(F.lit, range(islands)))))
        found = lean.groupBy("block", "island").cogroup(visits.groupBy("block", "to")).applyInPandas(later(epoch), _SOLUTION)
    best = found.groupBy("block").agg(F.min_by("labels", F.struct("n_bins", -F.col("fit"), "island")).alias("labels"))

    def place(items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(keys).reset_index(drop=True)
        items["bin"] = np.frombuffer(chosen["labels"].iloc[0], "<i4") if len(items) else []
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        return items[[c.split()[0] for c in _PLACED.split(", ")]].astype({"doc_id": "Int64"})

    return rows.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, _PLACED)
