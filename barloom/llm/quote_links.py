"""Quotation linking: quoted passages are joined to the messages they quote.

A message is cut into lines.  A line's quote level is the number of leading ``>`` (blanks
between them allowed); consecutive lines of one level are a passage.  Passages are
normalised (white space as one space, trimmed, lower case) and hashed.  Unquoted passages,
and each of their lines, are what can be quoted; a quoted passage links to the latest
earlier message of its conversation with that hash, or else the latest that one of its
lines has.  Replies are
ordered by the messages they quote, and bodies keep unquoted lines only.

A conversation may hold any share of all rows, and so may the replies to one message: what
has to be in order stands in ranges (``ranged``), never in one window by conversation or
parent.  Threads are numbered by list ranking, so no row holds a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CLASS, ranged, written

QUOTE = r"^(?:\x20*>)+\x20?"
_KEY = ["conv_id", "turn", "message"]
_BEFORE = (Window.unboundedPreceding, -1)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " ")))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, message: rows that are equal in all of these are one.

    Null turns and null conversations are left out, since nothing can be placed by them.
    """
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    return rows.withColumn("message", F.xxhash64("role", "text")).dropDuplicates(_KEY)


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, message, passage, level, text, lines: the passages of every message."""
    lines = rows.select(*_KEY, F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", QUOTE, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(mark, "[^>]", ""))).withColumn("said", F.expr("substring(line, length(regexp_extract(line, r'^(?:\\x20*>)+\\x20?', 0)) + 1)"))
    # One message is the unit here: a message is one row of the table.
    order = Window.partitionBy(*_KEY).orderBy("line_no")
    new = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")
    lines = lines.withColumn("new", new).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = lines.groupBy(*_KEY, "passage").agg(F.first("level").alias("level"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "said"))), lambda s: s["said"]).alias("lines"))
    return got.withColumn("text", F.array_join("lines", "\n"))


def _carried(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Per key and bucket the largest value of the buckets before."""
    per = rows.groupBy("bucket", *keys).agg(F.max(value).alias("top"))
    return per.select("bucket", *keys, F.max("top").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(*_BEFORE)).alias(name))


def latest_source(sources: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, hash, turn, source_turn: of every distinct quote the latest earlier turn
    with its hash."""
    asks = quoted.select("conv_id", "hash", "turn").distinct()
    known = sources.join(asks.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # At one turn the quote stands before the source: a message does not quote itself.
    events = asks.withColumn("source", F.lit(None).cast("long")).withColumn("kind", F.lit(0)).unionByName(known.select("conv_id", "hash", F.col("source_turn").alias("turn"), F.col("source_turn").alias("source"), F.lit(1).alias("kind")))
    events = ranged(events, "conv_id", "hash", "turn")
    own = Window.partitionBy("bucket", "conv_id", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = _carried(events, ["conv_id", "hash"], F.col("source"), "carried")
    got = events.withColumn("near", F.max("source").over(own)).where("kind = 0").join(carried, ["bucket", "conv_id", "hash"], "left")
    return got.select("conv_id", "hash", "turn", F.coalesce("near", "carried").alias("source_turn")).where("source_turn is not null")


def unplaced_messages(messages: DataFrame) -> DataFrame:
    """Rows as of ``link_quotes`` for messages without a conversation or turn: no links."""
    rows = messages.where("conv_id is null or turn is null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.xxhash64("role", "text")).dropDuplicates(_KEY)
    split = F.split("text", "\r?\n")
    levels = F.transform(split, lambda line: F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", "")))
    rows = rows.withColumn("lines", split).withColumn("levels", levels)
    body = F.array_join(F.filter("lines", lambda line, k: F.get("levels", k) == 0), "\n")
    starts = F.filter("levels", lambda level, k: (level > 0) & ((k == 0) | (level != F.get("levels", k - 1))))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return rows.select(*_KEY[:2], "role", "message", body.alias("body"), F.size(starts).cast("long").alias("n_quotes"), F.array_max("levels").cast("long").alias("max_level"), F.lit(0).cast("long").alias("n_linked"), none("long", "parent_turn"), none("long", "thread"), none("long", "depth"), none("long", "reply_order"))


def link_quotes(messages: DataFrame, unplaced: bool = False) -> DataFrame:
    """One row per message: conv_id, turn, role, message, body, n_quotes, max_level, n_linked, parent_turn, thread, depth, reply_order.

    ``message`` is a hash of role and text and tells messages of one turn apart.
    ``parent_turn`` is the latest message quoted at level 1, else the preceding turn, null
    for the first.  Quotes make trees: ``thread`` is the turn at the root of a message's
    tree and ``depth`` its distance from there.  ``reply_order`` numbers a conversation's
    messages thread by thread, each followed by its replies and theirs.  A message whose
    quotes match nothing keeps its place; empty and null texts have an empty body, texts
    may be of any length; messages of one turn are in the order of a hash; equal rows count
    once; other columns are ignored; an empty table gives no rows.

    Messages without a conversation or turn can be placed nowhere.  They are left out, or
    with ``unplaced`` are rows without parent, path and order.
    """
    rows = written(distinct_messages(messages))
    parts = written(passages(rows))
    own = parts.where("level = 0")
    piece = F.array_union(F.array("text"), F.col("lines"))
    sources = own.select("conv_id", F.col("turn").alias("source_turn"), F.explode(piece).alias("piece"))
    sources = sources.select("conv_id", "source_turn", F.sha2(normal(F.col("piece")), 256).alias("hash")).where(F.col("hash") != F.sha2(F.lit(""), 256)).distinct()
    quoted = parts.where("level > 0").select(*_KEY, "passage", "level", F.posexplode(piece).alias("k", "piece"))
    # The first piece is the whole passage.
    quoted = quoted.select(*_KEY, "passage", "level", (F.col("k") == 0).alias("is_whole"), F.sha2(normal(F.col("piece")), 256).alias("hash"))
    links = quoted.join(latest_source(sources, quoted), ["conv_id", "hash", "turn"], "left")
    links = links.groupBy(*_KEY, "passage", "level").agg(F.coalesce(F.max(F.when(F.col("is_whole"), F.col("source_turn"))), F.max("source_turn")).alias("source_turn"))
    per = links.groupBy(*_KEY).agg(F.count("*").alias("n_quotes"), F.max("level").alias("max_level"), F.count("source_turn").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source_turn"))).alias("quoted_turn"))
    bodies = own.groupBy(*_KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage", "text"))), lambda s: s["text"]), "\n").alias("body"))
    said = written(rows.select(*_KEY, "role").join(bodies, _KEY, "left").join(per, _KEY, "left"))
    turns = ranged(said.groupBy("conv_id", "turn").agg(F.max("quoted_turn").alias("turn_quoted")), "conv_id", "turn")
    before = F.lag("turn").over(Window.partitionBy("bucket", "conv_id").orderBy("turn"))
    turns = turns.withColumn("near", before).join(_carried(turns, ["conv_id"], F.col("turn"), "carried"), ["bucket", "conv_id"])
    turns = written(turns.select("conv_id", "turn", "turn_quoted", F.coalesce("near", "carried").alias("previous")))
    order = ["thread", "place", "message"]
    threads = turns.join(thread_order(turns), ["conv_id", "turn"], "left").select("conv_id", "turn", "previous", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    placed = ranged(said.join(threads, ["conv_id", "turn"]), "conv_id", *order)
    counts = placed.groupBy("conv_id", "bucket").agg(F.count("*").alias("rows_here"))
    offsets = counts.select("conv_id", "bucket", F.coalesce(F.sum("rows_here").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0)).alias("rows_before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "conv_id").orderBy(*order))
    out = placed.withColumn("rank", rank).join(offsets, ["conv_id", "bucket"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    linked = out.select(*_KEY[:2], "role", "message", F.coalesce("body", F.lit("")).alias("body"), zero("n_quotes"), zero("max_level"), zero("n_linked"), F.coalesce("quoted_turn", "previous").alias("parent_turn"), "thread", "depth", (F.col("rank") + F.col("rows_before")).cast("long").alias("reply_order"))
    return linked.unionByName(unplaced_messages(messages)) if unplaced else linked


def thread_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth, place of the turns that quote or are quoted.

    ``turns(conv_id, turn, turn_quoted)`` is a forest, since quotes point to earlier turns.
    Every turn is entered and left once on a walk through its tree; that walk is a linked
    list, and pointer doubling sums over it in as many rounds as its length has binary
    digits.  ``place`` grows along the walk.
    """
    kids = ranged(turns.where("turn_quoted is not null").select("conv_id", F.col("turn_quoted").alias("parent"), "turn"), "conv_id", "parent", "turn")
    firsts = kids.groupBy("bucket", "conv_id", "parent").agg(F.min("turn").alias("top"))
    later = Window.partitionBy("conv_id", "parent").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("bucket", "conv_id", "parent", F.min("top").over(later).alias("carried"))
    near = F.lead("turn").over(Window.partitionBy("bucket", "conv_id", "parent").orderBy("turn"))
    kids = written(kids.withColumn("near", near).join(firsts, ["bucket", "conv_id", "parent"]).select("conv_id", "turn", "parent", F.coalesce("near", "carried").alias("sibling")))
    heads = kids.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = kids.join(heads, ["conv_id", "turn"], "full")
    # Kind 0 enters a turn, kind 1 leaves it.
    step = lambda turn, kind: F.struct(turn.alias("turn"), F.lit(kind).alias("kind"))
    turn, child, sibling, parent = map(F.col, ("turn", "child", "sibling", "parent"))
    enter = F.struct(F.lit(0).alias("kind"), F.when(child.isNotNull(), step(child, 0)).otherwise(step(turn, 1)).alias("next"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("net"))
    leave = F.struct(F.lit(1).alias("kind"), F.when(sibling.isNotNull(), step(sibling, 0)).when(parent.isNotNull(), step(parent, 1)).alias("next"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("net"))
    walk = nodes.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("e"))
    walk = written(walk.select("conv_id", "turn", "e.kind", F.col("e.next.turn").alias("next_turn"), F.col("e.next.kind").alias("next_kind"), "e.enters", "e.net", turn.alias("last")))
    columns = walk.columns
    while walk.where("next_turn is not null").take(1):
        ahead = walk.select("conv_id", F.col("turn").alias("next_turn"), F.col("kind").alias("next_kind"), F.col("next_turn").alias("n2"), F.col("next_kind").alias("k2"), F.col("enters").alias("e2"), F.col("net").alias("s2"), F.col("last").alias("l2"))
        # Pointers that have not ended are all different, so no key is common.
        moved = walk.where("next_turn is not null").join(ahead, ["conv_id", "next_turn", "next_kind"])
        moved = moved.select("conv_id", "turn", "kind", F.col("n2").alias("next_turn"), F.col("k2").alias("next_kind"), (F.col("enters") + F.col("e2")).alias("enters"), (F.col("net") + F.col("s2")).alias("net"), F.col("l2").alias("last"))
        walk = written(moved.unionByName(walk.where("next_turn is null")).select(*columns))
    return walk.where("kind = 0").select("conv_id", "turn", F.col("last").alias("thread"), (-F.col("net")).alias("depth"), (-F.col("enters")).alias("place"))
