"""Rules and messages in SQL: functions that a session knows by name.

    register(spark, frame.schema)
    SELECT * FROM frame WHERE fires('strict_union', 1.5, struct(*))
    SELECT * FROM split_message(TABLE(messages), 3500)
    SELECT * FROM batch_messages(TABLE(items), 3000)

``fires`` and ``fired_rules`` are SQL functions: they become part of the plan, so a rule
that is named by a literal reads only its own columns.  Spark takes no SQL function inside
``explode``: explode ``fired_rules`` outside a subquery.  The table functions read any table
with the columns they name, other columns are not sent to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from barloom.functions.rules import NEEDS_CROSS, PRESETS
from barloom.operators.reports import split_message

_CHUNKS = StructType().add("ident", "string").add("chunk", "integer").add("text", "string")


def _selected(table: AnalyzeArgument, *names: str) -> list[SelectedColumn]:
    known = table.dataType.names if table.isTable and isinstance(table.dataType, StructType) else []
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"a table with the columns {', '.join(names)} is wanted; {', '.join(missing)} not found")
    return [SelectedColumn(n) for n in names]


class SplitMessage:
    """ident, chunk, text of TABLE(ident, text): lines packed into chunks of at most
    ``most`` characters.  Every row stands for itself: nothing is shuffled.  Null and empty
    texts give no chunk."""

    @staticmethod
    def analyze(messages: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(schema=_CHUNKS, select=_selected(messages, "ident", "text"))

    def eval(self, messages: Row, most: int = 3500) -> Iterator[tuple]:
        ident = None if messages["ident"] is None else str(messages["ident"])
        for k, part in enumerate(split_message(messages["text"] or "", most)):
            yield ident, k, part


class BatchMessages:
    """ident, chunk, text of TABLE(ident, place, message): messages of an ident in order of
    place, each followed by a blank line; a batch ends before the message that would take
    it above ``most`` characters.  The function itself asks for the partitioning and order;
    one batch is held at a time.  Null messages are left out."""

    def __init__(self) -> None:
        self._ident: str | None = None
        self._chunk, self._text = 0, ""

    @staticmethod
    def analyze(items: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(schema=_CHUNKS, select=_selected(items, "ident", "place", "message"), partitionBy=[PartitioningColumn("ident")], orderBy=[OrderingColumn("place"), OrderingColumn("message")])

    def eval(self, items: Row, most: int = 3000) -> Iterator[tuple]:
        self._ident = None if items["ident"] is None else str(items["ident"])
        message = items["message"]
        if message is None:
            return
        if self._text and len(self._text) + len(message) > most:
            yield self._ident, self._chunk, self._text
            self._chunk, self._text = self._chunk + 1, ""
        self._text += message + "\n\n"

    def terminate(self) -> Iterator[tuple]:
        if self._text:
            yield self._ident, self._chunk, self._text


def _over_struct(predicate: str, columns: list[str]) -> str:
    """The predicate with every column read from the argument ``bar``."""
    names = "|".join(map(re.escape, columns))
    return re.sub(rf"\b({names})\b", r"bar.\1", predicate)


def register(spark: SparkSession, frame: StructType) -> None:
    """``fires(rule, vol_mult, bar)`` and ``fired_rules(vol_mult, bar)`` for bars of an
    indicator frame's schema, ``split_message`` and ``batch_messages``.

    An unknown rule is an error when a row meets it; a missing rule's name gives null; a
    rule whose operands are missing does not fire.
    """
    whens, names = [], []
    for name, predicate in PRESETS.items():
        gate = "gc AND " if name in NEEDS_CROSS else ""
        test = f"coalesce({_over_struct(gate + '(' + predicate.format(v='vol_mult') + ')', frame.names)}, false)"
        whens.append(f"WHEN rule = '{name}' THEN {test}")
        names.append(f"CASE WHEN {test} THEN '{name}' END")
    bar = frame.simpleString()
    unknown = "WHEN rule IS NULL THEN CAST(NULL AS BOOLEAN) ELSE CAST(raise_error('unknown entry rule ' || rule) AS BOOLEAN)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fires(rule STRING, vol_mult DOUBLE, bar {bar}) RETURNS BOOLEAN RETURN CASE {' '.join(whens)} {unknown} END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fired_rules(vol_mult DOUBLE, bar {bar}) RETURNS ARRAY<STRING> RETURN array_compact(array({', '.join(names)}))")
    register_messages(spark)


def register_messages(spark: SparkSession) -> None:
    """``split_message`` and ``batch_messages``."""
    spark.udtf.register("split_message", udtf(SplitMessage))
    spark.udtf.register("batch_messages", udtf(BatchMessages))
