"""Columns from text, each built once a context: some thousand nodes of rules cost seconds if every use builds its own."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1 << 14)
def _built(context: SparkContext | None, text: str) -> Column:
    return F.expr(text)


def expr(text: str) -> Column:
    return _built(SparkContext._active_spark_context, text)


def quoted(text: str) -> str:
    """A text as a literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Entry:
    """The parts of an entry of a row of nodes(): kind, text, number, length, and whether it is a reference."""

    __slots__ = ("at",)

    def __init__(self, key: str):
        self.at = f"entries[{quoted(key)}]"

    @property
    def k(self) -> Column:
        return expr(self.at + ".k")

    @property
    def s(self) -> Column:
        return expr(self.at + ".s")

    @property
    def n(self) -> Column:
        return expr(self.at + ".n")

    @property
    def len(self) -> Column:
        return expr(self.at + ".len")

    @property
    def ref(self) -> Column:
        return expr(self.at + ".ref")
