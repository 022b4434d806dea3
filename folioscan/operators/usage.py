"""What content uses: codes of fonts, resources, states of the graphics, and operators that the format lacks.

The tables are rows of operators or of uses; each function is an aggregate, an anti join or a window by stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Operators of content streams.
OPERATORS = "b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EMC ET EX f F f* G g gs h i j J K k l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \"".split()


def used_codes(shown: DataFrame, font: str, text: Column) -> DataFrame:
    """font, code: the characters that a font shows, each once. A row's own are told apart before they meet others."""
    return shown.select(font, F.explode(F.array_distinct(F.split(text, ""))).alias("code")).distinct()


def invisible_only(shown: DataFrame, font: str, invisible: Column) -> DataFrame:
    """The fonts whose every use is invisible."""
    return shown.groupBy(font).agg(F.min(F.coalesce(invisible, F.lit(False))).alias("_all")).where("_all").select(font)


def unused(resources: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """The resources that nothing uses."""
    return resources.join(used.select(*on).distinct(), on, "left_anti")


def nesting_depth(ops: DataFrame, stream: list[str], order: str) -> DataFrame:
    """Adds depth, the open saves (q) after each operator; a restore (Q) of nothing counts for nothing."""
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = ops.withColumn("_sum", F.sum(F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)).over(w))
    return q.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def set_before(ops: DataFrame, stream: list[str], order: str, sets: Column) -> DataFrame:
    """Adds set_before: whether any operator before one in its stream sets a state."""
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("set_before", F.coalesce(F.max(sets).over(w), F.lit(False)))


def undefined_operators(ops: DataFrame) -> DataFrame:
    """The rows whose op the format doesn't define."""
    return ops.where(~F.col("op").isin(*OPERATORS))
