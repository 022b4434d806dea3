"""Conditions over an entity's entries, compiled to columns with three-valued logic.

A condition is unknown (null) where an operand can't be read; and, or and not then follow SQL. An absent entry is known:
it is not present, equal to nothing and unequal to everything. An ordering with an absent operand is unknown. Orderings
allow a tolerance. The same trees run over any table: `fields` gives the columns that hold an entry's presence, its
value as text and its number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.fonts import STANDARD_14

TOLERANCE = 1e-5


@dataclass(frozen=True)
class Entry:
    """An entry's columns: present, its name, integer or boolean as text, its number, its length."""

    present: Column
    text: Column
    number: Column
    length: Column | None = None


Fields = Callable[[str], Entry]


@dataclass(frozen=True)
class Cond:
    """A tree: op with kids, or op over a key. The right side of an order is add + factor * number(other), or a value."""

    op: str
    key: str = ""
    value: str | float | None = None
    kids: tuple = ()
    other: str = ""
    factor: float = 1.0
    add: float = 0.0
    use: str = "value"
    other_use: str = "value"
    minus: str = ""


def present(key: str) -> Cond:
    return Cond("present", key)


def eq(key: str, value: str) -> Cond:
    return Cond("eq", key, value)


def ne(key: str, value: str) -> Cond:
    return Cond("ne", key, value)


def order(key: str, op: str, value: float | None = None, other: str = "", factor: float = 1.0, add: float = 0.0, use: str = "value") -> Cond:
    """op is one of < <= > >= == !=; use 'length' compares the length of an array or a string."""
    return Cond(op, key, value, (), other, factor, add, use)


def modulo(key: str, divisor: int, rest: int, use: str = "value") -> Cond:
    return Cond("mod", key, rest, (), "", divisor, 0.0, use)


def bits_set(key: str, low: int, high: int) -> Cond:
    """All bits from low to high, counted from 1, are set."""
    return Cond("bits_set", key, ((1 << high - low + 1) - 1) << low - 1)


def bits_clear(key: str, low: int, high: int) -> Cond:
    return Cond("bits_clear", key, ((1 << high - low + 1) - 1) << low - 1)


def contains(key: str, value: str) -> Cond:
    return Cond("contains", key, value)


def both(*kids: Cond) -> Cond:
    return Cond("and", kids=kids)


def either(*kids: Cond) -> Cond:
    return Cond("or", kids=kids)


def negate(kid: Cond) -> Cond:
    return Cond("not", kids=(kid,))


def compile_cond(c: Cond, fields: Fields) -> Column:
    """A boolean column: true, false, or null for unknown."""
    if c.op in ("and", "or"):
        return reduce(lambda a, b: a & b if c.op == "and" else a | b, [compile_cond(k, fields) for k in c.kids])
    if c.op == "not":
        return ~compile_cond(c.kids[0], fields)
    if c.op == "true":
        return F.lit(True)
    if c.op == "unknown":
        return F.lit(None).cast("boolean")
    e = fields(c.key)
    here = F.coalesce(e.present, F.lit(False))
    if c.op == "present":
        return here
    if c.op in ("eq", "ne"):
        same = F.when(~here, F.lit(False)).otherwise(e.text == F.lit(str(c.value)))
        return same if c.op == "eq" else ~same
    if c.op == "contains":
        return F.when(~here, F.lit(False)).otherwise(F.contains(e.text, F.lit(str(c.value))))
    if c.op == "not_standard_14":
        return F.when(here, ~e.text.isin(*sorted(STANDARD_14)))
    left = F.when(here, (e.length if c.use == "length" else e.number).cast("double"))
    if c.op == "mod":
        return F.when(left == F.floor(left), F.pmod(left.cast("bigint"), F.lit(int(c.factor))) == F.lit(int(c.value)))
    if c.op in ("bits_set", "bits_clear"):
        mask = F.lit(int(c.value)).cast("bigint")
        return F.when(left == F.floor(left), left.cast("bigint").bitwiseAND(mask) == (mask if c.op == "bits_set" else F.lit(0)))
    if c.other:
        o = fields(c.other)
        right = F.lit(c.add) + F.lit(c.factor) * F.when(F.coalesce(o.present, F.lit(False)), (o.length if c.other_use == "length" else o.number).cast("double"))
        if c.minus:
            m = fields(c.minus)
            right = right - F.when(F.coalesce(m.present, F.lit(False)), m.number.cast("double"))
    else:
        right = F.lit(float(c.value)).cast("double")
    t = F.lit(TOLERANCE)
    return {
        "<": lambda: left < right - t, "<=": lambda: left <= right + t, ">": lambda: left > right + t,
        ">=": lambda: left >= right - t, "==": lambda: F.abs(left - right) <= t, "!=": lambda: F.abs(left - right) > t,
    }[c.op]()
