"""A schema applied to entities: what keys a type has, of what kinds and values, and which conditions hold.

A KeyDef compiles to columns with folioscan.plans.conditions; a condition that is unknown never flags. validate() is one
projection, whatever the number of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.plans.catalog import check_by_name
from folioscan.plans.conditions import Cond, Fields, compile_cond
from folioscan.plans.conditions import Entry as Operand
from folioscan.plans.expressions import Entry, expr, quoted

#: Kinds of values by the schema's types.
KINDS = {
    "integer": {"int"}, "bitmask": {"int"}, "number": {"int", "real"}, "boolean": {"bool"}, "name": {"name"}, "string": {"str", "hex"}, "date": {"str", "hex"},
    "string-text": {"str", "hex"}, "string-ascii": {"str", "hex"}, "string-byte": {"str", "hex"}, "array": {"array"}, "rectangle": {"array"}, "matrix": {"array"},
    "dictionary": {"dict", "stream"}, "stream": {"stream"}, "null": {"null"}, "name-tree": {"dict"}, "number-tree": {"dict"},
}


@dataclass(frozen=True)
class KeyDef:
    """A key: required always or under a condition; the types of its value; the texts it may have; a condition its
    value must meet; a condition over the whole entity; whether it must be a reference; whether it came later."""

    key: str
    types: tuple[str, ...] = ()
    required: bool | Cond = False
    enum: tuple[str, ...] = ()
    value_cond: Cond | None = None
    constraint: Cond | None = None
    indirect: bool = False
    later: bool = False


@dataclass(frozen=True)
class Field(Operand):
    """An entry with its kind, and whether it is a reference."""

    kind: Column | None = None
    reference: Column | None = None


def map_fields(key: str) -> Field:
    """Entries of the rows of folioscan.sources.pdf."""
    e = Entry(key)
    return Field(expr(f"coalesce({e.at}.k != 'null', false)"), expr(f"case when {e.at}.k in ('name', 'int', 'bool') then {e.at}.s end"), e.n, e.len, e.k, e.ref)


def column_fields(columns: dict[str, tuple[Column, str]]) -> Fields:
    """Columns of a flat table as entries: a column and its kind by key. Other keys are absent."""

    def field(key: str) -> Field:
        if key not in columns:
            none = F.lit(None)
            return Field(F.lit(False), none.cast("string"), none.cast("double"), none.cast("int"), none.cast("string"), F.lit(False))
        c, kind = columns[key]
        number = c.cast("double") if kind in ("int", "real") else F.lit(None).cast("double")
        length = F.length(c.cast("string")) if kind in ("str", "name") else F.lit(None).cast("int")
        return Field(c.isNotNull(), c.cast("string") if kind in ("name", "int", "bool", "str") else F.lit(None).cast("string"), number, length, F.when(c.isNotNull(), F.lit(kind)), F.lit(False))

    return field


def findings(type_name: str, defs: list[KeyDef], fields: Fields) -> list[Column]:
    """For each key and test a struct (check_id, om_type, om_key) where the test fails, else null."""
    out = []

    def flag(when: Column, rule: str, key: str) -> None:
        issue = expr(f"named_struct('check_id', {check_by_name(rule).check_id}, 'om_type', {quoted(type_name)}, 'om_key', {quoted(key)})")
        out.append(F.when(when, issue))  # null doesn't flag

    for d in defs:
        f = fields(d.key)
        here = F.coalesce(f.present, F.lit(False))
        if d.required is not False:
            need = F.lit(True) if d.required is True else compile_cond(d.required, fields)
            flag(~here & need, "MissingRequiredKey", d.key)
        wrong = F.lit(False)
        if d.types:
            kinds = sorted(set().union(*[KINDS[t] for t in d.types]))
            wrong = here & ~f.kind.isin(*kinds)
            flag(wrong, "WrongValueType", d.key)
        right = here & ~F.coalesce(wrong, F.lit(False))  # a wrong type hides the tests after it
        bad = F.lit(False)
        if d.enum:
            bad = bad | (f.kind.isin("name", "int", "bool") & ~f.text.isin(*d.enum))
        if d.value_cond is not None:
            bad = bad | F.coalesce(~compile_cond(d.value_cond, fields), F.lit(False))
        if d.enum or d.value_cond is not None:
            flag(right & bad, "DisallowedValue", d.key)
        if d.constraint is not None:
            flag(right & ~compile_cond(d.constraint, fields), "ConstraintViolated", d.key)
        if d.indirect:
            flag(right & f.kind.isin("dict", "stream") & ~f.reference, "IndirectRequired", d.key)
        if d.later:
            flag(here, "KeyIntroducedAfterPDF14", d.key)
    return out


def validate(df: DataFrame, key: Column, type_name: str, defs: list[KeyDef], fields: Fields) -> DataFrame:
    """file_id, check_id, om_type, om_key of all that fails."""
    found = F.array_compact(F.array(*findings(type_name, defs, fields)))
    return df.select(key.alias("file_id"), F.explode(found).alias("f")).select("file_id", "f.*")


def self_identified(type_col: Column, subtype: Column, pairs: dict[tuple[str, str], str]) -> Column:
    """The schema type of (Type, Subtype), or of Type alone."""
    m = F.create_map(*[x for (t, s), v in pairs.items() for x in (F.lit(f"{t}/{s}"), F.lit(v))])
    return F.coalesce(m[F.concat(type_col, F.lit("/"), F.coalesce(subtype, F.lit("")))], m[F.concat(type_col, F.lit("/"))])


def best_discriminator(values: DataFrame) -> DataFrame:
    """Of (candidate, key, value) the key that tells most candidates apart; of equal ones the first by name."""
    alone = values.groupBy("key", "value").agg(F.count_distinct("candidate").alias("c"), F.min("candidate").alias("candidate")).where("c = 1")
    return alone.groupBy("key").agg(F.count_distinct("candidate").alias("covered")).orderBy(F.desc("covered"), "key").limit(1)


def later_keys(definitions: DataFrame, version: float) -> DataFrame:
    """type, key of the keys (type, key, since) that no version up to this one has."""
    return definitions.groupBy("type", "key").agg(F.min("since").alias("_since")).where(F.col("_since") > version).select("type", "key")


def identifying_pairs(uses: DataFrame, pair: list[str], owner: str) -> DataFrame:
    """The pairs of values that one owner alone has, with it."""
    return uses.groupBy(*pair).agg(F.min(owner).alias(owner), F.max(owner).alias("_last")).where(F.col(owner) == F.col("_last")).drop("_last")


# repairs, as columns


def fill_required(f: Field, legal: list[str]) -> Column:
    """An absent value gets the only legal one, if there is just one."""
    return F.when(~f.present & F.lit(len(legal) == 1), F.lit(legal[0] if legal else None)).otherwise(f.text)


def coerce_scalar(text: Column, kind: str) -> Column:
    """A lossless change of type, null where there is none."""
    return {"integer": text.try_cast("bigint"), "number": text.try_cast("double"), "boolean": text.try_cast("boolean")}.get(kind, text)


def replace_disallowed(text: Column, enum: list[str]) -> Column:
    """A value outside the enumeration becomes its only member, or goes."""
    return F.when(text.isin(*enum), text).otherwise(F.lit(enum[0] if len(enum) == 1 else None))


def clear_bits(value: Column, mask: int) -> Column:
    return value.cast("bigint").bitwiseAND(F.lit(~mask))


def clamp_to(value: Column, low: float | None, high: float | None) -> Column:
    v = F.greatest(value, F.lit(float(low))) if low is not None else value
    return F.least(v, F.lit(float(high))) if high is not None else v


def condition_bounds(c: Cond) -> tuple[float | None, float | None]:
    """The least and the greatest value that a tree of ands over one key allows."""
    if c.op == "and":
        lows, highs = zip(*map(condition_bounds, c.kids))
        return max([x for x in lows if x is not None], default=None), min([x for x in highs if x is not None], default=None)
    if c.op in (">=", ">") and not c.other:
        return float(c.value), None
    if c.op in ("<=", "<") and not c.other:
        return None, float(c.value)
    return None, None
