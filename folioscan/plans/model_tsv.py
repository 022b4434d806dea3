"""The whole object model from tables of tab-separated values, one file a type, and the compiler of their predicates.

A table has the columns Key, Type, SinceVersion, DeprecatedIn, Required, IndirectReference, Inheritable, DefaultValue,
PossibleValues, SpecialCase, Link, Note. Predicates become trees of folioscan.plans.conditions, or are folded where the
version of the model decides them; what the compiler doesn't know never flags. Types reach containers along the links
from the trailer on, while a file is walked; the tests are then one pass over the rows with the model as a broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.schema import KINDS, KeyDef, findings, map_fields
from folioscan.plans import conditions as c
from folioscan.plans.catalog import check_by_name

COLUMNS = ("Key", "Type", "SinceVersion", "DeprecatedIn", "Required", "IndirectReference", "Inheritable", "DefaultValue", "PossibleValues", "SpecialCase", "Link", "Note")
VERSION = 1.4
#: What a predicate can be besides true, false and a tree: not applicable, and not understood.
VACUOUS, UNKNOWN = "vacuous", "unknown"
Result = bool | c.Cond | str
_TOKEN = re.compile(r"\s*(?:(fn:\w+)|(&&|\|\||==|!=|>=|<=|[-+*()<>,])|'([^']*)'|([^\s()<>=!&|,+*']+(?:\*(?![\s\d@(]))?))")


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all tables of a folder, with om_type for the name of the file."""
    kinds = ", ".join(f"`{x}` string" for x in COLUMNS)
    df = spark.read.schema(kinds).option("sep", "\t").option("header", "true").option("quote", "").option("mode", "FAILFAST").option("pathGlobFilter", "*.tsv").csv(folder)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.tsv$", 1).alias("om_type"), *COLUMNS)


def read_tables(folder: str) -> dict[str, list[dict[str, str]]]:
    """The same on the driver, in the order of the files' lines; a line of another number of columns is
    an error, but for one without its note."""
    out = {}
    for path in sorted(Path(folder).glob("*.tsv")):
        rows = []
        for k, line in enumerate(path.read_text(encoding="utf-8").split("\n")):
            cells = line.rstrip("\r").split("\t")
            if k and line:
                if len(cells) == len(COLUMNS) - 1:  # without a note
                    cells.append("")
                if len(cells) != len(COLUMNS):
                    raise ValueError(f"{path.name}, line {k + 1}: {len(cells)} columns")
                rows.append(dict(zip(COLUMNS, cells)))
        out[path.stem] = rows
    return out


# predicates


class _Parser:
    """A recursive descent over one predicate."""

    def __init__(self, text: str, version: float, own: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no predicate: {text[at:]}")
            kind = m.lastindex
            self.tokens.append(({1: "fn", 2: "op", 3: "text", 4: "word"}[kind], m[kind]))
            at = m.end()
        self.at, self.version, self.own = 0, version, own

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("a cut predicate")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        if self.take() != ("op", op):
            raise ValueError(f"{op} is missing")

    def whole(self) -> Result:
        r = self.either()
        if self.at < len(self.tokens):
            raise ValueError("more than a predicate")
        return r

    def either(self) -> Result:
        parts = [self.both()]
        while self.peek("||"):
            self.take()
            parts.append(self.both())
        return combine(parts, False)

    def both(self) -> Result:
        parts = [self.one()]
        while self.peek("&&"):
            self.take()
            parts.append(self.one())
        return combine(parts, True)

    def one(self) -> Result:
        """A comparison, a function, or what is in parentheses."""
        save = self.at
        try:
            left = self.sum()
            if self.peek("==", "!=", ">=", "<=", ">", "<"):
                op = self.take()[1]
                return compare(left, op, self.sum())
        except ValueError:
            pass
        self.at = save
        if self.peek("("):
            self.take()
            r = self.either()
            self.expect(")")
            return r
        kind, name = self.take()
        if kind != "fn":
            raise ValueError(f"no predicate: {name}")
        return self.function(name[3:])

    def arguments(self) -> list[list[tuple[str, str]]]:
        """The tokens of each argument."""
        self.expect("(")
        out, depth = [[]], 0
        while True:
            t = self.take()
            if t == ("op", ")") and not depth:
                return [a for a in out if a]
            depth += (t == ("op", "(")) - (t == ("op", ")"))
            if t == ("op", ",") and not depth:
                out.append([])
            else:
                out[-1].append(t)

    def sub(self, tokens: list) -> _Parser:
        p = _Parser("", self.version, self.own)
        p.tokens = tokens
        return p

    def function(self, name: str) -> Result:
        args = self.arguments()
        inner = lambda k: self.sub(args[k]).whole()
        word = lambda k: args[k][0][1] if len(args[k]) == 1 else "::"
        if name in ("Eval", "IsRequired") and len(args) == 1:
            return inner(0)
        if name == "Not" and len(args) == 1:
            r = inner(0)
            return not r if isinstance(r, bool) else r if isinstance(r, str) else c.negate(r)
        if name == "IsPresent" and len(args) == 1 and plain(word(0)):
            return c.present(word(0))
        if name == "Contains" and len(args) == 2 and word(0)[:1] == "@" and plain(word(0)[1:]):
            return c.contains(word(0)[1:], word(1))
        if name == "NotStandard14Font" and not args:
            return c.Cond("not_standard_14", "BaseFont")
        if name in ("BitSet", "BitClear", "BitsSet", "BitsClear") and args:
            low, high = int(word(0)), int(word(-1))
            if not 1 <= low <= high <= 32:
                raise ValueError("bits out of range")
            return (c.bits_set if "Set" in name else c.bits_clear)(self.own, low, high)
        if name == "Extension":
            return c.Cond("unknown")
        if name in ("SinceVersion", "BeforeVersion", "IsPDFVersion") and args:
            v = float(word(0))
            if not {"S": self.version >= v, "B": self.version < v, "I": self.version == v}[name[0]]:
                return VACUOUS if len(args) == 2 else False
            return True if len(args) == 1 else inner(1)
        return UNKNOWN

    # numbers: a key with its use, a factor and a summand, or a constant

    def sum(self) -> tuple:
        t = self.term()
        while self.peek("+", "-"):
            sign = 1 if self.take()[1] == "+" else -1
            u = self.term()
            if u[0] is None:
                t = (*t[:3], t[3] + sign * u[3])
            elif t[0] is None and sign == 1:
                t = (*u[:3], u[3] + t[3])
            elif sign == -1 and u[1:] == ("value", 1.0, 0.0) and t[0] is not None and " " not in t[1]:
                t = (t[0], f"{t[1]} minus {u[0]}", *t[2:])
            else:
                raise ValueError("no linear comparison")
        return t

    def term(self) -> tuple:
        t = self.operand()
        while self.peek("*"):
            self.take()
            u = self.operand()
            if u[0] is None:
                t, u = u, t
            if t[0] is not None or isinstance(t[3], str):
                raise ValueError("no linear comparison")
            t = (u[0], u[1], u[2] * t[3], u[3] * t[3])
        if self.at < len(self.tokens) and self.tokens[self.at] == ("word", "mod"):
            self.take()
            n = self.operand()
            t = (t[0], f"{t[1]} mod {int(n[3])}", t[2], t[3])
        return t

    def operand(self) -> tuple:
        """(key or None, use, factor, summand or constant)."""
        kind, t = self.take()
        if (kind, t) == ("op", "-"):
            r = self.operand()
            if r[1] != "number":
                raise ValueError("no number")
            return (*r[:3], -r[3])
        if (kind, t) == ("op", "("):
            r = self.sum()
            self.expect(")")
            return r
        if kind == "fn" and t in ("fn:ArrayLength", "fn:StringLength"):
            a = self.arguments()
            key = a[0][0][1].removeprefix("@") if len(a) == 1 and len(a[0]) == 1 else "::"
            if not plain(key):
                raise ValueError("no key")
            return key, "length", 1.0, 0.0
        if kind == "word" and t[0] == "@":
            if not plain(t[1:]):
                raise ValueError("no key")
            return t[1:], "value", 1.0, 0.0
        if kind == "text":
            return None, "text", 1.0, t
        if kind == "word":
            try:
                return None, "number", 1.0, float(t)
            except ValueError:
                return None, "text", 1.0, t
        raise ValueError("no operand")


def plain(key: str) -> bool:
    """A key of the same container, or an index."""
    return re.fullmatch(r"[A-Za-z0-9_.]+\*?", key) is not None


def combine(parts: list[Result], conjunction: bool) -> Result:
    """And, or of what is known: what isn't applicable is left out, and one part that decides does so."""
    kids = [p for p in parts if p != VACUOUS]
    if any(isinstance(p, bool) and p is not conjunction for p in kids):
        return not conjunction
    if UNKNOWN in [p for p in kids if isinstance(p, str)]:
        return UNKNOWN
    trees = [p for p in kids if isinstance(p, c.Cond)]
    if not trees:
        return VACUOUS if len(parts) == 1 and not kids else conjunction
    return trees[0] if len(trees) == 1 else (c.both if conjunction else c.either)(*trees)


def compare(left: tuple, op: str, right: tuple) -> Result:
    if left[0] is None and right[0] is not None:
        left, right, op = right, left, {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op)
    if " minus " in left[1] and right[0] is not None and " minus " not in right[1]:
        left, right, op = right, left, {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op)
    key, use, factor, add = left
    if " minus " in use or key is None or isinstance(add, str) or factor != 1 or add != 0:
        raise ValueError("no comparison")
    if " mod " in use:
        use, _, divisor = use.partition(" mod ")
        if op not in ("==", "!=") or right[0] is not None or isinstance(right[3], str):
            raise ValueError("no comparison")
        m = c.modulo(key, int(divisor), int(right[3]), use)
        return m if op == "==" else c.negate(m)
    if right[0] is None and isinstance(right[3], str):
        if op not in ("==", "!="):
            raise ValueError("no comparison")
        return c.eq(key, right[3]) if op == "==" else c.ne(key, right[3])
    if right[0] is None:
        return c.order(key, op, right[3], use=use)
    if " mod " in right[1]:
        raise ValueError("no comparison")
    other_use, _, minus = right[1].partition(" minus ")
    return replace(c.order(key, op, None, right[0], right[2], right[3], use), other_use=other_use, minus=minus)


def predicate(text: str, version: float = VERSION, own: str = "") -> Result:
    """A predicate as a constant, a tree, VACUOUS or UNKNOWN. own is the key of bits that aren't named."""
    try:
        return _Parser(text, version, own).whole()
    except (ValueError, IndexError):
        return UNKNOWN


# columns of a table


def groups(text: str) -> list[str]:
    """The parts of [..];[..], or the whole."""
    return [g[1:-1] if g[:1] == "[" and g[-1:] == "]" else g for g in _split(text, ";")] if text else []


def _split(text: str, mark: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, x in enumerate(text):
        depth += (x in "([") - (x in ")]")
        if x == mark and not depth:
            out.append(text[start:k].strip())
            start = k + 1
    return [*out, text[start:].strip()]


def folded(item: str, version: float) -> str | None:
    """An item that holds from, or up to, a version: itself, or None where it doesn't hold; 'fn:' of what isn't known."""
    m = re.fullmatch(r"fn:(SinceVersion|BeforeVersion|IsPDFVersion|Deprecated)\(([\d.]+),(.*)\)", item)
    if not m:
        return item
    v = float(m[2])
    holds = {"S": version >= v, "B": version < v, "I": version == v, "D": True}[m[1][0]]
    return folded(m[3].strip(), version) if holds else None


def possible_values(text: str, version: float = VERSION) -> tuple[list[str], list[tuple[c.Cond, str]], bool]:
    """The values of an enumeration, those that a condition pins, and whether some of it isn't understood. A star
    allows all."""
    values, pins, unknown, parts = [], [], False, groups(text)
    for g in parts:
        for item in filter(None, _split(g, ",")):
            item = folded(item, version)
            if item is None:
                continue
            m = re.fullmatch(r"fn:RequiredValue\((.*)\)", item)
            if m and len(two := _split(m[1], ",")) == 2:
                v = two[1].strip("'")
                if "fn:" in v or v == "*":
                    unknown = True
                    continue
                values.append(v)
                if len(parts) == 1 and isinstance(r := predicate(two[0], version), c.Cond):
                    pins.append((r, v))
                continue
            if item.startswith("fn:"):
                unknown = True
                continue
            if (v := item.strip("'")) == "*":
                return [], [], False
            values.append(v)
    return values, pins, unknown


def special_case(text: str, own: str, version: float = VERSION) -> c.Cond | None:
    """The condition of all groups that state one, if they state the same; None of what reaches other objects."""
    found = {g for g in groups(text) if g}
    r = predicate(found.pop(), version, own) if len(found) == 1 and "::" not in text else UNKNOWN
    return r if isinstance(r, c.Cond) else None


def key_def(row: dict[str, str], version: float = VERSION) -> KeyDef:
    """The tests of a row."""
    key = row["Key"]
    types = [folded(t, version) for t in _split(row["Type"], ";")]
    known = tuple(t for t in types if t in KINDS) if all(t is None or t in KINDS for t in types) else ()
    need: bool | c.Cond = row["Required"] == "TRUE"
    if "fn:" in row["Required"]:
        r = predicate(row["Required"], version, key)
        need = r if isinstance(r, (bool, c.Cond)) else False
    ref = row["IndirectReference"] == "TRUE"
    if m := re.fullmatch(r"fn:MustBeIndirect\((.*)\)", row["IndirectReference"]):
        ref = predicate(m[1], version, key) is True if m[1] else True
    values, pins, unknown = possible_values(row["PossibleValues"], version)
    value_cond, parts = None, groups(row["PossibleValues"])
    if unknown:
        values = []
        if len(parts) == 1 and parts[0].startswith("fn:Eval(") and len(_split(parts[0], ",")) == 1 and isinstance(r := predicate(parts[0], version, key), c.Cond):
            value_cond = r
    for when, v in pins:
        pin = c.either(c.negate(when), c.eq(key, v))
        value_cond = pin if value_cond is None else c.both(value_cond, pin)
    return KeyDef(key, known, need, tuple(dict.fromkeys(values)), value_cond, special_case(row["SpecialCase"], key, version), ref)


Links = dict[str, dict[str, list[tuple[str | None, tuple[str, ...]]]]]


def links(rows: list[dict[str, str]]) -> dict[str, list[tuple[str | None, tuple[str, ...]]]]:
    """By key, the types that a value may have, each with the type of value that they are for; None for any."""
    out = {}
    for row in rows:
        kinds, parts = _split(row["Type"], ";"), [tuple(x for x in _split(re.sub(r"fn:\w+\([\d.]+,([^()]*)\)", r"\1", g), ",") if x and "fn:" not in x) for g in groups(row["Link"])]
        if len(kinds) > 1 and len(kinds) == len(parts):
            found = [(k, p) for k, p in zip(kinds, parts) if p]
        else:
            found = [(None, tuple(x for p in parts for x in p))] if any(parts) else []
        if found:
            out[row["Key"]] = found
    return out


@dataclass
class Model:
    """Types with their keys, links, the keys of later versions, and the pairs of Type and Subtype that tell a type."""

    types: dict[str, list[KeyDef]] = field(default_factory=dict)
    links: Links = field(default_factory=dict)
    later: dict[str, frozenset[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], str] = field(default_factory=dict)
    told: dict[tuple[str, ...], tuple[str, dict[str, str]] | None] = field(default_factory=dict)

    def named(self, type_name: str, key: str) -> KeyDef | None:
        """The definition of a key, else that of all others."""
        defs = {d.key: d for d in self.types.get(type_name, [])}
        return defs.get(key) or defs.get("*")

    def discriminator(self, candidates: tuple[str, ...]) -> tuple[str, dict[str, str]] | None:
        """The key whose values tell most of the candidates apart, the first by name of equals, and who has which."""
        if candidates not in self.told:
            best = None
            for key in sorted({d.key for t in candidates for d in self.types.get(t, []) if d.enum}):
                owner: dict[str, set[str]] = {}
                for t in candidates:
                    for v in next((d.enum for d in self.types.get(t, []) if d.key == key), ()):
                        owner.setdefault(v, set()).add(t)
                alone = {v: next(iter(o)) for v, o in owner.items() if len(o) == 1}
                n = len(set(alone.values()))
                if n and (best is None or n > best[0]):
                    best = (n, key, alone)
            self.told[candidates] = best and (best[1], best[2])
        return self.told[candidates]

    def child(self, parent: str, key: str, kind: str, value: object, get=lambda x: x) -> str:
        """The type of a value under a key: by the kind of value, then by the discriminator of the candidates, then by
        what its own Type and Subtype say; '' where it isn't known."""
        own = self.links.get(parent, {})
        for wanted, candidates in own.get(key) or own.get(key + "*") or own.get("*") or []:
            if wanted is not None and kind not in KINDS.get(wanted, ()):
                continue
            if len(candidates) == 1:
                return candidates[0]
            if isinstance(value, dict) and (told := self.discriminator(candidates)):
                v = get(value.get(told[0]))
                if isinstance(v, (str, int)) and (found := told[1].get(str(v))):
                    return found
            if isinstance(value, dict) and (found := self.identified(value, get)) in candidates:
                return found
            return ""
        return self.identified(value, get) if isinstance(value, dict) else ""

    def identified(self, value: dict, get=lambda x: x) -> str:
        t, s = (str(get(value.get(k)) or "") for k in ("Type", "Subtype"))
        return self.pairs.get((t, s)) or self.pairs.get((t, ""), "") if t else ""


def identifying(tables: dict[str, list[KeyDef]]) -> dict[tuple[str, str], str]:
    """The pairs of Type and Subtype that exactly one type claims; a type without a Subtype claims its Type alone."""
    claims: list[tuple[tuple[str, str], str]] = []
    for name, defs in tables.items():
        by = {d.key: d for d in defs}
        if "Type" in by:
            subs = by["Subtype"].enum if "Subtype" in by and by["Subtype"].enum else ("",)
            claims += [((t, s), name) for t in by["Type"].enum for s in subs]
    n = Counter(p for p, _ in claims)
    return {p: name for p, name in claims if n[p] == 1}


def read_model(folder: str, latest: str | None = None, version: float = VERSION) -> Model:
    """The model of a folder of tables; latest is a folder of the newest tables, whose further keys came later."""
    tables = read_tables(folder)
    types = {name: [key_def(r, version) for r in rows] for name, rows in tables.items()}
    later = {}
    for name, rows in (read_tables(latest) if latest else {}).items():
        if name in tables and (more := {r["Key"] for r in rows} - {r["Key"] for r in tables[name]}):
            later[name] = frozenset(more)
    return Model(types, {name: links(rows) for name, rows in tables.items()}, later, identifying(types))


# validation


def model_rows(rows: DataFrame) -> DataFrame:
    """The rows of nodes() that have a type of the model: a row for each of its types, in om_type."""
    own = F.transform(F.filter("roles", lambda r: r.startswith("=")), lambda r: F.substring(r, 2, 1 << 20))
    return rows.withColumn("om_type", F.explode(F.array_distinct(own)))


def _columns(model: Model, spark: SparkSession) -> DataFrame:
    """A row a type: its keys with kinds and enumerations, its required keys, and the kinds of all other keys."""
    out = []
    for name, defs in model.types.items():
        keys = {}
        for d in defs:
            kinds = sorted(set().union(*[KINDS[t] for t in d.types])) if d.types else []
            keys[d.key] = (kinds, list(d.enum), d.indirect)
        out.append((name, keys, [d.key for d in defs if d.required is True and d.key != "*"], sorted(model.later.get(name, ()))))
    return spark.createDataFrame(out, "t string, keys map<string,struct<kinds:array<string>,enum:array<string>,ref:boolean>>, need array<string>, later array<string>")


def validate_model(rows: DataFrame, model: Model) -> DataFrame:
    """file_id, check_id, page, om_type, om_key of all that fails in rows of nodes(..., model): keys that are missing, of
    a wrong type, not allowed, not indirect, broken conditions, and keys of later versions. The tables of the model are
    broadcast (a row a type); conditions are columns, for the types that have any."""
    spark, typed = rows.sparkSession, model_rows(rows)
    j = typed.join(F.broadcast(_columns(model, spark)), F.col("om_type") == F.col("t"))
    rule = lambda name: F.lit(check_by_name(name).check_id)
    issue = lambda check, key: F.struct(check.alias("check_id"), key.alias("om_key"))
    entry = lambda k: F.col("entries")[k]
    missing = F.transform(F.filter("need", lambda k: F.coalesce(entry(k).k == "null", F.lit(True))), lambda k: issue(rule("MissingRequiredKey"), k))

    def tests(x: Column) -> Column:
        k, v = x.key, x.value
        d = F.coalesce(F.col("keys")[k], F.col("keys")["*"])
        here = d.isNotNull() & (v.k != "null")
        wrong = here & (F.size(d.kinds) > 0) & ~F.array_contains(d.kinds, v.k)
        right = here & ~wrong
        return F.array_compact(F.array(
            F.when(wrong, issue(rule("WrongValueType"), k)),
            F.when(right & (F.size(d.enum) > 0) & v.k.isin("name", "int", "bool") & ~F.array_contains(d.enum, v.s), issue(rule("DisallowedValue"), k)),
            F.when(right & d.ref & v.k.isin("dict", "stream") & ~v.ref, issue(rule("IndirectRequired"), k)),
            F.when(F.array_contains("later", k), issue(rule("KeyIntroducedAfterPDF14"), k)),
        ))

    own = F.filter(F.map_entries("entries"), lambda x: ~x.key.startswith("~"))
    found = F.concat(missing, F.flatten(F.transform(own, tests)))
    conditions = []
    for name, defs in model.types.items():
        some = [replace(d, types=(), required=d.required if isinstance(d.required, c.Cond) else False, enum=(), indirect=False) for d in defs if d.key != "*" and (isinstance(d.required, c.Cond) or d.value_cond is not None or d.constraint is not None)]
        if some:
            kinds = "array<struct<check_id:int,om_key:string>>"
            each = F.transform(F.array_compact(F.array(*findings(name, some, map_fields))), lambda f: F.struct(f.check_id.alias("check_id"), f.om_key.alias("om_key"))).cast(kinds)
            conditions.append(F.when(F.col("om_type") == name, each).otherwise(F.array().cast(kinds)))
    if conditions:
        found = F.concat(found, *conditions)
    return j.select("file_id", "page", "om_type", F.explode(F.array_distinct(found)).alias("f")).select("file_id", "f.check_id", "page", "om_type", "f.om_key")


def type_names(model: Model) -> Iterable[str]:
    return sorted(model.types)
