"""A schema of the most common types of version 1.4, for the rules of the object model over files.

A row's type comes from its role, or from its Type and Subtype. Keys that the schema doesn't name aren't judged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.operators.schema import KeyDef, findings, map_fields
from folioscan.plans import conditions as c


def K(key: str, *types: str, need: bool = False, enum: str = "", cond: c.Cond | None = None, rule: c.Cond | None = None, ref: bool = False, later: bool = False) -> KeyDef:  # noqa: N802
    return KeyDef(key, types, need, tuple(enum.split()), cond, rule, ref, later)


def share(key: str) -> c.Cond:
    return c.both(c.order(key, ">=", 0), c.order(key, "<=", 1))


#: By type: how its rows are told (role, kind of row, Type, Subtype; an empty one holds for all), and its keys.
TYPES: dict[str, tuple[tuple[str, str, str, str], list[KeyDef]]] = {
    "Trailer": (("trailer", "dict", "", ""), [K("Size", "integer", need=True), K("Root", "dictionary", need=True, ref=True), K("Info", "dictionary", ref=True), K("ID", "array"), K("Prev", "integer"), K("XRefStm", "integer", later=True)]),
    "Catalog": (("catalog", "dict", "", ""), [
        K("Type", "name", need=True, enum="Catalog"), K("Pages", "dictionary", need=True, ref=True), K("PageMode", "name", enum="UseNone UseOutlines UseThumbs FullScreen"), K("PageLayout", "name", enum="SinglePage OneColumn TwoColumnLeft TwoColumnRight"),
        K("Metadata", "stream", ref=True), K("OutputIntents", "array"), K("OCProperties", later=True), K("Collection", later=True), K("Legal", later=True), K("NeedsRendering", later=True),
    ]),
    "Pages": (("", "dict", "Pages", ""), [K("Kids", "array", need=True), K("Count", "integer", need=True, cond=c.order("Count", ">=", 0)), K("Parent", "dictionary", ref=True), K("Rotate", "integer", rule=c.modulo("Rotate", 90, 0))]),
    "Page": (("page", "dict", "", ""), [
        K("Type", "name", need=True, enum="Page"), K("Parent", "dictionary", need=True, ref=True), K("MediaBox", "rectangle", rule=c.order("MediaBox", "==", 4, use="length")), K("Contents", "array", "stream"), K("Annots", "array"),
        K("Rotate", "integer", rule=c.modulo("Rotate", 90, 0)), K("Dur", "number"), K("Tabs", later=True), K("UserUnit", later=True), K("VP", later=True),
    ]),
    "Font": (("font", "dict", "Font", "TrueType"), [K("BaseFont", "name", need=True), K("FirstChar", "integer"), K("LastChar", "integer", rule=c.either(c.negate(c.present("FirstChar")), c.order("LastChar", ">=", other="FirstChar"))), K("Widths", "array", rule=c.order("Widths", "==", other="~Span", use="length")), K("FontDescriptor", "dictionary", ref=True)]),
    "FontDescriptor": (("descriptor", "dict", "", ""), [K("Type", "name", need=True, enum="FontDescriptor"), K("FontName", "name", need=True), K("Flags", "bitmask", need=True), K("ItalicAngle", "number"), K("StemV", "number"), K("FontFile2", "stream", ref=True)]),
    "Annotation": (("annot", "dict", "", ""), [K("Type", "name", enum="Annot"), K("Subtype", "name", need=True), K("Rect", "rectangle", need=True), K("F", "bitmask"), K("AP", "dictionary"), K("OC", later=True)]),
    "Image": (("", "stream", "", "Image"), [K("Width", "integer", need=True, cond=c.order("Width", ">", 0)), K("Height", "integer", need=True, cond=c.order("Height", ">", 0)), K("BitsPerComponent", "integer"), K("ColorSpace", "name", "array"), K("Interpolate", "boolean"), K("SMaskInData", later=True)]),
    "Form": (("", "stream", "", "Form"), [K("BBox", "rectangle", need=True), K("FormType", "integer", enum="1"), K("Matrix", "matrix"), K("Resources", "dictionary")]),
    "GraphicsState": (("gs", "dict", "", ""), [K("Type", "name", enum="ExtGState"), K("LW", "number", cond=c.order("LW", ">=", 0)), K("CA", "number", cond=share("CA")), K("ca", "number", cond=share("ca")), K("BM", "name", "array"), K("SMask", "name", "dictionary")]),
    "OutputIntent": (("intent", "dict", "", ""), [K("Type", "name", enum="OutputIntent"), K("S", "name", need=True), K("OutputConditionIdentifier", "string", need=True), K("DestOutputProfile", "stream", ref=True)]),
    "Information": (("info", "dict", "", ""), [*(K(k, "string-text") for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")), K("Trapped", "name", enum="True False Unknown")]),
    "Action": (("action", "dict", "", ""), [K("S", "name", need=True), K("Type", "name", enum="Action")]),
}


def type_test(how: tuple[str, str, str, str]) -> Column:
    role, kind, type_name, subtype = how
    test = F.col("kind") == kind
    if role:
        test &= F.array_contains("roles", role)
    for key, value in (("Type", type_name), ("Subtype", subtype)):
        if value:
            test &= F.coalesce(F.col("entries")[key].s == value, F.lit(False))
    return test


def model_findings(enabled: set[int]) -> Column:
    """An array of check_id, one for each key and test that fails, of a row of nodes()."""
    parts = []
    for name, (how, defs) in TYPES.items():
        own = [x.check_id for x in findings(name, defs, map_fields)]
        parts.append(F.when(type_test(how), F.array_compact(F.array(*own))).otherwise(F.array().cast("array<int>")))
    return F.filter(F.concat(*parts), lambda k: k.isin(*sorted(enabled)))
