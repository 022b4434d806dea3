"""The rules as columns over the rows of folioscan.sources.pdf, and verify(), which evaluates a profile's.

Rules over containers and operators are one projection: a scan of the rows evaluates all of them. Only enabled rules
become part of the plan.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import scalars
from folioscan.operators.graph import written
from folioscan.operators.usage import OPERATORS
from folioscan.plans.catalog import Profile, check_by_name, profiles
from folioscan.plans.expressions import Entry, expr, quoted
from folioscan.plans.object_model import model_findings
from folioscan.sources.pdf import nodes

INTENTS = ("RelativeColorimetric", "AbsoluteColorimetric", "Perceptual", "Saturation")
ANNOTATIONS = "Text Link FreeText Line Square Circle Highlight Underline Squiggly StrikeOut Stamp Ink Popup Widget PrinterMark TrapNet".split()
FONTS = "Type0 Type1 MMType1 Type3 TrueType CIDFontType0 CIDFontType2".split()
FORBIDDEN_ACTIONS = "Launch Sound Movie ResetForm ImportData JavaScript SetState NOP set-state no-op Hide Rendition Trans GoTo3DView SetOCGState".split()
NAMED_ACTIONS = "NextPage PrevPage FirstPage LastPage".split()
CMAPS = "Identity-H Identity-V GB-EUC-H GB-EUC-V GBpc-EUC-H GBpc-EUC-V GBK-EUC-H GBK-EUC-V UniGB-UCS2-H UniGB-UCS2-V B5pc-H B5pc-V ETen-B5-H ETen-B5-V UniCNS-UCS2-H UniCNS-UCS2-V 83pv-RKSJ-H 90ms-RKSJ-H 90ms-RKSJ-V EUC-H EUC-V H V UniJIS-UCS2-H UniJIS-UCS2-V KSC-EUC-H KSC-EUC-V KSCms-UHC-H KSCms-UHC-V UniKS-UCS2-H UniKS-UCS2-V".split()
LATER_VIEWER_KEYS = ("PrintScaling", "Duplex", "PickTrayByPDFSize", "NumCopies")


def e(key: str) -> Entry:
    return Entry(key)


def has(key: str) -> Column:
    """The entry is there and not null."""
    return expr(f"coalesce({Entry(key).at}.k != 'null', false)")


def name(key: str) -> Column:
    return expr(f"case when {Entry(key).at}.k = 'name' then {Entry(key).at}.s end")


def role(r: str) -> Column:
    return expr(f"array_contains(roles, {quoted(r)})")


def truth(key: str) -> Column:
    return expr(f"{Entry(key).at}.k = 'bool' and {Entry(key).at}.s = 'true'")


def own_keys() -> Column:
    return F.filter(F.map_keys("entries"), lambda k: ~k.startswith("~"))


def bit(key: str, n: int) -> Column:
    return expr(f"cast(coalesce({Entry(key).at}.n, 0.0D) as bigint) & {1 << n - 1}L != 0")


def uncovered(key: str) -> Column:
    return expr(f"not array_contains(coverage, {Entry(key).at}.s)")


def value_tests(v: Column) -> dict[str, Column]:
    """Of one value of a container or one operand."""
    return {
        "HexStringInvalidChar": (v.k == "hex") & v.s.rlike("[^0-9A-Fa-f \\t\\r\\n\\f\\x00]"),
        "HexStringOddLength": (v.k == "hex") & (F.length(F.regexp_replace(v.s, "[ \\t\\r\\n\\f\\x00]", "")) % 2 == 1),
        "IntegerOutOfRange": (v.k == "int") & scalars.integer_out_of_range(v.n),
        "RealOutOfRange": (v.k == "real") & scalars.real_out_of_range(v.n),
        "StringTooLong": (v.k == "str") & scalars.too_long(v.len, 65535),
        "NameTooLong": (v.k == "name") & scalars.too_long(v.len, 127),
    }


def value_findings(enabled: dict[str, int]) -> Column:
    """The rules that any value breaks, once each: one pass over the values that can break one."""
    risky = lambda v: v.k.isin("hex", "real") | (v.k.isin("int") & (F.abs(v.n) > 2147483647)) | (v.len > 127)
    one = lambda v: F.array_compact(F.array(*[F.when(t, F.lit(enabled[k])) for k, t in value_tests(v).items() if k in enabled]))
    found = F.flatten(F.transform(F.filter(F.map_values("entries"), risky), one))
    if "NameTooLong" in enabled:
        keys = F.exists(own_keys(), lambda k: F.length(k) > 127)
        found = F.concat(found, F.when(keys, F.array(F.lit(enabled["NameTooLong"]))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(found)


def container_rules() -> dict[str, Column]:
    """Of dictionaries, streams and arrays."""
    d, stream = F.col("kind").isin("dict", "stream"), F.col("kind") == "stream"
    image = stream & (name("Subtype") == "Image")
    form = stream & (name("Subtype") == "Form")
    gs, annot, font, cid, intent = (d & role(r) for r in ("gs", "annot", "font", "cidfont", "intent"))
    mask = truth("ImageMask")
    allowed = name("Subtype").isin(ANNOTATIONS)
    shown = annot & allowed & ~name("Subtype").isin("Popup", "Link")
    widget = d & (role("annot") | role("field")) & has("Rect") & ~F.coalesce(name("Subtype").isin("Popup", "Link"), F.lit(False))
    known = name("Subtype").isin(FONTS)
    simple = name("Subtype").isin("Type1", "MMType1", "TrueType")
    embedded = e("~Embedded").s
    symbolic = e("~Flags").n.cast("bigint").bitwiseAND(F.lit(4)) != 0
    trailer = role("trailer")
    device = F.create_map(*[F.lit(x) for x in ("DeviceRGB", "rgb", "DeviceCMYK", "cmyk", "DeviceGray", "gray")])
    action = d & (role("action") | (has("S") & name("S").isin(FORBIDDEN_ACTIONS + ["Named"]) & ~has("Type") | (name("Type") == "Action")))
    field = d & (role("field") | (role("annot") & (name("Subtype") == "Widget")))
    r = {
        "TrailerID": trailer & ~has("ID"),
        "TrailerEncrypt": trailer & has("Encrypt"),
        "StreamFileSpec": stream & has("F"),
        "StreamFileFilter": stream & has("FFilter"),
        "StreamFileDecodeParams": stream & has("FDecodeParms"),
        "StreamLZWFilter": stream & (name("Filter").isin("LZWDecode", "LZW") | ((e("Filter").k == "array") & F.concat(F.lit(" "), e("Filter").s, F.lit(" ")).rlike(" (LZWDecode|LZW) "))),
        "EmbeddedFileSpec": d & has("EF"),
        "EmbeddedFiles": d & has("EmbeddedFiles"),
        "ArrayTooLarge": (F.col("kind") == "array") & (F.size("entries") > 8191),
        "DictTooLarge": d & (F.size(own_keys()) > 4095),
        "DeviceNColorants": (F.col("kind") == "array") & (name("0") == "DeviceN") & (e("1").k == "array") & (e("1").len > 8),
        "OptionalContent": role("catalog") & F.map_contains_key("entries", F.lit("OCProperties")),
        "PostPDF14ViewerPref": role("viewer") & F.exists(own_keys(), lambda k: k.isin(*LATER_VIEWER_KEYS)),
        "OutputIntentNotArray": role("catalog") & has("OutputIntents") & (e("OutputIntents").k != "array"),
        "OutputIntentNotDict": role("catalog") & truth("~IntentNotDict"),
        "OutputIntentMultipleProfiles": role("catalog") & truth("~IntentProfiles"),
        "ICCBasedComponentsMismatch": intent & (e("~N").k == "int") & (e("~Space").k == "int") & (e("~N").n != e("~Space").n),
        "SeparationAlternateColour": (F.col("kind") == "array") & name("0").isin("Separation", "DeviceN") & ~F.array_contains("coverage", F.element_at(device, F.coalesce(name("2"), F.lit("")))),
        "CMapCIDOutOfRange": font & (e("~CID").n > 65535),
        "CMapWModeInconsistent": font & (e("~WModes").s == "false"),
        "SymbolicTrueTypeCmap": font & (name("Subtype") == "TrueType") & symbolic & (e("~Cmaps").n != 1),
        "OutputIntentInvalidS": intent & (e("S").k.isNull() | (e("S").k != "name")),
        "OutputIntentWrongS": intent & (name("S") != "GTS_PDFA1"),
        "OutputIntentMissingIdentifier": intent & (name("S").isNotNull()) & ~has("OutputConditionIdentifier"),
        "OutputIntentUnresolvedProfile": intent & name("S").isNotNull() & ~has("DestOutputProfile"),
        "OutputIntentInvalidProfile": intent & has("DestOutputProfile") & ~e("DestOutputProfile").k.isin("dict", "stream"),
        "OutputIntentMissingN": intent & e("DestOutputProfile").k.isin("dict", "stream") & (e("~N").k != "int"),
        "OutputIntentInvalidN": intent & (e("~N").k == "int") & ~e("~N").n.isin(1.0, 3.0, 4.0),
        "OutputIntentICCVersion": intent & e("~N").n.isin(1.0, 3.0, 4.0) & truth("~BadICC"),
        "DeviceColourSpaceUsage": (image | (d & role("shading"))) & ~mask_or_false(mask) & uncovered("~Model"),
        "ImageInterpolate": image & truth("Interpolate"),
        "ImageAlternates": image & has("Alternates"),
        "ImageOPI": image & has("OPI"),
        "ImageRenderingIntent": image & ~name("Intent").isin(*INTENTS),
        "ImageBitsPerComponent": image & ~mask_or_false(mask) & ~e("BitsPerComponent").n.isin(1.0, 2.0, 4.0, 8.0),
        "ImageMaskBitsPerComponent": image & mask & (e("BitsPerComponent").n != 1),
        "ImageWithSoftMask": image & has("SMask") & ~F.coalesce(name("SMask") == "None", F.lit(False)),
        "FormOPI": form & has("OPI"),
        "FormSubtype2PS": form & (name("Subtype2") == "PS"),
        "FormPSEntry": form & has("PS"),
        "FormPostScript": form & has("PS"),
        "ReferenceXObject": form & has("Ref"),
        "PostScriptXObject": stream & (name("Subtype") == "PS"),
        "TransferFunction": gs & has("TR"),
        "DefaultTransferFunction": gs & has("TR2") & ~F.coalesce(name("TR2") == "Default", F.lit(False)),
        "ExtGStateRenderingIntent": gs & ~name("RI").isin(*INTENTS),
        "SoftMaskExtGState": gs & has("SMask") & ~F.coalesce(name("SMask") == "None", F.lit(False)),
        "BlendMode": gs & has("BM") & ~F.coalesce(F.when(e("BM").k == "array", ~F.concat(F.lit(" "), e("BM").s, F.lit(" ")).rlike(" (?!Normal |Compatible )\\S")).otherwise(name("BM").isin("Normal", "Compatible")), F.lit(False)),
        "StrokingAlpha": gs & (F.abs(e("CA").n - 1) > 1e-5),
        "NonStrokingAlpha": gs & (F.abs(e("ca").n - 1) > 1e-5),
        "TransparencyGroup": d & (e("~GroupS").s == "Transparency"),
        "InvalidSubtype": (font | cid) & ~F.coalesce(known, F.lit(False)),
        "FontBaseFont": (font | cid) & known & (name("Subtype") != "Type3") & ~has("BaseFont"),
        "InvalidProgram": (font | cid) & known & (e("~Program").s == "false"),
        "CIDSystemInfoMismatch": font & (name("Subtype") == "Type0") & (e("~SameSystem").s == "false"),
        "CIDToGIDMapMissing": cid & (name("Subtype") == "CIDFontType2") & ~has("CIDToGIDMap"),
        "CMapNotEmbedded": font & (name("Subtype") == "Type0") & ~name("Encoding").isin(*CMAPS),
        "SimpleNotEmbedded": font & simple & (embedded == "none") & ~truth("~Invisible"),
        "CIDNotEmbedded": cid & name("Subtype").isin("CIDFontType0", "CIDFontType2") & (embedded == "none") & ~truth("~Invisible"),
        "TrueTypeEncoding": font & (name("Subtype") == "TrueType") & ~symbolic & ~F.coalesce(name("Encoding").isin("MacRomanEncoding", "WinAnsiEncoding") | e("Encoding").k.isin("dict"), F.lit(False)),
        "SymbolicTrueTypeEncoding": font & (name("Subtype") == "TrueType") & symbolic & has("Encoding"),
        "DisallowedSubtype": annot & ~F.coalesce(allowed, F.lit(False)),
        "PrintFlagNotSet": annot & allowed & ~bit("F", 3) & (name("Subtype") != "Popup"),
        "HiddenFlagSet": annot & allowed & bit("F", 2),
        "InvisibleFlagSet": annot & allowed & bit("F", 1),
        "NoViewFlagSet": annot & allowed & bit("F", 6),
        "OpacityNotOne": annot & allowed & (e("CA").n != 1.0),
        "MissingAppearance": shown & ~has("AP") & ~has("~FT"),
        "WidgetMissingAppearance": widget & ~has("AP") & has("~FT"),
        "AppearanceMissingN": shown & has("AP") & (e("~N").s == "none"),
        "AppearanceExtraEntries": shown & truth("~Extra"),
        "AppearanceNNotStream": shown & has("AP") & ((e("~N").s == "other") | F.when(e("~FT").s == "Btn", e("~N").s == "stream").otherwise(e("~N").s == "dict")),
        "ColourWithoutIntent": annot & allowed & (F.coalesce(uncovered("~ModelC"), F.lit(False)) | F.coalesce(uncovered("~ModelIC"), F.lit(False))),
        "ForbiddenActionType": action & name("S").isin(*FORBIDDEN_ACTIONS),
        "DisallowedNamedAction": action & (name("S") == "Named") & ~F.coalesce(name("N").isin(*NAMED_ACTIONS), F.lit(False)),
        "AdditionalActions": d & has("AA") & ~field,
        "FieldAdditionalActions": field & has("AA"),
        "FieldAction": field & has("A"),
        "NeedAppearances": role("acroform") & truth("NeedAppearances"),
        "XFA": role("acroform") & has("XFA"),
        "ObjectXMPNoXPacket": stream & role("metadata") & (e("~Catalog").s == "false") & (e("~XPacket").s == "false"),
    }
    return r


def mask_or_false(mask: Column) -> Column:
    return F.coalesce(mask, F.lit(False))


def operator_rules() -> dict[str, Column]:
    """Of content operators."""
    op = F.col("kind") == "op"
    o = F.col("op")
    model = F.when(o.isin("rg", "RG"), "rgb").when(o.isin("k", "K"), "cmyk").when(o.isin("g", "G"), "gray")
    return {
        "UndefinedOperator": op & ~o.isin(*OPERATORS),
        "RenderingIntent": op & (((o == "ri") & ~name("0").isin(*INTENTS)) | ((o == "BI") & ~name("Intent").isin(*INTENTS))),
        "InlineImageLZWFilter": op & (o == "BI") & F.coalesce(name("F"), name("Filter")).isin("LZW", "LZWDecode"),
        "ImageInterpolate": op & (o == "BI") & (truth("I") | truth("Interpolate")),
        "DeviceColourContentStream": op & ~F.array_contains("coverage", model),
    }


def file_rules() -> dict[str, Column]:
    """Of the header and the end of a file."""
    f = F.col("kind") == "file"
    line2, n = e("~line2").s, e("~line2").len
    comment = line2.startswith("25")
    return {
        "FileHeaderSignature": f & ~e("~line1").s.rlike("^%PDF-[0-9]\\.[0-9]$"),
        "FileHeaderComment": f & ~F.coalesce(comment, F.lit(False)),
        "FileHeaderCommentLength": f & comment & (n < 5),
        "FileHeaderCommentBytes": f & comment & (n >= 5) & F.substring(line2, 3, 8).rlike("^(..)*[0-7]."),
        "TrailerEOF": f & (e("~eof").s == "false"),
        "IndirectObjectsExceeded": f & (e("~objects").n == 0),
    }


#: Rules of containers by the gate that their rows must pass: role names, or = and a Subtype. The rest are for all.
GATES = {
    "gs": "TransferFunction DefaultTransferFunction ExtGStateRenderingIntent SoftMaskExtGState BlendMode StrokingAlpha NonStrokingAlpha",
    "annot": "DisallowedSubtype PrintFlagNotSet HiddenFlagSet InvisibleFlagSet NoViewFlagSet OpacityNotOne MissingAppearance AppearanceMissingN AppearanceExtraEntries AppearanceNNotStream ColourWithoutIntent",
    "font cidfont": "InvalidSubtype FontBaseFont InvalidProgram CIDSystemInfoMismatch CIDToGIDMapMissing CMapNotEmbedded SimpleNotEmbedded CIDNotEmbedded TrueTypeEncoding SymbolicTrueTypeEncoding CMapCIDOutOfRange CMapWModeInconsistent SymbolicTrueTypeCmap",
    "intent": "OutputIntentInvalidS OutputIntentWrongS OutputIntentMissingIdentifier OutputIntentUnresolvedProfile OutputIntentInvalidProfile OutputIntentMissingN OutputIntentInvalidN OutputIntentICCVersion ICCBasedComponentsMismatch",
    "trailer catalog viewer acroform": "TrailerID TrailerEncrypt OptionalContent PostPDF14ViewerPref OutputIntentNotArray OutputIntentNotDict OutputIntentMultipleProfiles NeedAppearances XFA",
    "annot field": "WidgetMissingAppearance FieldAdditionalActions FieldAction",
    "=Image": "ImageInterpolate ImageAlternates ImageOPI ImageRenderingIntent ImageBitsPerComponent ImageMaskBitsPerComponent ImageWithSoftMask",
    "=Form": "FormOPI FormSubtype2PS FormPSEntry FormPostScript ReferenceXObject",
}


def found(profile: Profile) -> Column:
    """The rules that a row breaks. A row is held against the rules of its kind and roles alone."""
    return _found(SparkContext.getOrCreate().applicationId, profile)


@lru_cache(32)
def _found(application: str, profile: Profile) -> Column:
    """Building some thousand nodes of an expression from Python takes seconds, so it is done once a context."""
    enabled = {c.name: c.check_id for c in profile.checks()}
    empty = F.array().cast("array<int>")

    def of(gate: Column, rules: dict[str, Column]) -> list[Column]:
        own = [F.when(v, expr(str(enabled[k]))) for k, v in rules.items() if k in enabled]
        return [F.when(gate, F.array_compact(F.array(*own))).otherwise(empty)] if own else []

    kind, rules = F.col("kind"), container_rules()
    container = ~kind.isin("op", "file")
    reached = ~role("unreached") if profile.skip_unreachable_forms else F.lit(True)
    if profile.skip_unused_simple_fonts:
        rules["SimpleNotEmbedded"] &= truth("~Shown")
    parts = of((kind == "op") & reached, operator_rules()) + of(kind == "file", file_rules())
    for gate, names in GATES.items():
        if gate[0] == "=":
            test = (kind == "stream") & (name("Subtype") == gate[1:]) & (reached if gate == "=Form" else F.lit(True))
        else:
            test = container & F.arrays_overlap("roles", F.array(*map(F.lit, gate.split())))
        parts += of(test, {k: rules.pop(k) for k in names.split()})
    parts += of(container, rules)
    if set(enabled) & set(value_tests(F.lit(None).cast("struct<k:string,s:string,n:double,len:int>"))):
        parts.append(F.when(kind != "file", value_findings(enabled)).otherwise(empty))
    model = {v for k, v in enabled.items() if check_by_name(k).group == "ObjectModel"}
    if model:
        parts.append(F.when(container, model_findings(model)).otherwise(empty))
    return F.concat(*parts) if parts else empty


def _known_faults(profile: Profile) -> Column:
    """The faults of a row of nodes() whose rules are enabled."""
    names = [c.name for c in profile.checks()]
    return F.filter("faults", lambda f: f.rule.isin(*names) if names else F.lit(False))


def _issues(profile: Profile) -> Column:
    """The issues of a row of nodes(), an array of (check_id, page): what its rules find, and its faults."""
    kinds = "array<struct<check_id:int,page:int>>"
    own = F.transform(found(profile), lambda k: F.struct(k.alias("check_id"), F.col("page").alias("page"))).cast(kinds)
    enabled = [(c.name, c.check_id) for c in profile.checks()]
    if not enabled:
        return own
    ids = expr("map(" + ", ".join(f"{quoted(k)}, {v}" for k, v in enabled) + ")")
    of = F.transform(_known_faults(profile), lambda f: F.struct(ids[f.rule].alias("check_id"), f.page.alias("page"))).cast(kinds)
    return F.concat(own, of)


def evaluate(rows: DataFrame, profile: Profile) -> DataFrame:
    """file_id, check_id, page of the issues that a profile's rules find in rows of nodes(), in one scan of them."""
    return rows.select("file_id", F.explode(_issues(profile)).alias("i")).select("file_id", "i.check_id", "i.page")


def file_results(rows: DataFrame, profile: Profile) -> DataFrame:
    """file_id, valid, n_issues of the files of nodes(), in one scan of their rows."""
    n = rows.select("file_id", (F.size(found(profile)) + F.size(_known_faults(profile))).alias("n")).groupBy("file_id").agg(F.sum("n").alias("n_issues"))
    return n.select("file_id", (F.col("n_issues") == 0).alias("valid"), "n_issues")


def verify(files: DataFrame, profile: Profile | str = "a_1b", reread: bool = True) -> tuple[DataFrame, DataFrame]:
    """The issues (file_id, check_id, page) of files (file_id, content), and for each file whether it is valid. Both
    are one scan of the files' rows. The rows are written once for the two; without reread nothing is written, and
    each of the two reads the files when it is used."""
    p = profiles()[profile] if isinstance(profile, str) else profile
    rows = written(nodes(files), "nodes") if reread else nodes(files)
    return evaluate(rows, p), file_results(rows, p)
