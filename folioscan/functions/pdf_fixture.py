"""Small files with one known defect each, as test inputs. The reader and the rules don't use this module."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.decoders import encode_ascii85, encode_lzw
from folioscan.functions.font_fixture import build_cff, build_sfnt, build_type1
from folioscan.functions.xmp import escape_text
from folioscan.sources.pdf_bytes import Dict, Hex, Lit, Name, Ref, format_value, write_document


#: Files that a task holds at once.
FILES_A_BATCH = 200


def stream(data: bytes, **entries: object) -> Dict:
    d = Dict({k: v for k, v in entries.items()})
    d.raw = data
    return d


def icc(space: bytes = b"RGB ", major: int = 2) -> bytes:
    p = bytearray(128)
    p[8], p[12:16], p[16:20], p[36:40] = major, b"mntr", space, b"acsp"
    return bytes(p)


def packet(title: str, part: str = "1", level: str = "B", extra: str = "", head: str = "") -> bytes:
    return (
        f'<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"{head}?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        '<rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<pdfaid:part>{part}</pdfaid:part><pdfaid:conformance>{level}</pdfaid:conformance>"
        f'<dc:title><rdf:Alt><rdf:li xml:lang="x-default">{escape_text(title)}</rdf:li></rdf:Alt></dc:title>{extra}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    ).encode()


#: A font with a glyph for x, of the width that the base file states, and one for y without an outline.
_PROGRAM = build_sfnt([0, 500, 300], {120: 1, 121: 2}, empty=(0, 2))


def base(text: str) -> tuple[dict[int, object], dict]:
    """A valid file's objects and trailer: a page, a form, an image, a graphics state, an annotation and a font."""
    title = text[:40].strip(" \n")
    # the whole text, in strings that no limit forbids
    whole = b"".join(b"/Span <</ActualText " + format_value(Lit(text[k : k + 8000].encode())) + b">> BDC EMC " for k in range(0, len(text), 8000))
    body = b"q /GS0 gs 0.5 0.5 0.5 rg 0 0 10 10 re f BT /F0 12 Tf (x) Tj ET Q " + whole
    ap = stream(b"0 0 1 1 re f", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 1, 1])
    objects: dict[int, object] = {
        1: Dict(Type=Name("Catalog"), Pages=Ref(2, 0), Metadata=Ref(4, 0), OutputIntents=[Ref(5, 0)]),
        2: Dict(Type=Name("Pages"), Kids=[Ref(3, 0)], Count=1),
        3: Dict(Type=Name("Page"), Parent=Ref(2, 0), MediaBox=[0, 0, 100, 100], Contents=Ref(7, 0), Annots=[Ref(12, 0)], Resources=Dict(Font=Dict(F0=Ref(8, 0)), ExtGState=Dict(GS0=Ref(10, 0)), XObject=Dict(Im0=Ref(11, 0), Fm0=Ref(14, 0)))),
        4: stream(packet(title), Type=Name("Metadata"), Subtype=Name("XML")),
        5: Dict(Type=Name("OutputIntent"), S=Name("GTS_PDFA1"), OutputConditionIdentifier=Lit(b"Custom"), DestOutputProfile=Ref(6, 0)),
        6: stream(zlib.compress(icc()), N=3, Filter=Name("FlateDecode")),
        7: stream(zlib.compress(body), Filter=Name("FlateDecode")),
        8: Dict(Type=Name("Font"), Subtype=Name("TrueType"), BaseFont=Name("ABCDEF+Own"), Encoding=Name("WinAnsiEncoding"), FirstChar=120, LastChar=120, Widths=[500], FontDescriptor=Ref(9, 0)),
        9: Dict(Type=Name("FontDescriptor"), FontName=Name("ABCDEF+Own"), Flags=32, FontFile2=Ref(15, 0)),
        10: Dict(Type=Name("ExtGState"), CA=1.0, ca=1, BM=Name("Normal"), SMask=Name("None")),
        11: stream(b"\0" * 3, Type=Name("XObject"), Subtype=Name("Image"), Width=1, Height=1, BitsPerComponent=8, ColorSpace=Name("DeviceRGB")),
        12: Dict(Type=Name("Annot"), Subtype=Name("Square"), Rect=[0, 0, 1, 1], F=4, AP=Dict(N=Ref(13, 0))),
        13: ap,
        14: stream(b"q Q", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 1, 1]),
        15: stream(_PROGRAM),
    }
    info = Dict(Title=Lit(b"\xfe\xff" + title.encode("utf-16-be")))
    objects[16] = info
    return objects, Dict(Root=Ref(1, 0), Info=Ref(16, 0), ID=[Hex(b"00ff"), Hex(b"00ff")])


def _set(num: int, **entries: object):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        for k, v in entries.items():
            if v is None:
                o[num].pop(k, None)
            else:
                o[num][k] = v

    return change


def _content(data: bytes):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[7] = stream(zlib.compress(data), Filter=Name("FlateDecode"))

    return change


def _xmp(**x: str):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[4] = stream(packet(text[:40].strip(" \n"), **x), Type=Name("Metadata"), Subtype=Name("XML"))

    return change


def _trailer(key: str, value: object):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        t.pop(key, None) if value is None else t.__setitem__(key, value)

    return change


def _image(data: bytes, **x: object):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[11] = stream(data, **{k: v for k, v in {**o[11], **x}.items() if v is not None})

    return change


def _type0(encoding: object = None, system: bytes = b"Adobe", cmap: bytes = b"", **x: object):
    """The font as a composite one."""

    def change(o: dict[int, object], t: dict, text: str) -> None:
        info = lambda r: Dict(Registry=Lit(r), Ordering=Lit(b"Identity"), Supplement=0)
        o[17] = stream(b"begincmap " + cmap + b" endcmap", Type=Name("CMap"), CIDSystemInfo=info(b"Adobe"), **{k: v for k, v in x.items() if k == "WMode"})
        o[18] = Dict({k: v for k, v in dict(Type=Name("Font"), Subtype=Name("CIDFontType2"), BaseFont=Name("ABCDEF+Own"), CIDSystemInfo=info(system), FontDescriptor=Ref(9, 0), CIDToGIDMap=x.get("gids", Name("Identity"))).items() if v is not None})
        o[9]["CIDSet"], o[19] = Ref(19, 0), stream(b"\x7f")
        o[8] = Dict(Type=Name("Font"), Subtype=Name("Type0"), BaseFont=Name("ABCDEF+Own"), Encoding=encoding or Ref(17, 0), DescendantFonts=[Ref(18, 0)])

    return change


_USE = '<own:n xmlns:own="http://own.example/">v</own:n>'


def _extension(container: str = "Bag", use: str = _USE, **fields: str) -> str:
    """An extension schema with one property, n, and its use; a field given as '' is left out."""
    f = {"name": "n", "valueType": "Text", "category": "external", "description": "d"} | fields
    more = f.pop("more", "")
    ns = "".join(f' xmlns:pdfa{k}="http://www.aiim.org/pdfa/ns/{u}"' for k, u in (("Extension", "extension/"), ("Schema", "schema#"), ("Property", "property#")))
    own = "".join(f"<pdfaProperty:{k}>{v}</pdfaProperty:{k}>" for k, v in f.items() if v) + more
    return (
        f'<pdfaExtension:schemas{ns}><rdf:{container}><rdf:li rdf:parseType="Resource"><pdfaSchema:schema>Own</pdfaSchema:schema><pdfaSchema:namespaceURI>http://own.example/</pdfaSchema:namespaceURI>'
        f'<pdfaSchema:prefix>own</pdfaSchema:prefix><pdfaSchema:property><rdf:Seq><rdf:li rdf:parseType="Resource">{own}</rdf:li></rdf:Seq></pdfaSchema:property></rdf:li></rdf:{container}></pdfaExtension:schemas>{use}'
    )


def _second_intent(o: dict[int, object], t: dict, text: str) -> None:
    o[17] = stream(icc() + b"more", N=3)
    o[1]["OutputIntents"] = [Ref(5, 0), Dict(Type=Name("OutputIntent"), S=Name("GTS_PDFA1"), OutputConditionIdentifier=Lit(b"x"), DestOutputProfile=Ref(17, 0))]


def _symbolic_cmap(o: dict[int, object], t: dict, text: str) -> None:
    o[9]["Flags"] = 4
    o[8].pop("Encoding")
    o[15] = stream(b"\0\1\0\0\0\1" + b"\0" * 6 + b"cmap" + b"\0" * 4 + (28).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\0\0\0\2")


def _font(program: Dict, key: str = "FontFile2", widths: list | None = None, subtype: str = "TrueType", descriptor: dict | None = None, show: bytes = b"(x)", **x: object):
    """The font with another program, and a page that shows some text in it."""

    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[15] = program
        o[9].pop("FontFile2")
        o[9][key] = Ref(15, 0)
        o[9].update(descriptor or {})
        o[8].update({"Subtype": Name(subtype), "Widths": widths or [500], "LastChar": 119 + len(widths or [500]), **x})
        _content(b"BT /F0 12 Tf " + show + b" Tj ET")(o, t, text)

    return change


def _cid(data: bytes, kind: str, key: str, bits: bytes | None, w: list, show: bytes = b"<0001>", **x: object):
    """The font as a composite one with a program of its own, under the identity."""

    def change(o: dict[int, object], t: dict, text: str) -> None:
        _type0(encoding=Name("Identity-H"))(o, t, text)
        o[18].update(Subtype=Name(kind), W=w, **x)
        if kind == "CIDFontType0":
            o[18].pop("CIDToGIDMap")
        o[9].pop("FontFile2")
        if bits is None:
            o[9].pop("CIDSet")
        else:
            o[19] = stream(bits)
        o[9][key], o[15] = Ref(15, 0), stream(data, Subtype=Name("CIDFontType0C"))
        _content(b"BT /F0 12 Tf " + show + b" Tj ET")(o, t, text)

    return change


def _type3(width: int):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[17] = stream(b"%d 0 d0 0 0 1 1 re f" % width)
        o[8] = Dict(Type=Name("Font"), Subtype=Name("Type3"), FontBBox=[0, 0, 1, 1], FontMatrix=[0.001, 0, 0, 0.001, 0, 0], CharProcs=Dict(sq=Ref(17, 0)), Encoding=Dict(Type=Name("Encoding"), Differences=[120, Name("sq")]), FirstChar=120, LastChar=120, Widths=[500])

    return change


_T1 = build_type1({".notdef": 0, "x": 500, "y": 600})
_C1 = build_cff(["x", "y"], [500, 600])
_CID = build_cff([], [500, 600], [1, 2])
_SFNT = build_sfnt([0, 500, 600], {120: 1, 121: 2})


def _annot(**x: object):
    return _set(12, **x)


def _widget(**x: object):
    """The annotation as a field."""

    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[12].update(Subtype=Name("Widget"), FT=Name("Tx"), T=Lit(b"f"), **{k: v for k, v in x.items() if v is not None})
        for k, v in x.items():
            if v is None:
                o[12].pop(k)
        o[1]["AcroForm"] = Dict(Fields=[Ref(12, 0)])

    return change


def _replace(old: bytes, new: bytes):
    return lambda b: b.replace(old, new, 1)


def _packet(old: str, new: str):
    def change(o: dict[int, object], t: dict, text: str) -> None:
        o[4].raw = o[4].raw.replace(old.encode(), new.encode())

    return change


def _default_space(model: bytes, key: str):
    """Device colour of a model without an intent for it, and resources that name a space instead."""

    def change(o: dict[int, object], t: dict, text: str) -> None:
        _content(model)(o, t, text)
        o[3]["Resources"]["ColorSpace"] = Dict({key: [Name("ICCBased"), Ref(6, 0)]})

    return change


def _table_as_stream(data: bytes) -> bytes:
    """The file with its classic table replaced by a stream of the same entries."""
    head, _, tail = data.partition(b"xref\n0 ")
    places = {int(m[1]): m.start() for m in re.finditer(rb"(?m)^(\d+) 0 obj", head)}
    num = max(places) + 1
    places[num] = len(head)
    rows = b"".join(bytes([1 if k in places else 0]) + places.get(k, 0).to_bytes(4, "big") + b"\0" for k in range(num + 1))
    trailer = tail[tail.index(b"<<") + 2 : tail.index(b"startxref")].rstrip().removesuffix(b">>")
    trailer = re.sub(rb"/Size \d+", b"/Size %d" % (num + 1), trailer)
    return head + b"%d 0 obj\n<<%s /Type /XRef /W [1 4 1] /Length %d>>\nstream\n" % (num, trailer, len(rows)) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(head)


def _colorants(o: dict[int, object], t: dict, text: str) -> None:
    """An image and a page in a space of nine colorants with a function."""
    o[17] = stream(b"{" + b"pop " * 6 + b"}", FunctionType=4, Domain=[0, 1] * 9, Range=[0, 1] * 3)
    o[18] = [Name("DeviceN"), [Name(f"C{k}") for k in range(9)], Name("DeviceRGB"), Ref(17, 0)]
    o[11] = stream(bytes(range(9)), **{**o[11], "ColorSpace": Ref(18, 0)})
    o[3]["Resources"]["ColorSpace"] = Dict(N9=Ref(18, 0))
    _content(b"/N9 cs 0.1 0.2 0.3 0 0 0 0 0 0 scn 0 0 1 1 re f")(o, t, text)


_TYPE = '<pdfaSchema:valueType><rdf:Seq><rdf:li rdf:parseType="Resource">{}</rdf:li></rdf:Seq></pdfaSchema:valueType>'


def _own_type(use: str, fields: tuple[str, ...] = ("type", "namespaceURI", "prefix", "description"), own: str = "", value: str = "Own") -> str:
    """An extension schema with a type of its own."""
    values = {"type": "Own", "namespaceURI": "http://own.example/", "prefix": "own", "description": "d"}
    made = "".join(f"<pdfaType:{k}>{values[k]}</pdfaType:{k}>" for k in fields)
    text = _extension(valueType=value, use=use)
    text = text.replace("<pdfaExtension:schemas", '<pdfaExtension:schemas xmlns:pdfaType="http://www.aiim.org/pdfa/ns/type#" xmlns:pdfaField="http://www.aiim.org/pdfa/ns/field#"', 1)
    return text.replace("</pdfaSchema:property></rdf:li>", f"</pdfaSchema:property>{_TYPE.format(made)}{own}</rdf:li>")


_STRUCT = '<own:n rdf:parseType="Resource" xmlns:own="http://own.example/"><own:n>v</own:n></own:n>'

#: Defects by name: a change of the objects, or of the bytes, and the rules that must be found, with their counts.
DEFECTS: list[tuple[str, object, list[str]]] = [
    ("none", lambda o, t, x: None, []),
    ("no_id", _trailer("ID", None), ["TrailerID"]),
    ("encrypted", _trailer("Encrypt", Dict(Filter=Name("Standard"))), ["TrailerEncrypt"]),
    ("info_array", _trailer("Info", [1]), ["InfoDictUnreadable", "WrongValueType"]),
    ("info_empty", _set(16, Author=Lit(b"")), ["InfoDictEmptyValues"]),
    ("info_differs", _set(16, Title=Lit(b"another")), ["InfoXMPSync", "InfoDictXMPMismatch"]),
    ("stream_f", _set(14, F=Lit(b"x.bin")), ["StreamFileSpec"]),
    ("stream_ffilter", _set(14, FFilter=Name("FlateDecode")), ["StreamFileFilter"]),
    ("stream_fparms", _set(14, FDecodeParms=Dict()), ["StreamFileDecodeParams"]),
    ("lzw", lambda o, t, x: o.__setitem__(14, stream(encode_lzw(b"q Q"), **{**o[14], "Filter": Name("LZWDecode")})), ["StreamLZWFilter"]),
    ("embedded", _set(1, Names=Dict(EmbeddedFiles=Dict(Names=[]))), ["EmbeddedFiles"]),
    ("big_int", _set(9, StemV=3000000000), ["IntegerOutOfRange"]),
    ("big_real", _set(9, ItalicAngle=40000.5), ["RealOutOfRange"]),
    ("hex_bad", _set(9, CharSet=Hex(b"0g")), ["HexStringInvalidChar"]),
    ("hex_odd", _set(9, CharSet=Hex(b"0 0 1")), ["HexStringOddLength"]),
    ("long_name", _set(9, FontFamily=Name("n" * 128)), ["NameTooLong"]),
    ("optional", _set(1, OCProperties=Dict(OCGs=[], D=Dict())), ["OptionalContent", "KeyIntroducedAfterPDF14"]),
    ("viewer", _set(1, ViewerPreferences=Dict(Duplex=Name("Simplex"))), ["PostPDF14ViewerPref"]),
    ("intent_s", _set(5, S=Name("GTS_PDFX")), ["OutputIntentWrongS", "DeviceColourContentStream", "DeviceColourSpaceUsage"]),
    ("intent_id", _set(5, OutputConditionIdentifier=None), ["OutputIntentMissingIdentifier", "MissingRequiredKey"]),
    ("intent_icc", lambda o, t, x: o.__setitem__(6, stream(icc(major=4), N=3)), ["OutputIntentICCVersion"]),
    ("cmyk", _content(b"0 0 0 1 k 0 0 1 1 re f"), ["DeviceColourContentStream"]),
    ("nesting", _content(b"q " * 30 + b"Q " * 30), ["GraphicsStateNesting"] * 2),
    ("operator", _content(b"1 xyz"), ["UndefinedOperator"]),
    ("intent_op", _content(b"/Vivid ri"), ["RenderingIntent"]),
    ("image_interpolate", _image(b"\0" * 3, Interpolate=True), ["ImageInterpolate"]),
    ("image_alternates", _image(b"\0" * 3, Alternates=[]), ["ImageAlternates"]),
    ("image_bits", _image(b"\0" * 6, BitsPerComponent=16), ["ImageBitsPerComponent"]),
    ("image_mask", _image(b"\0", ImageMask=True, BitsPerComponent=2, ColorSpace=None), ["ImageMaskBitsPerComponent"]),
    ("image_cmyk", _image(b"\0" * 4, ColorSpace=Name("DeviceCMYK")), ["DeviceColourSpaceUsage"]),
    ("soft_mask", _image(b"\0" * 3, SMask=Ref(14, 0)), ["ImageWithSoftMask"]),
    ("form_ref", _set(14, Ref=Dict()), ["ReferenceXObject"]),
    ("form_group", _set(14, Group=Dict(S=Name("Transparency"))), ["TransparencyGroup"]),
    ("transfer", _set(10, TR=Name("Identity")), ["TransferFunction"]),
    ("blend", _set(10, BM=Name("Multiply")), ["BlendMode"]),
    ("alpha", _set(10, CA=0.5), ["StrokingAlpha"]),
    ("fill_alpha", _set(10, ca=0.999), ["NonStrokingAlpha"]),
    ("gs_mask", _set(10, SMask=Dict()), ["SoftMaskExtGState"]),
    ("font_subtype", _set(8, Subtype=Name("Type9")), ["InvalidSubtype"]),
    ("font_base", _set(8, BaseFont=None), ["FontBaseFont", "MissingRequiredKey"]),
    ("font_program", lambda o, t, x: o.__setitem__(15, stream(b"nothing")), ["InvalidProgram"]),
    ("font_missing", _set(9, FontFile2=None), ["SimpleNotEmbedded"]),
    ("font_symbolic", _set(9, Flags=4), ["SymbolicTrueTypeEncoding"]),
    ("annot_subtype", _set(12, Subtype=Name("Movie")), ["DisallowedSubtype"]),
    ("annot_hidden", _set(12, F=6), ["HiddenFlagSet"]),
    ("annot_flags", _set(12, F=0), ["PrintFlagNotSet"]),
    ("annot_opacity", _set(12, CA=0.5), ["OpacityNotOne"]),
    ("annot_ap", _set(12, AP=None), ["MissingAppearance"]),
    ("annot_ap_extra", _set(12, AP=Dict(N=Ref(13, 0), D=Ref(13, 0))), ["AppearanceExtraEntries"]),
    ("action", _set(1, OpenAction=Dict(S=Name("JavaScript"), JS=Lit(b"1"))), ["ForbiddenActionType"]),
    ("action_named", _set(1, OpenAction=Dict(S=Name("Named"), N=Name("Print"))), ["DisallowedNamedAction"]),
    ("additional", _set(3, AA=Dict()), ["AdditionalActions"]),
    ("form_appearances", _set(1, AcroForm=Dict(Fields=[], NeedAppearances=True)), ["NeedAppearances"]),
    ("xfa", _set(1, AcroForm=Dict(Fields=[], XFA=Lit(b"x"))), ["XFA"]),
    ("xmp_missing", _set(1, Metadata=None), ["MetadataMissing"]),
    ("xmp_filter", lambda o, t, x: o.__setitem__(4, stream(encode_ascii85(o[4].raw), Filter=Name("ASCII85Decode"))), ["MetadataFiltered"]),
    ("xmp_part", _xmp(part="2"), ["PDFAPartNumber"]),
    ("xmp_level", _xmp(level="U"), ["PDFAConformanceLevel"]),
    ("xmp_broken", _xmp(extra="<a><b></a>"), ["XMPNotWellFormed"]),
    ("xmp_bytes", _xmp(head=' bytes="10"'), ["XPacketBytesAttribute"]),
    ("intent_not_dict", _set(1, OutputIntents=[Ref(5, 0), 7]), ["OutputIntentNotDict"]),
    ("intent_two", _second_intent, ["OutputIntentMultipleProfiles"]),
    ("icc_components", lambda o, t, x: o.__setitem__(6, stream(icc(b"GRAY"), N=3)), ["ICCBasedComponentsMismatch"]),
    ("separation", _image(b"\0", ColorSpace=[Name("Separation"), Name("Spot"), Name("DeviceCMYK"), Ref(14, 0)]), ["SeparationAlternateColour"]),
    ("composite", _type0(), []),
    ("cmap_cid", _type0(cmap=b"1 begincidrange <0000> <ffff> 70000 endcidrange"), ["CMapCIDOutOfRange"]),
    ("cmap_wmode", _type0(cmap=b"/WMode 0 def", WMode=1), ["CMapWModeInconsistent"]),
    ("cmap_name", _type0(encoding=Name("Own-H")), ["CMapNotEmbedded"]),
    ("cid_system", _type0(system=b"Other"), ["CIDSystemInfoMismatch"]),
    ("cid_map", _type0(gids=None), ["CIDToGIDMapMissing"]),
    ("symbolic_cmap", _symbolic_cmap, ["SymbolicTrueTypeCmap"]),
    ("model_enum", _set(1, PageMode=Name("Odd")), ["DisallowedValue"]),
    ("model_rotate", _set(3, Rotate=45), ["ConstraintViolated"]),
    ("model_missing", _set(14, BBox=None), ["MissingRequiredKey"]),
    ("model_kind", _set(14, FormType=Name("One")), ["WrongValueType"]),
    ("model_direct", lambda o, t, x: o[8].__setitem__("FontDescriptor", Dict(o[9])), ["IndirectRequired"]),
    ("model_widths", _set(8, Widths=[500, 300]), ["ConstraintViolated"]),
    ("model_range", _set(10, LW=-1), ["DisallowedValue"]),
    ("model_later", _set(3, UserUnit=2.0), ["KeyIntroducedAfterPDF14"]),
    ("extension", _xmp(extra=_extension()), []),
    ("extension_field", _xmp(extra=_extension(category="", description="")), ["ExtPropertyMissingField"] * 2),
    ("extension_names", _xmp(extra=_extension(more="<pdfaProperty:name>m</pdfaProperty:name>")), ["ExtPropertyMultipleName"]),
    ("extension_seq", _xmp(extra=_extension("Seq")), ["ExtSchemasNotBag"]),
    ("extension_use", _xmp(extra=_extension(use=_USE.replace("own:n", "own:z"))), ["ExtPropertyUndocumented"]),
    ("extension_type", _xmp(extra=_extension(valueType="Odd")), ["ExtPropertyUndefinedType", "ExtPropertyComplexAsSimple"]),
    ("extension_prefix", _xmp(extra='<ext:schemas xmlns:ext="http://www.aiim.org/pdfa/ns/extension/"/>'), ["ExtSchemaNamespace"]),
    ("extension_uri", _xmp(extra='<pdfaExtension:schemas xmlns:pdfaExtension="http://other.example/"/>'), ["ExtSchemaWrongPrefixURI"]),
    ("namespace", _xmp(extra=_USE), ["MetadataUndeclaredProperty"]),
    ("inline_lzw", _content(b"BI /W 1 /H 1 /BPC 8 /CS /G /F /LZW ID " + encode_lzw(b"\0") + b"\nEI"), ["InlineImageLZWFilter"]),
    ("font_width", _set(8, Widths=[510]), ["AdvanceWidthMismatch"]),
    ("font_coverage", _set(8, Widths=[500, 300, 400], LastChar=122), []),
    ("font_shown", _font(stream(_SFNT), widths=[500, 600, 400], show=b"(xz)"), ["SubsetGlyphCoverage"]),
    ("font_type1", _font(stream(_T1), "FontFile", [500, 600], "Type1", {"CharSet": Lit(b"/x/y")}), []),
    ("font_char_set", _font(stream(_T1), "FontFile", [500, 600], "Type1", {"CharSet": Lit(b"/x")}, b"(xy)"), ["Type1SubsetCharSet"]),
    ("font_char_set_none", _font(stream(_T1), "FontFile", [500, 600], "Type1"), ["Type1SubsetCharSet"]),
    ("font_type1_width", _font(stream(_T1), "FontFile", [500, 650], "Type1", {"CharSet": Lit(b"/x/y")}), ["AdvanceWidthMismatch"]),
    ("font_compact", _font(stream(_C1, Subtype=Name("Type1C")), "FontFile3", [500, 600], "Type1", {"CharSet": Lit(b"/x/y")}, b"(xy)"), []),
    ("font_compact_width", _font(stream(_C1, Subtype=Name("Type1C")), "FontFile3", [500, 604], "Type1", {"CharSet": Lit(b"/x/y")}, b"(xy)"), ["AdvanceWidthMismatch"]),
    ("cid_true_type", _cid(_SFNT, "CIDFontType2", "FontFile2", b"\x60", [1, [500, 600]]), []),
    ("cid_no_set", _cid(_SFNT, "CIDFontType2", "FontFile2", None, [1, [500, 600]]), ["CIDSubsetCIDSet"]),
    ("cid_short_set", _cid(_SFNT, "CIDFontType2", "FontFile2", b"\x40", [1, [500, 600]]), ["CIDSubsetCIDSet"]),
    ("cid_width", _cid(_SFNT, "CIDFontType2", "FontFile2", b"\x60", [1, [500, 620]]), ["AdvanceWidthMismatch"]),
    ("cid_default_width", _cid(_SFNT, "CIDFontType2", "FontFile2", b"\x60", [1, [500]], b"<00010002>"), ["AdvanceWidthMismatch"]),
    ("cid_glyph", _cid(_SFNT, "CIDFontType2", "FontFile2", b"\x60", [1, [500, 600]], b"<0009>"), ["SubsetGlyphCoverage"]),
    ("cid_compact", _cid(_CID, "CIDFontType0", "FontFile3", b"\xe0", [1, [500, 600]], b"<00010002>"), []),
    ("cid_compact_set", _cid(_CID, "CIDFontType0", "FontFile3", b"\xc0", [1, [500, 600]]), ["CIDSubsetCIDSet"]),
    ("cid_compact_width", _cid(_CID, "CIDFontType0", "FontFile3", b"\xe0", [1, [540, 600]]), ["AdvanceWidthMismatch"]),
    ("cid_compact_glyph", _cid(_CID, "CIDFontType0", "FontFile3", b"\xe0", [1, 3, 500], b"<0003>"), ["SubsetGlyphCoverage"]),
    ("type3", _type3(500), []),
    ("type3_width", _type3(502), ["AdvanceWidthMismatch"]),
    ("invisible", lambda o, t, x: (o[9].pop("FontFile2"), _content(b"BT 3 Tr /F0 12 Tf (x) Tj ET")(o, t, x)), []),
    ("cid_missing", lambda o, t, x: (_type0()(o, t, x), o[9].pop("FontFile2")), ["CIDNotEmbedded"]),
    ("font_encoding", _set(8, Encoding=Name("StandardEncoding")), ["TrueTypeEncoding"]),
    ("default_cmyk", _default_space(b"0 0 0 1 k 0 0 1 1 re f", "DefaultCMYK"), []),
    ("default_other", _default_space(b"0 0 0 1 k 0 0 1 1 re f", "DefaultRGB"), ["DeviceColourContentStream"]),
    ("ef", _set(3, EF=Dict()), ["EmbeddedFileSpec"]),
    ("big_array", _set(9, Big=[0] * 8192), ["ArrayTooLarge"]),
    ("big_dict", lambda o, t, x: o[9].__setitem__("Big", Dict({f"K{k}": 0 for k in range(4096)})), ["DictTooLarge"]),
    ("big_string", _set(9, Big=Lit(b"s" * 65536)), ["StringTooLong"]),
    ("colorants", _image(b"\0", ColorSpace=[Name("DeviceN"), [Name(f"C{k}") for k in range(9)], Name("DeviceRGB"), Ref(14, 0)]), ["DeviceNColorants"]),
    ("colorants_function", _colorants, ["DeviceNColorants"]),
    ("big_resources", lambda o, t, x: o[3]["Resources"]["ExtGState"].update({f"G{k}": Ref(10, 0) for k in range(4100)}), ["DictTooLarge"]),
    ("intent_array", _set(1, OutputIntents=Dict()), ["OutputIntentNotArray", "DeviceColourContentStream", "DeviceColourSpaceUsage", "WrongValueType"]),
    ("intent_s_kind", _set(5, S=Lit(b"GTS_PDFA1")), ["OutputIntentInvalidS", "DeviceColourContentStream", "DeviceColourSpaceUsage", "WrongValueType"]),
    ("intent_profile", _set(5, DestOutputProfile=None), ["OutputIntentUnresolvedProfile", "DeviceColourContentStream", "DeviceColourSpaceUsage"]),
    ("intent_profile_kind", _set(5, DestOutputProfile=7), ["OutputIntentInvalidProfile", "DeviceColourContentStream", "DeviceColourSpaceUsage", "WrongValueType"]),
    ("intent_n", _set(6, N=None), ["OutputIntentMissingN", "DeviceColourContentStream", "DeviceColourSpaceUsage"]),
    ("intent_n_wrong", _set(6, N=2), ["OutputIntentInvalidN", "ICCBasedComponentsMismatch", "DeviceColourContentStream", "DeviceColourSpaceUsage"]),
    ("image_opi", _image(b"\0" * 3, OPI=Dict()), ["ImageOPI"]),
    ("image_intent", _image(b"\0" * 3, Intent=Name("Vivid")), ["ImageRenderingIntent"]),
    ("form_opi", _set(14, OPI=Dict()), ["FormOPI"]),
    ("form_subtype2", _set(14, Subtype2=Name("PS")), ["FormSubtype2PS"]),
    ("form_ps", _set(14, PS=Ref(14, 0)), ["FormPSEntry", "FormPostScript"]),
    ("postscript", _set(14, Subtype=Name("PS")), ["PostScriptXObject"]),
    ("transfer2", _set(10, TR2=Name("Identity")), ["DefaultTransferFunction"]),
    ("gs_intent", _set(10, RI=Name("Vivid")), ["ExtGStateRenderingIntent"]),
    ("annot_invisible", _annot(F=5), ["InvisibleFlagSet"]),
    ("annot_no_view", _annot(F=36), ["NoViewFlagSet"]),
    ("annot_ap_n", _annot(AP=Dict(N=None)), ["AppearanceMissingN"]),
    ("annot_ap_dict", _annot(AP=Dict(N=Dict(On=Ref(13, 0)))), ["AppearanceNNotStream"]),
    ("annot_colour", _annot(C=[0, 0, 0, 1]), ["ColourWithoutIntent"]),
    ("widget", _widget(), []),
    ("widget_action", _widget(A=Dict(S=Name("GoTo"), D=[])), ["FieldAction"]),
    ("widget_additional", _widget(AA=Dict()), ["FieldAdditionalActions"]),
    ("widget_ap", _widget(AP=None), ["WidgetMissingAppearance"]),
    ("xmp_description", _xmp(extra="<dc:description>plain</dc:description>"), ["MetadataFiltered", "MetadataPropertyType"]),
    ("xmp_encoding", _xmp(head=' encoding="UTF-8"'), ["XPacketEncodingAttribute"]),
    ("xmp_object", lambda o, t, x: (o.__setitem__(17, stream(b"<x/>", Type=Name("Metadata"))), o[14].__setitem__("Metadata", Ref(17, 0))), ["ObjectXMPNoXPacket"]),
    ("xmp_unread", lambda o, t, x: o.__setitem__(4, stream(b"\0\0", Type=Name("Metadata"), Subtype=Name("XML"), Filter=Name("JBIG2Decode"))), ["MetadataFiltered", "XMPStreamUnreadable"]),
    ("xmp_no_id", _packet("pdfaid", "other"), ["PDFAIdentifierMissing"]),
    ("xmp_id_part", _packet("<pdfaid:part>1</pdfaid:part>", ""), ["PDFAIdentifierMissing"]),
    ("xmp_id_uri", _packet("pdfa/ns/id/", "pdfa/ns/ids/"), ["PDFAIdentifierNamespace"]),
    ("xmp_id_more", _xmp(extra="<pdfaid:own>1</pdfaid:own>"), ["PDFAIdentifierUndefinedProperty"]),
    ("xmp_property", _xmp(extra="<dc:colour>red</dc:colour>"), ["MetadataFiltered"]),
    ("xmp_form", _xmp(extra="<dc:subject>one</dc:subject>"), ["MetadataFiltered"]),
    ("xmp_value", _xmp(extra="<dc:date><rdf:Seq><rdf:li>yesterday</rdf:li></rdf:Seq></dc:date>"), ["MetadataFiltered"]),
    ("xmp_language", _xmp(extra="<dc:rights><rdf:Alt><rdf:li>mine</rdf:li></rdf:Alt></dc:rights>"), ["MetadataFiltered"]),
    ("extension_struct", _xmp(extra=_own_type(_STRUCT)), []),
    ("extension_simple", _xmp(extra=_own_type(_USE)), ["ExtPropertyComplexAsSimple"]),
    ("extension_own_type", _xmp(extra=_own_type(_STRUCT, ("type", "namespaceURI", "description"))), ["ExtTypeInvalid"]),
    ("extension_own_field", _xmp(extra=_own_type(_STRUCT, own=_TYPE.format("<pdfaField:name>f</pdfaField:name><pdfaField:valueType>Text</pdfaField:valueType>"))), ["ExtFieldInvalid"]),
    ("comment", _replace(b"%\xe2\xe3\xcf\xd3\n", b"\n"), ["FileHeaderComment", "XRefKeyword"]),
    ("comment_short", _replace(b"%\xe2\xe3\xcf\xd3\n", b"%\xe2\xe3\n  "), ["FileHeaderCommentLength"]),
    ("xref_space", _replace(b"xref\n0 ", b"xref\n\n0 "), ["XRefSubsectionHeader"]),
    ("xref_header", _replace(b"xref\n0 ", b"xref\n0  "), ["XRefSubsectionHeaderFormat"]),
    ("stream_eol", _replace(b"stream\n\0\0\0\nendstream", b"stream\r\0\0\0\nendstream"), ["StreamKeywordEOL"]),
    ("endstream_eol", _replace(b"\0\0\0\nendstream", b"\0\0\0endstream\n"), ["EndstreamEOL"]),
    ("stream_length", _replace(b"/Length 3 /Subtype /Form", b"/Length 2 /Subtype /Form"), ["StreamLengthMismatch"]),
    ("stream_length_eol", _replace(b"/Length 3 /Subtype /Form", b"/Length 4 /Subtype /Form"), ["StreamLengthIncludesEOL"]),
    ("table_stream", lambda b: _table_as_stream(b), ["XRefStream"]),
    ("nothing", lambda b: b"nothing", ["GraphResolutionFailure", "FileHeaderSignature", "FileHeaderComment", "TrailerEOF", "IndirectObjectsExceeded"]),
    ("object_framing", _replace(b"12 0 obj\n", b"12 0 obj "), ["ObjectFraming"]),
    ("eof", lambda b: b + b"trailing bytes after the end", ["TrailerEOF"]),
    ("header", lambda b: b.replace(b"%PDF-1.4\n", b"%PDF-1x4\n", 1), ["FileHeaderSignature"]),
    ("comment_bytes", lambda b: b.replace(b"%\xe2\xe3\xcf\xd3", b"%abcd", 1), ["FileHeaderCommentBytes"]),
]
_BYTES = {"eof", "header", "comment_bytes", "comment", "comment_short", "xref_space", "xref_header", "stream_eol", "endstream_eol", "stream_length", "stream_length_eol", "object_framing", "table_stream", "nothing"}


def make(text: str, defect: int) -> bytes:
    """The file of a text with the defect of that number."""
    name, change, _ = DEFECTS[defect]
    o, t = base(text)
    if name not in _BYTES:
        change(o, t, text)
    out = write_document(o, t)
    return change(out) if name in _BYTES else out


def make_files(texts: DataFrame) -> DataFrame:
    """file_id, content: a file for each row (file_id, text), with defect file_id modulo their number."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FILES_A_BATCH):
                b = whole.slice(at, FILES_A_BATCH)
                out = [make(t or "", k % len(DEFECTS)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["file_id", "content"])

    return texts.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, "file_id bigint, content binary")
