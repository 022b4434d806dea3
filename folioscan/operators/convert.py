"""Repair of files: named fixers over a file's objects, driven by the issues that the rules find.

convert() is the fixpoint of operators.fixpoint: files that still have issues are verified, mended in the tasks, a file
at a time, and written again; the others rest. What every conversion does beside the issues (metadata packet, information
entries, colour intent) is done in the first round.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import xmp
from folioscan.operators import colour_repair, font_repair, raster_repair
from folioscan.functions.decoders import lzw
from folioscan.operators.fixpoint import MAX_ROUNDS, repair
from folioscan.operators.graph import written
from folioscan.operators.results import results
from folioscan.operators.rules import ANNOTATIONS, FORBIDDEN_ACTIONS, INTENTS, LATER_VIEWER_KEYS, NAMED_ACTIONS, OPERATORS, evaluate
from folioscan.operators.schema import KINDS, condition_bounds
from folioscan.plans.catalog import Profile, all_checks, profiles
from folioscan.plans.conditions import TOLERANCE
from folioscan.plans.object_model import TYPES
from folioscan.sources.pdf import INFO_KEYS, entry, nodes, slices
from folioscan.sources.pdf_bytes import Dict, Document, Hex, Lit, Name, ParseError, Ref, format_value, text_string, tokenize_content, write_document

MAX_INT, MAX_REAL, MAX_STRING, MAX_NAME, MAX_NESTING = 2147483647, 32767.0, 65535, 127, 28


class Editor:
    """All objects of a file by number, to be changed in place."""

    def __init__(self, data: bytes):
        self.doc = Document(data).open()
        if self.doc.error:
            raise ParseError(self.doc.error)
        self.objects = {n: v for n in sorted(self.doc.xref) if n and (v := self.doc.resolve(Ref(n, 0))) is not None and not (isinstance(v, Dict) and v.get("Type") in ("XRef", "ObjStm"))}
        self.trailer = Dict({k: self.doc.trailer[k] for k in ("Root", "Info", "ID") if k in self.doc.trailer})

    def get(self, v: object) -> object:
        while isinstance(v, Ref):
            v = self.objects.get(v.num)
        return v

    def add(self, v: object) -> Ref:
        n = max(self.objects, default=0) + 1
        self.objects[n] = v
        return Ref(n, 0)

    def dicts(self) -> Iterator[Dict]:
        """Every dictionary, once."""
        seen, todo = set(), [*self.objects.values(), self.trailer]
        while todo:
            v = todo.pop()
            if isinstance(v, (dict, list)) and id(v) not in seen:
                seen.add(id(v))
                todo += v.values() if isinstance(v, dict) else v
                if isinstance(v, Dict):
                    yield v

    def containers(self) -> Iterator[dict | list]:
        seen, todo = set(), [*self.objects.values()]
        while todo:
            v = todo.pop()
            if isinstance(v, (dict, list)) and id(v) not in seen:
                seen.add(id(v))
                todo += v.values() if isinstance(v, dict) else v
                yield v

    def under(self, key: str) -> Iterator[Dict]:
        """The dictionaries among the values of all dictionaries' entries of a key."""
        for d in list(self.dicts()):
            m = self.get(d.get(key))
            for x in m.values() if isinstance(m, dict) else m if isinstance(m, list) else ():
                if isinstance(x := self.get(x), Dict):
                    yield x

    @property
    def catalog(self) -> Dict:
        c = self.get(self.trailer.get("Root"))
        return c if isinstance(c, Dict) else Dict()

    def body(self, s: Dict) -> bytes:
        return self.doc.decoded(s)

    def set_body(self, s: Dict, data: bytes) -> None:
        s.raw = zlib.compress(data)
        s["Filter"] = Name("FlateDecode")
        s.pop("DecodeParms", None)

    def contents(self) -> Iterator[Dict]:
        seen: set[int] = set()
        for d in list(self.dicts()):
            own = []
            if d.get("Type") == "Page" and (c := self.get(d.get("Contents"))) is not None:
                own = [self.get(x) for x in c] if isinstance(c, list) else [c]
            if d.is_stream and d.get("Subtype") == "Form":
                own.append(d)
            for s in own:
                if isinstance(s, Dict) and s.is_stream and id(s) not in seen:
                    seen.add(id(s))
                    yield s

    def write(self) -> bytes:
        self.trailer.setdefault("ID", [Hex(b"00" * 16), Hex(b"00" * 16)])
        return write_document(self.objects, self.trailer)


def drop(*keys: str, of: Callable[[Editor], Iterator[Dict]] = Editor.dicts) -> Callable[[Editor], None]:
    def fix(e: Editor) -> None:
        for d in list(of(e)):
            for k in keys:
                d.pop(k, None)

    return fix


def images(e: Editor) -> Iterator[Dict]:
    return (d for d in e.dicts() if d.is_stream and d.get("Subtype") == "Image")


def forms(e: Editor) -> Iterator[Dict]:
    return (d for d in e.dicts() if d.is_stream and d.get("Subtype") == "Form")


def annotations(e: Editor) -> Iterator[Dict]:
    return e.under("Annots")


def image_metadata(e: Editor) -> None:
    for d in list(images(e)):
        for k in ("Alternates", "OPI"):
            d.pop(k, None)
        if d.get("Interpolate") is True:
            d["Interpolate"] = False
        if "Intent" in d and d["Intent"] not in INTENTS:
            d.pop("Intent")
    drop("OPI", "Ref", of=forms)(e)


def postscript(e: Editor) -> None:
    drop("PS", of=forms)(e)
    for d in list(forms(e)):
        if d.get("Subtype2") == "PS":
            d.pop("Subtype2")


def graphics_states(e: Editor) -> None:
    for g in e.under("ExtGState"):
        g.pop("TR", None)
        if g.get("TR2") not in (None, "Default"):
            g["TR2"] = Name("Default")
        if g.get("RI") is not None and g["RI"] not in INTENTS:
            g["RI"] = Name("RelativeColorimetric")
        if g.get("SMask") is not None:
            g["SMask"] = Name("None")
        if g.get("BM") is not None:
            g["BM"] = Name("Normal")
        for k in ("CA", "ca"):
            if k in g:
                g[k] = 1.0


def annotation_flags(e: Editor) -> None:
    for a in annotations(e):
        f = e.get(a.get("F"))
        a["F"] = (f if isinstance(f, int) else 0) & ~35 | 4
        if a.get("CA") is not None and a["CA"] != 1.0:
            a["CA"] = 1.0


def disallowed_annotations(e: Editor) -> None:
    for d in list(e.dicts()):
        if isinstance(kids := e.get(d.get("Annots")), list):
            d["Annots"] = [a for a in kids if isinstance(x := e.get(a), Dict) and x.get("Subtype") in ANNOTATIONS]


def annotation_colours(e: Editor) -> None:
    drop("C", "IC", of=annotations)(e)


def appearances(e: Editor) -> None:
    for a in annotations(e):
        if a.get("Subtype") in ("Popup", "Link"):
            continue
        ap = e.get(a.get("AP"))
        n = e.get(ap.get("N")) if isinstance(ap, Dict) else None
        if not (isinstance(n, Dict) and (n.is_stream or e.get(a.get("FT")) == "Btn")):
            r = e.get(a.get("Rect"))
            w, h = (r[2] - r[0], r[3] - r[1]) if isinstance(r, list) and len(r) == 4 and all(isinstance(x, (int, float)) for x in r) else (0, 0)
            s = Dict(Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, w, h])
            s.raw = b""
            a["AP"] = Dict(N=e.add(s))
        else:
            a["AP"] = Dict(N=ap["N"])


def actions(e: Editor) -> None:
    for d in list(e.dicts()):
        d.pop("AA", None)
        for k in ("A", "OpenAction", "Next"):
            a = e.get(d.get(k))
            if isinstance(a, Dict) and (a.get("S") in FORBIDDEN_ACTIONS or a.get("S") == "Named" and a.get("N") not in NAMED_ACTIONS):
                d.pop(k)
        if isinstance(n := e.get(d.get("Names")), Dict):
            n.pop("JavaScript", None)


def fields(e: Editor) -> None:
    form = e.get(e.catalog.get("AcroForm"))
    if isinstance(form, Dict):
        form.pop("XFA", None)
        form.pop("NeedAppearances", None)
    for d in [*e.under("Fields"), *(a for a in annotations(e) if a.get("Subtype") == "Widget")]:
        d.pop("A", None)
        d.pop("AA", None)


def file_specs(e: Editor) -> None:
    for d in list(e.dicts()):
        d.pop("EF", None)
        d.pop("EmbeddedFiles", None)
        if d.is_stream:
            for k in ("F", "FFilter", "FDecodeParms"):
                d.pop(k, None)


def viewer(e: Editor) -> None:
    if isinstance(v := e.get(e.catalog.get("ViewerPreferences")), Dict):
        for k in LATER_VIEWER_KEYS:
            v.pop(k, None)


def font_dicts(e: Editor) -> None:
    for d in e.dicts():
        if d.get("Subtype") == "CIDFontType2":
            d.setdefault("CIDToGIDMap", Name("Identity"))


def composite_fonts(e: Editor) -> None:
    """The writing mode of a character map's text, and its character collection in the descendant."""
    for d in list(e.dicts()):
        m = e.get(d.get("Encoding"))
        if d.get("Subtype") != "Type0" or not isinstance(m, Dict) or not m.is_stream:
            continue
        if (w := re.search(rb"/WMode\s+(\d+)", e.body(m))) and isinstance(m.get("WMode"), int):
            m["WMode"] = int(w[1])
        kids = e.get(d.get("DescendantFonts"))
        c = e.get(kids[0]) if isinstance(kids, list) and kids else None
        if isinstance(c, Dict) and isinstance(i := e.get(m.get("CIDSystemInfo")), Dict):
            c["CIDSystemInfo"] = Dict(i)


def cmap_cids(e: Editor) -> None:
    """Numbers beyond the limit in the blocks of character maps become the limit."""
    for d in list(e.dicts()):
        m = e.get(d.get("Encoding"))
        if isinstance(m, Dict) and m.is_stream:
            body = e.body(m)
            new = re.sub(rb"(begincid(?:range|char))(.*?)(endcid)", lambda b: b[1] + re.sub(rb"(?<![<\w])\d+(?![\w>])", lambda x: b"65535" if int(x[0]) > 65535 else x[0], b[2]) + b[3], body, flags=re.S)
            if new != body:
                e.set_body(m, new)


def true_type_encodings(e: Editor) -> None:
    for d in e.dicts():
        if d.get("Type") == "Font" and d.get("Subtype") == "TrueType":
            f = e.get(d.get("FontDescriptor"))
            flags = e.get(f.get("Flags")) if isinstance(f, Dict) else 0
            if isinstance(flags, int) and flags & 4:
                d.pop("Encoding", None)
            elif not isinstance(e.get(d.get("Encoding")), Dict) and e.get(d.get("Encoding")) not in ("MacRomanEncoding", "WinAnsiEncoding"):
                d["Encoding"] = Name("WinAnsiEncoding")


def lzw_streams(e: Editor) -> None:
    for d in list(e.dicts()):
        if d.is_stream and {"LZWDecode", "LZW"} & set(e.doc.filters(d)):
            e.set_body(d, e.body(d))


def inline_lzw(e: Editor) -> None:
    """Inline images with the filter get their data in hexadecimal."""
    for s in list(e.contents()):
        ops = tokenize_content(e.body(s))
        for op, operands in ops:
            d = operands[0] if op == "BI" else None
            if d is not None and (d.get("F") or d.get("Filter")) in ("LZW", "LZWDecode"):
                d.raw = lzw(d.raw or b"").hex().encode() + b">"
                d.pop("Filter", None)
                d["F"] = Name("AHx")
        e.set_body(s, write_content(ops))


def limit(v: object) -> object:
    """A scalar within the limits."""
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return max(-MAX_INT - 1, min(MAX_INT, v))
    if isinstance(v, float):
        return max(-MAX_REAL, min(MAX_REAL, v))
    if isinstance(v, Hex):
        d = bytes(c for c in v if c in b"0123456789abcdefABCDEF")
        return Hex(d + b"0" * (len(d) % 2))
    if isinstance(v, bytes) and len(v) > MAX_STRING:
        return Lit(v[:MAX_STRING])
    return v


def content_limits(e: Editor) -> None:
    for c in e.containers():
        for k, v in list(c.items() if isinstance(c, dict) else enumerate(c)):
            if (new := limit(v)) is not v:
                c[k] = new
    for s in list(e.contents()):
        out, depth, over = [], 0, 0
        for op, operands in tokenize_content(e.body(s)):
            if op == "q":
                depth += 1
                if depth > MAX_NESTING:
                    over += 1
                    continue
            elif op == "Q":
                depth = max(0, depth - 1)
                if over:
                    over -= 1
                    continue
            if op != "BI" and op not in OPERATORS:
                continue
            if op == "ri" and operands and operands[0] not in INTENTS:
                operands = [Name("RelativeColorimetric")]
            out.append((op, [limit(x) for x in operands]))
        e.set_body(s, write_content(out))


def write_content(ops: list[tuple[str, list]]) -> bytes:
    out = []
    for op, operands in ops:
        if op == "BI":
            d = operands[0]
            out.append(b"BI " + b" ".join(format_value(Name(k)) + b" " + format_value(v) for k, v in d.items()) + b" ID " + (d.raw or b"") + b"\nEI")
        else:
            out.append(b" ".join([*map(format_value, operands), op.encode("latin-1")]))
    return b"\n".join(out)


def long_names(e: Editor) -> None:
    """Names as values are cut; a key is cut to 119 bytes and, if that is taken, numbered; its uses go with it."""
    renamed: dict[str, str] = {}
    for c in e.containers():
        if isinstance(c, dict):
            for k in [k for k in c if len(k) > MAX_NAME]:
                new, n = k[:119], 1
                while new in c:
                    new, n = f"{k[:119]}~{n}", n + 1
                renamed[k] = new
                c[new] = c.pop(k)
        for k, v in list(c.items() if isinstance(c, dict) else enumerate(c)):
            if isinstance(v, Name) and len(v) > MAX_NAME:
                c[k] = Name(renamed.get(v, v[:MAX_NAME]))


def big_arrays(e: Editor) -> None:
    """A page tree node with too many kids gets a level of nodes between."""
    for d in list(e.dicts()):
        kids = e.get(d.get("Kids"))
        if d.get("Type") == "Pages" and isinstance(kids, list) and len(kids) > 8191:
            nodes = []
            for k in range(0, len(kids), 4096):
                part = kids[k : k + 4096]
                me = e.add(Dict(Type=Name("Pages"), Kids=part, Count=sum(c if isinstance(c := (x := e.get(p)).get("Count") if isinstance(e.get(p), Dict) else 1, int) else 1 for p in part)))
                parent = next((n for n, v in e.objects.items() if v is d), None)
                if parent:
                    e.objects[me.num]["Parent"] = Ref(parent, 0)
                for p in part:
                    if isinstance(x := e.get(p), Dict):
                        x["Parent"] = me
                nodes.append(me)
            d["Kids"] = nodes


def oversized_structure(e: Editor) -> None:
    """A structure tree with an array beyond the limit goes, with what refers to it."""
    tree, seen = e.get(e.catalog.get("StructTreeRoot")), set()
    todo = [tree]
    while todo:
        v = e.get(todo.pop())
        if isinstance(v, (dict, list)) and id(v) not in seen:
            seen.add(id(v))
            if isinstance(v, list) and len(v) > 8191:
                e.catalog.pop("StructTreeRoot", None)
                e.catalog.pop("MarkInfo", None)
                drop("StructParents", "StructParent")(e)
                return
            todo += [x for k, x in v.items() if k not in ("P", "Pg", "Parent")] if isinstance(v, dict) else v


def plain_groups(e: Editor) -> None:
    """A transparency group goes where every graphics state of the file is opaque, and a mask that is opaque goes too."""
    plain = all(g.get("CA", 1) == 1 and g.get("ca", 1) == 1 and g.get("BM", "Normal") in ("Normal", "Compatible") and g.get("SMask") in (None, "None") for g in e.under("ExtGState"))
    for d in list(e.dicts()):
        if plain and isinstance(g := e.get(d.get("Group")), Dict) and g.get("S") == "Transparency":
            d.pop("Group")
        if d.is_stream and d.get("Subtype") == "Image" and d.get("SMask") is not None:
            m = e.get(d["SMask"])
            try:
                opaque = isinstance(m, Dict) and m.is_stream and set(e.body(m)) <= {255}
            except ValueError:
                opaque = False
            if opaque:
                d.pop("SMask")


def model_type(e: Editor, d: Dict) -> str | None:
    """The type of folioscan.plans.object_model that a dictionary's own entries tell."""
    t, s = e.get(d.get("Type")), e.get(d.get("Subtype"))
    if d is e.trailer:
        return "Trailer"
    if d.is_stream:
        return s if s in ("Image", "Form") else None
    if t == "Font":
        return "Font" if s == "TrueType" else None
    return {"Annot": "Annotation", "ExtGState": "GraphicsState"}.get(t, t if t in TYPES else None)


def _ordered(a: object, op: str, b: float) -> bool:
    return isinstance(a, (int, float)) and not isinstance(a, bool) and {">=": a >= b - TOLERANCE, "<=": a <= b + TOLERANCE, ">": a > b + TOLERANCE, "<": a < b - TOLERANCE}.get(op, True)


def object_model(e: Editor) -> None:
    """Keys of the schema that can be mended without a guess: a missing key with one legal value, a value outside an
    enumeration or a range, of a wrong kind, or bound by a rule it breaks goes if it is optional (a number is clamped);
    a dictionary that must be a reference becomes an object; later keys go."""
    for d in list(e.dicts()):
        name = model_type(e, d)
        for k in TYPES[name][1] if name else ():
            v = e.get(d.get(k.key))
            if v is None:
                if k.required is True and len(k.enum) == 1 and "name" in k.types:
                    d[k.key] = Name(k.enum[0])
                continue
            if k.later:
                d.pop(k.key)
                continue
            kind = entry(v).k
            bad = bool(k.types) and kind not in set().union(*[KINDS[t] for t in k.types])
            bad |= bool(k.enum) and kind in ("name", "int", "bool") and str(v if not isinstance(v, bool) else v).lower() not in [x.lower() for x in k.enum]
            if not bad and k.value_cond is not None and kind in ("int", "real"):
                low, high = condition_bounds(k.value_cond)
                if low is not None and not _ordered(v, ">=", low) or high is not None and not _ordered(v, "<=", high):
                    d[k.key] = type(v)(min(max(v, low if low is not None else v), high if high is not None else max(v, low)))
            if not bad and k.constraint is not None and k.constraint.op == "mod" and isinstance(v, int):
                bad = v % int(k.constraint.factor) != k.constraint.value
            if not bad and k.key == "Widths" and isinstance(v, list):
                first, last = e.get(d.get("FirstChar")), e.get(d.get("LastChar"))
                if isinstance(first, int) and isinstance(last, int) and last - first + 1 != len(v):
                    d[k.key] = (v + [0] * (last - first + 1))[: last - first + 1]
            if bad and k.required is False:
                d.pop(k.key)
            elif k.indirect and isinstance(v, Dict) and not isinstance(d[k.key], Ref):
                d[k.key] = e.add(v)


FIXERS: dict[str, Callable[[Editor], None]] = {
    "disallowedAnnotFixer": disallowed_annotations, "annotColourFixer": annotation_colours, "appearanceFixer": appearances, "contentLimitsFixer": content_limits, "actionFixer": actions,
    "extGStateFixer": graphics_states, "annotationFlagsFixer": annotation_flags, "formFixer": fields, "imageMetadataFixer": image_metadata, "postScriptXObjectFixer": postscript,
    "optionalContentFixer": drop("OCProperties"), "viewerPrefFixer": viewer, "fileSpecFixer": file_specs, "fontDictFixer": font_dicts, "type0FontFixer": composite_fonts, "cmapCIDClampFixer": cmap_cids, "trueTypeEncodingFixer": true_type_encodings,
    "fontMetricFixer": font_repair.metrics, "fontSubsetMetaFixer": font_repair.subset_meta, "deviceColourFixer": lambda e: colour_repair.default_spaces(e, profile_bytes), "deviceNColorantsFixer": lambda e: colour_repair.colorants(e, write_content),
    "resourceDictPruneFixer": colour_repair.prune, "pagesTreeArrayFixer": lambda e: (big_arrays(e), oversized_structure(e)), "nameTooLongFixer": long_names, "lzwStreamFixer": lzw_streams, "inlineImageLZWFixer": inline_lzw, "transparencyFlattener": lambda e: (raster_repair.bake_soft_masks(e), plain_groups(e)),
    **dict.fromkeys(("missingRequiredKeyFixer", "wrongValueTypeFixer", "disallowedValueFixer", "indirectRequiredFixer", "post14KeyFixer", "constraintFixer"), object_model),
}


def dominant_model(e: Editor) -> str | None:
    """rgb or cmyk, whichever more colour operators and images use; rgb of equals, none without either."""
    n = {"rgb": 0, "cmyk": 0}
    for s in e.contents():
        for op, _ in tokenize_content(e.body(s)):
            n["rgb"] += op in ("rg", "RG")
            n["cmyk"] += op in ("k", "K")
    for d in images(e):
        cs = e.get(d.get("ColorSpace"))
        n["rgb"] += cs == "DeviceRGB"
        n["cmyk"] += cs == "DeviceCMYK"
    return None if not any(n.values()) else "rgb" if n["rgb"] >= n["cmyk"] else "cmyk"


def profile_bytes(model: str) -> bytes:
    """The least profile header that passes for a model."""
    p = bytearray(128)
    p[8], p[12:16], p[16:20], p[36:40] = 2, b"prtr" if model == "cmyk" else b"mntr", {"rgb": b"RGB ", "cmyk": b"CMYK"}[model], b"acsp"
    return bytes(p)


def prepare(e: Editor) -> None:
    """Information entries that are texts, a packet made from them, and an intent for the dominant colours."""
    info = e.get(e.trailer.get("Info"))
    texts: dict[str, str] = {}
    if isinstance(info, Dict):
        for k in list(info):
            t = text_string(e.get(info[k]))
            if k in INFO_KEYS and k != "Trapped" and (not t or k in ("CreationDate", "ModDate") and xmp.pdf_date_to_iso(t) is None):
                info.pop(k)
            elif t and k in INFO_KEYS:
                texts[k] = t.strip(" \n")
                if t != texts[k]:
                    info[k] = Lit(b"\xfe\xff" + texts[k].encode("utf-16-be"))
    else:
        e.trailer.pop("Info", None)
    alt = lambda name, t: f'<{name}><rdf:Alt><rdf:li xml:lang="x-default">{xmp.escape_text(t)}</rdf:li></rdf:Alt></{name}>'
    make = {
        "Title": lambda t: alt("dc:title", t), "Subject": lambda t: alt("dc:description", t), "Author": lambda t: f"<dc:creator><rdf:Seq><rdf:li>{xmp.escape_text(t)}</rdf:li></rdf:Seq></dc:creator>",
        "Creator": lambda t: f"<xmp:CreatorTool>{xmp.escape_text(t)}</xmp:CreatorTool>", "Producer": lambda t: f"<pdf:Producer>{xmp.escape_text(t)}</pdf:Producer>", "Keywords": lambda t: f"<pdf:Keywords>{xmp.escape_text(t)}</pdf:Keywords>",
        "CreationDate": lambda t: f"<xmp:CreateDate>{xmp.pdf_date_to_iso(t)}</xmp:CreateDate>", "ModDate": lambda t: f"<xmp:ModifyDate>{xmp.pdf_date_to_iso(t)}</xmp:ModifyDate>",
    }
    body = "".join(make[k](t) for k, t in sorted(texts.items()) if k in make)
    packet = Dict(Type=Name("Metadata"), Subtype=Name("XML"))
    packet.raw = (
        '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" '
        f'xmlns:pdfaid="{xmp.PDFA_NS}" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/">'
        f"<pdfaid:part>1</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>{body}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end=\"w\"?>"
    ).encode()
    for d in list(e.dicts()):
        if d is not e.catalog:
            d.pop("Metadata", None)
    e.catalog["Metadata"] = e.add(packet)
    font_repair.promote(e)
    model = dominant_model(e)
    if model:
        s = Dict(N=3 if model == "rgb" else 4)
        e.set_body(s, profile_bytes(model))
        e.catalog["OutputIntents"] = [e.add(Dict(Type=Name("OutputIntent"), S=Name("GTS_PDFA1"), OutputConditionIdentifier=Lit(b"Custom"), DestOutputProfile=e.add(s)))]


def fix_bytes(data: bytes, fixers: list[str], first: bool = True, faces: dict | None = None) -> bytes:
    """The file with these fixers applied; one that can't be read stays as it is. faces are the programs that fonts may
    be substituted by."""
    try:
        e = Editor(data)
        if first:
            prepare(e)
        for f in fixers:
            if f == "fontSubstitutionFixer" and faces:
                font_repair.substitute(e, faces)
            if f in FIXERS:
                FIXERS[f](e)
        return e.write()
    except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
        return data


def apply_fixers(files: DataFrame, issues: DataFrame, faces: dict | None = None) -> DataFrame:
    """Files with the fixers of their issues applied, in the textual order of clauses. The join is on file_id, with
    the short lists of fixers."""
    checks = sorted((c for c in all_checks()), key=lambda c: (c.clause, c.subclause))
    order = {c.check_id: (k, c.repair or "") for k, c in enumerate(checks)}
    rank = F.create_map(*[x for i, (k, _) in order.items() for x in (F.lit(i), F.lit(k))])
    fixer = F.create_map(*[x for i, (_, f) in order.items() for x in (F.lit(i), F.lit(f))])
    need = issues.select("file_id", F.struct(rank[F.col("check_id")].alias("k"), fixer[F.col("check_id")].alias("f")).alias("x")).groupBy("file_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("x")), lambda x: x.f)).alias("fixers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [fix_bytes(c, f or [], faces=faces) if c else c for c, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["file_id", "content"])

    return files.join(need, "file_id", "left").select("file_id", "content", "fixers").mapInArrow(run, "file_id bigint, content binary")


def flatten_bytes(data: bytes, pages: list[int]) -> bytes:
    """The file with these pages as images; one in which none can be painted stays byte for byte."""
    try:
        e = Editor(data)
        if not raster_repair.backstop(e, pages):
            return data
        colour_repair.default_spaces(e, profile_bytes)
        return e.write()
    except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
        return data


def raster_backstop(fixed: DataFrame, issues: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Files (file_id, content) and their issues, where pages that still have issues became images in those files that
    have fewer issues so. Only files with such pages are painted and verified again."""
    pages = issues.where("page > 0").groupBy("file_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [flatten_bytes(c, p) for c, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["file_id", "flat"])

    flat = written(fixed.join(pages, "file_id").select("file_id", "content", "pages").mapInArrow(run, "file_id bigint, flat binary"), "flat")
    again = written(evaluate(nodes(flat.select("file_id", F.col("flat").alias("content"))), profile), "issues")
    n = lambda i, name: i.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    counts = flat.select("file_id").join(n(issues, "before"), "file_id").join(n(again, "after"), "file_id", "left")
    better = written(counts.where("coalesce(after, 0) < before").select("file_id"), "better")
    kept = fixed.join(flat.join(better, "file_id", "left_semi"), "file_id", "left").select("file_id", F.coalesce("flat", "content").alias("content"))
    left = issues.join(better, "file_id", "left_anti").unionByName(again.join(better, "file_id", "left_semi"))
    return kept, left


def convert(files: DataFrame, profile: Profile | str = "a_1b", max_rounds: int = MAX_ROUNDS, raster: bool = False, faces: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, results, issues): the files mended (file_id, content, rounds), whether each is valid now, and what is
    left. A valid file stays byte for byte. faces are TrueType programs by (family, bold, slanted), as pick_face() names
    them, from which fonts without a usable program are substituted; without them such fonts stay. With raster pages that no fixer mends become images, where all they show can
    be painted."""
    p = profiles()[profile] if isinstance(profile, str) else profile
    start = written(files.select(F.col("file_id").cast("bigint").alias("file_id"), "content"), "files")
    fixed, issues, rounds = repair(start, lambda s: evaluate(nodes(s), p), lambda s, i: apply_fixers(s, i, faces), max_rounds)
    if raster:
        fixed, issues = raster_backstop(fixed, issues, p)
    return fixed.join(rounds, "file_id").select("file_id", "content", "rounds"), results(fixed, issues), issues


def text_of(data: bytes) -> str | None:
    """The title that a file states, for round trips."""
    t = text_string(Document(data).open().path("Info", "Title"))
    return re.sub(r"[ \t\n\f\r]+", " ", t) if t else None
