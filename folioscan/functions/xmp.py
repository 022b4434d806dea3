"""Metadata packets: encoding, well-formedness, properties, and the rules about them."""

from __future__ import annotations

import re

PDFA_NS = "http://www.aiim.org/pdfa/ns/id/"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TAG = re.compile(r"<(?:!--.*?-->|\?.*?\?>|!\[CDATA\[.*?\]\]>|(/?)([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>)", re.S)


def decode_packet(raw: bytes) -> str:
    """UTF-8, or UTF-16 or UTF-32 by mark or by where the zeros stand."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    for start, name in ((b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be"), (b"<\0", "utf-16-le"), (b"\0<", "utf-16-be")):
        if raw.startswith(start):
            return raw.decode(name, "replace")
    return raw.decode("utf-8", "replace")


def unescape(text: str) -> str:
    """The five entities, the ampersand first."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(a, b)
    return text


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def well_formed(text: str) -> bool:
    """Whether tags nest and nothing else begins with <; lenient about all else."""
    stack, at = [], 0
    while (k := text.find("<", at)) >= 0:
        m = _TAG.match(text, k)
        if not m:
            return False
        if m[2] and m[1]:
            if not stack or stack.pop() != m[2]:
                return False
        elif m[2] and not m[4]:
            stack.append(m[2])
        at = m.end()
    return not stack


def prop(text: str, name: str) -> str | None:
    """An attribute's value, or an element's text or that of its first list item."""
    if m := re.search(rf"\s{re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", text):
        return unescape(m[1] if m[1] is not None else m[2]).strip()
    if m := re.search(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", text, re.S):
        li = re.search(r"<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li>", m[1], re.S)
        return unescape(re.sub(r"<[^>]*>", "", li[1] if li else m[1])).strip()
    return None


_TWO = "[0-9]{2}"
_ZONE = f"Z|[-+]{_TWO}:{_TWO}"
_CLOCK = f"T{_TWO}:{_TWO}(?::{_TWO}(?:[.][0-9]+)?)?(?:{_ZONE})?"
#: Dates as packets write them.
ISO_DATE = f"[0-9]{{4}}(?:-{_TWO}(?:-{_TWO}(?:{_CLOCK})?)?)?"


#: The same, its parts in groups: year, month, day, hour, minute, second, zone.
ISO_PARTS = f"([0-9]{{4}})(?:-({_TWO})(?:-({_TWO})(?:T({_TWO}):({_TWO})(?::({_TWO})(?:[.][0-9]+)?)?({_ZONE})?)?)?)?"


def date_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def is_date(text: str) -> bool:
    """A year, or with a month, a day and a time of day at any of these precisions."""
    return re.fullmatch(ISO_DATE, text) is not None


def is_integer(text: str) -> bool:
    return re.fullmatch("[+-]?[0-9]+", text) is not None


def pdf_date_to_iso(text: str) -> str | None:
    """D:YYYYMMDDHHmmSSOHH'mm' at the precision it has; a time without a zone is in UTC."""
    m = re.fullmatch(r"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:Z.*|([+-])(\d\d)'?(\d\d)?'?)?", text or "")
    if not m:
        return None
    y, mo, d, h, mi, s, sign, zh, zm = m.groups()
    out = y + (f"-{mo}" if mo else "") + (f"-{d}" if d else "")
    if h:
        out += f"T{h}:{mi or '00'}" + (f":{s}" if s else "") + (f"{sign}{zh}:{zm or '00'}" if sign else "Z")
    return out


def iso_to_pdf_date(text: str) -> str | None:
    m = re.fullmatch(ISO_PARTS, text or "")
    if not m:
        return None
    zone = m[7] or ""
    return "D:" + "".join(x or "" for x in m.groups()[:6]) + ("Z" if zone == "Z" else f"{zone[:3]}'{zone[4:]}'" if zone else "")


#: Info key, property, and whether it is a date.
SYNC = (("Title", "dc:title", False), ("Subject", "dc:description", False), ("Author", "dc:creator", False), ("Creator", "xmp:CreatorTool", False), ("Producer", "pdf:Producer", False), ("Keywords", "pdf:Keywords", False), ("CreationDate", "xmp:CreateDate", True), ("ModDate", "xmp:ModifyDate", True))


#: The conventional prefixes of extension schemas.
EXTENSION = {p: f"http://www.aiim.org/pdfa/ns/{u}" for p, u in (("pdfaExtension", "extension/"), ("pdfaSchema", "schema#"), ("pdfaProperty", "property#"), ("pdfaType", "type#"), ("pdfaField", "field#"))}
KNOWN = ("adobe:ns:meta/", RDF_NS, PDFA_NS, "http://purl.org/dc/elements/1.1/", "http://ns.adobe.com/", "http://www.w3.org/XML/1998/namespace", "http://iptc.org/std/")
BUILT_IN = set("Text Integer Boolean Real Date URI URL MIMEType AgentName GUID Locale ProperName XPath RenditionClass Rational Thumbnail Dimensions Colorant Font Version Job ResourceEvent ResourceRef GPSCoordinate OECF/SFR CFAPattern DeviceSettings Flash".split())


_XAP, _EXIF = "http://ns.adobe.com/xap/1.0/", "http://ns.adobe.com/exif/1.0/"
_GPS = "AreaInformation DOP DestBearing DestBearingRef DestDistance DestDistanceRef DestLatitude DestLongitude ImgDirection ImgDirectionRef Latitude Longitude MapDatum MeasureMode ProcessingMethod Satellites Speed SpeedRef Status TimeStamp Track TrackRef VersionID Altitude"
#: By namespace, the properties of each form: text, integer, boolean, bag, seq, alt or struct.
PROPERTIES: dict[str, dict[str, str]] = {
    "http://purl.org/dc/elements/1.1/": {"text": "coverage format identifier source", "bag": "contributor language publisher relation subject type", "seq": "creator date", "alt": "description rights title"},
    _XAP: {"text": "BaseURL CreateDate CreatorTool MetadataDate ModifyDate Format Nickname", "bag": "Advisory Identifier", "alt": "Thumbnails"},
    "http://ns.adobe.com/pdf/1.3/": {"text": "Producer Keywords PDFVersion"},
    _XAP + "rights/": {"text": "Certificate WebStatement", "boolean": "Marked", "bag": "Owner", "alt": "UsageTerms"},
    _XAP + "mm/": {"text": "DocumentID InstanceID LastURL Manager ManageTo ManageUI ManagerVariant RenditionClass RenditionParams VersionID", "integer": "SaveID", "bag": "Ingredients", "seq": "History Versions", "struct": "DerivedFrom ManagedFrom RenditionOf"},
    _XAP + "bj/": {"bag": "JobRef"},
    _XAP + "t/pg/": {"integer": "NPages", "struct": "MaxPageSize"},
    "http://ns.adobe.com/photoshop/1.0/": {"text": "AuthorsPosition CaptionWriter Category City Country Credit DateCreated Headline ICCProfile Instructions Source State SupplementalCategories TransmissionReference", "integer": "Urgency"},
    "http://ns.adobe.com/tiff/1.0/": {
        "text": "Artist DateTime Make Model Software XResolution YResolution", "integer": "Compression ImageLength ImageWidth Orientation PhotometricInterpretation PlanarConfiguration ResolutionUnit SamplesPerPixel YCbCrPositioning",
        "seq": "BitsPerSample PrimaryChromaticities ReferenceBlackWhite TransferFunction WhitePoint YCbCrCoefficients YCbCrSubSampling", "alt": "Copyright ImageDescription",
    },
    _EXIF: {
        "text": " ".join("GPS" + x for x in _GPS.split()) + " ApertureValue BrightnessValue CompressedBitsPerPixel DateTimeDigitized DateTimeOriginal DigitalZoomRatio ExifVersion ExposureBiasValue ExposureIndex ExposureTime FNumber FlashEnergy FlashpixVersion FocalLength "
        "FocalPlaneXResolution FocalPlaneYResolution ImageUniqueID MakerNote MaxApertureValue RelatedSoundFile ShutterSpeedValue SpectralSensitivity SubjectDistance Fired pdf.Function RedEyeMode",
        "integer": "ColorSpace Contrast CustomRendered ExposureMode ExposureProgram FileSource FocalLengthIn35mmFilm FocalPlaneResolutionUnit GainControl GPSAltitudeRef GPSDifferential LightSource MeteringMode PixelXDimension PixelYDimension "
        "Saturation SceneCaptureType SceneType SensingMethod Sharpness SubjectDistanceRange WhiteBalance Return Mode Columns Rows",
        "seq": "ComponentsConfiguration ISOSpeedRatings SubjectArea SubjectLocation Names Values Settings", "alt": "UserComment", "struct": "CFAPattern DeviceSettingDescription Flash OECF SpatialFrequencyResponse",
    },
    PDFA_NS: {"integer": "part", "text": "conformance amd"},
}
FORMS = {ns: {p: form for form, names in by.items() for p in names.split()} for ns, by in PROPERTIES.items()}
_DATES = {("dc", "date"), (_XAP, "CreateDate"), (_XAP, "ModifyDate"), (_XAP, "MetadataDate"), ("http://ns.adobe.com/photoshop/1.0/", "DateCreated"), ("http://ns.adobe.com/tiff/1.0/", "DateTime"), (_EXIF, "DateTimeOriginal"), (_EXIF, "GPSTimeStamp")}
_XML_NS = "http://www.w3.org/XML/1998/namespace"


def value_fault(ns: str, name: str, value: str) -> bool:
    """Whether a single value breaks what its property asks beyond its form."""
    ns = "dc" if "purl.org/dc" in ns else ns
    if (ns, name) in _DATES:
        return not is_date(value)
    if (ns, name) in {("http://ns.adobe.com/tiff/1.0/", "BitsPerSample"), (_EXIF, "ISOSpeedRatings")}:
        return not is_integer(value)
    return (ns, name) == (_EXIF, "GPSMeasureMode") and value not in ("2", "3")


def property_fault(ns: str, name: str, form: str, value: str, items: list[tuple[str, bool]]) -> bool:
    """Whether a property of a known namespace is undefined there, of a wrong form, or has a wrong value; items are
    the texts of a list with whether each states its language."""
    wanted = FORMS[ns].get(name)
    if wanted is None or form != (wanted if wanted in ("bag", "seq", "alt", "struct") else "text"):
        return True
    if form == "text" and value:
        return wanted == "integer" and not is_integer(value) or wanted == "boolean" and value not in ("True", "False") or value_fault(ns, name, value)
    if form in ("bag", "seq"):
        return any(t and value_fault(ns, name, t) for t, _ in items)
    return form == "alt" and name != "Thumbnails" and not all(lang for _, lang in items)


def properties(text: str) -> list[tuple[str, str, str, str, list[tuple[str, bool]]]]:
    """(namespace, name, form, value, items) of the properties of a packet, in order; none of one that no parser reads."""
    from xml.etree import ElementTree

    at = text.find("<")
    try:
        root = ElementTree.fromstring(re.sub(r"<\?.*?\?>", "", text[max(at, 0) :], flags=re.S).strip())
    except (ElementTree.ParseError, ValueError):
        return []
    split = lambda tag: tuple(tag[1:].split("}", 1)) if tag[:1] == "{" else ("", tag)
    rdf, out, todo = f"{{{RDF_NS}}}", [], [root]
    while todo:
        e = todo.pop()
        ns, name = split(e.tag)
        if (ns, name) == (RDF_NS, "Description"):
            for k, v in e.attrib.items():
                a, local = split(k)
                if a not in ("", RDF_NS, _XML_NS):
                    out.append((a, local, "text", v.strip(), []))
        elif ns in FORMS:
            first = next(iter(e), None)
            kind = {rdf + "Bag": "bag", rdf + "Seq": "seq", rdf + "Alt": "alt"}.get(first.tag, "struct") if first is not None else "text"
            if e.get(rdf + "parseType") == "Resource":
                kind = "struct"
            value = e.get(rdf + "resource") or (e.text or "").strip()
            items = [((li.text or "").strip(), li.get(f"{{{_XML_NS}}}lang") is not None) for li in first if li.tag == rdf + "li"] if kind in ("bag", "seq", "alt") else []
            out.append((ns, name, "text" if e.get(rdf + "resource") else kind, value, items))
            continue
        todo += list(e)[::-1]
    return out


def property_faults(text: str) -> list[str]:
    """A fault for each property that its schema doesn't allow."""
    rule = lambda ns: "PDFAIdentifierUndefinedProperty" if ns == PDFA_NS else "MetadataFiltered"
    return [rule(p[0]) for p in properties(text) if p[0] in FORMS and property_fault(*p)]


def extension_faults(text: str) -> list[str]:
    """Of namespaces, and of extension schemas with their properties, types and fields."""
    out = []
    bound = re.findall(r"xmlns:([\w-]+)\s*=\s*[\"']([^\"']*)[\"']", text)
    for prefix, uri in dict.fromkeys(bound):
        if uri in EXTENSION.values():
            out += ["ExtSchemaNamespace"] * (EXTENSION.get(prefix) != uri)
        elif prefix in EXTENSION:
            out.append("ExtSchemaWrongPrefixURI")
    if (m := re.search(r"<pdfaExtension:schemas[^>]*>\s*<rdf:(\w+)", text)) and m[1] != "Bag":
        out.append("ExtSchemasNotBag")
    types = set(re.findall(r"<pdfaType:type>\s*([^<\s]+)", text))
    names: set[str] = set()
    for block in re.findall(r"<rdf:li[^>]*>((?:(?!<rdf:li|</rdf:li>).)*)</rdf:li>", text, re.S):
        values = lambda kind, f, b=block: re.findall(rf"<{kind}:{f}(?:\s[^>]*)?>([^<]*)<", b)
        if "<pdfaProperty:" in block:
            names |= {n.strip() for n in values("pdfaProperty", "name")}
            out += ["ExtPropertyMissingField" for f in ("name", "valueType", "category", "description") if not values("pdfaProperty", f)]
            out += ["ExtPropertyMultipleName"] * (len(values("pdfaProperty", "name")) > 1)
            for t in values("pdfaProperty", "valueType"):
                base = re.sub(r"^(?:(?:open|closed)\s+)?(?:choice\s+(?:of\s+)?)?|^(?:bag|seq|alt)\s+|^Lang Alt$", "", t.strip(), flags=re.I)
                out += ["ExtPropertyUndefinedType"] * (bool(base) and base not in BUILT_IN | types)
        elif "<pdfaField:" in block:
            out += ["ExtFieldInvalid" for f in ("name", "valueType", "description") if not values("pdfaField", f)]
        elif "<pdfaType:" in block:
            out += ["ExtTypeInvalid" for f in ("type", "namespaceURI", "prefix", "description") if not values("pdfaType", f)]
    # a property of a type that isn't built in must be used as a structure
    for prefix, block in zip(re.findall(r"<pdfaSchema:prefix>\s*([^<\s]*)", text), re.findall(r"<pdfaSchema:property>(.*?)</pdfaSchema:property>", text, re.S)):
        for item in re.findall(r"<rdf:li[^>]*>(.*?)</rdf:li>", block, re.S):
            n, t = (re.search(rf"<pdfaProperty:{f}>\s*([^<]*?)\s*<", item) for f in ("name", "valueType"))
            if n and t and t[1] and t[1] not in BUILT_IN and (used := re.findall(rf"<{re.escape(prefix)}:{re.escape(n[1])}(\s[^>]*)?>", text)):
                out += ["ExtPropertyComplexAsSimple"] * (not any("parseType" in u and "Resource" in u for u in used))
    described = dict(zip(re.findall(r"<pdfaSchema:prefix>\s*([^<\s]*)", text), re.findall(r"<pdfaSchema:namespaceURI>\s*([^<\s]*)", text)))
    for prefix, uri in dict.fromkeys(bound):
        if prefix == "pdfaid" or prefix in EXTENSION or uri in EXTENSION.values() or uri.startswith(KNOWN):
            continue
        used = re.findall(rf"<{re.escape(prefix)}:([\w-]+)", text)
        if not used:
            continue
        if prefix in described:
            out += ["ExtPropertyUndocumented" for u in dict.fromkeys(used) if u not in names]
        else:
            out.append("ExtSchemaNamespace" if "<pdfaExtension:schemas" in text else "MetadataUndeclaredProperty")
    return out


def claimed(text: str) -> tuple[str | None, str | None]:
    """The part and the conformance level that a packet claims."""
    return prop(text, "pdfaid:part"), prop(text, "pdfaid:conformance")


def packet_faults(text: str, info: dict[str, str]) -> list[str]:
    """The rules that a catalog's packet breaks, against the entries of the information dictionary."""
    out = []
    if head := re.search(r"<\?xpacket\s+begin[^?]*\?>", text):
        out += ["XPacketBytesAttribute"] * ("bytes=" in head[0].replace(" ", "")) + ["XPacketEncodingAttribute"] * ("encoding=" in head[0].replace(" ", ""))
    if not well_formed(text):
        return out + ["XMPNotWellFormed"]
    if RDF_NS in text and "<rdf:RDF" not in text:
        out.append("MetadataMissing")
    ns = re.search(r"xmlns:pdfaid\s*=\s*[\"']([^\"']*)[\"']", text)
    part, level = claimed(text)
    if not ns:
        out.append("PDFAIdentifierMissing")
    else:
        if ns[1] != PDFA_NS:
            out.append("PDFAIdentifierNamespace")
        out += ["PDFAIdentifierMissing"] * ((part is None) + (level is None))
        out += ["PDFAPartNumber"] * (part is not None and part != "1") + ["PDFAConformanceLevel"] * (level is not None and level not in ("A", "B"))
        if any(p not in ("part", "conformance", "amd", "corr") for p in re.findall(r"[<\s]pdfaid:(\w+)", text)):
            out.append("PDFAIdentifierUndefinedProperty")
    out += [x for x in property_faults(text) if x not in out]
    if (m := re.search(r"<dc:description(?:\s[^>]*)?>(.*?)</dc:description>", text, re.S)) and "<rdf:Alt" not in m[1]:
        out.append("MetadataPropertyType")
    out += extension_faults(text)
    for key, name, date in SYNC:
        if key not in info:
            continue
        own, other = info[key], prop(text, name)
        if date:
            a, b = date_digits(own), date_digits(other or "")
            n = min(len(a), len(b))
            same = n >= 8 and a[:n] == b[:n]
        else:
            same = other is not None and own.strip() == other.strip()  # white space around a property's text doesn't count
        if not same:
            out += ["InfoXMPSync", "InfoDictXMPMismatch"]
    return out
