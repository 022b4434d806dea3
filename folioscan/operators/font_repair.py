"""Repairs of font dictionaries from their programs: widths, and what subsets state about themselves."""

from __future__ import annotations

from folioscan.functions import fonts
from folioscan.sources.content_usage import Usage, content_usage
from folioscan.sources.pdf_bytes import Dict, Lit, Name, tokenize_content


def _ops(e):
    def of(s: Dict) -> list:
        try:
            return tokenize_content(e.body(s)) if s.is_stream else []
        except ValueError:
            return []

    return of


class _View:
    """An editor as the replay of content sees a document."""

    def __init__(self, e):
        self.e, self.resolve = e, e.get

    def path(self, *keys: str) -> object:
        v: object = self.e.trailer
        for k in keys:
            v = self.e.get(v)
            v = v.get(k) if isinstance(v, dict) else None
        return self.e.get(v)


def usage_of(e) -> Usage:
    return content_usage(_View(e), _ops(e))


def _programs(e):
    """Each font dictionary with its Program."""
    used = usage_of(e)

    def body(x: object) -> bytes | None:
        try:
            return e.body(x) if isinstance(x, Dict) and x.is_stream else None
        except ValueError:
            return None

    for d in list(e.dicts()):
        if d.get("Type") == "Font":
            cid = str(e.get(d.get("Subtype"))).startswith("CIDFont")
            p = fonts.program_of(d, e.get, body, used.cids.get(id(d)) if cid else used.codes.get(id(d)))
            yield d, p


def metrics(e) -> None:
    """Widths that differ from the program's by more than one become the program's; CIDs in use that no width is stated
    for get one where the default is wrong."""
    for d, p in _programs(e):
        if d.get("Subtype") == "Type3":
            enc, first, widths = e.get(d.get("Encoding")), e.get(d.get("FirstChar")), e.get(d.get("Widths"))
            if isinstance(enc, Dict) and isinstance(first, int) and isinstance(widths, list):
                names, own = fonts.glyph_table(enc, e.get), fonts.type3_advances(e.get(d.get("CharProcs")), e.get, _ops(e))
                d["Widths"] = [own[names[first + k]] if 0 <= first + k < 256 and names[first + k] in own and abs(own[names[first + k]] - (fonts.number(e.get(w)) or 0)) > 1 else w for k, w in enumerate(widths)]
        elif p is not None and p.first is not None and (own := fonts.code_widths(p)):
            d["Widths"] = [own[c] if w and (c := p.first + k) in own and abs(own[c] - w) > 1 else w for k, w in enumerate(p.widths)]
        elif p is not None and p.cid_widths is not None and (own := fonts.code_widths(p)):
            pairs = dict(p.cid_widths) | {c: p.default_width for c in p.used or () if c not in dict(p.cid_widths)}
            fixed = {c: own[c] if c in own and abs(own[c] - w) > 1 else w for c, w in pairs.items()}
            d["W"] = [x for c, w in sorted(fixed.items()) for x in (c, [w])]


def subset_meta(e) -> None:
    """CharSet and CIDSet from the glyphs of the program."""
    for d, p in _programs(e):
        f = e.get(d.get("FontDescriptor"))
        if p is None or not p.subset or not isinstance(f, Dict):
            continue
        if p.subtype in ("Type1", "MMType1") and (names := fonts.subset_names(p)):
            f["CharSet"] = Lit(names.encode("latin-1"))
        elif p.subtype.startswith("CIDFont") and (bits := fonts.subset_bits(p)):
            s = Dict()
            e.set_body(s, bits)
            f["CIDSet"] = e.add(s)


def promote(e) -> None:
    """Blank glyphs of programs by CID become explicit."""
    for d in list(e.dicts()):
        f = e.get(d.get("FontDescriptor"))
        s = e.get(f.get("FontFile2")) if d.get("Subtype") == "CIDFontType2" and isinstance(f, Dict) else None
        if isinstance(s, Dict) and s.is_stream:
            try:
                data = e.body(s)
            except ValueError:
                continue
            if (new := fonts.promote_empty_glyphs(data)) != data:
                e.set_body(s, new)
                s["Length1"] = len(new)


def needs_substitute(p: fonts.Program) -> bool:
    """Whether a font has no program that can be read, or lacks a glyph in use."""
    readable = {"FontFile": lambda: fonts.type1(p.data), "FontFile2": lambda: fonts.sfnt(p.data), "FontFile3": lambda: fonts.cff(p.data)}
    return p.kind not in readable or readable[p.kind]() is None or "SubsetGlyphCoverage" in fonts.font_faults(p)


def _embed(e, d: Dict, f: Dict, data: bytes, name: str, flags: int) -> None:
    s = Dict(Length1=len(data))
    e.set_body(s, data)
    for k in "CharSet CIDSet FontFile FontFile2 FontFile3".split():
        f.pop(k, None)
    f.update(Type=Name("FontDescriptor"), FontName=Name(name), Flags=flags, FontFile2=e.add(s))
    f.setdefault("ItalicAngle", 0)
    f.setdefault("StemV", 80)
    f.setdefault("Ascent", 900)
    f.setdefault("Descent", -200)
    f.setdefault("CapHeight", 700)
    f.setdefault("FontBBox", [-200, -250, 1200, 1000])
    d["BaseFont"] = Name(name)


def substitute(e, faces: dict[fonts.Face, bytes]) -> int:
    """Fonts without a usable program get a subset of a face that fits them, of the characters they show; how many did.
    faces are TrueType programs by (family, bold, slanted); a font whose face isn't among them, or lacks a character, or
    whose codes don't tell characters, stays."""
    n = 0
    parents = {id(e.get(k)): d for d in list(e.dicts()) if d.get("Subtype") == "Type0" and isinstance(kids := e.get(d.get("DescendantFonts")), list) for k in kids}
    for d, p in list(_programs(e)):
        if p is None and d.get("Subtype") in ("Type1", "MMType1", "TrueType", "CIDFontType2", "CIDFontType0"):
            d["FontDescriptor"] = e.add(Dict())
            p = next((q for x, q in _programs(e) if x is d), None)
        if p is None or p.subtype == "Type3" or not needs_substitute(p) or not p.used:
            continue
        f = e.get(d["FontDescriptor"])
        base = str(e.get(d.get("BaseFont")) or "")
        flags = e.get(f.get("Flags"))
        face = fonts.pick_face(fonts.SUBSET_TAG.sub("", base), flags if isinstance(flags, int) else 0, fonts.number(e.get(f.get("FontWeight"))) or 0)
        if face not in faces:
            continue
        own = e.get(parents.get(id(d), d).get("ToUnicode"))
        told: dict[int, int] = {}
        if isinstance(own, Dict) and own.is_stream:
            try:
                told = fonts.to_unicode_map(e.body(own))
            except ValueError:
                pass
        simple = not p.subtype.startswith("CIDFont")
        table = fonts.code_to_unicode(p.enc) if simple and p.enc is not None else fonts.code_to_unicode("StandardEncoding") if simple else []
        character = {c: told.get(c) or (table[c] if c < len(table) else 0) for c in sorted(p.used)}
        made = fonts.subset_true_type(faces[face], list(character.values())) if all(character.values()) else None
        if made is None or any(u not in made[1] for u in character.values()):
            continue
        data, glyph = made
        t = fonts.sfnt(data)
        name = f"SUBSET+{fonts.SUBSET_TAG.sub('', base) or 'Font'}"
        if simple:
            first, last = min(character), max(character)
            d.update(Subtype=Name("TrueType"), FirstChar=first, LastChar=last, Widths=[fonts.advance(t, glyph[character[c]]) if c in character else 0 for c in range(first, last + 1)])
            win = fonts.code_to_unicode("WinAnsiEncoding")
            names = {c: u for c, u in character.items() if win[c] != u}
            reverse = {u: n for n in fonts.encoding("WinAnsiEncoding") if n and (u := fonts.to_unicode(n))}
            d["Encoding"] = Dict(Type=Name("Encoding"), BaseEncoding=Name("WinAnsiEncoding"), Differences=[x for c, u in names.items() for x in (c, Name(reverse.get(u, f"uni{u:04X}")))]) if names else Name("WinAnsiEncoding")
            _embed(e, d, f, data, name, 32)
        else:
            # the CIDs are the numbers of the glyphs, so that the map is the identity
            glyphs = [b""] * (max(character) + 1)
            for c, u in character.items():
                glyphs[c] = fonts.glyph_data(t, glyph[u]) or b"\0" * 12
            widths = [fonts.advance(t, glyph[character[c]]) if c in character else 0 for c in range(len(glyphs))]
            em = fonts.u16(t["head"], 18) or 1000
            order = b"".join((w * em // 1000).to_bytes(2, "big") + b"\0\0" for w in widths)
            tables = fonts._glyphs({k: t[k] for k in ("head", "hhea", "maxp")}, glyphs)
            count = len(glyphs).to_bytes(2, "big")
            tables |= {"hmtx": order, "hhea": t["hhea"][:34] + count, "maxp": t["maxp"][:4] + count + t["maxp"][6:]}
            d.update(Subtype=Name("CIDFontType2"), CIDToGIDMap=Name("Identity"), W=[x for c in sorted(character) for x in (c, [widths[c]])])
            _embed(e, d, f, fonts.build_tables(tables), name, 4)
            bits = fonts.subset_bits(fonts.program_of(d, e.get, lambda x: e.body(x) if isinstance(x, Dict) and x.is_stream else None, None))
            stream_ = Dict()
            e.set_body(stream_, bits)
            f["CIDSet"] = e.add(stream_)
            if id(d) in parents:
                parents[id(d)]["BaseFont"] = Name(name)
        n += 1
    return n
