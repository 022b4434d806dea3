"""Font programs: what was built comes back, and each rule with a font that breaks it and one that doesn't."""

import pytest

from folioscan.functions import font_fixture as fx
from folioscan.functions import fonts as f
from folioscan.functions.glyph_names import STANDARD_STRINGS, encoding, to_unicode

ADVANCES = [0, 500, 600, 250, 0]
CODES = {65: 1, 66: 2, 0x20AC: 3}


@pytest.mark.parametrize("form", [0, 4, 6])
def test_true_type(form):
    codes = CODES if form == 4 else {65: 1, 66: 2, 70: 3}
    t = f.sfnt(fx.build_sfnt(ADVANCES, codes, em=2000, form=form, empty=(0, 4)))
    assert f.glyph_count(t) == 5 and [f.advance(t, g) for g in range(6)] == [0, 250, 300, 125, 0, 0]
    assert f.code_map(f.cmaps(t)[3, 1]) == codes
    assert [bool(f.glyph_data(t, g)) for g in range(6)] == [False, True, True, True, False, False]
    assert [f.present(t, g) for g in (0, 1, 4, 9)] == [True, True, True, False]
    assert f.true_type_outline(t, 1) == [[(0, 0), (500, 0), (500, 500), (0, 500), (0, 0)]] and f.true_type_outline(t, 0) == []


def test_damaged_programs_are_empty():
    data = fx.build_sfnt(ADVANCES, CODES)
    for k in range(0, len(data), 7):
        t = f.sfnt(data[:k])
        if t:
            [f.advance(t, g) for g in range(6)], [f.code_map(x) for x in f.cmaps(t).values()], f.true_type_outline(t, 1)
    for whole in (fx.build_cff(["A", "own"], [400, 500]), fx.build_cff([], [400, 500], [3, 9]), fx.build_type1({"A": 500})):
        for k in range(0, len(whole), 5):
            f.cff_widths(f.cff(whole[:k]))
            f.type1_widths(f.type1(whole[:k]))
    assert f.sfnt(b"") is None and f.cff(b"\2\0\0\0") is None and f.type1(b"x") is None


def test_compact_fonts():
    font = f.cff(fx.build_cff(["A", "Bown", "zcaron"], [431, 500, 777]))
    assert font.names == [".notdef", "A", "Bown", "zcaron"] and f.cff_widths(font) == {"A": 431, "Bown": 500, "zcaron": 777}
    font = f.cff(fx.build_cff([], [431, 500], [7, 300]))
    assert font.by_cid and font.sids == [0, 7, 300] and f.cff_widths(font) == {0: 500, 7: 431, 300: 500}
    assert f.cff_outline(font, 1) == [[(0, 0), (400, 0), (400, 400), (0, 400)]]
    assert len(STANDARD_STRINGS) == 391
    assert f.cff_dict(b"\x1e\xe2\xa2\x5f\x05" + b"\xf7\x00\xfb\x00\x06") == {5: [-2.25], 6: [108, -108]}


def test_charstrings():
    n = fx.type2_number
    p, font = f.Private(500, 600, [n(5) + b"\x0b"]), f.Cff([], False, [], [], [], [], [n(9) + n(9) + b"\x16"], False)
    width = lambda code: f.run_type2(code, font, p)
    assert width(b"\x0e") is None and width(n(7) + b"\x0e") == 7 and width(n(7) + n(1) + n(2) + b"\x01") == 7 and width(n(1) + n(2) + b"\x01") is None
    assert width(n(-107) + b"\x0a" + n(1) + n(2) + b"\x15") == 5  # the width comes from a subroutine
    assert width(n(-107) + b"\x1d") == 9 and width(b"\x1c\x01\x00" + n(4) + b"\x04") == 256
    for bad in (b"\x0a", n(50) + b"\x0a", b"\x05"):
        with pytest.raises(ValueError):
            width(bad)
    pen = f._Pen()
    f.run_type2(n(0) + n(0) + b"\x15" + n(10) + n(0) + n(10) + n(10) + n(0) + n(10) + b"\x08" + n(-10) + b"\x07\x0e", font, p, pen)
    assert pen.contours[0][0] == (0, 0) and pen.contours[0][8] == (20, 20) and pen.contours[0][-1] == (20, 10)


@pytest.mark.parametrize("hexadecimal", [False, True])
def test_type1(hexadecimal):
    font = f.type1(fx.build_type1({".notdef": 250, "A": 722, "own": 31}, {65: "A", 66: "own"}, hexadecimal=hexadecimal))
    assert f.type1_widths(font) == {".notdef": 250, "A": 722, "own": 31} and font.encoding[65:67] == ("A", "own")
    assert f.type1_outline(font, "A") == [[(0, 0), (300, 0), (300, 300), (0, 300)]]
    assert f.type1(fx.build_type1({"A": 1})).encoding == encoding("StandardEncoding")
    assert f.decrypt(f.encrypt(b"some text", 4330), 4330) == b"some text"


def test_names():
    assert [to_unicode(x) for x in ("A", "eacute", "Euro", "uni00E9", "u1F600", "a.sc", "nosuch", ".notdef")] == [65, 0xE9, 0x20AC, 0xE9, 0x1F600, 97, None, None]
    assert f.glyph_table("WinAnsiEncoding")[0x80] == "Euro" and f.glyph_table("Other") is None
    enc = {"BaseEncoding": "WinAnsiEncoding", "Differences": [65, "B", "own", 300, "x"]}
    assert f.glyph_table(enc)[65:68] == ["B", "own", "C"] and f.code_to_unicode(enc)[65:68] == [66, 0, 67]
    assert f.cid_widths([1, [10, 20.5], 5, 7, 30, 9]) == [(1, 10), (2, 20), (5, 30), (6, 30), (7, 30)] and f.cid_widths(None) == []
    assert "Times-Roman" in f.STANDARD_14 and len(f.STANDARD_14) == 14


def program(**x):
    return f.Program(**({"subtype": "TrueType", "subset": True, "first": 65, "widths": [500, 600], "enc": "WinAnsiEncoding", "symbolic": False, "kind": "FontFile2", "data": fx.build_sfnt(ADVANCES, CODES), "char_set": None, "cid_set": None, "has_cid_set": False, "identity": True, "cid_widths": None, "default_width": 1000, "used": None} | x))


TYPE1 = {"subtype": "Type1", "kind": "FontFile", "data": fx.build_type1({".notdef": 0, "A": 500, "B": 600}), "char_set": "/A/B"}
CIDS = {"subtype": "CIDFontType2", "first": None, "widths": [], "enc": None, "cid_set": b"\x7f", "has_cid_set": True, "cid_widths": [(1, 500), (2, 600)]}
COMPACT = CIDS | {"subtype": "CIDFontType0", "kind": "FontFile3", "data": fx.build_cff([], [500, 600], [1, 2]), "cid_set": b"\xe0"}


@pytest.mark.parametrize("change, want", [
    ({}, []), ({"widths": [500, 602]}, ["AdvanceWidthMismatch"]), ({"widths": [500, 601, 0]}, []), ({"widths": [500, 600, 300]}, ["SubsetGlyphCoverage"]), ({"widths": [500, 600, 300], "subset": False}, []),
    ({"widths": [500, 600, 300], "used": frozenset({65})}, []), ({"used": frozenset({70})}, ["SubsetGlyphCoverage"]), ({"enc": None, "symbolic": True}, []),
    ({"enc": None, "symbolic": True, "data": fx.build_sfnt(ADVANCES, {0xF041: 1, 66: 2}, platform=(3, 0)), "widths": [500, 610]}, ["AdvanceWidthMismatch"]),
    (TYPE1, []), (TYPE1 | {"char_set": None}, ["Type1SubsetCharSet"]), (TYPE1 | {"char_set": ""}, ["Type1SubsetCharSet"]), (TYPE1 | {"char_set": "/A"}, ["Type1SubsetCharSet"]), (TYPE1 | {"widths": [500, 600, 9]}, ["SubsetGlyphCoverage"]),
    (TYPE1 | {"widths": [500, 700]}, ["AdvanceWidthMismatch"]), (TYPE1 | {"kind": "FontFile3", "data": fx.build_cff(["A", "B"], [500, 600])}, []), (TYPE1 | {"kind": "FontFile3", "data": fx.build_cff(["A", "B"], [500, 620])}, ["AdvanceWidthMismatch"]),
    (CIDS, []), (CIDS | {"has_cid_set": False, "cid_set": None}, ["CIDSubsetCIDSet"]), (CIDS | {"cid_set": b"\x40"}, ["CIDSubsetCIDSet"]), (CIDS | {"cid_widths": [(1, 500), (9, 600)]}, ["SubsetGlyphCoverage"]),
    (CIDS | {"cid_widths": [(1, 510)]}, ["AdvanceWidthMismatch"]), (CIDS | {"used": frozenset({3})}, ["AdvanceWidthMismatch"]), (CIDS | {"used": frozenset({3}), "default_width": 250}, []),
    (COMPACT, []), (COMPACT | {"cid_set": b"\xc0"}, ["CIDSubsetCIDSet"]), (COMPACT | {"cid_widths": [(1, 500), (3, 5)]}, ["SubsetGlyphCoverage"]), (COMPACT | {"cid_widths": [(1, 502)]}, ["AdvanceWidthMismatch"]),
    (COMPACT | {"cid_widths": [(1, 502)], "used": frozenset({2})}, []),
])
def test_rules(change, want):
    assert f.font_faults(program(**change)) == want


def test_type3():
    assert f.type3_fault(65, 66, [500.0, 600.0], {65: "a", 66: "b"}, {"a": 502.0}) and not f.type3_fault(65, 66, [500.0, 600.0], {65: "a", 66: "b"}, {"a": 500.9}) and not f.type3_fault(65, 65, [500.0, 600.0], {66: "b"}, {"b": 1.0})


def test_subsets():
    face = fx.build_sfnt([0, 500, 600, 700], {65: 1, 66: 2, 0x20AC: 3}, em=2000)
    data, own = f.subset_true_type(face, [0x20AC, 65, 90])
    t = f.sfnt(data)
    assert own == {65: 1, 0x20AC: 2} and f.glyph_count(t) == 3 and [f.advance(t, g) for g in range(3)] == [0, 250, 350] and f.code_map(f.cmaps(t)[3, 1]) == own
    assert f.true_type_outline(t, 1) == f.true_type_outline(f.sfnt(face), 1) and f.subset_true_type(b"nothing", [65]) is None
    # a composed glyph brings its parts, under their new numbers
    t = f.sfnt(face)
    composed = b"\xff\xff" + b"\0" * 8 + (0x0023).to_bytes(2, "big") + (3).to_bytes(2, "big") + b"\0\x0a\0\x14" + (0x0003).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\0\0\0\0"
    whole = f.build_tables(f._glyphs(t, [b"", f.glyph_data(t, 1), composed, f.glyph_data(t, 3)]))
    data, own = f.subset_true_type(whole, [66])
    t = f.sfnt(data)
    assert own == {66: 1} and f.component_ids(f.glyph_data(t, 1)) == [2, 3] and len(f.true_type_outline(t, 1)) == 2 and min(x for x, _ in f.true_type_outline(t, 1)[0]) == 10


def test_blank_glyphs_and_maps_to_unicode():
    data = fx.build_sfnt([0, 500, 300, 0], {65: 1}, empty=(0, 2, 3))
    new = f.sfnt(f.promote_empty_glyphs(data))
    assert f.present(new, 2) and not f.present(f.sfnt(data), 2) and not f.glyph_data(new, 3) and f.true_type_outline(new, 2) == [] and f.promote_empty_glyphs(b"x") == b"x"
    assert f.promote_empty_glyphs(fx.build_sfnt([0, 500], {65: 1})) == fx.build_sfnt([0, 500], {65: 1})
    text = b"2 beginbfchar <01> <0041> <02> <00660069> endbfchar 2 beginbfrange <10> <12> <0061> <20> <22> [<0030> <0031>] endbfrange"
    assert f.to_unicode_map(text) == {1: 65, 2: 0x66, 16: 97, 17: 98, 18: 99, 32: 48, 33: 49} and f.to_unicode_map(b"") == {}


@pytest.mark.parametrize("name, flags, weight, want", [("Courier-Bold", 0, 0, ("mono", True, False)), ("ArialMT", 0, 0, ("sans", False, False)), ("Times-BoldItalic", 0, 0, ("serif", True, True)), ("Own", 1, 0, ("mono", False, False)), ("Own", 2 + 64, 700, ("serif", True, True)), ("Own", 0, 0, ("sans", False, False))])
def test_faces(name, flags, weight, want):
    assert f.pick_face(name, flags, weight) == want
