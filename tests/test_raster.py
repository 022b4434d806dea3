"""Painting: areas against arithmetic, and pages against what their content says."""

import numpy as np
import pytest

from folioscan.functions import font_fixture, raster
from folioscan.functions import pdf_fixture as fx
from folioscan.sources.content_usage import page_dicts
from folioscan.sources.pdf_bytes import Dict, Document, Hex, Lit, Name, Ref, write_document


def test_coverage_is_the_area():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = [tuple(x) for x in rng.uniform(1, 19, (3, 2))]
        (a, b), (c, d), (e, f) = p
        assert raster.coverage([p], 20, 20).sum() == pytest.approx(abs((c - a) * (f - b) - (e - a) * (d - b)) / 2, abs=0.8)
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    assert raster.coverage([square(2.25, 7.5)], 10, 10).sum() == pytest.approx(27.5625, abs=0.2)
    both = [square(0, 10), square(2, 8)]
    assert raster.coverage(both, 10, 10).sum() == pytest.approx(100) and raster.coverage(both, 10, 10, True).sum() == pytest.approx(64)
    assert raster.coverage([square(0, 10), square(2, 8)[::-1]], 10, 10).sum() == pytest.approx(64)
    assert raster.coverage([], 5, 5).sum() == 0 and raster.coverage([square(-5, 3)], 10, 10).sum() == pytest.approx(9)


def test_strokes_images_and_blends():
    c = raster.Canvas(20, 20)
    c.stroke([[(2, 10), (18, 10)]], [False], 4, (0, 0, 0))
    assert (1 - c.rgb[:, :, 0]).sum() == pytest.approx(64, abs=1)
    c = raster.Canvas(4, 4)
    c.fill([[(0, 0), (4, 0), (4, 4), (0, 4)]], (1, 0, 0), 0.5)
    assert c.pixels()[0, 0].tolist() == [255, 128, 128]
    rgba = np.ones((2, 2, 4))
    rgba[0, 0, :3], rgba[1, 1, 3] = 0, 0
    c = raster.Canvas(4, 4)
    c.fill([[(0, 0), (4, 0), (4, 4), (0, 4)]], (0, 1, 0))
    c.image(rgba, (4, 0, 0, -4, 0, 4))
    assert c.pixels()[0, 0].tolist() == [0, 0, 0] and c.pixels()[3, 3].tolist() == [0, 255, 0] and c.pixels()[0, 3].tolist() == [255] * 3
    m = (2.0, 1.0, -1.0, 3.0, 5.0, -4.0)
    assert raster.apply(raster.inverse(m), *raster.apply(m, 3, 4)) == pytest.approx((3, 4)) and raster.inverse((0,) * 6) is None
    with pytest.raises(ValueError):
        raster.Canvas(0, 5)


def image(data, **x):
    s = Dict({"Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")} | x)
    s.raw = data
    return s


def test_images():
    get, dec = (lambda v: v), (lambda s: s.raw)
    one = lambda *a, **x: np.rint(raster.decode_image(image(*a, **x), get, dec) * 255).astype(int).tolist()[0]
    assert one(b"\0\xff") == [[0, 0, 0, 255], [255] * 4] and one(b"\0\xff", Decode=[1, 0])[0] == [255] * 4
    assert one(b"\x40", BitsPerComponent=1) == [[0, 0, 0, 255], [255] * 4] and one(b"\x1b", BitsPerComponent=2)[1][0] == 85 and one(b"\xff\xff\x80\0", BitsPerComponent=16)[1][0] == 128
    assert one(b"\1\0", ColorSpace=[Name("Indexed"), Name("DeviceRGB"), 1, Hex(b"000000ff0000")])[0] == [255, 0, 0, 255]
    assert one(b"\0\0", SMask=image(b"\x80\0"))[0][3] == 128 and one(b"\0\x05", Mask=[5, 9])[1][3] == 0 and one(b"\x80", ImageMask=True)[0][3] == 0
    assert raster.decode_image(Dict(Width=0, Height=1), get, dec) is None and raster.decode_image(image(b"", BitsPerComponent=3), get, dec) is None


def painted(content, change=None):
    o, t = fx.base("text")
    o[7] = fx.stream(content)
    if change:
        change(o)
    doc = Document(write_document(o, t)).open()
    page, resources = next(page_dicts(doc))
    return raster.render_page(doc, page, resources)


def test_pages():
    px, missing = painted(b"1 0 0 rg 10 20 30 40 re f")
    dark = (px == [255, 0, 0]).all(axis=2)
    assert px.shape == (100, 100, 3) and missing == 0 and dark.sum() == 1200 and dark[40:80, 10:40].all()
    px, _ = painted(b"q 2 0 0 2 10 10 cm 0 g 0 0 5 5 re f Q 50 50 5 5 re f")
    assert (px == 0).all(axis=2).sum() == 125
    px, _ = painted(b"20 20 20 20 re W n 0 g 0 0 100 100 re f")
    assert (px == 0).all(axis=2).sum() == 400
    px, _ = painted(b"0 g 50 50 m 90 50 90 90 50 90 c h f 10 10 m 20 10 l 20 20 l s")
    assert (255 - px[:, :, 0].astype(int)).sum() / 255 == pytest.approx(960 + 34, rel=0.03)  # of the curve, and of the outline
    px, missing = painted(b"q 50 0 0 50 0 0 cm /Im0 Do Q")
    assert (px == 0).all(axis=2).sum() == 2500 and missing == 0
    px, missing = painted(b"BT /F0 40 Tf 10 10 Td (x) Tj 0 30 Td (xx) Tj ET")  # squares of half an em
    assert (px == 0).all(axis=2).sum() == 1200 and missing == 0
    px, missing = painted(b"BT /F0 40 Tf 3 Tr (x) Tj ET")
    assert (px == 255).all() and missing == 0
    assert painted(b"BT /F0 40 Tf (z) Tj ET")[1] == 1 and painted(b"BT /None 40 Tf (z) Tj ET")[1] == 1
    px, _ = painted(b"/Fm0 Do", lambda o: o.__setitem__(14, fx.stream(b"0 0 100 100 re f", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 10, 10], Matrix=[2, 0, 0, 2, 0, 0])))
    assert (px == 0).all(axis=2).sum() == 400
    px, _ = painted(b"BI /W 1 /H 1 /BPC 8 /CS /G ID \x00 EI")
    assert (px == 0).all(axis=2).sum() == 1
    px, _ = painted(b"/GS0 gs 0 0 0 rg 0 0 10 10 re f", lambda o: o[10].update(ca=0.5))
    assert px[95, 5].tolist() == [128] * 3


@pytest.mark.parametrize("key, data, kind", [("FontFile", font_fixture.build_type1({".notdef": 0, "x": 500}), "Type1"), ("FontFile3", font_fixture.build_cff(["x"], [500]), "Type1")])
def test_text_of_other_programs(key, data, kind):
    def change(o):
        o[15] = fx.stream(data)
        o[9].pop("FontFile2")
        o[9][key] = Ref(15, 0)
        o[8]["Subtype"] = Name(kind)

    px, missing = painted(b"BT /F0 100 Tf (x) Tj ET", change)
    assert missing == 0 and (px == 0).all(axis=2).sum() == (900 if key == "FontFile" else 1600)
    assert Lit(b"x") == b"x"


def test_coverage_line_by_line():
    """All lines at once, in parts of any size, cover what each line's sorted crossings enclose."""
    rng, height, width = np.random.default_rng(4), 12, 17
    for k in range(60):
        path = [[tuple(p) for p in rng.uniform(-4, 20, (rng.integers(1, 7), 2)).round(k % 3)] for _ in range(3)]
        want = np.zeros((height, width))
        for line in range(height * raster.SAMPLES):
            y, crossings = (line + 0.5) / raster.SAMPLES, []
            for c in path:
                for (x0, y0), (x1, y1) in zip(c, c[1:] + c[:1]):
                    if min(y0, y1) <= y < max(y0, y1):
                        crossings.append((x0 + (y - y0) * (x1 - x0) / (y1 - y0), 1 if y0 < y1 else -1))
            crossings.sort()
            turns = 0
            for j, (x, sign) in enumerate(crossings[:-1]):
                turns += sign
                if (j % 2 == 0) if k % 2 else turns:
                    a, b = (min(max(v, 0), width) for v in (x, crossings[j + 1][0]))
                    want[line // raster.SAMPLES] += [max(0, min(b, i + 1) - max(a, i)) / raster.SAMPLES for i in range(width)]
        assert np.allclose(raster.coverage(path, height, width, bool(k % 2)), want, atol=1e-9)
    whole = raster.coverage(path, height, width)
    most, raster.MAX_CROSSINGS = raster.MAX_CROSSINGS, 7
    try:
        assert (raster.coverage(path, height, width) == whole).all()
    finally:
        raster.MAX_CROSSINGS = most
