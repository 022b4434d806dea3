"""Repairs by painting: images without soft masks, and pages and forms as images where nothing else mends them."""

from __future__ import annotations

import numpy as np

from folioscan.functions import raster
from folioscan.operators.font_repair import _View
from folioscan.sources.content_usage import page_dicts
from folioscan.sources.pdf_bytes import Dict, Name, Ref

#: Pixels for each unit of a page: 144 in an inch.
SCALE = 2.0


class _Doc(_View):
    def decoded(self, s: Dict) -> bytes:
        return self.e.body(s)


def picture(e, pixels: np.ndarray) -> Ref:
    """An image of pixels of red, green and blue."""
    s = Dict(Type=Name("XObject"), Subtype=Name("Image"), Width=int(pixels.shape[1]), Height=int(pixels.shape[0]), BitsPerComponent=8, ColorSpace=Name("DeviceRGB"))
    e.set_body(s, pixels.tobytes())
    return e.add(s)


def bake_soft_masks(e) -> None:
    """Images with a soft mask become what they show on white; of those without a decoder the mask goes alone."""
    doc = _Doc(e)
    for d in list(e.dicts()):
        mask = e.get(d.get("SMask"))
        if not (d.is_stream and d.get("Subtype") == "Image" and mask is not None and mask != "None"):
            continue
        rgba = raster.decode_image(d, doc.resolve, doc.decoded)
        d.pop("SMask")
        if rgba is not None:
            flat = rgba[:, :, :3] * rgba[:, :, 3:] + 1 - rgba[:, :, 3:]
            e.set_body(d, np.rint(flat * 255).astype(np.uint8).tobytes())
            d.update(ColorSpace=Name("DeviceRGB"), BitsPerComponent=8)
            for k in ("Decode", "Mask"):
                d.pop(k, None)


def flatten_form(e, form: Dict, resources: object = None) -> bool:
    """A form as an image of what it paints; whether all of it could be painted, else it stays."""
    doc, box = _Doc(e), e.get(form.get("BBox"))
    if not isinstance(box, list) or len(box) != 4:
        return False
    x0, y0, x1, y1 = (float(e.get(v)) for v in box)
    try:
        canvas = raster.Canvas(max(1, round((y1 - y0) * SCALE)), max(1, round((x1 - x0) * SCALE)))
        r = raster.Renderer(doc, canvas)
        own = e.get(form.get("Resources"))
        r.run(doc.decoded(form), own if own is not None else resources, raster.State(ctm=(SCALE, 0, 0, -SCALE, -x0 * SCALE, y1 * SCALE)))
    except ValueError:
        return False
    if r.missing:
        return False
    form["Resources"] = Dict(XObject=Dict(Im=picture(e, canvas.pixels())))
    form.pop("Group", None)
    e.set_body(form, b"q %g 0 0 %g %g %g cm /Im Do Q" % (x1 - x0, y1 - y0, x0, y0))
    return True


def flatten_page(e, page: Dict, resources: object) -> bool:
    """A page as an image of what it shows; whether all of it could be painted, else it stays."""
    doc = _Doc(e)
    try:
        pixels, missing = raster.render_page(doc, page, resources, SCALE)
    except ValueError:
        return False
    if missing:
        return False
    x0, y0, x1, y1 = raster.page_box(doc, page)
    s = Dict()
    e.set_body(s, b"q %g 0 0 %g %g %g cm /Im Do Q" % (x1 - x0, y1 - y0, x0, y0))
    page["Contents"], page["Resources"] = e.add(s), Dict(XObject=Dict(Im=picture(e, pixels)))
    page.pop("Group", None)
    return True


def backstop(e, pages: list[int]) -> int:
    """Flattens the pages of these numbers, from 1; how many it could."""
    doc = _Doc(e)
    return sum(flatten_page(e, p, r) for k, (p, r) in enumerate(list(page_dicts(doc)), 1) if k in pages)
