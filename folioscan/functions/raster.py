"""Pages as pixels: paths, text, images and forms of content streams, painted on an array.

Coverage is exact along a line and sampled SAMPLES times between lines. Colours are red, green and blue from 0 to 1 on
white. Clips are masks. What a file can't give (a glyph without a program, an image in a filter without a decoder) isn't
painted and is counted in `missing`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from folioscan.functions import colour, fonts
from folioscan.sources.pdf_bytes import Dict, Hex, Name, tokenize_content

SAMPLES, CURVE_STEPS, MAX_FORMS, MAX_PIXELS = 4, 12, 24, 1 << 26
#: Pairs of a line and an edge that are held at once.
MAX_CROSSINGS = 1 << 18
PAINT = frozenset("n f F f* S s B B* b b*".split())
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
Path = list[list[tuple[float, float]]]


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverse(m: Matrix) -> Matrix | None:
    d = m[0] * m[3] - m[1] * m[2]
    if abs(d) < 1e-12:
        return None
    return m[3] / d, -m[1] / d, -m[2] / d, m[0] / d, (m[2] * m[5] - m[3] * m[4]) / d, (m[1] * m[4] - m[0] * m[5]) / d


def coverage(path: Path, height: int, width: int, even_odd: bool = False) -> np.ndarray:
    """The share of each pixel that a path's inside covers, by the winding number or by parity."""
    out = np.zeros((height, width + 2))
    edges = []
    for contour in path:
        for (x0, y0), (x1, y1) in zip(contour, contour[1:] + contour[:1]):
            if y0 != y1:
                edges.append((x0, y0, x1, y1, 1) if y0 < y1 else (x1, y1, x0, y0, -1))
    if not edges:
        return out[:, :width]
    e = np.array(edges)
    first, last = max(0, int(np.floor(e[:, 1].min() * SAMPLES))), min(height * SAMPLES, int(np.ceil(e[:, 3].max() * SAMPLES)) + 1)
    step = max(1, MAX_CROSSINGS // len(e))
    for top in range(first, last, step):
        lines = np.arange(top, min(top + step, last))
        y = (lines + 0.5) / SAMPLES
        at, edge = np.nonzero((e[:, 1] <= y[:, None]) & (y[:, None] < e[:, 3]))  # by line, then by edge
        if not len(at):
            continue
        on = e[edge]
        x = on[:, 0] + (y[at] - on[:, 1]) * (on[:, 2] - on[:, 0]) / (on[:, 3] - on[:, 1])
        if np.isnan(x).any():
            raise ValueError("a path without a place")
        order = np.lexsort((x, at))  # lines stay where they are
        x, winding = np.clip(x[order], 0, width), np.cumsum(on[order, 4])
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        if even_odd:
            inside = (np.arange(len(at)) - starts[of]) % 2 == 0
        else:
            inside = winding - np.concatenate([[0.0], winding[starts[1:] - 1]])[of] != 0
        inside[np.append(starts[1:], len(at)) - 1] = False
        k = np.flatnonzero(inside)  # the integral of the span's step, as a second difference
        ends = np.stack([x[k], x[k + 1]], axis=1)
        i = ends.astype(int)
        part, sign = ends - i, np.array([1.0, -1.0])
        cells = (lines[at[k]] // SAMPLES)[:, None] * (width + 2) + i
        np.add.at(out.reshape(-1), np.stack([cells, cells + 1], axis=2).reshape(-1), np.stack([sign * (1 - part) / SAMPLES, sign * part / SAMPLES], axis=2).reshape(-1))
    return np.clip(np.cumsum(out, axis=1)[:, :width], 0, 1)


def stroke_outline(path: Path, width: float, closed: list[bool]) -> Path:
    """Quadrilaterals along the segments and rounds at the joins, to be filled by the winding number."""
    r, out = max(width / 2, 0.35), []
    circle = [(r * np.cos(a), r * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 13)[:-1]]
    for contour, shut in zip(path, closed):
        points = contour + contour[:1] if shut else contour
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            d = float(np.hypot(x1 - x0, y1 - y0))
            if d:
                nx, ny = -(y1 - y0) / d * r, (x1 - x0) / d * r
                out.append([(x0 - nx, y0 - ny), (x1 - nx, y1 - ny), (x1 + nx, y1 + ny), (x0 + nx, y0 + ny)])
        joins = points if shut else points[1:-1]
        out += [[(x + dx, y + dy) for dx, dy in circle] for x, y in joins]
    return out


class Canvas:
    def __init__(self, height: int, width: int):
        if height * width > MAX_PIXELS or height < 1 or width < 1:
            raise ValueError("no such page")
        self.rgb, self.height, self.width = np.ones((height, width, 3)), height, width

    def paint(self, share: np.ndarray, rgb: np.ndarray, clip: np.ndarray | None) -> None:
        if clip is not None:
            share = share * clip
        self.rgb += share[:, :, None] * (rgb - self.rgb)

    def fill(self, path: Path, rgb: object, alpha: float = 1.0, even_odd: bool = False, clip: np.ndarray | None = None) -> None:
        self.paint(coverage(path, self.height, self.width, even_odd) * alpha, np.asarray(rgb, float), clip)

    def stroke(self, path: Path, closed: list[bool], width: float, rgb: object, alpha: float = 1.0, clip: np.ndarray | None = None) -> None:
        self.fill(stroke_outline(path, width, closed), rgb, alpha, False, clip)

    def image(self, rgba: np.ndarray, m: Matrix, alpha: float = 1.0, clip: np.ndarray | None = None) -> None:
        """An image on the unit square that m places, by the pixel under each centre."""
        back = inverse(m)
        if back is None:
            return
        y, x = np.mgrid[0 : self.height, 0 : self.width] + 0.5
        u, v = back[0] * x + back[2] * y + back[4], back[1] * x + back[3] * y + back[5]
        inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        h, w = rgba.shape[:2]
        picked = rgba[np.clip(((1 - v) * h).astype(int), 0, h - 1), np.clip((u * w).astype(int), 0, w - 1)]
        self.paint(inside * picked[:, :, 3] * alpha, picked[:, :, :3], clip)

    def pixels(self) -> np.ndarray:
        return np.rint(np.clip(self.rgb, 0, 1) * 255).astype(np.uint8)


_SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "IM": "ImageMask", "F": "Filter", "DP": "DecodeParms", "I": "Interpolate"}


def samples(raw: bytes, height: int, width: int, n: int, bits: int) -> np.ndarray:
    """The samples of an image, rows that end at bytes; missing ones are 0."""
    row = (width * n * bits + 7) // 8
    data = np.frombuffer(raw[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        out = data[:, : width * n].astype(float)
    elif bits == 16:
        out = (data[:, 0 : 2 * width * n : 2].astype(float) * 256) + data[:, 1 : 2 * width * n : 2]
    else:
        out = np.unpackbits(data, axis=1)[:, : width * n * bits].reshape(height, width * n, bits) @ (2.0 ** np.arange(bits - 1, -1, -1))
    return out.reshape(height, width, n)


def decode_image(d: dict, get, decoded, resources: object = None, paint: object = (0, 0, 0), depth: int = 0) -> np.ndarray | None:
    """Red, green, blue and opacity of an image; None of one whose samples can't be had."""
    e = {_SHORT.get(k, k): get(v) for k, v in d.items()}
    width, height, mask = e.get("Width"), e.get("Height"), e.get("ImageMask") is True
    if type(width) is not int or type(height) is not int or not 0 < width * height <= MAX_PIXELS:
        return None
    cs = None if mask else e.get("ColorSpace")
    bits, n = (1, 1) if mask else (e.get("BitsPerComponent", 8), colour.components(colour.named_space(cs, resources, get) or cs if isinstance(cs, str) else cs, get))
    try:
        if bits not in (1, 2, 4, 8, 16):
            return None
        s = samples(decoded(d), height, width, n, bits)
    except ValueError:
        return None
    most = 2**bits - 1
    stated = e.get("Decode")
    ends = np.array([float(get(x)) for x in stated]).reshape(-1, 2) if isinstance(stated, list) and len(stated) == 2 * n else None
    out = np.ones((height, width, 4))
    if mask:
        out[:, :, :3] = paint
        out[:, :, 3] = s[:, :, 0] if ends is not None and ends[0, 0] == 1 else 1 - s[:, :, 0]
        return out
    head = get(cs[0]) if isinstance(cs, list) and cs else cs
    if ends is not None:
        values = ends[:, 0] + s / most * (ends[:, 1] - ends[:, 0])
    else:
        values = s if head in ("Indexed", "I") else s / most
        if head == "Lab":
            values = values * [100, 255, 255] - [0, 128, 128]
    flat = values.reshape(-1, n)
    one, back = np.unique(flat, axis=0, return_inverse=True)
    out[:, :, :3] = colour.to_rgb(cs, one, resources, get, decoded)[back.reshape(-1)].reshape(height, width, 3)
    soft, hard = e.get("SMask"), e.get("Mask")
    if isinstance(soft, dict) and depth < 2 and (alpha := decode_image(soft, get, decoded, None, (0, 0, 0), depth + 1)) is not None:
        out[:, :, 3] = _resized(alpha[:, :, 0], height, width)
    elif isinstance(hard, dict) and depth < 2 and (alpha := decode_image(hard, get, decoded, None, (0, 0, 0), depth + 1)) is not None:
        out[:, :, 3] = _resized(alpha[:, :, 3], height, width)
    elif isinstance(hard, list) and len(hard) == 2 * n:
        low, high = np.array([float(get(x)) for x in hard]).reshape(-1, 2).T
        out[:, :, 3] = ~((s >= low) & (s <= high)).all(axis=2)
    return out


def _resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return a[np.arange(height) * a.shape[0] // height][:, np.arange(width) * a.shape[1] // width]


@dataclass(frozen=True)
class State:
    """The graphics state that q saves."""

    ctm: Matrix = IDENTITY
    fill_space: object = "DeviceGray"
    stroke_space: object = "DeviceGray"
    fill: tuple[float, ...] = (0.0, 0.0, 0.0)
    stroke: tuple[float, ...] = (0.0, 0.0, 0.0)
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    line_width: float = 1.0
    clip: np.ndarray | None = field(default=None, compare=False)
    font: object = None
    size: float = 1.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


def _numbers(operands: list, n: int) -> list[float] | None:
    v = [float(x) for x in operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
    return v[-n:] if len(v) >= n else None


class Renderer:
    """Runs content on a canvas. doc has resolve() and decoded()."""

    def __init__(self, doc, canvas: Canvas):
        self.doc, self.canvas, self.missing, self.glyphs = doc, canvas, 0, {}

    def decoded(self, s: Dict) -> bytes:
        return self.doc.decoded(s)

    def run(self, data: bytes, resources: object, state: State, depth: int = 0) -> None:
        get, canvas = self.doc.resolve, self.canvas
        saved: list[State] = []
        path: Path = []
        closed: list[bool] = []
        at = (0.0, 0.0)
        pending: bool | None = None
        tm = line = IDENTITY
        resources = get(resources) if get(resources) is not None else Dict()

        def named(category: str, name: object) -> object:
            group = get(resources.get(category)) if isinstance(resources, dict) else None
            return get(group.get(name)) if isinstance(group, dict) and isinstance(name, str) else None

        def rgb(space: object, values: list) -> tuple[float, ...]:
            v = [float(x) for x in values if isinstance(x, (int, float))]
            return tuple(colour.to_rgb(space, [v], resources, get, self.decoded)[0]) if v else (0.5, 0.5, 0.5)

        def curve(a: tuple, b: tuple, c: tuple) -> None:
            nonlocal at
            if path:
                path[-1] += [apply(state.ctm, *p) for p in fonts._curve([at, a, b, c], 3, CURVE_STEPS)]
            at = c

        def paint(fill: bool, even_odd: bool, stroke: bool, shut: bool) -> None:
            nonlocal path, closed, pending, state
            if shut and closed:
                closed[-1] = True
            if fill and path:
                canvas.fill(path, state.fill, state.fill_alpha, even_odd, state.clip)
            if stroke and path:
                m = state.ctm
                canvas.stroke(path, closed, state.line_width * abs(m[0] * m[3] - m[1] * m[2]) ** 0.5, state.stroke, state.stroke_alpha, state.clip)
            if pending is not None:
                c = coverage(path, canvas.height, canvas.width, pending)
                state = replace(state, clip=c if state.clip is None else state.clip * c)
            path, closed, pending = [], [], None

        def show(raw: bytes) -> None:
            nonlocal tm
            for code, outline, advance in self.text(state.font, raw):
                scale: Matrix = (state.size * state.scale, 0, 0, state.size, 0, state.rise)
                if outline and state.mode in (0, 1, 2, 4, 5, 6):
                    m = multiply(multiply(scale, tm), state.ctm)
                    glyph = [[apply(m, x, y) for x, y in c] for c in outline]
                    if state.mode in (0, 2, 4, 6):
                        canvas.fill(glyph, state.fill, state.fill_alpha, False, state.clip)
                    if state.mode in (1, 2, 5, 6):
                        canvas.stroke(glyph, [True] * len(glyph), state.line_width, state.stroke, state.stroke_alpha, state.clip)
                step = (advance * state.size + state.char_space + (state.word_space if code == 32 else 0)) * state.scale
                tm = multiply((1, 0, 0, 1, step, 0), tm)

        def next_line(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = multiply((1, 0, 0, 1, x, y), line)

        for op, operands in tokenize_content(data):
            v = lambda n, o=operands: _numbers(o, n)
            if op == "q":
                saved.append(state)
            elif op == "Q":
                state = saved.pop() if saved else state
            elif op == "cm" and (m := v(6)):
                state = replace(state, ctm=multiply(tuple(m), state.ctm))
            elif op == "w" and (m := v(1)):
                state = replace(state, line_width=m[0])
            elif op == "gs" and operands and isinstance(g := named("ExtGState", operands[0]), dict):
                new = {k: float(get(g[n])) for k, n in (("fill_alpha", "ca"), ("stroke_alpha", "CA"), ("line_width", "LW")) if isinstance(get(g.get(n)), (int, float))}
                f = get(g.get("Font"))
                if isinstance(f, list) and len(f) == 2:
                    new |= {"font": get(f[0]), "size": float(get(f[1]))}
                state = replace(state, **new)
            elif op == "m" and (p := v(2)):
                at = tuple(p)
                path.append([apply(state.ctm, *at)])
                closed.append(False)
            elif op == "l" and (p := v(2)) and path:
                at = tuple(p)
                path[-1].append(apply(state.ctm, *at))
            elif op == "c" and (p := v(6)):
                curve(tuple(p[:2]), tuple(p[2:4]), tuple(p[4:]))
            elif op == "v" and (p := v(4)):
                curve(at, tuple(p[:2]), tuple(p[2:]))
            elif op == "y" and (p := v(4)):
                curve(tuple(p[:2]), tuple(p[2:]), tuple(p[2:]))
            elif op == "h" and closed:
                closed[-1] = True
            elif op == "re" and (p := v(4)):
                x, y, w, h = p
                at = (x, y)
                path.append([apply(state.ctm, *q) for q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
                closed.append(True)
            elif op in PAINT:
                paint(op[0] in "fFBb", op.endswith("*"), op[0] in "SsBb", op[0] in "sb")
            elif op in ("W", "W*"):
                pending = op == "W*"
            elif op in ("g", "rg", "k", "G", "RG", "K"):
                space = {"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}[op.lower()]
                which = "fill" if op.islower() else "stroke"
                state = replace(state, **{which + "_space": space, which: rgb(space, operands)})
            elif op in ("cs", "CS") and operands:
                which, space = ("fill" if op == "cs" else "stroke"), named("ColorSpace", operands[0]) or operands[0]
                state = replace(state, **{which + "_space": space, which: rgb(space, [0.0 if colour.components(space, get) < 4 else 0.0] * colour.components(space, get))})
            elif op in ("sc", "scn", "SC", "SCN"):
                which = "fill" if op.islower() else "stroke"
                state = replace(state, **{which: rgb(getattr(state, which + "_space"), operands)})
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf" and len(operands) > 1:
                state = replace(state, font=named("Font", operands[0]), size=float(operands[1]) if isinstance(operands[1], (int, float)) else 1.0)
            elif op in ("Tc", "Tw", "TL", "Ts", "Tr", "Tz") and (p := v(1)):
                key = {"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise", "Tr": "mode", "Tz": "scale"}[op]
                state = replace(state, **{key: int(p[0]) if op == "Tr" else p[0] / 100 if op == "Tz" else p[0]})
            elif op in ("Td", "TD") and (p := v(2)):
                if op == "TD":
                    state = replace(state, leading=-p[1])
                next_line(*p)
            elif op == "Tm" and (p := v(6)):
                tm = line = tuple(p)
            elif op == "T*":
                next_line(0, -state.leading)
            elif op in ("Tj", "'", '"') and operands and isinstance(operands[-1], bytes):
                if op == '"' and (p := v(2)):
                    state = replace(state, word_space=p[0], char_space=p[1])
                if op != "Tj":
                    next_line(0, -state.leading)
                show(operands[-1].value if isinstance(operands[-1], Hex) else bytes(operands[-1]))
            elif op == "TJ" and operands and isinstance(operands[0], list):
                for x in operands[0]:
                    if isinstance(x, bytes):
                        show(x.value if isinstance(x, Hex) else bytes(x))
                    elif isinstance(x, (int, float)):
                        tm = multiply((1, 0, 0, 1, -x / 1000 * state.size * state.scale, 0), tm)
            elif op == "Do" and operands and isinstance(x := named("XObject", operands[0]), dict):
                if x.get("Subtype") == "Image":
                    self.image(x, state, resources)
                elif x.get("Subtype") == "Form" and depth < MAX_FORMS:
                    self.form(x, state, resources, depth + 1)
            elif op == "BI":
                self.image(operands[0], state, resources)

    def image(self, d: Dict, state: State, resources: object) -> None:
        rgba = decode_image(d, self.doc.resolve, self._image_bytes, resources, state.fill)
        if rgba is None:
            self.missing += 1
        else:
            self.canvas.image(rgba, state.ctm, state.fill_alpha, state.clip)

    def _image_bytes(self, d: Dict) -> bytes:
        long = Dict({_SHORT.get(k, k): v for k, v in d.items()})
        long.raw = d.raw
        return self.decoded(long)

    def form(self, x: Dict, state: State, resources: object, depth: int) -> None:
        get = self.doc.resolve
        m, box = get(x.get("Matrix")), get(x.get("BBox"))
        if isinstance(m, list) and len(m) == 6:
            state = replace(state, ctm=multiply(tuple(float(get(k)) for k in m), state.ctm))
        if isinstance(box, list) and len(box) == 4:
            a, b, c, d = (float(get(k)) for k in box)
            clip = coverage([[apply(state.ctm, *p) for p in ((a, b), (c, b), (c, d), (a, d))]], self.canvas.height, self.canvas.width)
            state = replace(state, clip=clip if state.clip is None else state.clip * clip)
        try:
            self.run(self.decoded(x), x.get("Resources") if get(x.get("Resources")) is not None else resources, state, depth)
        except ValueError:
            self.missing += 1

    def text(self, font: object, raw: bytes):
        """(code, outline in text space, advance) of each code that a font shows."""
        if not isinstance(font, dict):
            self.missing += bool(raw)
            return
        key = id(font)
        if key not in self.glyphs:
            self.glyphs[key] = self._font(font)
        glyph, two = self.glyphs[key]
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if two else list(raw)
        for code in codes:
            outline, advance, known = glyph(code)
            self.missing += not known
            yield (-1 if two else code), outline, advance

    def _font(self, font: Dict):
        """A function from a code to (outline, advance, whether the program has it), and whether codes have two bytes."""
        get = self.doc.resolve
        two = get(font.get("Subtype")) == "Type0"
        own = font
        if two:
            kids = get(font.get("DescendantFonts"))
            own = get(kids[0]) if isinstance(kids, list) and kids and isinstance(get(kids[0]), dict) else Dict()

        def body(x: object) -> bytes | None:
            try:
                return self.decoded(x) if isinstance(x, Dict) and x.is_stream else None
            except ValueError:
                return None

        p = fonts.program_of(own, get, body, None)
        if p is None:
            return (lambda code: ([], 0.5, False)), two
        t, compact, one = (fonts.sfnt(p.data), fonts.cff(p.data) if p.kind == "FontFile3" else None, fonts.type1(p.data) if p.kind == "FontFile" else None)
        stated, widths = dict(p.cid_widths or ()), fonts.code_widths(p)
        gid = fonts._simple_gid(p, t) if t and not two else None
        names = fonts.glyph_table(p.enc) or (list(one.encoding) if one and one.encoding else [""] * 256)

        def glyph(code: int):
            if two:
                width = stated.get(code, p.default_width)
            else:
                k = code - (p.first or 0)
                width = p.widths[k] if 0 <= k < len(p.widths) else widths.get(code, 0)
            outline, em, known = [], 1000.0, False
            if t and p.kind == "FontFile2":
                g = code if two else gid(code)[0]
                if g:
                    outline, em, known = fonts.true_type_outline(t, g), float(fonts.u16(t["head"], 18) or 1000), fonts.present(t, g)
            elif compact:
                g = next((k for k, c in enumerate(compact.sids) if c == code), None) if compact.by_cid else code if two else next((k for k, n in enumerate(compact.names) if n == names[code]), None)
                if g is not None:
                    outline, known = fonts.cff_outline(compact, g), True
            elif one and names[code] in one.charstrings:
                outline, known = fonts.type1_outline(one, names[code]), True
            return [[(x / em, y / em) for x, y in c] for c in outline], width / 1000, known

        return glyph, two


def page_box(doc, page: Dict) -> tuple[float, float, float, float]:
    """The media box of a page, its own or inherited."""
    at, hops = page, 0
    while isinstance(at, dict) and hops < 64:
        box = doc.resolve(at.get("MediaBox"))
        if isinstance(box, list) and len(box) == 4:
            v = [doc.resolve(x) for x in box]
            if all(isinstance(x, (int, float)) for x in v):
                return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])
        at, hops = doc.resolve(at.get("Parent")), hops + 1
    return 0.0, 0.0, 612.0, 792.0


def render_page(doc, page: Dict, resources: object, scale: float = 1.0) -> tuple[np.ndarray, int]:
    """The page's pixels, rows from the top, and how many of its parts couldn't be painted."""
    x0, y0, x1, y1 = page_box(doc, page)
    canvas = Canvas(max(1, round((y1 - y0) * scale)), max(1, round((x1 - x0) * scale)))
    r = Renderer(doc, canvas)
    start = State(ctm=(scale, 0, 0, -scale, -x0 * scale, y1 * scale))
    c = doc.resolve(page.get("Contents"))
    parts = []
    for s in [c] if isinstance(c, dict) else c if isinstance(c, list) else []:
        s = doc.resolve(s)
        try:
            parts.append(doc.decoded(s) if isinstance(s, Dict) and s.is_stream else b"")
        except ValueError:
            r.missing += 1
    r.run(b"\n".join(parts), resources, start)
    return canvas.pixels(), r.missing
