"""Small font programs with known glyphs, codes and widths, as test inputs. The readers don't use this module."""

from __future__ import annotations

import struct

from folioscan.functions.fonts import encrypt
from folioscan.functions.glyph_names import STANDARD_STRINGS


def square(size: int) -> bytes:
    """The outline of a square of four points."""
    return struct.pack(">hhhhh", 1, 0, 0, size, size) + struct.pack(">HH", 3, 0) + b"\x01" * 4 + struct.pack(">hhhh", 0, size, 0, -size) + struct.pack(">hhhh", 0, 0, size, 0)


def build_sfnt(advances: list[int], codes: dict[int, int], em: int = 1000, empty: tuple[int, ...] = (0,), form: int = 4, platform: tuple[int, int] = (3, 1), sizes: list[int] | None = None) -> bytes:
    """A TrueType font whose glyphs have these advances; those of `empty` have no outline. codes maps characters to
    glyphs by a map of format 0, 4 or 6."""
    glyphs = [b"" if g in empty else square(sizes[g] if sizes else 500) for g in range(len(advances))]
    glyphs = [g + b"\0" * (-len(g) % 4) for g in glyphs]
    at = [0]
    for g in glyphs:
        at.append(at[-1] + len(g))
    order = sorted(codes)
    if form == 0:
        sub = struct.pack(">HHH", 0, 262, 0) + bytes(codes.get(c, 0) for c in range(256))
    elif form == 6:
        first, n = (order[0], order[-1] - order[0] + 1) if order else (0, 0)
        sub = struct.pack(">HHHHH", 6, 10 + 2 * n, 0, first, n) + b"".join(struct.pack(">H", codes.get(first + k, 0)) for k in range(n))
    else:
        segments = [(c, c, (codes[c] - c) & 0xFFFF) for c in order] + [(0xFFFF, 0xFFFF, 1)]
        n = len(segments)
        sub = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(">H", e) for _, e, _ in segments) + b"\0\0" + b"".join(struct.pack(">H", s) for s, _, _ in segments)
        sub += b"".join(struct.pack(">H", d) for _, _, d in segments) + b"\0\0" * n
    tables = {
        "cmap": struct.pack(">HHHHI", 0, 1, *platform, 12) + sub, "glyf": b"".join(glyphs), "head": struct.pack(">IIIIHH", 0x10000, 0, 0, 0x5F0F3CF5, 0, em) + b"\0" * 16 + struct.pack(">hhhhHHhhh", 0, 0, em, em, 0, 8, 2, 1, 0),
        "hhea": b"\0\1\0\0" + b"\0" * 30 + struct.pack(">H", len(advances)), "hmtx": b"".join(struct.pack(">Hh", a, 0) for a in advances), "loca": b"".join(struct.pack(">I", a) for a in at), "maxp": struct.pack(">IH", 0x10000, len(advances)) + b"\0" * 26,
    }
    head, body, start = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in sorted(tables.items()):
        head += tag.encode() + struct.pack(">III", 0, start + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + body


def _index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    at, ends = 1, []
    for x in items:
        ends.append(at)
        at += len(x)
    return struct.pack(">HB", len(items), 4) + b"".join(struct.pack(">I", e) for e in [*ends, at]) + b"".join(items)


def _number(v: int) -> bytes:
    """As long as any, so that offsets don't move each other."""
    return b"\x1d" + struct.pack(">i", v)


def type2_number(v: int) -> bytes:
    return bytes([v + 139]) if -107 <= v <= 107 else b"\x1c" + struct.pack(">h", v)


def _box(width: int | None, size: int) -> bytes:
    """A charstring of a square, with its width first."""
    n = type2_number
    return (b"" if width is None else n(width)) + n(0) + n(0) + b"\x15" + n(size) + n(size) + n(-size) + b"\x06" + b"\x0e"


def build_cff(names: list[str], widths: list[int], cids: list[int] | None = None, default: int = 500, nominal: int = 600, size: int = 400) -> bytes:
    """A compact font of a .notdef and these glyphs; with cids one by CID. Widths that are the default are left out."""
    strings = [n.encode() for n in names if n not in STANDARD_STRINGS] if cids is None else [b"Adobe", b"Identity"]
    known = len(STANDARD_STRINGS)
    ids = cids if cids is not None else [STANDARD_STRINGS.index(n) if n in STANDARD_STRINGS else known + strings.index(n.encode()) for n in names]
    charset = b"\0" + b"".join(struct.pack(">H", k) for k in ids)
    charstrings = _index([_box(None, size)] + [_box(None if w == default else w - nominal, size) for w in widths])
    private = _number(default) + b"\x14" + _number(nominal) + b"\x15"
    start = b"\1\0\4\1" + _index([b"Own"])
    tail = _index(strings) + b"\0\0"

    def top(at: int) -> bytes:
        parts = {"charset": at, "charstrings": at + len(charset), "private": at + len(charset) + len(charstrings)}
        d = b""
        if cids is not None:
            d += _number(known) + _number(known + 1) + _number(0) + b"\x0c\x1e"
        d += _number(parts["charset"]) + b"\x0f" + _number(parts["charstrings"]) + b"\x11"
        if cids is None:
            return d + _number(len(private)) + _number(parts["private"]) + b"\x12"
        after = parts["private"] + len(private)
        return d + _number(after) + b"\x0c\x24" + _number(after + len(fds(parts["private"]))) + b"\x0c\x25"

    def fds(at: int) -> bytes:
        return _index([_number(len(private)) + _number(at) + b"\x12"])

    at = len(start) + len(_index([top(0)])) + len(tail)
    out = start + _index([top(at)]) + tail + charset + charstrings
    place = len(out)
    out += private
    if cids is not None:
        out += fds(place) + b"\3" + struct.pack(">HHBH", 1, 0, 0, len(cids) + 1)
    return out


def build_type1(widths: dict[str, int], codes: dict[int, str] | None = None, size: int = 300, hexadecimal: bool = False) -> bytes:
    """A Type 1 program of these glyphs, by the standard encoding or by codes."""

    def n(v: int) -> bytes:
        return bytes([v + 139]) if -107 <= v <= 107 else b"\xff" + struct.pack(">i", v)

    table = b"/Encoding StandardEncoding def\n" if codes is None else b"/Encoding 256 array\n" + b"".join(b"dup %d /%s put\n" % (c, x.encode()) for c, x in codes.items()) + b"readonly def\n"
    box = n(0) + n(0) + b"\x15" + n(size) + b"\x06" + n(size) + b"\x07" + n(-size) + b"\x06\x09\x0e"
    chars = b""
    for name, w in widths.items():
        c = encrypt(n(0) + n(w) + b"\x0d" + box, 4330)
        chars += b"/%s %d RD " % (name.encode(), len(c)) + c + b" ND\n"
    body = b"dup /Private 8 dict dup begin /lenIV 4 def\n2 index /CharStrings %d dict dup begin\n" % len(widths) + chars + b"end\nend\nreadonly put\n"
    coded = encrypt(body, 55665, b"abcd")
    return b"%!PS-AdobeFont-1.0: Own\n" + table + b"currentfile eexec\n" + (coded.hex().encode() if hexadecimal else coded) + b"\n" + b"0" * 64 + b"\ncleartomark\n"
