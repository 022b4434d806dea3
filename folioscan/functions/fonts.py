"""Font programs: tables of TrueType, compact (CFF) and Type 1 fonts, their glyphs, widths and outlines, and the rules
that hold a font dictionary against its program.

Everything takes bytes and gives plain values; damaged programs give empty tables instead of errors.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from typing import NamedTuple

from folioscan.functions.glyph_names import STANDARD_STRINGS, encoding, to_unicode

SUBSET_TAG = re.compile(r"[A-Z]{6}\+")
STANDARD_14 = frozenset(
    [f"Courier{x}" for x in ("", "-Bold", "-Oblique", "-BoldOblique")] + [f"Helvetica{x}" for x in ("", "-Bold", "-Oblique", "-BoldOblique")] + [f"Times-{x}" for x in ("Roman", "Bold", "Italic", "BoldItalic")] + ["Symbol", "ZapfDingbats"]
)


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def i16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big", signed=True)


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


# TrueType


@lru_cache(64)
def sfnt(data: bytes) -> dict[str, bytes] | None:
    """The tables of a font by tag; None of what is no such font."""
    if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO") or not (n := u16(data, 4)) or len(data) < 12 + 16 * n:
        return None
    out = {}
    for k in range(12, 12 + 16 * n, 16):
        start = u32(data, k + 8)
        if start <= len(data):
            out[data[k : k + 4].decode("latin-1")] = data[start : start + u32(data, k + 12)]
    return out


def glyph_count(t: dict[str, bytes]) -> int:
    return u16(t.get("maxp", b""), 4)


def glyph_data(t: dict[str, bytes], gid: int) -> bytes:
    """The outline of a glyph; empty without one."""
    loca, long = t.get("loca", b""), u16(t.get("head", b""), 50)
    size = 4 if long else 2
    if gid < 0 or (gid + 2) * size > len(loca):
        return b""
    a, b = (u32(loca, k * 4) if long else 2 * u16(loca, k * 2) for k in (gid, gid + 1))
    return t.get("glyf", b"")[a:b]


def advance(t: dict[str, bytes], gid: int) -> int | None:
    """In thousandths of the em; None where the tables don't tell."""
    hmtx, hhea, head = (t.get(k, b"") for k in ("hmtx", "hhea", "head"))
    em, n = u16(head, 18), u16(hhea, 34)
    if not hmtx or len(hhea) < 36 or len(head) < 20 or not em:
        return None
    at = 4 * min(gid, n - 1)
    if n == 0:
        return 0
    return None if at + 2 > len(hmtx) else (u16(hmtx, at) * 1000 + em // 2) // em


def present(t: dict[str, bytes], gid: int) -> bool:
    """With an outline, or known and without width, as a space of none."""
    return bool(glyph_data(t, gid)) or 0 <= gid < glyph_count(t) and advance(t, gid) == 0


def cmaps(t: dict[str, bytes]) -> dict[tuple[int, int], bytes]:
    """The character maps by platform and encoding; of equal ones the first."""
    c, out = t.get("cmap", b""), {}
    for k in range(4, 4 + 8 * u16(c, 2), 8):
        if k + 8 <= len(c):
            out.setdefault((u16(c, k), u16(c, k + 2)), c[u32(c, k + 4) :])
    return out


def code_map(sub: bytes | None) -> dict[int, int] | None:
    """Code to glyph of a map of format 0, 4 or 6; None of another."""
    if not sub:
        return None
    kind = u16(sub, 0)
    if kind == 0:
        return {c: g for c, g in enumerate(sub[6:262]) if g}
    if kind == 6:
        first, n = u16(sub, 6), u16(sub, 8)
        return {first + k: g for k in range(n) if (g := u16(sub, 10 + 2 * k))}
    if kind != 4:
        return None
    n, out = u16(sub, 6) // 2, {}
    for k in range(n):
        end, start = u16(sub, 14 + 2 * k), u16(sub, 16 + 2 * n + 2 * k)
        delta, at = u16(sub, 16 + 4 * n + 2 * k), 16 + 6 * n + 2 * k
        offset = u16(sub, at)
        for c in range(start, min(end, 0xFFFE) + 1):
            place = at + offset + 2 * (c - start)
            g = c + delta if not offset else (u16(sub, place) and u16(sub, place) + delta) if place + 2 <= len(sub) else 0
            if g & 0xFFFF:
                out[c] = g & 0xFFFF
    return out


Contour = list[tuple[float, float]]


def _curve(points: Contour, degree: int, steps: int = 8) -> Contour:
    """Points on a Bezier curve after its first."""
    out = []
    for s in range(1, steps + 1):
        u, level = s / steps, points
        for _ in range(degree):
            level = [(a[0] + (b[0] - a[0]) * u, a[1] + (b[1] - a[1]) * u) for a, b in zip(level, level[1:])]
        out.append(level[0])
    return out


def true_type_outline(t: dict[str, bytes], gid: int, depth: int = 0) -> list[Contour]:
    """The contours of a glyph, and of those it is composed of, as polygons in font units."""
    g = glyph_data(t, gid)
    if len(g) < 10 or depth > 8:
        return []
    n, at = i16(g, 0), 10
    if n < 0:
        out = []
        while at + 4 <= len(g):
            flags, part = u16(g, at), u16(g, at + 2)
            at += 4
            if flags & 1:
                dx, dy = i16(g, at), i16(g, at + 2)
                at += 4
            else:
                dx, dy = struct.unpack_from(">bb", g, at) if at + 2 <= len(g) else (0, 0)
                at += 2
            m = [1.0, 0.0, 0.0, 1.0]
            many = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            v = [i16(g, at + 2 * k) / 16384 for k in range(many)]
            at += 2 * many
            m = [v[0], 0, 0, v[0]] if many == 1 else [v[0], 0, 0, v[1]] if many == 2 else v if many else m
            if not flags & 2:
                dx = dy = 0  # matched points aren't told from offsets
            out += [[(x * m[0] + y * m[2] + dx, x * m[1] + y * m[3] + dy) for x, y in c] for c in true_type_outline(t, part, depth + 1)]
            if not flags & 0x20:
                break
        return out
    ends = [u16(g, at + 2 * k) for k in range(n)]
    at += 2 * n
    at += 2 + u16(g, at)
    total = ends[-1] + 1 if ends else 0
    flags: list[int] = []
    while len(flags) < total and at < len(g):
        f = g[at]
        at += 1
        flags.append(f)
        if f & 8 and at < len(g):
            flags += [f] * g[at]
            at += 1
    axes = []
    for short, same in ((2, 0x10), (4, 0x20)):
        v, values = 0, []
        for f in flags[:total]:
            if f & short:
                v += (g[at] if at < len(g) else 0) * (1 if f & same else -1)
                at += 1
            elif not f & same:
                v += i16(g, at)
                at += 2
            values.append(v)
        axes.append(values)
    points = list(zip(axes[0], axes[1], (f & 1 for f in flags)))
    out, start = [], 0
    for end in ends:
        raw = points[start : end + 1]
        start = end + 1
        if len(raw) < 2:
            continue
        # between two points off the curve lies one on it
        full: list[tuple[float, float, int]] = []
        for p, q in zip(raw, raw[1:] + raw[:1]):
            full.append(p)
            if not p[2] and not q[2]:
                full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, 1))
        first = next((k for k, p in enumerate(full) if p[2]), 0)
        full = full[first:] + full[: first + 1]
        contour = [full[0][:2]]
        k = 1
        while k < len(full):
            if full[k][2] or k + 1 >= len(full):
                contour.append(full[k][:2])
                k += 1
            else:
                contour += _curve([contour[-1], full[k][:2], full[k + 1][:2]], 2)
                k += 2
        out.append(contour)
    return out


# compact fonts


def cff_index(d: bytes, at: int) -> tuple[list[bytes], int]:
    """The items of an index, and where it ends."""
    n = u16(d, at)
    if not n or at < 0 or at + 3 > len(d):
        return [], at + 2
    size = d[at + 2]
    base = at + 2 + (n + 1) * size
    if not 1 <= size <= 4 or base > len(d):
        return [], at + 2
    ends = [int.from_bytes(d[at + 3 + k * size : at + 3 + (k + 1) * size], "big") for k in range(n + 1)]
    return [d[base + a : base + b] for a, b in zip(ends, ends[1:])], base + ends[-1]


def cff_dict(d: bytes) -> dict[int, list[float]]:
    """Operands by operator; two-byte operators count from 1200."""
    out, stack, k = {}, [], 0
    while k < len(d):
        b = d[k]
        k += 1
        if b <= 21:
            if b == 12:
                b = 1200 + (d[k] if k < len(d) else 0)
                k += 1
            out[b] = stack
            stack = []
        elif b == 28:
            stack.append(i16(d, k))
            k += 2
        elif b == 29:
            stack.append(int.from_bytes(d[k : k + 4], "big", signed=True))
            k += 4
        elif b == 30:
            digits = ""
            while k < len(d):
                pair = (d[k] >> 4, d[k] & 15)
                k += 1
                digits += "".join("0123456789.EM?-f"[x] for x in pair)
                if 15 in pair:
                    break
            text = digits.partition("f")[0].replace("M", "E-")
            try:
                stack.append(float(text))
            except ValueError:
                stack.append(0.0)
        elif b >= 251:
            stack.append(-(b - 251) * 256 - (d[k] if k < len(d) else 0) - 108)
            k += 1
        elif b >= 247:
            stack.append((b - 247) * 256 + (d[k] if k < len(d) else 0) + 108)
            k += 1
        elif b >= 32:
            stack.append(b - 139)
    return out


class Private(NamedTuple):
    default: float
    nominal: float
    subrs: list[bytes]


class Cff(NamedTuple):
    """A compact font: its strings of glyphs, their names or CIDs, and what they are drawn with."""

    charstrings: list[bytes]
    by_cid: bool
    sids: list[int]
    names: list[str]
    privates: list[Private]
    select: list[int]
    global_subrs: list[bytes]
    matrix: bool


def _private(d: bytes, entry: dict[int, list[float]]) -> Private | None:
    if len(entry.get(18, [])) < 2:
        return None
    size, at = map(int, entry[18][:2])
    if at < 0 or at + size > len(d):
        return None
    p = cff_dict(d[at : at + size])
    one = lambda k: float(p[k][0]) if p.get(k) else 0.0
    subrs = cff_index(d, at + int(p[19][0]))[0] if p.get(19) else []
    return Private(one(20), one(21), subrs)


def _charset(d: bytes, at: int, n: int) -> list[int]:
    """The string or CID of each glyph; offset 0 is the predefined set of the first strings."""
    if at <= 2:
        return list(range(n))
    kind, out, k = d[at] if at < len(d) else 9, [0], at + 1
    if kind == 0:
        out += [u16(d, k + 2 * i) for i in range(n - 1)]
    elif kind in (1, 2):
        while len(out) < n and k + 2 < len(d):
            first, left = u16(d, k), d[k + 2] if kind == 1 else u16(d, k + 2)
            out += range(first, first + left + 1)
            k += 2 + kind
    return out[:n]


def _select(d: bytes, at: int, n: int) -> list[int]:
    if at <= 0 or at >= len(d):
        return [0] * n
    if d[at] == 0:
        return list(d[at + 1 : at + 1 + n])
    out: list[int] = []
    ranges = u16(d, at + 1)
    for k in range(ranges):
        p = at + 3 + 3 * k
        out += [d[p + 2] if p + 2 < len(d) else 0] * max(0, min(n, u16(d, p + 3)) - u16(d, p))
    return (out + [0] * n)[:n]


@lru_cache(64)
def cff(data: bytes) -> Cff | None:
    """A compact font, also one in an OpenType wrapper; None of what is none."""
    if data[:4] == b"OTTO":
        data = (sfnt(data) or {}).get("CFF ", b"")
    if len(data) < 4 or data[0] != 1:
        return None
    _, at = cff_index(data, data[2])
    tops, at = cff_index(data, at)
    strings, at = cff_index(data, at)
    subrs, _ = cff_index(data, at)
    if not tops:
        return None
    top = cff_dict(tops[0])
    one = lambda k: int(top[k][0]) if top.get(k) else 0
    charstrings, _ = cff_index(data, one(17)) if one(17) else ([], 0)
    if not charstrings:
        return None
    n, by_cid = len(charstrings), 1230 in top
    sids = _charset(data, one(15), n)
    fds = [cff_dict(x) for x in cff_index(data, one(1236))[0]] if by_cid else [top]
    privates = [_private(data, f) or Private(0, 0, []) for f in fds] or [Private(0, 0, [])]
    known = len(STANDARD_STRINGS)
    text = lambda s: STANDARD_STRINGS[s] if s < known else strings[s - known].decode("latin-1") if s - known < len(strings) else f"sid{s}"
    return Cff(charstrings, by_cid, sids, [] if by_cid else [text(s) for s in sids], privates, _select(data, one(1237), n) if by_cid else [0] * n, subrs, 1207 in top or any(1207 in f for f in fds))


def _bias(subrs: list[bytes]) -> int:
    return 107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768


class _Pen:
    """Contours as polygons."""

    def __init__(self):
        self.at, self.contours = (0.0, 0.0), []

    def move(self, dx: float, dy: float) -> None:
        self.at = (self.at[0] + dx, self.at[1] + dy)
        self.contours.append([self.at])

    def line(self, dx: float, dy: float) -> None:
        if not self.contours:
            self.contours.append([self.at])
        self.at = (self.at[0] + dx, self.at[1] + dy)
        self.contours[-1].append(self.at)

    def curve(self, *d: float) -> None:
        if not self.contours:
            self.contours.append([self.at])
        p = [self.at]
        for k in range(0, 6, 2):
            p.append((p[-1][0] + d[k], p[-1][1] + d[k + 1]))
        self.at = p[-1]
        self.contours[-1] += _curve(p, 3)


def run_type2(code: bytes, font: Cff, private: Private, pen: _Pen | None = None) -> float | None:
    """Runs a charstring: its width less the nominal one, None without; draws with the pen. Without a pen it ends at
    the first operator that tells the width. A damaged one is a ValueError."""
    stack: list[float] = []
    width: list[float | None] = [None]
    state = {"hints": 0, "told": False}

    def tell(extra: bool) -> None:
        if not state["told"]:
            state["told"] = True
            if extra:
                width[0] = stack.pop(0)

    def run(code: bytes, depth: int) -> bool:
        """Whether the glyph has ended."""
        if depth > 10:
            raise ValueError("subroutines too deep")
        k = 0
        while k < len(code):
            b = code[k]
            k += 1
            if b >= 32 or b == 28:
                if b == 28:
                    stack.append(i16(code, k))
                    k += 2
                elif b <= 246:
                    stack.append(b - 139)
                elif b <= 254:
                    if k >= len(code):
                        raise ValueError("a cut number")
                    stack.append((b - 247) * 256 + code[k] + 108 if b <= 250 else -(b - 251) * 256 - code[k] - 108)
                    k += 1
                else:
                    stack.append(int.from_bytes(code[k : k + 4], "big", signed=True) / 65536)
                    k += 4
                continue
            if b in (10, 29):
                subrs = private.subrs if b == 10 else font.global_subrs
                at = int(stack.pop()) + _bias(subrs) if stack else -1
                if not 0 <= at < len(subrs):
                    raise ValueError("no such subroutine")
                if run(subrs[at], depth + 1):
                    return True
                continue
            if b == 11:
                return False
            if b in (1, 3, 18, 23, 19, 20):
                tell(len(stack) % 2 == 1)
                state["hints"] += len(stack) // 2
                stack.clear()
                if b in (19, 20):
                    k += (state["hints"] + 7) // 8
            elif b in (21, 4, 22, 14):
                if b == 14:
                    tell(len(stack) in (1, 5))
                else:
                    tell(len(stack) > (2 if b == 21 else 1))
                if b == 14 or pen is None:
                    return True
                d = (stack + [0.0, 0.0])[:2]
                pen.move(*(d if b == 21 else (0, d[0]) if b == 4 else (d[0], 0)))
                stack.clear()
            elif pen is None:
                raise ValueError("no operator that tells the width")
            else:
                draw(b, code[k] if b == 12 and k < len(code) else 0)
                k += b == 12
                stack.clear()
            if pen is None and state["told"]:
                return True
        return False

    def draw(b: int, more: int) -> None:
        s = stack
        if b == 5:
            for i in range(0, len(s) - 1, 2):
                pen.line(s[i], s[i + 1])
        elif b in (6, 7):
            for i, v in enumerate(s):
                pen.line(*((v, 0) if (i + (b == 7)) % 2 == 0 else (0, v)))
        elif b in (8, 24, 25):
            lines = 2 if b == 24 else 0
            i = 0
            if b == 25:
                while i + 6 < len(s):
                    pen.line(s[i], s[i + 1])
                    i += 2
            while i + 6 <= len(s) - lines:
                pen.curve(*s[i : i + 6])
                i += 6
            if b == 24 and i + 2 <= len(s):
                pen.line(s[i], s[i + 1])
        elif b in (26, 27):
            i, first = len(s) % 4 and 1, s[0] if len(s) % 4 else 0
            while i + 4 <= len(s):
                a, c, d, e = s[i : i + 4]
                pen.curve(*((first, a, c, d, 0, e) if b == 26 else (a, first, c, d, e, 0)))
                first, i = 0, i + 4
        elif b in (30, 31):
            flat, i = b == 31, 0
            while i + 4 <= len(s):
                a, c, d, e = s[i : i + 4]
                last = s[i + 4] if len(s) - i == 5 else 0
                pen.curve(*((a, 0, c, d, last, e) if flat else (0, a, c, d, e, last)))
                flat, i = not flat, i + 4
        elif b == 12 and more == 35 and len(s) >= 12:
            pen.curve(*s[:6])
            pen.curve(*s[6:12])
        elif b == 12 and more == 34 and len(s) >= 7:
            pen.curve(s[0], 0, s[1], s[2], s[3], 0)
            pen.curve(s[4], 0, s[5], -s[2], s[6], 0)
        elif b == 12 and more == 36 and len(s) >= 9:
            pen.curve(*s[:4], s[4], 0)
            pen.curve(s[5], 0, *s[6:8], s[8], -(s[1] + s[3] + s[7]))
        elif b == 12 and more == 37 and len(s) >= 11:
            dx, dy = sum(s[0:10:2]), sum(s[1:10:2])
            pen.curve(*s[:6])
            pen.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))

    run(code, 0)
    return width[0]


def cff_widths(font: Cff | None) -> dict[str | int, int]:
    """The advance of each glyph by name, or by CID, in whole units; none of a font with a matrix of its own."""
    if font is None or font.matrix:
        return {}
    out: dict[str | int, int] = {}
    for gid, code in enumerate(font.charstrings):
        if not font.by_cid and not gid or gid >= len(font.sids):
            continue
        fd = font.select[gid] if gid < len(font.select) else 0
        if fd >= len(font.privates):
            continue
        p = font.privates[fd]
        try:
            w = run_type2(code, font, p)
        except (ValueError, IndexError):
            continue
        out[font.sids[gid] if font.by_cid else font.names[gid]] = int((p.default if w is None else p.nominal + w) + 0.5)
    return out


def cff_outline(font: Cff, gid: int) -> list[Contour]:
    pen = _Pen()
    if 0 <= gid < len(font.charstrings):
        try:
            run_type2(font.charstrings[gid], font, font.privates[min(font.select[gid], len(font.privates) - 1)], pen)
        except (ValueError, IndexError):
            pass
    return pen.contours


# Type 1


def decrypt(data: bytes, key: int, skip: int = 4) -> bytes:
    """The plain bytes of an encrypted block, without its first ones."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


def encrypt(data: bytes, key: int, lead: bytes = b"\0\0\0\0") -> bytes:
    out = bytearray()
    for p in lead + data:
        c = p ^ key >> 8
        out.append(c)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


class Type1(NamedTuple):
    charstrings: dict[str, bytes]
    subrs: dict[int, bytes]
    encoding: tuple[str, ...] | None


@lru_cache(64)
def type1(data: bytes) -> Type1 | None:
    """A Type 1 program in plain, segmented or hexadecimal form; None without charstrings."""
    if data[:1] == b"\x80":  # segments with a head of six bytes
        parts, k = [], 0
        while k + 6 <= len(data) and data[k] == 0x80 and data[k + 1] in (1, 2):
            n = int.from_bytes(data[k + 2 : k + 6], "little")
            parts.append(data[k + 6 : k + 6 + n])
            k += 6 + n
        data = b"".join(parts)
    head, mark, rest = data.partition(b"eexec")
    if not mark:
        return None
    rest = rest.lstrip(b" \t\r\n")
    if re.match(rb"[0-9A-Fa-f \t\r\n]{8}", rest[:8]):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", rest)
        rest = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    body = decrypt(rest, 55665)
    skip = int(m[1]) if (m := re.search(rb"/lenIV\s+(\d+)", body)) else 4
    chars, subrs = {}, {}
    at = 0
    for m in re.finditer(rb"(?:dup\s+(\d+)|/(\S+))\s+(\d+)\s+(?:RD|-\||\S+)\s", body):
        if m.start() < at:
            continue
        n = int(m[3])
        raw = body[m.end() : m.end() + n]
        if len(raw) < n or not re.match(rb"\s*(?:ND|NP|\|-|\||noaccess|put|def)", body[m.end() + n : m.end() + n + 12]):
            continue
        at = m.end() + n
        if m[1] is not None:
            subrs[int(m[1])] = decrypt(raw, 4330, skip)
        else:
            chars[m[2].decode("latin-1")] = decrypt(raw, 4330, skip)
    if not chars:
        return None
    own = None
    if re.search(rb"/Encoding\s+StandardEncoding", head):
        own = encoding("StandardEncoding")
    elif pairs := re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", head):
        table = [""] * 256
        for code, name in pairs:
            if int(code) < 256:
                table[int(code)] = name.decode("latin-1")
        own = tuple("" if n == ".notdef" else n for n in table)
    return Type1(chars, subrs, own)


def run_type1(code: bytes, font: Type1, pen: _Pen | None = None) -> float | None:
    """Runs a Type 1 charstring; its advance. Without a pen it ends there."""
    stack: list[float] = []
    posted: list[float] = []
    out: list[float | None] = [None]
    flex: list | None = None

    def run(code: bytes, depth: int) -> bool:
        nonlocal flex
        if depth > 10:
            raise ValueError("subroutines too deep")
        k = 0
        while k < len(code):
            b = code[k]
            k += 1
            if b >= 32:
                if b <= 246:
                    stack.append(b - 139)
                elif b <= 254:
                    if k >= len(code):
                        raise ValueError("a cut number")
                    stack.append((b - 247) * 256 + code[k] + 108 if b <= 250 else -(b - 251) * 256 - code[k] - 108)
                    k += 1
                else:
                    stack.append(int.from_bytes(code[k : k + 4], "big", signed=True))
                    k += 4
                continue
            if b == 12:
                b = 1200 + (code[k] if k < len(code) else 0)
                k += 1
            if b == 1212 and len(stack) >= 2:  # division
                d = stack.pop()
                stack.append(stack.pop() / d if d else 0)
                continue
            if b == 10 and stack:
                at = int(stack.pop())
                if at not in font.subrs:
                    raise ValueError("no such subroutine")
                if run(font.subrs[at], depth + 1):
                    return True
                continue
            if b == 11:
                return False
            if b == 1216 and len(stack) >= 2:  # the drawing program's own procedures: flex, and hints
                which, n = int(stack.pop()), int(stack.pop())
                args = [stack.pop() for _ in range(min(n, len(stack)))]
                if which == 1:
                    flex = []
                elif which == 0 and flex is not None and pen is not None and len(flex) >= 7:
                    p = flex
                    pen.contours[-1] += _curve([pen.at, p[1], p[2], p[3]], 3) + _curve([p[3], p[4], p[5], p[6]], 3) if pen.contours else []
                    pen.at, flex = p[6], None
                    posted.extend(args[:2])
                elif which != 2:
                    posted.extend(args if which != 3 else [3.0])
                continue
            if b == 1217:
                stack.append(posted.pop() if posted else 0.0)
                continue
            s = stack
            if b == 13 and len(s) >= 2:
                out[0] = s[1]
                if pen is None:
                    return True
                pen.at = (s[0], 0.0)
            elif b == 1207 and len(s) >= 4:
                out[0] = s[2]
                if pen is None:
                    return True
                pen.at = (s[0], s[1])
            elif b == 14:
                return True
            elif pen is None:
                pass
            elif b in (21, 4, 22) and s:
                d = (s[0], s[1]) if b == 21 and len(s) > 1 else (0, s[0]) if b == 4 else (s[0], 0)
                if flex is not None:
                    last = flex[-1] if flex else pen.at
                    flex.append((last[0] + d[0], last[1] + d[1]))
                else:
                    pen.move(*d)
            elif b == 5 and len(s) >= 2:
                pen.line(s[0], s[1])
            elif b == 6 and s:
                pen.line(s[0], 0)
            elif b == 7 and s:
                pen.line(0, s[0])
            elif b == 8 and len(s) >= 6:
                pen.curve(*s[:6])
            elif b == 30 and len(s) >= 4:
                pen.curve(0, s[0], s[1], s[2], s[3], 0)
            elif b == 31 and len(s) >= 4:
                pen.curve(s[0], 0, s[1], s[2], 0, s[3])
            elif b == 1233 and len(s) >= 2:
                pen.at = (s[0], s[1])
            stack.clear()
        return False

    run(code, 0)
    return out[0]


def type1_widths(font: Type1 | None) -> dict[str, int]:
    out = {}
    for name, code in font.charstrings.items() if font else ():
        try:
            w = run_type1(code, font)
        except (ValueError, IndexError):
            continue
        if w is not None:
            out[name] = int(w + 0.5)
    return out


def type1_outline(font: Type1, name: str) -> list[Contour]:
    pen = _Pen()
    if name in font.charstrings:
        try:
            run_type1(font.charstrings[name], font, pen)
        except (ValueError, IndexError):
            pass
    return pen.contours


# font dictionaries


def number(v: object) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def cid_widths(w: object, get=lambda x: x) -> list[tuple[int, int]]:
    """(cid, width) of an array of `first [w ...]` and `first last w`."""
    out, items, k = [], [get(x) for x in w] if isinstance(w, list) else [], 0
    while k + 1 < len(items):
        first, second = items[k], items[k + 1]
        if not isinstance(first, int):
            k += 1
        elif isinstance(second, list):
            out += [(first + i, int(n)) for i, x in enumerate(second) if (n := number(get(x))) is not None]
            k += 2
        elif k + 2 < len(items):
            if isinstance(second, int) and (n := number(items[k + 2])) is not None:
                out += [(c, int(n)) for c in range(first, min(second, first + 0xFFFF) + 1)]
            k += 3
        else:
            break
    return out


def glyph_table(enc: object, get=lambda x: x) -> list[str] | None:
    """256 glyph names of an encoding, with its differences; None where it doesn't tell."""
    enc = get(enc)
    if isinstance(enc, str):
        found = encoding(enc)
        return list(found) if found else None
    if not isinstance(enc, dict):
        return None
    out = list(encoding(get(enc.get("BaseEncoding"))) or [""] * 256)
    code, differences = 0, get(enc.get("Differences"))
    for x in differences if isinstance(differences, list) else []:
        x = get(x)
        if isinstance(x, int):
            code = x
        elif isinstance(x, str):
            if 0 <= code < 256:
                out[code] = str(x)
            code += 1
    return out


def code_to_unicode(enc: object, get=lambda x: x) -> list[int]:
    """256 characters, 0 for none."""
    return [to_unicode(n) or 0 if n else 0 for n in glyph_table(enc, get) or [""] * 256]


def char_set(text: str) -> set[str]:
    """The names of a descriptor's CharSet, and the one of no glyph."""
    return {".notdef", *(x for x in re.split(r"[/\s]+", text) if x)}


def in_bitmap(bitmap: bytes, cid: int) -> bool:
    return cid // 8 < len(bitmap) and bitmap[cid // 8] >> 7 - cid % 8 & 1 == 1


class Program(NamedTuple):
    """A font dictionary as the rules need it: plain values, the decoded program and CIDSet, and the codes in use (None
    where they aren't known)."""

    subtype: str
    subset: bool
    first: int | None
    widths: list[int]
    enc: object
    symbolic: bool
    kind: str
    data: bytes
    char_set: str | None
    cid_set: bytes | None
    has_cid_set: bool
    identity: bool
    cid_widths: list[tuple[int, int]] | None
    default_width: int
    used: frozenset[int] | None


def _far(a: float, b: float) -> bool:
    return abs(a - b) > 1


def _simple_gid(f: Program, t: dict[str, bytes]):
    """A function from a code to its glyph: 0 for a code that a map lacks, None where nothing tells."""
    maps, unicode = cmaps(t), code_to_unicode(f.enc)
    windows, symbol = code_map(maps.get((3, 1))), code_map(maps.get((3, 0)) or maps.get((1, 0)))

    def gid(code: int) -> tuple[int | None, bool]:
        if unicode[code] and windows is not None:
            return windows.get(unicode[code], 0), True
        for c in (code | 0xF000, code) if symbol is not None else ():
            if c in symbol:
                return symbol[c], True
        return (None if f.symbolic else 0), False

    return gid


def _asked(f: Program) -> list[int]:
    """The codes that a simple font must have: those in use, or without knowledge those with a width."""
    if f.used is not None:
        return sorted(c for c in f.used if 0 <= c < 256)
    return [c for k, w in enumerate(f.widths) if w > 0 and 0 <= (c := (f.first or 0) + k) < 256]


def font_faults(f: Program) -> list[str]:
    """SubsetGlyphCoverage, AdvanceWidthMismatch, Type1SubsetCharSet and CIDSubsetCIDSet, each at most once."""
    out: list[str] = []
    if f.subtype == "TrueType" and f.kind == "FontFile2" and f.first is not None and (t := sfnt(f.data)):
        gid, many = _simple_gid(f, t), glyph_count(t)
        if f.subset and any(w > 0 for w in f.widths):
            for c in _asked(f):
                g = gid(c)[0]
                if g is not None and (not g or many and g >= many):
                    out.append("SubsetGlyphCoverage")
                    break
        for k, w in enumerate(f.widths):
            c = f.first + k
            if w and 0 <= c < 256:
                g, told = gid(c)
                if told and g and (a := advance(t, g)) is not None and _far(a, w):
                    out.append("AdvanceWidthMismatch")
                    break
    elif f.subtype in ("Type1", "MMType1"):
        program = type1(f.data) if f.kind == "FontFile" else None
        compact = cff(f.data) if f.kind == "FontFile3" else None
        names = glyph_table(f.enc)
        if f.subset and f.char_set is None:
            out.append("Type1SubsetCharSet")
        elif f.subset and f.first is not None:
            if not f.char_set:
                out.append("Type1SubsetCharSet")
            elif names is not None:
                stated = char_set(f.char_set)
                own = set(program.charstrings) if program else set(compact.names) if compact and not compact.by_cid else None
                for c in _asked(f):
                    n = names[c]
                    if n in ("", ".notdef"):
                        continue
                    if n not in (own or stated):
                        out.append("SubsetGlyphCoverage")
                        break
                    if own and n not in stated:
                        out.append("Type1SubsetCharSet")
                        break
        if f.first is not None:
            if program:
                table = encoding(f.enc) if isinstance(f.enc, str) else program.encoding if f.enc is None else names
                widths: dict = type1_widths(program)
            else:
                table, widths = names, cff_widths(compact) if compact and not compact.by_cid else {}
            for k, w in enumerate(f.widths if table else ()):
                c = f.first + k
                if not w or not 0 <= c < 256 or (compact is not None and f.used is not None and c not in f.used):
                    continue
                if (a := widths.get(table[c])) is not None and table[c] and _far(a, w):
                    out.append("AdvanceWidthMismatch")
                    break
    elif f.subtype in ("CIDFontType0", "CIDFontType2"):
        t = sfnt(f.data) if f.subtype == "CIDFontType2" and f.kind == "FontFile2" else None
        compact = cff(f.data) if f.subtype == "CIDFontType0" and f.kind == "FontFile3" else None
        if f.subset and not f.has_cid_set:
            out.append("CIDSubsetCIDSet")
        elif f.subset and f.cid_set is not None:
            if compact and compact.by_cid:
                out += ["CIDSubsetCIDSet"] * any(not in_bitmap(f.cid_set, c) for c in compact.sids)
            elif t and f.identity:
                out += ["CIDSubsetCIDSet"] * any(glyph_data(t, c) and not in_bitmap(f.cid_set, c) for c in range(1, glyph_count(t)))
        pairs = f.cid_widths
        if pairs is not None and t:
            stated = dict(pairs)
            asked = sorted(f.used) if f.used is not None else [c for c, _ in pairs]
            if f.subset and any(not present(t, c) for c in asked):
                out.append("SubsetGlyphCoverage")
            rest = [(c, f.default_width) for c in sorted(f.used or ()) if c not in stated]
            for c, w in pairs + rest:
                if present(t, c) and (a := advance(t, c)) is not None and _far(a, w):
                    out.append("AdvanceWidthMismatch")
                    break
        elif pairs is not None and compact:
            asked = [c for c, _ in pairs if f.used is None or c in f.used]
            if f.subset:
                if compact.by_cid:
                    at = {c: g for g, c in enumerate(compact.sids)}
                    bad = any(c not in at or len(compact.charstrings[at[c]]) <= 1 for c in asked)
                else:
                    bad = any(c >= len(compact.charstrings) for c in asked)
                out += ["SubsetGlyphCoverage"] * bad
            widths = cff_widths(compact) if compact.by_cid else {}
            for c, w in pairs:
                if (f.used is None or c in f.used) and c in widths and _far(widths[c], w):
                    out.append("AdvanceWidthMismatch")
                    break
    return out


def type3_fault(first: int, last: int, widths: list[float], names: dict[int, str], advances: dict[str, float]) -> bool:
    """Whether a width of a Type 3 font differs from what its glyph's procedure states (d0 or d1)."""
    for k, w in enumerate(widths):
        a = advances.get(names.get(first + k, "")) if first + k <= last else None
        if a is not None and _far(a, w):
            return True
    return False


def program_of(v: dict, get, body, used) -> Program | None:
    """The Program of a font dictionary; None without a descriptor. get resolves references, body decodes a stream (None
    where it can't), used are the codes, or the CIDs, in use."""
    kind, f = get(v.get("Subtype")), get(v.get("FontDescriptor"))
    if not isinstance(f, dict):
        return None
    first, last, widths = get(v.get("FirstChar")), get(v.get("LastChar")), get(v.get("Widths"))
    stated = type(first) is type(last) is int and isinstance(widths, list)
    enc = get(v.get("Encoding"))
    if isinstance(enc, dict):
        differences = get(enc.get("Differences"))
        enc = {k: get(x) for k, x in enc.items()} | ({"Differences": [get(x) for x in differences]} if isinstance(differences, list) else {})
    key = next((k for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(get(f.get(k)), dict)), "")
    flags, w, dw, chars, cids = get(f.get("Flags")), get(v.get("W")), number(get(v.get("DW"))), get(f.get("CharSet")), get(f.get("CIDSet"))
    names = chars.value if hasattr(chars, "value") else chars
    return Program(
        str(kind), SUBSET_TAG.match(str(get(v.get("BaseFont")) or "")) is not None, first if stated else None, [int(number(get(x)) or 0) for x in widths] if stated else [], enc, isinstance(flags, int) and flags & 4 != 0,
        key, body(get(f.get(key))) or b"" if key else b"", names.decode("latin-1") if isinstance(names, bytes) else None, body(cids), cids is not None,
        get(v.get("CIDToGIDMap")) in (None, "Identity"), cid_widths(w, get) if isinstance(w, list) else None, int(dw) if dw is not None else 1000, frozenset(used) if used is not None else None,
    )


def type3_advances(procs: object, get, ops_of) -> dict[str, float]:
    """By glyph, the width that its procedure states."""
    out = {}
    for k, x in procs.items() if isinstance(procs, dict) else ():
        x = get(x)
        n = next((number(o[0]) for op, o in (ops_of(x) if isinstance(x, dict) else ()) if op in ("d0", "d1") and o), None)
        if n is not None:
            out[k] = n
    return out


def code_widths(f: Program) -> dict[int, int]:
    """By code or CID, the advance that the program has for it, as far as it tells."""
    if f.subtype == "TrueType" and (t := sfnt(f.data)):
        gid, out = _simple_gid(f, t), {}
        for c in range(256):
            g, told = gid(c)
            if told and g and (a := advance(t, g)) is not None:
                out[c] = a
        return out
    if f.subtype in ("Type1", "MMType1"):
        if f.kind == "FontFile":
            program = type1(f.data)
            table = encoding(f.enc) if isinstance(f.enc, str) else program.encoding if program and f.enc is None else glyph_table(f.enc)
            widths: dict = type1_widths(program)
        else:
            table, widths = glyph_table(f.enc), cff_widths(cff(f.data))
        return {c: widths[n] for c, n in enumerate(table or ()) if n and n in widths}
    if f.subtype == "CIDFontType2" and (t := sfnt(f.data)):
        return {g: a for g in range(glyph_count(t)) if present(t, g) and (a := advance(t, g)) is not None}
    if f.subtype == "CIDFontType0" and (c := cff(f.data)) and c.by_cid:
        return {k: w for k, w in cff_widths(c).items() if isinstance(k, int)}
    return {}


def subset_names(f: Program) -> str | None:
    """The CharSet of a Type 1 program; None of another."""
    program = type1(f.data) if f.kind == "FontFile" else None
    compact = cff(f.data) if f.kind == "FontFile3" else None
    names = list(program.charstrings) if program else compact.names if compact and not compact.by_cid else None
    return "".join("/" + n for n in names if n != ".notdef") if names else None


def subset_bits(f: Program) -> bytes | None:
    """The CIDSet of a program by CID; None of another."""
    if f.subtype == "CIDFontType0" and (c := cff(f.data)) and c.by_cid:
        cids = c.sids
    elif f.subtype == "CIDFontType2" and (t := sfnt(f.data)):
        cids = [0, *(g for g in range(1, glyph_count(t)) if glyph_data(t, g))]
    else:
        return None
    out = bytearray(max(cids) // 8 + 1)
    for c in cids:
        out[c // 8] |= 0x80 >> c % 8
    return bytes(out)


# writing TrueType


def build_tables(tables: dict[str, bytes]) -> bytes:
    """A font file of tables by tag; its checksums aren't set."""
    head, body, start = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in sorted(tables.items()):
        head += tag.encode("latin-1") + struct.pack(">III", 0, start + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + body


def _glyphs(t: dict[str, bytes], glyphs: list[bytes]) -> dict[str, bytes]:
    """The tables with these outlines, by long offsets."""
    at, body = [0], b""
    for g in glyphs:
        body += g + b"\0" * (-len(g) % 4)
        at.append(len(body))
    head = t["head"][:50].ljust(50, b"\0") + b"\0\1" + t["head"][52:].ljust(2, b"\0")
    return t | {"glyf": body, "loca": b"".join(struct.pack(">I", a) for a in at), "head": head}


def promote_empty_glyphs(data: bytes) -> bytes:
    """Glyphs that have a width but no outline get a record without contours, so that they count as there; the same bytes
    where there is none such."""
    t = sfnt(data)
    if not t or not {"head", "loca", "glyf", "maxp"} <= set(t):
        return data
    glyphs = [glyph_data(t, g) for g in range(glyph_count(t))]
    blank = [k for k, g in enumerate(glyphs) if k and not g and advance(t, k)]
    if not blank:
        return data
    for k in blank:
        glyphs[k] = b"\0" * 12
    return build_tables(_glyphs(t, glyphs))


def component_ids(glyph: bytes) -> list[int]:
    """The glyphs that a glyph is composed of."""
    out, at = [], 10
    while i16(glyph, 0) < 0 and at + 4 <= len(glyph):
        flags = u16(glyph, at)
        out.append(u16(glyph, at + 2))
        at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
        if not flags & 0x20:
            break
    return out


def _renumbered(glyph: bytes, to: dict[int, int]) -> bytes:
    out, at = bytearray(glyph), 10
    while i16(glyph, 0) < 0 and at + 4 <= len(glyph):
        flags = u16(glyph, at)
        out[at + 2 : at + 4] = struct.pack(">H", to.get(u16(glyph, at + 2), 0))
        at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
        if not flags & 0x20:
            break
    return bytes(out)


def subset_true_type(data: bytes, characters: list[int]) -> tuple[bytes, dict[int, int]] | None:
    """A font of the glyphs of these characters, and of those they are composed of, with a map of them, and the glyph
    of each character it has; None of what is no font with a Unicode map."""
    t = sfnt(data)
    codes = code_map(cmaps(t).get((3, 1)) or cmaps(t).get((0, 3))) if t else None
    if not t or codes is None or not {"head", "hhea", "hmtx", "maxp", "loca", "glyf"} <= set(t):
        return None
    wanted = [0]
    for c in sorted(set(characters)):
        if (g := codes.get(c)) and g not in wanted:
            wanted.append(g)
    for g in wanted:  # grows on the way
        wanted += [x for x in dict.fromkeys(component_ids(glyph_data(t, g))) if x not in wanted]
    to = {g: k for k, g in enumerate(wanted)}
    own = {c: to[codes[c]] for c in sorted(set(characters)) if codes.get(c) in to and codes.get(c)}
    n = u16(t["hhea"], 34)
    metrics = b"".join(t["hmtx"][4 * (k := min(g, n - 1)) : 4 * k + 2] + b"\0\0" for g in wanted)
    segments = [(c, (g - c) & 0xFFFF) for c, g in own.items() if c < 0xFFFF] + [(0xFFFF, 1)]
    pack = lambda v: b"".join(struct.pack(">H", x) for x in v)
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * len(segments), 0, 2 * len(segments), 0, 0, 0) + pack(c for c, _ in segments) + b"\0\0" + pack(c for c, _ in segments) + pack(d for _, d in segments) + b"\0\0" * len(segments)
    tables = _glyphs({k: t[k] for k in ("head", "hhea", "maxp")}, [_renumbered(glyph_data(t, g), to) for g in wanted])
    tables |= {"hmtx": metrics, "hhea": t["hhea"][:34] + struct.pack(">H", len(wanted)), "maxp": t["maxp"][:4] + struct.pack(">H", len(wanted)) + t["maxp"][6:], "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub}
    return build_tables(tables), own


def to_unicode_map(data: bytes) -> dict[int, int]:
    """Code to character of a map of codes to Unicode; of several characters the first."""
    out: dict[int, int] = {}
    text = data.decode("latin-1")
    first = lambda h: int(h[:4].ljust(4, "0"), 16)
    for kind, body in re.findall(r"beginbf(char|range)(.*?)endbf", text, re.S):
        tokens = re.findall(r"<([0-9A-Fa-f\s]*)>|(\[)|(\])", body)
        flat = ["[" if a else "]" if b else re.sub(r"\s", "", h) for h, a, b in tokens]
        k = 0
        while k + 1 < len(flat):
            if kind == "char":
                if flat[k] and flat[k + 1]:
                    out[int(flat[k], 16)] = first(flat[k + 1])
                k += 2
                continue
            if k + 2 >= len(flat) or not flat[k] or not flat[k + 1]:
                break
            low, high = int(flat[k], 16), int(flat[k + 1], 16)
            if flat[k + 2] == "[":
                end = flat.index("]", k) if "]" in flat[k:] else len(flat)
                out |= {low + i: first(h) for i, h in enumerate(flat[k + 3 : end]) if h and low + i <= high}
                k = end + 1
            else:
                out |= {c: first(flat[k + 2]) + c - low for c in range(low, min(high, low + 0xFFFF) + 1)}
                k += 3
    return out


Face = tuple[str, bool, bool]


def pick_face(name: str, flags: int = 0, weight: float = 0) -> Face:
    """The family (mono, serif or sans) and whether bold and slanted, by a font's name, flags and weight."""
    n = name.lower()
    has = lambda *parts: any(p in n for p in parts)
    if flags & 1 or has("courier", "mono", "consol", "typewriter"):
        family = "mono"
    elif has("arial", "helvet", "sans", "verdana", "calibri", "tahoma"):
        family = "sans"
    else:
        family = "serif" if flags & 2 or has("times", "serif", "roman", "georgia", "garamond", "palatino", "book") else "sans"
    return family, weight >= 600 or bool(flags & 1 << 18) or has("bold", "black", "heavy"), bool(flags & 64) or has("italic", "oblique")
