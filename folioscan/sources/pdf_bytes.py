"""From bytes to an object graph: lexer, objects, cross references, object streams, recovery.

Runs in the tasks, a file at a time; what it finds becomes rows in folioscan.sources.pdf. Framing faults are kept as
(rule, place) on the way.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache

from folioscan.functions.decoders import decode_chain

MAX_DEPTH = 1000
#: Missing numbers in a row that a table lists as free; more begin a subsection.
MAX_FREE = 1000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # two frames a level
SPACE = b" \t\r\n\f\0"
DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^ \t\r\n\f\0()<>\[\]{}/%]+")
_GAP = re.compile(rb"(?:[ \t\r\n\f\0]+|%[^\r\n]*)+")
#: White space and comments, then a name, a number, another word, or a delimiter. What was passed over isn't tried in
#: other cuts, of which a run of comment signs at the end of the data has exponentially many.
_TOKEN = re.compile(
    rb"(?:[ \t\r\n\f\0]++|%[^\r\n]*+)*+(?:/(?P<name>[^ \t\r\n\f\0()<>\[\]{}/%]*)|(?P<int>[+-]?\d+)(?=[ \t\r\n\f\0()<>\[\]{}/%]|\Z)|(?P<real>[+-]?(?:\d+\.\d*|\.\d+))(?=[ \t\r\n\f\0()<>\[\]{}/%]|\Z)"
    rb"|(?P<word>[^ \t\r\n\f\0()<>\[\]{}/%]+)|(?P<mark><<|>>|[()<>\[\]{}]))"
)
NAME, INT, REAL, WORD, MARK = range(1, 6)
#: An escaped byte, or a parenthesis.
_PARENTHESIS = re.compile(rb"\\.|[()]", re.S)
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj(?![a-z])")


class Name(str):
    """A name, its escapes resolved; raw_bytes is its length in the file's terms."""


class Lit(bytes):
    """A literal string."""


class Hex(bytes):
    """The digits of a hexadecimal string as written."""

    @property
    def value(self) -> bytes:
        d = bytes(c for c in self if c in b"0123456789abcdefABCDEF")
        return bytes.fromhex((d + b"0" * (len(d) % 2)).decode())


class Keyword(str):
    """An operator or another bare word."""


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


class Dict(dict):
    """A dictionary; raw is the body of a stream."""

    raw: bytes | None = None
    num: int | None = None

    @property
    def is_stream(self) -> bool:
        return self.raw is not None


class ParseError(ValueError):
    pass


def unescape_name(raw: bytes) -> Name:
    return _short_name(raw) if len(raw) <= SHORT else _name(raw)


def _name(raw: bytes) -> Name:
    if b"#" not in raw:
        return Name(raw.decode("latin-1"))
    return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))


#: Names of at most this length recur, and a few thousand are kept.
SHORT = 32
_short_name = lru_cache(4096)(_name)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


def unescape_literal(raw: bytes) -> bytes:
    """Escapes, octal codes and continued lines of a literal string."""

    if b"\\" not in raw and b"\r" not in raw:
        return raw

    def one(m: re.Match) -> bytes:
        x = m[0]
        if x[0] != 0x5C:
            return b"\n"
        if (y := x[1:]) in _ESCAPES:
            return _ESCAPES[y]
        if y[:1].isdigit():
            return bytes([int(y, 8) & 255])
        return b"" if y[:1] in (b"\r", b"\n") or not y else y

    return re.sub(rb"\\(?:[0-7]{1,3}|\r\n|.|\Z)|\r\n?", one, raw, flags=re.S)


class Lexer:
    """Tokens and values from a place in the data."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def gap(self) -> None:
        if m := _GAP.match(self.data, self.at):
            self.at = m.end()

    def literal(self) -> Lit:
        depth, d = 1, self.data
        start = self.at + 1
        for m in _PARENTHESIS.finditer(d, start):
            c = m[0]
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = m.end()
                    return Lit(unescape_literal(d[start : m.start()]))
        raise ParseError("a string without its end")

    def value(self, depth: int = 0, content: bool = False):
        """The next value; a Keyword for a bare word, None for null. At the end of the data, ParseError."""
        if depth > MAX_DEPTH:
            raise ParseError("too deep")
        d = self.data
        m = _TOKEN.match(d, self.at)
        if m is None:
            self.at = len(d)
            raise ParseError("end of data")
        kind = m.lastindex
        self.at = m.end()
        if kind == NAME:
            return unescape_name(m[NAME])
        if kind == INT:
            digits = m[INT]
            return int(digits) if len(digits) < 40 else float(b"-1e40" if digits[:1] == b"-" else b"1e40")  # beyond any limit
        if kind == REAL:
            return float(m[REAL])
        if kind == WORD:
            word = m[WORD]
            if word in (b"true", b"false"):
                return word == b"true"
            return None if word == b"null" else Keyword(word.decode("latin-1"))
        mark = m[MARK]
        if mark == b"<<":
            self.at -= 2
            return self.dictionary(depth, content)
        if mark == b"(":
            self.at -= 1
            return self.literal()
        if mark == b"<":
            end = d.find(b">", self.at)
            if end < 0:
                raise ParseError("a hexadecimal string without its end")
            v = Hex(d[self.at : end])
            self.at = end + 1
            return v
        if mark != b"[":
            return Keyword(mark.decode())
        out: list = []
        while True:
            self.plain(out, depth)
            v = self.value(depth + 1, content)
            if type(v) is Keyword:
                if v == "]":
                    return out
                if v == "R" and len(out) >= 2 and type(out[-1]) is type(out[-2]) is int:
                    gen, num = out.pop(), out.pop()
                    v = Ref(num, gen)
                elif v in ("endobj", "stream", ">>"):
                    raise ParseError("an array without its end")
                else:
                    v = Name(v)
            out.append(v)

    def plain(self, out: list, depth: int) -> None:
        """Appends the names, numbers and references that follow, which value() would give one by one."""
        if depth >= MAX_DEPTH:
            return
        d, at, match = self.data, self.at, _TOKEN.match
        while (m := match(d, at)) is not None:
            kind = m.lastindex
            if kind == NAME:
                out.append(unescape_name(m[NAME]))
            elif kind == INT and len(digits := m[INT]) < 40:
                out.append(int(digits))
            elif kind == WORD and m[WORD] == b"R" and len(out) >= 2 and type(out[-1]) is type(out[-2]) is int:
                gen, num = out.pop(), out.pop()
                out.append(Ref(num, gen))
            elif kind == REAL:
                out.append(float(m[REAL]))
            else:
                break
            at = m.end()
        self.at = at

    def dictionary(self, depth: int, content: bool) -> Dict:
        self.at += 2
        out, stack = Dict(), []
        while True:
            self.plain(stack, depth)
            v = self.value(depth + 1, content)
            if type(v) is Keyword:
                if v == ">>":
                    break
                if v == "R" and len(stack) >= 2 and type(stack[-1]) is type(stack[-2]) is int:
                    gen, num = stack.pop(), stack.pop()
                    v = Ref(num, gen)
                elif v in ("endobj", "stream"):
                    raise ParseError("a dictionary without its end")
                else:
                    v = Name(v)
            stack.append(v)
        k = 0
        while k < len(stack):
            if type(stack[k]) is Name:
                if k + 1 < len(stack):
                    out[str(stack[k])] = stack[k + 1]
                k += 2
            else:
                k += 1
        return out


@dataclass
class Document:
    """A parsed file. xref maps an object number to its offset, or to (container, index). faults are (rule, place)."""

    data: bytes
    xref: dict[int, int | tuple[int, int]] = field(default_factory=dict)
    trailer: Dict = field(default_factory=Dict)
    faults: list[tuple[str, int]] = field(default_factory=list)
    error: str | None = None
    objects: dict[int, object] = field(default_factory=dict)
    containers: dict[int, list] = field(default_factory=dict)
    scanned: dict[int, int] | None = None
    classic: bool = True

    # structure

    def open(self) -> Document:
        start = self.data.find(b"%PDF-", 0, 1024)
        if start < 0:
            self.error = "no header"
            return self
        m = list(re.finditer(rb"startxref[ \t\r\n\f\0]+(\d+)", self.data[-1500:]))
        at, seen = (int(m[-1][1]) if m else -1), set()
        try:
            if at < 0 or at >= len(self.data):
                raise ParseError("no startxref")
            while at is not None and at not in seen:
                seen.add(at)
                at = self.section(at)
        except (ParseError, ValueError, IndexError):
            self.recover()
        if "Root" not in self.trailer:
            self.recover()
        if not self.trailer:
            self.error = "no trailer"
        return self

    def section(self, at: int) -> int | None:
        """Reads a section, older entries after newer ones; gives the place of the one before."""
        lx = Lexer(self.data, at)
        lx.gap()
        if not self.data.startswith(b"xref", lx.at):
            before = self.stream_section(at)
            self.faults.append(("XRefStream", 0))
            return before
        if self.data[at : at + 4] != b"xref":
            self.faults.append(("XRefKeyword", 0))
        at = lx.at + 4
        m = re.compile(rb"[ \t]*(?:\r\n|\r|\n)").match(self.data, at)
        lines = m.end() if m else at
        if re.compile(rb"[ \t]*(?:\r\n|\r|\n)|[ \t]*trailer").match(self.data, lines):
            self.faults.append(("XRefSubsectionHeader", 0))
        lx.at = at
        while True:
            lx.gap()
            begin = lx.at
            v = lx.value()
            if v == "trailer" and type(v) is Keyword:
                break
            n = lx.value()
            if type(v) is not int or type(n) is not int:
                raise ParseError("a damaged table")
            if not re.compile(rb"[0-9]+ [0-9]+[ \t]*(?:\r\n|\r|\n)").match(self.data, begin):
                self.faults.append(("XRefSubsectionHeaderFormat", 0))
            for k in range(v, v + n):
                offset, gen, kind = lx.value(), lx.value(), lx.value()
                if type(offset) is not int or type(gen) is not int:
                    raise ParseError("a damaged entry")
                if kind == "n" and k not in self.xref and offset:
                    self.xref[k] = offset
                elif kind == "f":
                    self.xref.setdefault(k, 0)
        t = lx.value()
        if not isinstance(t, Dict):
            raise ParseError("no trailer")
        for k, v in t.items():
            self.trailer.setdefault(k, v)
        if type(t.get("XRefStm")) is int:
            self.stream_section(t["XRefStm"])
        return t["Prev"] if type(t.get("Prev")) is int else None

    def first_page_trailer(self) -> Dict | None:
        """The trailer of the first section in the file's order that has a root, as files for the web begin with; None
        without one. It reads the sections apart from what the document knows."""
        for m in re.finditer(rb"(?m)^xref\b", self.data):
            own = Document(self.data)
            try:
                own.section(m.start())
            except (ParseError, ValueError, IndexError):
                continue
            if "Root" in own.trailer:
                return own.trailer
        return None

    @property
    def effective_trailer(self) -> Dict:
        """The first page's trailer of a file that says it is linearized, else the trailer."""
        return (self.first_page_trailer() if b"/Linearized" in self.data[:1024] else None) or self.trailer

    def stream_section(self, at: int) -> int | None:
        _, s = self.object_at(at)
        if not isinstance(s, Dict) or s.get("Type") != "XRef" or s.raw is None:
            raise ParseError("no section")
        self.classic = False
        w = s.get("W")
        if not isinstance(w, list) or len(w) < 3 or not all(type(x) is int and 0 <= x <= 8 for x in w) or not sum(w[:3]):  # entries of no bytes have no end
            raise ParseError("no widths")
        body, at, size = self.decoded(s), 0, sum(w[:3])
        index = s.get("Index") or [0, s.get("Size", 0)]
        for first, n in zip(index[::2], index[1::2]):
            for k in range(first, first + n):
                row = body[at : at + size]
                if len(row) < size:
                    break
                kind = int.from_bytes(row[: w[0]], "big") if w[0] else 1
                a, b = int.from_bytes(row[w[0] : w[0] + w[1]], "big"), int.from_bytes(row[w[0] + w[1] : size], "big")
                if kind == 1:
                    self.xref.setdefault(k, a)
                elif kind == 2:
                    self.xref.setdefault(k, (a, b))
                at += size
        for k, v in s.items():
            if k not in ("W", "Index", "Length", "Filter", "DecodeParms", "Type"):
                self.trailer.setdefault(k, v)
        return s["Prev"] if type(s.get("Prev")) is int else None

    def scan(self) -> dict[int, int]:
        """Every object in the file by search; the last of a number counts."""
        if self.scanned is None:
            self.scanned = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        return self.scanned

    def recover(self) -> None:
        if ("XRefKeyword", 0) not in self.faults:
            self.faults.append(("XRefKeyword", 0))
        for num, at in self.scan().items():
            if not isinstance(self.xref.get(num), tuple):
                self.xref[num] = at
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Lexer(self.data, m.end()).value()
            except ParseError:
                continue
            if isinstance(t, Dict):
                self.trailer.update(t)
        if "Root" not in self.trailer:
            for num in self.scan():
                o = self.resolve(Ref(num, 0))
                if isinstance(o, Dict) and o.get("Type") == "XRef" and "Root" in o:
                    self.trailer.update({k: v for k, v in o.items() if k in ("Root", "Info", "ID", "Encrypt", "Size")})
                elif isinstance(o, Dict) and o.get("Type") == "Catalog" and "Root" not in self.trailer:
                    self.trailer["Root"] = Ref(num, 0)

    # objects

    def object_at(self, at: int, note: bool = False) -> tuple[int, object]:
        """Number and value of the object at a place; with note, framing faults are kept."""
        lx = Lexer(self.data, at)
        num, gen, word = lx.value(), lx.value(), lx.value()
        if type(num) is not int or type(gen) is not int or word != "obj":
            raise ParseError("no object")
        fault = note and not re.compile(rb"\d+ \d+ obj[ \t]*[\r\n]").match(self.data, at)
        v = lx.value()
        if type(v) is Keyword:
            if v == "endobj":
                return num, None
            v = Name(v)
        if type(v) is int:  # a reference as the object
            save = lx.at
            try:
                g, r = lx.value(), lx.value()
                if type(g) is int and r == "R":
                    v = Ref(v, g)
                else:
                    lx.at = save
            except ParseError:
                lx.at = save
        if isinstance(v, Dict):
            v.num = num
            after = lx.at
            lx.gap()
            if self.data.startswith(b"stream", lx.at):
                self.body(v, lx, num, note)
            else:
                lx.at = after
        if note:
            end = re.compile(rb"([\r\n]?)[ \t\f\0]*([\r\n]*)[ \t\r\n]*endobj").match(self.data, lx.at)
            if fault or not end or not self.data[lx.at : end.end() - 6].strip(b" \t\0\f"):
                self.faults.append(("ObjectFraming", num))
        return num, v

    def body(self, v: Dict, lx: Lexer, num: int, note: bool) -> None:
        d, k = self.data, lx.at + 6
        eol = 2 if d[k : k + 2] == b"\r\n" else 1 if d[k : k + 1] == b"\n" else 0
        if not eol and note:
            self.faults.append(("StreamKeywordEOL", num))
        if not eol:
            m = re.compile(rb"[ \t]*(?:\r\n|\r|\n)").match(d, k)
            eol = m.end() - k if m else 0
        start = k + eol
        n = v.get("Length")
        if isinstance(n, Ref):
            n = self.resolve(n)
        end = d.find(b"endstream", start)
        if type(n) is int and 0 <= n and start + n <= len(d) and re.compile(rb"[ \t\r\n\f\0]*endstream").match(d, start + n):
            v.raw = d[start : start + n]
            if note:
                if d.startswith(b"endstream", start + n):
                    if d[start + n - 1 : start + n] in (b"\r", b"\n"):
                        self.faults.append(("StreamLengthIncludesEOL", num))
                    self.faults.append(("EndstreamEOL", num)) if d[start + n - 1 : start + n] not in (b"\r", b"\n") else None
            end = d.find(b"endstream", start + n)
        else:
            if end < 0:
                raise ParseError("a stream without its end")
            stop = end
            if d[stop - 2 : stop] == b"\r\n":
                stop -= 2
            elif d[stop - 1 : stop] in (b"\r", b"\n"):
                stop -= 1
            v.raw = d[start:stop]
            if note:
                self.faults.append(("StreamLengthMismatch", num))
        lx.at = end + 9

    def resolve(self, v: object, hops: int = 0) -> object:
        """The value of a reference; one to nothing, or to itself, is None. The generation doesn't count."""
        while isinstance(v, Ref):
            if hops > 32:
                return None
            hops += 1
            num = v.num
            if num not in self.objects:
                self.objects[num] = None
                self.objects[num] = self.load(num)
            v = self.objects[num]
        return v

    def load(self, num: int) -> object:
        at = self.xref.get(num)
        if isinstance(at, tuple):
            items = self.container(at[0])
            return next((o for n, o in items if n == num), None)
        if at:
            try:
                found, o = self.object_at(at, True)
                if found == num:
                    return o
            except ParseError:
                pass
        if at is None or at:
            if (at := self.scan().get(num)) is not None:
                try:
                    return self.object_at(at, True)[1]
                except ParseError:
                    pass
        return None

    def container(self, num: int) -> list[tuple[int, object]]:
        if num not in self.containers:
            self.containers[num] = []
            s = self.resolve(Ref(num, 0))
            if isinstance(s, Dict) and s.is_stream:
                try:
                    body, n, first = self.decoded(s), s.get("N", 0), s.get("First", 0)
                    lx = Lexer(body)
                    heads = [(lx.value(), lx.value()) for _ in range(n)]
                    for k, at in heads:
                        o = Lexer(body, first + at).value()
                        if isinstance(o, Dict):
                            o.num = k
                        self.containers[num].append((k, o))
                except (ParseError, ValueError, TypeError):
                    pass
        return self.containers[num]

    def filters(self, s: Dict) -> list[str]:
        f = self.resolve(s.get("Filter"))
        return [str(self.resolve(x)) for x in f] if isinstance(f, list) else [str(f)] if f is not None else []

    def decoded(self, s: Dict) -> bytes:
        p = self.resolve(s.get("DecodeParms"))
        parms = [self.resolve(x) or {} for x in p] if isinstance(p, list) else [p or {}]
        return decode_chain(s.raw or b"", self.filters(s), parms)

    def path(self, *keys: str) -> object:
        """From the trailer by keys and indexes; a key that is no number leaves an array as it is."""
        v: object = self.trailer
        for k in keys:
            v = self.resolve(v)
            if isinstance(v, dict):
                v = v.get(k)
            elif isinstance(v, list):
                if k.isdigit():
                    v = v[int(k)] if int(k) < len(v) else None
            else:
                return None
        return self.resolve(v)


def tokenize_content(data: bytes) -> list[tuple[str, list]]:
    """Operators with their operands, in order; an inline image is one operator, BI, with its dictionary and data."""
    lx, stack, out = Lexer(data), [], []
    while True:
        try:
            v = lx.value(content=True)
        except ParseError:
            return out
        if type(v) is not Keyword:
            stack.append(v)
            continue
        if v == "BI":
            items: list = []
            try:
                while True:
                    x = lx.value(content=True)
                    if type(x) is Keyword and x == "ID":
                        break
                    items.append(x)
            except ParseError:
                return out
            m = re.compile(rb"[ \t\r\n]EI(?=[ \t\r\n]|\Z)").search(data, lx.at)
            end = m.start() if m else len(data)
            d = Dict({str(k): x for k, x in zip(items[::2], items[1::2]) if isinstance(k, Name)})
            d.raw = data[lx.at + 1 : end]
            out.append(("BI", [d]))
            lx.at = m.end() if m else len(data)
            stack = []
            continue
        out.append((str(v), stack))
        stack = []


PDF_DOC_HIGH = {0x80: "\u2022", 0x81: "\u2020", 0x82: "\u2021", 0x83: "\u2026", 0x84: "\u2014", 0x85: "\u2013", 0x86: "\u0192", 0x87: "\u2044", 0x88: "\u2039", 0x89: "\u203a", 0x8A: "\u2212", 0x8B: "\u2030", 0x8C: "\u201e", 0x8D: "\u201c", 0x8E: "\u201d", 0x8F: "\u2018", 0x90: "\u2019", 0x91: "\u201a", 0x92: "\u2122", 0x93: "\ufb01", 0x94: "\ufb02", 0x95: "\u0141", 0x96: "\u0152", 0x97: "\u0160", 0x98: "\u0178", 0x99: "\u017d", 0x9A: "\u0131", 0x9B: "\u0142", 0x9C: "\u0153", 0x9D: "\u0161", 0x9E: "\u017e", 0xA0: "\u20ac"}


def text_string(v: object) -> str | None:
    """The text of a string value: UTF-16 behind its mark, else the document encoding."""
    if not isinstance(v, bytes):
        return None
    raw = v.value if isinstance(v, Hex) else bytes(v)
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("latin-1").translate(PDF_DOC_HIGH)


# writing


def _format_name(v: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in DELIMITERS + b"#" else b"#%02X" % c for c in v.encode("latin-1", "replace"))


_format_short = lru_cache(4096)(_format_name)


def format_value(v: object) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return _format_short(v) if len(v) <= SHORT else _format_name(v)
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, Hex):
        return b"<" + bytes(v) + b">"
    if isinstance(v, bytes):
        return b"(" + re.sub(rb"[()\\\r\n]", lambda m: {b"\r": b"\\r", b"\n": b"\\n"}.get(m[0], b"\\" + m[0]), v) + b")"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, list):
        return b"[" + b" ".join(map(format_value, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join((_format_short(k) if len(k) <= SHORT else _format_name(k)) + b" " + format_value(x) for k, x in sorted(v.items())) + b">>"
    raise TypeError(type(v))


def reachable(objects: dict[int, object], trailer: dict) -> list[int]:
    """The numbers of the objects that the trailer leads to, in the order of first encounter, keys in order."""
    out: dict[int, None] = {}
    todo: list[object] = [trailer]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            if v.num in out or v.num not in objects:
                continue
            out[v.num] = None
            v = objects[v.num]
        if isinstance(v, dict):
            todo += [x for _, x in sorted(v.items(), reverse=True)]
        elif isinstance(v, list):
            todo += v[::-1]
    return list(out)


def renumbered(objects: dict[int, object], trailer: dict) -> tuple[dict[int, object], Dict]:
    """Only what the trailer leads to, numbered from 1 in the order of first encounter; references to nothing are null."""
    to = {num: k for k, num in enumerate(reachable(objects, trailer), 1)}

    def copy(v: object) -> object:
        if isinstance(v, Ref):
            return Ref(to[v.num], 0) if v.num in to else None
        if isinstance(v, dict):
            d = Dict({k: copy(x) for k, x in v.items()})
            d.raw = v.raw if isinstance(v, Dict) else None
            return d
        return [copy(x) for x in v] if isinstance(v, list) else v

    return {k: copy(objects[num]) for num, k in to.items()}, copy(trailer)


def write_document(objects: dict[int, object], trailer: dict, version: str = "1.4") -> bytes:
    """Objects by number as a file with a classic table; Length and Size are set."""
    out, at = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        v = objects[num]
        at[num] = len(out)
        out += b"%d 0 obj\n" % num
        if isinstance(v, Dict) and v.raw is not None:
            out += format_value({**v, "Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
        else:
            out += format_value(v)
        out += b"\nendobj\n"
    start, size = len(out), max(objects, default=0) + 1
    out += b"xref\n"
    runs: list[list[int]] = [[0, 0]]  # first and last number of each subsection; small gaps are free entries
    for num in sorted(at):
        if num - runs[-1][1] <= MAX_FREE:
            runs[-1][1] = num
        else:
            runs.append([num, num])
    for first, last in runs:
        out += b"%d %d\n" % (first, last - first + 1)
        for num in range(first, last + 1):
            out += b"%010d 00000 n \n" % at[num] if num in at else b"0000000000 65535 f \n"
    return bytes(out) + b"trailer\n" + format_value({**trailer, "Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
