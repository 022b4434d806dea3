"""Bilevel images in the codes of facsimile groups 3 and 4."""

from __future__ import annotations

_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011
00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101
01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001
010011010 011000 010011011"""
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000
000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010
000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011
000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
#: Runs below 64, then in steps of 64, by code.
RUNS = [{c: k if k < 64 else (k - 63) * 64 for k, c in enumerate((x + " " + _LONG).split())} for x in (_WHITE, _BLACK)]
#: Vertical offsets, pass and horizontal.
MODES: dict[str, int | str] = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal"}
MAX_COLUMNS, MAX_BYTES = 1 << 20, 64 << 20


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, table: dict, most: int = 13):
        """The value of the code that stands here; None where none does."""
        for n in range(1, most + 1):
            if (v := table.get(self.bits[self.at : self.at + n])) is not None and self.at + n <= len(self.bits):
                self.at += n
                return v
        return None

    def run(self, black: int) -> int | None:
        total = 0
        while (n := self.code(RUNS[black])) is not None:
            total += n
            if n < 64:
                return total
        return None

    def end_of_line(self) -> bool:
        """Passes the fill and the mark of a line's end, if they are here."""
        k = self.bits.find("1", self.at)
        if k - self.at >= 11:
            self.at = k + 1
            return True
        return False


def _one(b: _Bits, columns: int) -> list[int] | None:
    """The places at which a line changes its colour, from white."""
    at, black, out = 0, 0, []
    while at < columns:
        n = b.run(black)
        if n is None:
            return None
        at += n
        out.append(min(at, columns))
        black ^= 1
    return out


def _two(b: _Bits, above: list[int], columns: int) -> list[int] | None:
    """As _one(), coded against the line above."""
    at, black, out = -1, 0, []
    while at < columns:
        # the first change above to the right of here, to the other colour, and the one after it
        k = next((k for k, x in enumerate(above) if x > at and k % 2 == black), len(above))
        b1 = above[k] if k < len(above) else columns
        b2 = above[k + 1] if k + 1 < len(above) else columns
        mode = b.code(MODES, 7)
        if mode is None:
            return None
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            first, second = b.run(black), b.run(black ^ 1)
            if first is None or second is None:
                return None
            start = max(at, 0)
            out += [min(start + first, columns), min(start + first + second, columns)]
            at = start + first + second
        else:
            at = b1 + mode
            if at < (out[-1] if out else 0):
                return None
            out.append(min(at, columns))
            black ^= 1
    return out


def decode_ccitt(data: bytes, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, byte_align: bool = False) -> bytes:
    """Rows of packed bits. k < 0 is group 4, 0 group 3, above it mixed. Damage ends the image: rows that are stated but
    missing are white; without any row it is an error."""
    if columns > MAX_COLUMNS or rows > 0 and (columns + 7) // 8 * rows > MAX_BYTES:
        raise ValueError("an image too large")
    b, above, out, done = _Bits(data), [], bytearray(), 0

    def pack(changes: list[int]) -> bytes:
        v, edges = 0, [*changes, columns]
        for s, e in zip(edges[::2], edges[1::2]):
            if e > s:
                v |= (1 << e - s) - 1 << columns - e
        if not black_is_1:
            v ^= (1 << columns) - 1
        pad = -columns % 8
        return (v << pad).to_bytes((columns + pad) // 8, "big")

    while b.at < len(b.bits) and (rows <= 0 or done < rows):
        if byte_align and done:
            b.at += -b.at % 8
        ends = 0
        if k >= 0:
            while b.end_of_line():
                ends += 1
                if k > 0 and ends > 1:
                    b.at += 1
            if ends > 1:
                break
        two = k < 0
        if k > 0:
            two = b.bits[b.at : b.at + 1] == "0"
            b.at += 1
        line = _two(b, above, columns) if two else _one(b, columns)
        if line is None:
            break
        out += pack(line)
        above, done = line, done + 1
        if len(out) > MAX_BYTES:
            raise ValueError("an image too large")
    if not done:
        raise ValueError("no row of an image")
    for _ in range(max(0, rows - done)):
        out += pack([])
    return bytes(out)


def encode_ccitt(lines: list[list[int]], columns: int, group4: bool = True) -> bytes:
    """The same from lines of changes, for tests: group 4, or group 3 with ends of lines."""
    codes = [{v: c for c, v in t.items()} for t in RUNS]
    modes = {v: c for c, v in MODES.items()}

    def run(n: int, black: int) -> str:
        out = ""
        while n >= 2560:
            out, n = out + codes[black][2560], n - 2560
        if n >= 64:
            out, n = out + codes[black][n // 64 * 64], n % 64
        return out + codes[black][n]

    bits, above = "", []
    for line in lines:
        if not group4:
            at = black = 0
            bits += "0" * 11 + "1"
            for x in [*line, *([columns] if not line or line[-1] < columns else [])]:
                bits += run(x - at, black)
                at, black = x, black ^ 1
        else:
            at, black = -1, 0
            while at < columns:
                nexts = [x for x in line if x > at and (line.index(x) % 2 == black)] or [columns]
                a1 = nexts[0]
                a2 = next((x for x in line if x > a1), columns)
                k = next((k for k, x in enumerate(above) if x > at and k % 2 == black), len(above))
                b1, b2 = (above[j] if j < len(above) else columns for j in (k, k + 1))
                if b2 < a1:
                    bits, at = bits + modes["pass"], b2
                elif abs(a1 - b1) <= 3:
                    bits, at, black = bits + modes[a1 - b1], a1, black ^ 1
                else:
                    bits += modes["horizontal"] + run(a1 - max(at, 0), black) + run(a2 - a1, black ^ 1)
                    at = a2
        above = line
    bits += "000000000001" * (2 if group4 else 6)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")
