"""Stream decoders, predictors and bit readers, for the tasks that read files."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable

import numpy as np

from folioscan.functions.ccitt import decode_ccitt

MAX_INFLATED = 256 << 20


def inflate(data: bytes, limit: int = MAX_INFLATED) -> bytes:
    """Zlib data; of truncated data, what could be had. Data that don't begin as zlib are an error."""
    z, out = zlib.decompressobj(), b""
    try:
        out = z.decompress(data, limit)
        if z.unconsumed_tail and not z.eof:
            raise ValueError(f"more than {limit} bytes inflated")
        return out + z.flush() if z.eof else out
    except zlib.error:
        parts, z = [], zlib.decompressobj()
        for k in range(0, len(data), 64):
            try:
                parts.append(z.decompress(data[k : k + 64]))
            except zlib.error:
                break
        if not any(parts):
            raise ValueError("not zlib data") from None
        return b"".join(parts)


def deflate(data: bytes, fast: bool = False) -> bytes:
    return zlib.compress(data, 1 if fast else -1)


def deflate_rows(rows: Iterable[bytes]) -> bytes:
    """Rows compressed one after another, of which no more than one is held."""
    z = zlib.compressobj()
    return b"".join([*(z.compress(r) for r in rows), z.flush()])


_NO_DIGITS = bytes(c for c in range(256) if c not in b"0123456789abcdefABCDEF")
_NO_85 = bytes(c for c in range(256) if not 33 <= c <= 117 and c != 0x7A)
_POWERS_85 = np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)


def ascii_hex(data: bytes) -> bytes:
    digits = data.partition(b">")[0].translate(None, _NO_DIGITS)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    """Base 85; z stands for four zero bytes, ~ ends."""
    out, held = [], b""

    def whole(digits: bytes) -> bytes:
        v = (np.frombuffer(digits, np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(33)) @ _POWERS_85
        return (v & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()

    *zeros, last = data.partition(b"~")[0].translate(None, _NO_85).split(b"z")
    for part in zeros:
        held += part
        if len(held) % 5 == 0:  # a z within a group counts for nothing
            out += [whole(held), b"\0\0\0\0"]
            held = b""
    held += last
    n = len(held) % 5
    out.append(whole(held[: len(held) - n]))
    if n > 1:
        out.append(whole(held[len(held) - n :] + b"u" * (5 - n))[: n - 1])
    return b"".join(out)


def encode_ascii85(data: bytes) -> bytes:
    return base64.a85encode(data) + b"~>"


def run_length(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data) and data[k] != 128:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


_LZW_BYTES = [bytes([k]) for k in range(256)] + [b"", b""]


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends; the width changes one code early."""
    out, table, width, held, bits, last = [], _LZW_BYTES[:], 9, 0, 0, b""
    size, wider = 258, 512 - early  # of the table, and at which the codes get a bit more
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code < size:
            if code == 256:
                table, width, last, size, wider = _LZW_BYTES[:], 9, b"", 258, 512 - early
                continue
            if code == 257:
                break
            entry = table[code]
        elif code == size and last:
            entry = last + last[:1]
        else:
            break
        out.append(entry)
        if last and size < 4096:
            table.append(last + entry[:1])
            size += 1
            if size >= wider and width < 12:
                width += 1
                wider = (1 << width) - early
        last = entry
    return b"".join(out)


def encode_lzw(data: bytes, early: int = 1) -> bytes:
    # a run is known by its code; a longer one by the code of all but its last byte, and that byte
    longer: dict[int, int] = {}
    width, count, run = 9, 258, -1
    codes, widths = [256], [9]
    for b in data:
        if run < 0:
            run = b
            continue
        key = run << 8 | b
        if (known := longer.get(key)) is not None:
            run = known
            continue
        codes.append(run)
        widths.append(width)
        if count < 4095:
            longer[key] = count
            count += 1
            # the decoder is one entry behind the encoder
            width = min(12, max(9, (count - 1 + early).bit_length()))
        else:
            codes.append(256)
            widths.append(width)
            longer, width, count = {}, 9, 258
        run = b
    if run >= 0:
        codes.append(run)
        widths.append(width)
        count += 1
        width = min(12, max(9, (count - 1 + early).bit_length()))
    codes.append(257)
    widths.append(width)
    out, value, bits = bytearray(), 0, 0
    for code, width in zip(codes, widths):
        value, bits = value << width | code, bits + width
        if bits >= 512:
            keep = bits & 7
            out += (value >> keep).to_bytes(bits >> 3, "big")
            value, bits = value & (1 << keep) - 1, keep
    if bits:
        out += (value << (-bits & 7)).to_bytes((bits + 7) >> 3, "big")
    return bytes(out)


def png_predictor(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes the row filters none, sub, up, average and Paeth."""
    row, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    out, above = bytearray(), bytearray(row)
    for k in range(0, len(data), row + 1):
        kind, line = data[k], bytearray(data[k + 1 : k + 1 + row].ljust(row, b"\0"))
        if kind == 1:
            for i in range(step, row):
                line[i] = line[i] + line[i - step] & 255
        elif kind == 2:
            line = bytearray([x + b & 255 for x, b in zip(line, above)])
        elif kind == 3:
            for i in range(row):
                line[i] = line[i] + ((line[i - step] if i >= step else 0) + above[i]) // 2 & 255
        elif kind == 4:
            for i in range(min(step, row)):
                line[i] = line[i] + above[i] & 255
            for i in range(step, row):
                a, b, c = line[i - step], above[i], above[i - step]
                pa, pb = b - c, a - c
                pc = pa + pb
                pa, pb, pc = pa if pa >= 0 else -pa, pb if pb >= 0 else -pb, pc if pc >= 0 else -pc
                line[i] = line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
        out += line
        above = line
    return bytes(out)


def encode_png_predictor(data: bytes, columns: int, kind: int) -> bytes:
    """One filter for all rows, of one 8-bit colour; the last row is padded."""
    x = np.frombuffer(data.ljust(-(-len(data) // columns) * columns, b"\0"), np.uint8).reshape(-1, columns).astype(np.int16)
    a, b, c = (np.zeros_like(x) for _ in range(3))
    a[:, 1:], b[1:], c[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    out = np.full((len(x), columns + 1), kind, np.uint8)
    out[:, 1:] = x - (0, a, b, (a + b) // 2, paeth)[kind] & 255
    return out.tobytes()


def tiff_predictor(data: bytes, columns: int, colors: int = 1) -> bytes:
    """Undoes horizontal differences of 8-bit samples."""
    row, out = columns * colors, bytearray(data)
    for k in range(0, len(out), row):
        for i in range(k + colors, min(k + row, len(out))):
            out[i] = out[i] + out[i - colors] & 255
    return bytes(out)


def predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    columns, colors, bits = parms.get("Columns", 1), parms.get("Colors", 1), parms.get("BitsPerComponent", 8)
    if kind == 2:
        return tiff_predictor(data, columns, colors)
    return png_predictor(data, columns, colors, bits) if isinstance(kind, int) and kind >= 10 else data


def read_bits(data: bytes, at: int, n: int) -> int:
    """n bits from bit place at, zeros beyond the end."""
    first, last = at // 8, (at + n + 7) // 8
    v = int.from_bytes(data[first:last].ljust(last - first, b"\0"), "big")
    return v >> last * 8 - at - n & (1 << n) - 1


FILTERS = {"FlateDecode": inflate, "Fl": inflate, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "ASCII85Decode": ascii85, "A85": ascii85, "LZWDecode": lzw, "LZW": lzw, "RunLengthDecode": run_length, "RL": run_length}


def decode_chain(data: bytes, names: list[str], parms: list[dict]) -> bytes:
    """Filters one after another, each with its predictor; an unknown filter is an error."""
    for k, name in enumerate(names):
        own = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        if name in ("CCITTFaxDecode", "CCF"):
            whole = lambda key, d, own=own: v if type(v := own.get(key, d)) is int else d
            data = decode_ccitt(data, whole("K", 0), whole("Columns", 1728), whole("Rows", 0), own.get("BlackIs1") is True, own.get("EncodedByteAlign") is True)
            continue
        if name not in FILTERS:
            raise ValueError(f"no decoder for {name}")
        data = predicted(FILTERS[name](data, own.get("EarlyChange", 1)) if FILTERS[name] is lzw else FILTERS[name](data), own)
    return data
