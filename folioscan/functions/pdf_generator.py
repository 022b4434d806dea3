"""Broken files from a number: seeds of eight structures, corruptions by name, and files of a random grammar.

A number gives the same file everywhere, so a table of numbers is a table of files that any task can build.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.decoders import encode_ascii85
from folioscan.functions.pdf_fixture import _table_as_stream, packet, stream
from folioscan.sources.pdf_bytes import Dict, Hex, Lit, Name, Ref, format_value, write_document

Corruption = Callable[[bytes, random.Random], bytes]
CONTENT = b"BT /F0 12 Tf (generated) Tj ET 0 0 10 10 re f"


def _plain(content: Dict | None = None, metadata: bool = False) -> bytes:
    o: dict[int, object] = {
        1: Dict(Type=Name("Catalog"), Pages=Ref(2, 0)), 2: Dict(Type=Name("Pages"), Kids=[Ref(3, 0)], Count=1),
        3: Dict(Type=Name("Page"), Parent=Ref(2, 0), MediaBox=[0, 0, 72, 72]),
    }
    if content is not None:
        o[4] = content
        o[3]["Contents"] = Ref(4, 0)
    if metadata:
        o[5] = stream(packet("generated"), Type=Name("Metadata"), Subtype=Name("XML"))
        o[1]["Metadata"] = Ref(5, 0)
    return write_document(o, Dict(Root=Ref(1, 0), ID=[Hex(b"00"), Hex(b"00")]))


def _updated() -> bytes:
    """A file whose page was written again behind its end."""
    data = _plain(stream(CONTENT))
    old, new = int(re.findall(rb"startxref\n(\d+)", data)[-1]), len(data)
    body = b"3 0 obj\n<</MediaBox [0 0 90 90] /Parent 2 0 R /Type /Page>>\nendobj\n"
    return data + body + b"xref\n3 1\n%010d 00000 n \ntrailer\n<</Prev %d /Root 1 0 R /Size 5>>\nstartxref\n%d\n%%%%EOF\n" % (new, old, new + len(body))


def _object_streams() -> bytes:
    """A file whose pages are in an object stream, with a stream for its table."""
    inside = [(2, format_value(Dict(Type=Name("Pages"), Kids=[Ref(3, 0)], Count=1))), (3, format_value(Dict(Type=Name("Page"), Parent=Ref(2, 0), MediaBox=[0, 0, 72, 72])))]
    heads, at = [], 0
    for num, body in inside:
        heads.append(b"%d %d" % (num, at))
        at += len(body) + 1
    first = b" ".join(heads) + b" "
    data = write_document({1: Dict(Type=Name("Catalog"), Pages=Ref(2, 0)), 4: stream(zlib.compress(first + b" ".join(b for _, b in inside)), Type=Name("ObjStm"), N=2, First=len(first), Filter=Name("FlateDecode"))}, Dict(Root=Ref(1, 0)))
    data = data[: data.index(b"xref\n0 ")]
    at1, at4, at5 = data.index(b"1 0 obj"), data.index(b"4 0 obj"), len(data)
    rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + bytes([b]) for k, a, b in ((0, 0, 0), (1, at1, 0), (2, 4, 0), (2, 4, 1), (1, at4, 0), (1, at5, 0)))
    return data + b"5 0 obj\n<</Type /XRef /W [1 4 1] /Index [0 6] /Size 6 /Root 1 0 R /Length %d>>\nstream\n" % len(rows) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at5


SEEDS: dict[str, Callable[[], bytes]] = {
    "minimal": _plain, "metadata": lambda: _plain(metadata=True), "flate": lambda: _plain(stream(zlib.compress(CONTENT), Filter=Name("FlateDecode"))),
    "hex": lambda: _plain(stream(CONTENT.hex().encode() + b">", Filter=Name("ASCIIHexDecode"))), "base85": lambda: _plain(stream(encode_ascii85(CONTENT), Filter=Name("ASCII85Decode"))),
    "table_stream": lambda: _table_as_stream(_plain(stream(CONTENT))), "object_stream": _object_streams, "updated": _updated,
}


def seeds() -> dict[str, bytes]:
    """The eight files that others are made from, by name."""
    return {k: f() for k, f in SEEDS.items()}


def mutate(data: bytes, rng: random.Random) -> bytes:
    """A few bytes at random; what a corruption does where its own target is missing."""
    out = bytearray(data or b"%")
    for _ in range(rng.randint(1, 8)):
        out[rng.randrange(len(out))] = rng.randrange(256)
    return bytes(out)


def _swap(pattern: bytes, new: bytes | Callable[[re.Match, random.Random], bytes]) -> Corruption:
    """One occurrence of a pattern, chosen at random, becomes something else."""
    find = re.compile(pattern, re.S)

    def apply(data: bytes, rng: random.Random) -> bytes:
        found = list(find.finditer(data))
        if not found:
            return mutate(data, rng)
        m = rng.choice(found)
        return data[: m.start()] + (new(m, rng) if callable(new) else m.expand(new)) + data[m.end() :]

    return apply


def _shift(m: re.Match, rng: random.Random) -> bytes:
    return m[1] + b"%d" % max(0, int(m[2]) + rng.choice([-7, -1, 1, 13]))


def _payload(m: re.Match, rng: random.Random) -> bytes:
    body = bytearray(m[2])
    for _ in range(min(len(body), 5)):
        body[rng.randrange(len(body))] ^= 1 << rng.randrange(8)
    return m[1] + bytes(body) + m[3]


def _zeros(data: bytes, rng: random.Random) -> bytes:
    out = bytearray(data or b"%")
    for _ in range(rng.randint(1, 12)):
        out.insert(rng.randrange(len(out) + 1), 0)
    return bytes(out)


def _flips(data: bytes, rng: random.Random) -> bytes:
    out = bytearray(data or b"%")
    for _ in range(rng.randint(1, 16)):
        out[rng.randrange(len(out))] ^= 1 << rng.randrange(8)
    return bytes(out)


#: What breaks a file, by name.
CORRUPTIONS: dict[str, Corruption] = {
    "cut": lambda d, r: d[: r.randrange(len(d))] if d else mutate(d, r), "leading": lambda d, r: r.randbytes(r.randint(1, 200)) + d,
    **{f"no_{k}": _swap(re.escape(t), b"") for k, t in (("end", b"%%EOF"), ("trailer", b"trailer"), ("table", b"xref"), ("start", b"startxref"))},
    "two_starts": _swap(rb"(startxref\s+\d+)", rb"\1\n\1"), "start_negative": _swap(rb"(startxref\s+)\d+", rb"\1-1"), "start_huge": _swap(rb"(startxref\s+)\d+", rb"\g<1>999999999999"), "start_text": _swap(rb"(startxref\s+)\d+", rb"\1here"), "start_shifted": _swap(rb"(startxref\s+)(\d+)", _shift),
    "places": _swap(rb"(\n)(\d{10})(?= 00000 n)", lambda m, r: m[1] + b"%010d" % r.randrange(10**6)), "size": _swap(rb"/Size \d+", lambda m, r: b"/Size %d" % r.choice([0, 1, 10**9])),
    "length_long": _swap(rb"/Length \d+", b"/Length 1048576"), "length_negative": _swap(rb"/Length \d+", b"/Length -5"), "length_text": _swap(rb"/Length \d+", b"/Length (none)"), "payload": _swap(rb"(stream\r?\n)(.+?)(\r?\nendstream)", _payload),
    "filter": _swap(rb"/(Flate|ASCIIHex|ASCII85)Decode", b"/NoSuchDecode"), "dangling": _swap(rb"\d+ 0 R", b"9876 0 R"), "self_reference": _swap(rb"/Type /Catalog", b"/Type /Catalog /Own 1 0 R"), "huge_number": _swap(rb"\d+ 0 obj", b"4294967299 0 obj"),
    "open_dictionary": _swap(rb"<<", b"<< << "), "open_array": _swap(rb"/Kids ?\[", b"/Kids [[[["), "open_string": _swap(rb"/Type /(Catalog|Pages?)", b"/Own (never closed"), "name_escape": _swap(rb"/(Type|Kids|Count)", rb"/\1#zz"),
    "deep": _swap(rb"/MediaBox ?\[", lambda m, r: b"/Deep " + b"[" * 3000 + b"]" * 3000 + b" " + m[0]), "parameters": _swap(rb"/FlateDecode", b"/FlateDecode /DecodeParms <</Colors 77 /Columns -3 /BitsPerComponent 64 /Predictor 14>>"),
    "widths": _swap(rb"/W ?\[[^]]*\]", b"/W [9 9 9]"), "widths_none": _swap(rb"/W ?\[[^]]*\]", b"/W [0 0 0]"), "index": _swap(rb"/Index ?\[[^]]*\]", b"/Index [9999 9999]"), "members": _swap(rb"/N \d+", b"/N 999999"), "first": _swap(rb"/First \d+", b"/First 999999"),
    "zeros": _zeros, "flips": _flips,
}


def _value(rng: random.Random, most: int, depth: int) -> object:
    kind = rng.randrange(11 if depth < 4 else 8)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind in (1, 2):
        return rng.choice([0, 1, -1, 2**31 - 1, 2**31, -(2**31) - 1, rng.randrange(1000)])
    if kind == 3:
        return rng.choice([0.5, -0.0001, 32767.5, 1e9])
    if kind == 4:
        return Name(rng.choice(["Type", "Page", "Font", "A" * 130, "a b", "Catalog"]))
    if kind == 5:
        return Lit(rng.randbytes(rng.randrange(20)))
    if kind == 6:
        return Hex(rng.choice([b"", b"0", b"00FF", b"zz"]))
    if kind == 7:
        return Ref(rng.randint(0, most + 2), 0)
    if kind == 8:
        return [_value(rng, most, depth + 1) for _ in range(rng.randrange(5))]
    return _entries(rng, most, depth + 1)


def _entries(rng: random.Random, most: int, depth: int) -> Dict:
    keys = "Annots Contents Count Filter Kids Length Metadata Parent Resources S Subtype Type".split()
    return Dict({rng.choice(keys): _value(rng, most, depth) for _ in range(rng.randrange(6))})


def generate_grammar(seed: int) -> bytes:
    """A file of random objects that is well formed as a file."""
    rng = random.Random(f"grammar {seed}")
    most, objects = rng.randint(1, 12), {}
    for num in range(1, most + 1):
        v = _value(rng, most, 0)
        if isinstance(v, Dict) and rng.random() < 0.4:
            v.raw = rng.randbytes(rng.randrange(60))
        objects[num] = v
    objects[1] = Dict(_entries(rng, most, 1), Type=Name("Catalog"), Pages=Ref(rng.randint(1, most), 0))
    return write_document(objects, Dict(Root=Ref(1, 0)))


def generate(seed: int) -> bytes:
    """The file of a number: bytes at random (1 of 8), a random grammar (1 of 6 of the rest, half of them broken), or a
    seed with one to three corruptions."""
    rng = random.Random(f"file {seed}")
    if rng.randrange(8) == 0:
        return (b"%PDF-1." + b"%d\n" % rng.randrange(10) if rng.random() < 0.5 else b"") + rng.randbytes(rng.randrange(512))
    names = sorted(CORRUPTIONS)
    if rng.randrange(6) == 0:
        out = generate_grammar(seed)
        return out if rng.random() < 0.5 else CORRUPTIONS[rng.choice(names)](out, rng)
    out = SEEDS[rng.choice(sorted(SEEDS))]()
    for _ in range(rng.randint(1, 3)):
        out = CORRUPTIONS[rng.choice(names)](out, rng)
    return out


def corrupt(seed_name: str, name: str, number: int) -> bytes:
    """One corruption of one seed."""
    return CORRUPTIONS[name](SEEDS[seed_name](), random.Random(f"{seed_name} {name} {number}"))


def build_files(numbers: DataFrame) -> DataFrame:
    """file_id, content of the file of each number (file_id), built in the tasks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(generate, b.column(0).to_pylist()), pa.binary())], ["file_id", "content"])

    return numbers.select(F.col("file_id").cast("bigint").alias("file_id")).mapInArrow(build, "file_id bigint, content binary")


def generate_files(spark: SparkSession, first: int, n: int) -> DataFrame:
    """The files of n numbers from first on."""
    return build_files(spark.range(first, first + n).select(F.col("id").alias("file_id")))
