"""The byte reader, the decoders and the writer."""

import random
import zlib

import pytest

from folioscan.functions import decoders as d
from folioscan.functions import pdf_fixture as fx
from folioscan.functions import xmp
from folioscan.sources.pdf import Walk
from folioscan.sources.pdf_bytes import Dict, Document, Hex, Lexer, Lit, Name, ParseError, Ref, format_value, text_string, tokenize_content, write_document


@pytest.mark.parametrize("n", [0, 1, 4, 5, 255, 300, 5000, 70_000])
def test_decoders_undo_encoders(n):
    data = bytes(random.Random(n).choices(b"abcab\0\xff", k=n))
    assert d.lzw(d.encode_lzw(data)) == data
    assert d.ascii85(d.encode_ascii85(data)) == data
    assert d.ascii_hex(data.hex().encode() + b">") == data
    assert d.inflate(zlib.compress(data)) == data
    for kind in range(5):
        assert d.png_predictor(d.encode_png_predictor(data[:2000], 7, kind), 7)[: len(data[:2000])] == data[:2000]


def test_damaged_input():
    whole = zlib.compress(bytes(range(256)) * 50)
    assert d.inflate(whole[:-200]) == (bytes(range(256)) * 50)[: len(d.inflate(whole[:-200]))] != b""
    with pytest.raises(ValueError):
        d.inflate(b"no zlib data")
    with pytest.raises(ValueError):
        d.decode_chain(b"", ["JBIG2Decode"], [])
    assert d.run_length(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\1\2\3\t\t\t"
    assert d.read_bits(b"\xa5\xff", 4, 8) == 0x5F


def test_values():
    v = Lexer(rb"<< /A#20B [1 -2.5 (a\(b\)\101\n) <4 1> true null 3 0 R] /A#20B 7 /C << /D /E >> >>").value()
    assert v == {"A B": 7, "C": {"D": "E"}}
    v = Lexer(rb"[1 -2.5 (a\(b\)\101\n) <4 1> true null 3 0 R]").value()
    assert v == [1, -2.5, b"a(b)A\n", b"4 1", True, None, Ref(3, 0)] and v[3].value == b"A"
    for bad in (b"", b"(open", b"<41", b"[1 2", b"<< /A 1", b"[" * 1100):
        with pytest.raises(ParseError):
            Lexer(bad).value()
    for x in (None, True, 1, -2.5, Name("a b#"), Lit(b"(x)\\\r\n"), Hex(b"00"), [1, [Ref(2, 0)]], Dict(A=Dict(B=1))):
        assert Lexer(format_value(x)).value() == x or isinstance(x, Ref)
    assert text_string(Hex(b"FEFF00E9")) == text_string(Lit(b"\xe9")) == "\xe9"


def test_content():
    ops = tokenize_content(b"q 1 0 0 1 5 5 cm /F0 12 Tf [(a) -3 (b)] TJ BI /W 1 /H 1 ID \x00\x01 EI Q")
    assert [o for o, _ in ops] == ["q", "cm", "Tf", "TJ", "BI", "Q"] and ops[3][1] == [[b"a", -3, b"b"]]
    assert ops[4][1][0].raw == b"\0\1"


def test_incremental_update_and_recovery():
    o, t = fx.base("text")
    data = fx.make("text", 0)
    at = data.rindex(b"startxref")
    old = int(data[at:].split()[1])
    new = len(data)
    update = b"16 0 obj\n<</Title (New)>>\nendobj\n"
    data += update + b"xref\n16 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R /Size 17 /Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (new, old, new + len(update))
    doc = Document(data).open()
    assert doc.resolve(Ref(16, 0))["Title"] == b"New" and doc.path("Info", "Title") == b"New" and doc.path("Root", "Pages", "Count") == 1
    broken = fx.make("text", 0).replace(b"startxref", b"startxxxx")
    doc = Document(broken).open()
    assert doc.error is None and doc.path("Root", "Pages", "Kids", "0", "Type") == "Page" and ("XRefKeyword", 0) in doc.faults
    assert Document(b"nothing").open().error and Document(b"%PDF-1.4\n").open().error


def test_object_streams():
    body = b"2 0 3 31 <</Type /Pages /Kids [3 0 R]>> <</Type /Page>>"
    first = 9
    objects = {1: Dict(Type=Name("Catalog"), Pages=Ref(2, 0)), 4: fx.stream(zlib.compress(body), Type=Name("ObjStm"), N=2, First=first, Filter=Name("FlateDecode"))}
    plain = write_document(objects, {"Root": Ref(1, 0)})
    plain = plain[: plain.index(b"xref\n")]
    at = {n: plain.index(b"%d 0 obj" % n) for n in (1, 4)}
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (1, at[1], 0), (2, 4, 0), (2, 4, 1), (1, at[4], 0)])
    table = fx.stream(rows, Type=Name("XRef"), W=[1, 2, 1], Size=5, Root=Ref(1, 0), Length=len(rows))
    data = plain + b"5 0 obj\n" + format_value(table) + b"\nstream\n" + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(plain)
    doc = Document(data).open()
    assert doc.path("Root", "Pages", "Kids", "0", "Type") == "Page" and not doc.classic


def test_no_crash_on_broken_files():
    rng = random.Random(1)
    for k in range(150):
        data = bytearray(fx.make(f"text {k}", k % len(fx.DEFECTS)))
        for _ in range(rng.randint(1, 20)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if k % 3 == 0:
            del data[rng.randrange(len(data)) :]
        try:
            Walk(k, bytes(data)).run()
        except (ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
            pass  # what nodes() turns into a row


def test_xmp():
    assert xmp.well_formed("<a><b/></a>") and not xmp.well_formed("<a><b></a>") and not xmp.well_formed("a < b")
    assert xmp.decode_packet("<x>é".encode("utf-16-le")) == "<x>é" and xmp.unescape("&amp;lt;") == "<"
    assert xmp.pdf_date_to_iso("D:2024010203") == "2024-01-02T03:00Z" and xmp.pdf_date_to_iso("D:20240102030405+01'30'") == "2024-01-02T03:04:05+01:30" and xmp.pdf_date_to_iso("x") is None
    assert xmp.iso_to_pdf_date("2024-01-02T03:04:05+01:30") == "D:20240102030405+01'30'" and xmp.iso_to_pdf_date("2024-01") == "D:202401"
    assert xmp.is_date("2024-01") and not xmp.is_date("2024-1")


def test_renumbering_keeps_what_is_reachable():
    from folioscan.sources.pdf_bytes import reachable, renumbered

    o, t = fx.base("text")
    o[40] = Dict(Type=Name("Unreachable"))
    o[3]["Own"] = Ref(99, 0)
    assert reachable(o, t)[:2] == [16, 1] and 40 not in reachable(o, t)
    new, trailer = renumbered(o, t)
    assert sorted(new) == list(range(1, len(new) + 1)) and len(new) == len(o) - 1 and trailer["Info"] == Ref(1, 0) and trailer["Root"] == Ref(2, 0)
    doc = Document(write_document(new, trailer)).open()
    page = doc.path("Root", "Pages", "Kids", "0")
    assert page["Own"] is None and doc.path("Info", "Title") == o[16]["Title"] and doc.decoded(doc.resolve(page["Contents"])) == Document(write_document(o, t)).open().decoded(o[7])
    assert renumbered(new, trailer) == (new, trailer)


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A table with one row group is one task's, however many partitions its scan has; so are the queries over it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from folioscan.plans import program_queries, queries
    from folioscan.sources.pdf import slices, spread

    n = 4000
    text = ["word %d " % (k * k) * 40 for k in range(n)]
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": text}), f"{tmp_path}/documents.parquet", compression="none")
    pq.write_table(pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_name": text}), f"{tmp_path}/customer.parquet", compression="none")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        scan = spark.read.parquet(f"{tmp_path}/documents.parquet")
        held = lambda d: d.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(held(scan)) >= 12 and max(held(scan)) == n
        once = spread(scan, "doc_id")
        assert max(held(once)) < n / 4 and sum(held(once)) == n
        assert spread(once, "doc_id").rdd.getNumPartitions() == once.rdd.getNumPartitions()
        names = ("ascii_hex_roundtrip", "lzw_roundtrip", "ascii85_roundtrip", "predictor_roundtrip")
        for q in [*(queries.QUERIES[k] for k in names), *(program_queries.QUERIES[k] for k in ("facsimile_roundtrip", "deflated_rows"))]:
            assert max(held(q(spark, str(tmp_path)))) < n / 4
        assert max(held(queries._files(spark, str(tmp_path)))) < n / 4 and max(held(program_queries._ids(spark, str(tmp_path)))) < n / 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    big = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 10_000)], ["text"])
    parts = list(slices(iter([big])))
    assert max(p.nbytes for p in parts) < 3 << 20 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([big]))
