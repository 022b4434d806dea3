"""Conversion, the stream of files and the command line."""

from folioscan import cli
from folioscan.functions import pdf_fixture
from folioscan.functions.font_fixture import build_sfnt
from folioscan.operators.convert import Editor, convert, fix_bytes, write_content
from folioscan.operators.rules import verify
from folioscan.plans.catalog import check_by_name
from folioscan.sources.content_usage import page_dicts
from folioscan.sources.pdf import Walk
from folioscan.sources.pdf_bytes import Dict, Document, Name, Ref, tokenize_content, write_document
from folioscan.streaming.files import verify_stream


def test_convert_mends_and_rests(spark):
    n = {k: i for i, (k, _, _) in enumerate(pdf_fixture.DEFECTS)}
    wanted = ["none", "lzw", "nesting", "annot_hidden", "xmp_part", "big_int", "font_missing", "transfer", "embedded"]
    data = spark.createDataFrame([(n[k], "a text") for k in wanted], "file_id bigint, text string")
    files = pdf_fixture.make_files(data)
    fixed, results, issues = convert(files, "strict_1b")
    assert {r.file_id for r in results.where("not valid").collect()} == {n["font_missing"]}
    assert {r.check_id for r in issues.collect()} == {check_by_name("SimpleNotEmbedded").check_id}
    got = {r.file_id: r for r in fixed.collect()}
    assert bytes(got[0].content) == pdf_fixture.make("a text", 0) and got[0].rounds == 0 and got[n["lzw"]].rounds == 1
    again, _, _ = convert(fixed.select("file_id", "content"), "strict_1b")
    assert {r.file_id: bytes(r.content) for r in again.collect() if r.file_id != n["font_missing"]} == {k: bytes(r.content) for k, r in got.items() if k != n["font_missing"]}
    assert verify(fixed.select("file_id", "content"), "strict_1b")[1].where("valid").count() == len(wanted) - 1


def test_fix_bytes_leaves_what_it_cannot_read():
    assert fix_bytes(b"nothing", ["actionFixer"]) == b"nothing"
    data = pdf_fixture.make("t", 0)
    assert fix_bytes(data, []) == fix_bytes(data, [])
    assert Document(fix_bytes(data, [])).open().path("Root", "Pages", "Count") == 1
    e = Editor(data)
    assert e.get(Ref(3, 0))["Type"] == "Page" and Ref(999, 0) not in e.objects
    ops = tokenize_content(b"q BI /W 1 ID abc\nEI (x\\)) Tj Q")
    assert [o for o, _ in tokenize_content(write_content(ops))] == ["q", "BI", "Tj", "Q"]


def test_stream_and_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in (0, 1):
        (folder / f"{k}.pdf").write_bytes(pdf_fixture.make("text", k))
    q = verify_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "strict_1b")
    q.awaitTermination(120)
    assert sorted(r.valid for r in spark.read.parquet(str(tmp_path / "out/results")).collect()) == [False, True]
    assert cli.main(["verify", str(folder)]) == 1
    said = capsys.readouterr().out
    assert "2 files, 1 valid, 1 issues" in said and "TrailerID: 1" in said


def _converted(change, faces=None):
    """Issues of a changed file after conversion with some faces, and the file."""
    o, t = pdf_fixture.base("a text")
    change(o, t)
    data = write_document(o, t)
    fixed = fix_bytes(data, ["fontSubstitutionFixer", "fontMetricFixer", "fontSubsetMetaFixer", "pagesTreeArrayFixer", "resourceDictPruneFixer"], faces=faces)
    rows = Walk(1, fixed).run()
    return [x["rule"] for r in rows for x in r["faults"]], Document(fixed).open()


FACE = build_sfnt([0, 500, 620, 700], {120: 1, 121: 2, 0xE9: 3})


def test_substitution_of_simple_fonts():
    def missing(o, t):
        o[9].pop("FontFile2")
        o[8].update(FirstChar=120, LastChar=121, Widths=[400, 400], BaseFont=Name("Helvetica"))
        o[7] = pdf_fixture.stream(b"BT /F0 9 Tf (xy) Tj ET")

    faults, doc = _converted(missing, {("sans", False, False): FACE})
    font = doc.path("Root", "Pages", "Kids", "0", "Resources", "Font", "F0")
    assert faults == [] and doc.resolve(font["FontDescriptor"])["FontFile2"] and font["Widths"] == [500, 620] and font["BaseFont"].endswith("+Helvetica") and font["Encoding"] == "WinAnsiEncoding"
    for faces in (None, {("mono", False, False): FACE}, {("sans", False, False): build_sfnt([0, 500], {120: 1})}):
        _, doc = _converted(missing, faces)
        assert "FontFile2" not in doc.path("Root", "Pages", "Kids", "0", "Resources", "Font", "F0", "FontDescriptor")

    def no_descriptor(o, t):
        o[8] = Dict(Type=Name("Font"), Subtype=Name("Type1"), BaseFont=Name("Helvetica"), Encoding=Dict(Differences=[1, Name("eacute")]))
        o[7] = pdf_fixture.stream(b"BT /F0 9 Tf <01> Tj ET")

    faults, doc = _converted(no_descriptor, {("sans", False, False): FACE})
    font = doc.path("Root", "Pages", "Kids", "0", "Resources", "Font", "F0")
    assert faults == [] and font["Subtype"] == "TrueType" and font["Widths"] == [700] and font["Encoding"]["Differences"] == [1, "eacute"]


def test_substitution_of_fonts_by_cid():
    def missing(o, t):
        pdf_fixture._type0(encoding=Name("Identity-H"))(o, t, "")
        o[9].pop("FontFile2")
        o[18]["W"] = [3, [400], 7, [400]]
        o[20] = pdf_fixture.stream(b"2 beginbfchar <0003> <0078> <0007> <00E9> endbfchar")
        o[8]["ToUnicode"] = Ref(20, 0)
        o[7] = pdf_fixture.stream(b"BT /F0 9 Tf <00030007> Tj ET")

    faults, doc = _converted(missing, {("sans", False, False): FACE})
    cid = doc.resolve(doc.path("Root", "Pages", "Kids", "0", "Resources", "Font", "F0", "DescendantFonts")[0])
    assert faults == [] and cid["W"] == [3, [500], 7, [700]]


def test_big_structures():
    def kids(o, t):
        for k in range(8200):
            o[100 + k] = Dict(Type=Name("Page"), Parent=Ref(2, 0), MediaBox=[0, 0, 9, 9])
        o[2].update(Kids=[Ref(100 + k, 0) for k in range(8200)], Count=8200)
        o[1]["StructTreeRoot"] = Dict(Type=Name("StructTreeRoot"), K=[0] * 9000)
        o[3]["StructParents"] = 1

    _, doc = _converted(kids)
    top = doc.path("Root", "Pages")
    assert len(top["Kids"]) == 3 and top["Count"] == 8200 and sum(doc.resolve(k)["Count"] for k in top["Kids"]) == 8200 and len(list(page_dicts(doc))) == 8200 and doc.path("Root", "StructTreeRoot") is None


def test_first_page_trailer():
    data = pdf_fixture.make("t", 0)
    first = b"%PDF-1.4\n9 0 obj\n<</Linearized 1>>\nendobj\nxref\n9 1\n0000000009 00000 n \ntrailer\n<</Root 1 0 R /Size 10 /ID [<0a> <0a>]>>\nstartxref\n0\n%%EOF\n"
    doc = Document(first + data).open()
    assert doc.first_page_trailer()["ID"][0] == b"0a" and doc.effective_trailer["ID"][0] == b"0a"
    assert Document(data).open().effective_trailer["ID"][0] == b"00ff" and Document(b"%PDF-").first_page_trailer() is None


def test_issue_counts_by_window(spark, tmp_path):
    from folioscan.streaming.files import issue_counts

    rows = [(1, "2024-01-01 10:05:00"), (1, "2024-01-01 10:50:00"), (2, "2024-01-01 10:10:00"), (1, "2024-01-01 11:10:00"), (1, "2024-01-01 14:00:00")]
    spark.createDataFrame(rows, "check_id int, t string").selectExpr("check_id", "to_timestamp(t) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("check_id int, ts timestamp").parquet(f"{tmp_path}/in")
    q = issue_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.check_id, str(r.window.start)[11:13]): r.n for r in spark.table("counts").collect()}
    assert got == {(1, "10"): 2, (2, "10"): 1, (1, "11"): 1}


def test_files_as_an_object(spark, tmp_path):
    from folioscan.files import Files

    n = {k: i for i, (k, _, _) in enumerate(pdf_fixture.DEFECTS)}
    wanted = ["none", "no_id", "model_rotate", "nothing"]
    data = spark.createDataFrame([(n[k], "a text") for k in wanted], "file_id bigint, text string")
    files = Files(pdf_fixture.make_files(data))
    flag = lambda df: {r.file_id: r.valid for r in df.collect()}
    assert flag(files.is_pdfa()) == {n["none"]: True, n["no_id"]: False, n["model_rotate"]: False, n["nothing"]: False}
    assert flag(files.is_pdf()) == flag(files.verify_object_model()[1]) == {n["none"]: True, n["no_id"]: True, n["model_rotate"]: False, n["nothing"]: True}
    said = [r.message for r in files.messages().collect() if r.file_id in (n["no_id"], n["model_rotate"])]
    assert sorted(said) == ["6.1.3/1 trailer id in the document", f"{check_by_name('ConstraintViolated').clause}/{check_by_name('ConstraintViolated').subclause} constraint violated on page 1"]
    assert {r.file_id for r in files.report().collect()} == {n[k] for k in wanted[1:]} and files.unread().count() == 0
    mended, results, _ = files.convert()
    assert flag(results) == {n["none"]: True, n["no_id"]: True, n["model_rotate"]: True, n["nothing"]: False}
    saved = {r.file_id: r.bytes for r in mended.save(f"file://{tmp_path}/out").collect()}
    again = Files.open(spark, f"{tmp_path}/out")
    assert len(saved) == 4 and {p.name for p in (tmp_path / "out").iterdir()} == {f"{n[k]}.pdf" for k in wanted} and again.is_pdfa().where("valid").count() == 3
    meta = {r.pages for r in again.page_counts().collect()}, {r.version for r in again.versions().collect()}, {(r.part, r.conformance) for r in again.claimed_conformance().collect()}
    assert meta == ({0, 1}, {"1.4", None}, {("1", "B"), (None, None)}) and again.xmp().where("xmp is not null").count() == 3 and again.metadata().count() == 4
    model, _, left = files.convert_object_model()
    assert left.count() == 0 and model.files.count() == 4


def test_conversion_writes_no_rows(spark, monkeypatch):
    """The rows of files, many times their number, are read by the rules as they come and not written first."""
    from folioscan.functions import pdf_fixture
    from folioscan.operators import convert as c

    names, real = [], c.written
    monkeypatch.setattr(c, "written", lambda df, name: names.append(name) or real(df, name))
    files = pdf_fixture.make_files(spark.createDataFrame([(k, f"text {k}") for k in range(12)], "file_id bigint, text string"))
    fixed, results, left = c.convert(files, "strict_1b")
    assert fixed.count() == results.count() == 12 and "files" in names and "nodes" not in names


def test_titles_keep_their_white_space():
    """Only spaces and line ends go from around a title, and only runs of ASCII white space become a space, as in SQL;
    the packet, whose texts are trimmed, still agrees with it."""
    from folioscan.functions import pdf_fixture
    from folioscan.operators.convert import fix_bytes, text_of
    from folioscan.sources.pdf import Walk

    for text, want in (("\tled by a tab", " led by a tab"), ("within\u00a0a title \n", "within\u00a0a title"), ("\u2003wide\t\tends\u3000", "\u2003wide ends\u3000")):
        for data in (made := pdf_fixture.make(text, 0), fix_bytes(made, [])):
            assert text_of(data) == want and not [f for r in Walk(1, data).run() for f in r["faults"]]
