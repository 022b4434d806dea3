"""The object model from tables: predicates, columns, links, and validation of files."""

import pytest

from folioscan.functions import pdf_fixture as fx
from folioscan.plans import conditions as c
from folioscan.plans import model_tsv as m
from folioscan.plans.catalog import check_by_name
from folioscan.sources.pdf import nodes
from folioscan.sources.pdf_bytes import Dict, Name

TABLES = {
    "FileTrailer": "Root dictionary TRUE TRUE [] [] [Catalog]|Size integer TRUE FALSE [] [] []|ID array FALSE FALSE [] [] [ArrayOfTwo]|Info dictionary FALSE TRUE [] [] [Info]",
    "Catalog": "Type name TRUE FALSE [Catalog] [] []|Pages dictionary TRUE TRUE [] [] [Pages]|PageMode name FALSE FALSE [UseNone,UseOutlines,fn:SinceVersion(1.6,UseAttachments)] [] []|Metadata stream FALSE fn:MustBeIndirect() [] [] []|OutputIntents array FALSE FALSE [] [] [Intents]",
    "Pages": "Type name TRUE FALSE [Pages] [] []|Kids array TRUE FALSE [] [] [Kids]|Count integer TRUE FALSE [fn:Eval(@Count>=0)] [] []",
    "Kids": "* dictionary FALSE TRUE [] [] [Page,Pages]",
    "Page": "Type name TRUE FALSE [Page] [] []|Rotate integer FALSE FALSE [] [fn:Eval((@Rotate_mod_90)==0)] []|MediaBox rectangle TRUE FALSE [] [] []|Annots array FALSE FALSE [] [] [Annots]|Parent dictionary TRUE TRUE [] [] [Pages]",
    "Annots": "* dictionary FALSE FALSE [] [] [AnnotSquare,AnnotText]",
    "AnnotSquare": "Subtype name TRUE FALSE [Square] [] []|Rect rectangle TRUE FALSE [] [] []|F bitmask FALSE FALSE [] [fn:Eval(fn:BitsClear(11,32))] []|BS dictionary fn:IsRequired(fn:IsPresent(Border)) FALSE [] [] []",
    "AnnotText": "Subtype name TRUE FALSE [Text] [] []|Rect rectangle TRUE FALSE [] [] []",
    "Intents": "* dictionary FALSE FALSE [] [] [Intent]",
    "Intent": "S name TRUE FALSE [] [] []|DestOutputProfile stream FALSE TRUE [] [] []|OutputConditionIdentifier string TRUE FALSE [] [] []",
    "ArrayOfTwo": "0 string TRUE FALSE [] [] []|1 string TRUE FALSE [] [] []",
    "Info": "Title string-text FALSE FALSE [] [] []|Trapped name FALSE FALSE [True,False] [] []",
}


def folder(path, tables=TABLES):
    for name, text in tables.items():
        lines = ["\t".join(m.COLUMNS)]
        for row in text.split("|"):
            key, kind, need, ref, values, special, link = (x.replace("_", " ") for x in row.split(" "))
            lines.append("\t".join([key, kind, "1.0", "", need, ref, "FALSE", "", "" if values == "[]" else values, "" if special == "[]" else special, "" if link == "[]" else link, ""]))
        (path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("text, want", [
    ("fn:SinceVersion(1.5)", False), ("fn:BeforeVersion(1.5)", True), ("fn:IsPDFVersion(1.4)", True), ("fn:SinceVersion(1.5,fn:IsPresent(A))", m.VACUOUS), ("fn:SinceVersion(1.3,fn:IsPresent(A))", c.present("A")), ("fn:Not(fn:SinceVersion(1.5))", True),
    ("fn:IsRequired(fn:IsPresent(A) && fn:Not(fn:IsPresent(B)))", c.both(c.present("A"), c.negate(c.present("B")))), ("fn:IsPresent(A) || fn:BeforeVersion(1.5)", True), ("fn:IsPresent(A) && fn:BeforeVersion(1.5)", c.present("A")), ("fn:IsPresent(A) || fn:SinceVersion(1.5)", c.present("A")),
    ("fn:Eval(@A==B)", c.eq("A", "B")), ("@A!='b c'", c.ne("A", "b c")), ("@A>=-1", c.order("A", ">=", -1.0)), ("5<@A", c.order("A", ">", 5.0)), ("@A<@B", c.order("A", "<", None, "B")), ("fn:ArrayLength(A)==2*@N", c.order("A", "==", None, "N", 2.0, 0.0, "length")),
    ("(@Rotate mod 90)==0", c.modulo("Rotate", 90, 0)), ("(fn:ArrayLength(D) mod 2)==0", c.modulo("D", 2, 0, "length")), ("fn:ArrayLength(W)==(1+(@L - @F))", c.Cond("==", "W", None, (), "L", 1.0, 1.0, "length", "value", "F")), ("fn:BitClear(3)", c.bits_clear("own", 3, 3)), ("fn:BitsSet(1,2)", c.bits_set("own", 1, 2)),
    ("fn:Contains(@F,DCT)", c.contains("F", "DCT")), ("fn:NotStandard14Font()", c.Cond("not_standard_14", "BaseFont")), ("fn:Extension(X)", c.Cond("unknown")), ("fn:IsPresent(parent::A)", m.UNKNOWN), ("fn:Nosuch(1)", m.UNKNOWN), ("@A >", m.UNKNOWN), ("", m.UNKNOWN), ("fn:IsPresent(A) && fn:Nosuch()", m.UNKNOWN), ("fn:SinceVersion(1.9) && fn:Nosuch()", False),
])
def test_predicates(text, want):
    assert m.predicate(text, 1.4, "own") == want


def test_columns(spark, tmp_path):
    assert m.possible_values("[A,fn:SinceVersion(1.5,B),fn:SinceVersion(1.2,C),'d']") == (["A", "C", "d"], [], False) and m.possible_values("[A,*]") == ([], [], False) and m.possible_values("") == ([], [], False)
    assert m.possible_values("[fn:RequiredValue(@A==1,X),Y]") == (["X", "Y"], [(c.order("A", "==", 1.0), "X")], False) and m.possible_values("[fn:Eval(@A>0)]")[2]
    assert m.special_case("[fn:Eval(@A>0)];[fn:Eval(@A>0)]", "A") == c.order("A", ">", 0.0) and m.special_case("[fn:Eval(@A>0)];[fn:Eval(@A>1)]", "A") is None and m.special_case("[fn:Eval(parent::@A>0)]", "A") is None
    row = dict.fromkeys(m.COLUMNS, "") | {"Key": "K", "Type": "name;fn:SinceVersion(1.5,stream)", "Required": "fn:IsRequired(fn:SinceVersion(1.5))", "IndirectReference": "fn:MustBeIndirect(fn:BeforeVersion(1.5))"}
    d = m.key_def(row)
    assert d.types == ("name",) and d.required is False and d.indirect
    model = m.read_model(folder(tmp_path))
    assert len(model.types) == 12 and model.named("Kids", "3").key == "*" and model.named("Page", "Other") is None
    assert model.discriminator(("Page", "Pages")) == ("Type", {"Page": "Page", "Pages": "Pages"}) and model.discriminator(("AnnotSquare", "AnnotText"))[0] == "Subtype"
    assert model.child("Kids", "0", "dict", {"Type": "Page"}) == "Page" and model.child("FileTrailer", "Root", "dict", {}) == "Catalog" and model.child("Page", "Own", "dict", {"Type": "Pages"}) == "Pages" and model.child("Page", "Own", "dict", {}) == ""
    assert model.pairs == {("Catalog", ""): "Catalog", ("Pages", ""): "Pages", ("Page", ""): "Page"}
    t = m.table_rows(spark, str(tmp_path))
    assert t.count() == sum(map(len, model.types.values())) and {r.om_type for r in t.select("om_type").distinct().collect()} == set(TABLES)
    (tmp_path / "Bad.tsv").write_text("Key\nK\n")
    with pytest.raises(ValueError):
        m.read_tables(str(tmp_path))


def test_validation(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir()
    new.mkdir()
    folder(old)
    model = m.read_model(str(old), folder(new, TABLES | {"Page": TABLES["Page"] + "|UserUnit number FALSE FALSE [] [] []"}))
    assert model.later == {"Page": frozenset({"UserUnit"})}
    changes = [
        ({}, []), ({1: {"PageMode": Name("Odd")}}, [("DisallowedValue", "Catalog", "PageMode")]), ({1: {"PageMode": Name("UseAttachments")}}, [("DisallowedValue", "Catalog", "PageMode")]), ({3: {"MediaBox": None}}, [("MissingRequiredKey", "Page", "MediaBox")]),
        ({3: {"Rotate": 45}}, [("ConstraintViolated", "Page", "Rotate")]), ({3: {"Rotate": Name("x")}}, [("WrongValueType", "Page", "Rotate")]), ({3: {"UserUnit": 2}}, [("KeyIntroducedAfterPDF14", "Page", "UserUnit")]), ({2: {"Count": -1}}, [("DisallowedValue", "Pages", "Count")]),
        ({12: {"F": 1 << 20}}, [("ConstraintViolated", "AnnotSquare", "F")]), ({12: {"Border": [0]}}, [("MissingRequiredKey", "AnnotSquare", "BS")]), ({2: {"Kids": [Dict(Type=Name("Page"))]}}, [("IndirectRequired", "Kids", "0"), ("MissingRequiredKey", "Page", "MediaBox"), ("MissingRequiredKey", "Page", "Parent")]),
        ({5: {"S": None}}, [("MissingRequiredKey", "Intent", "S")]), ({1: {"OutputIntents": [7]}}, [("WrongValueType", "Intents", "0")]),
    ]
    files = []
    for k, (change, _) in enumerate(changes):
        o, t = fx.base("text")
        for num, entries in change.items():
            for key, v in entries.items():
                o[num].pop(key, None) if v is None else o[num].__setitem__(key, v)
        files.append((k, fx.write_document(o, t)))
    files.append((99, b"nothing"))
    rows = nodes(spark.createDataFrame(files, "file_id bigint, content binary"), model)
    got = {}
    for r in m.validate_model(rows, model).collect():
        got.setdefault(r.file_id, []).append((r.check_id, r.om_type, r.om_key))
    for k, (_, want) in enumerate(changes):
        assert sorted(got.get(k, [])) == sorted((check_by_name(n).check_id, t, key) for n, t, key in want)
    assert 99 not in got and m.validate_model(rows.limit(0), model).count() == 0
