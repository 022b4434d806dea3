"""Registered queries over what files carry: font programs, functions, colours, images, painted pages, the model from
tables. What is read was built from the rows of the tables, so SQL can say what must come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import ccitt, colour, decoders, fonts, pdf_generator, raster, scalars
from folioscan.functions import font_fixture as made
from folioscan.functions import pdf_fixture as fx
from folioscan.functions.pdf_functions import parse_function
from folioscan.operators import graph
from folioscan.operators.convert import convert
from folioscan.operators.results import issues_by_check
from folioscan.operators.rules import verify
from folioscan.plans.catalog import profiles
from folioscan.plans.queries import _N, _WANTED, _each_text, _files, _of, table
from folioscan.sources.content_usage import page_dicts
from folioscan.sources.pdf import nodes, spread
from folioscan.sources.pdf_bytes import Dict, Document, Name

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _ids(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _each(spark, sf_dir, one, kind: str = "string") -> DataFrame:
    """A function of doc_id, in batches."""

    @F.pandas_udf(kind)
    def run(k: pd.Series) -> pd.Series:
        return k.map(one)

    return _ids(spark, sf_dir).select("doc_id", run("doc_id").alias("found"))


def _width(k: int, g: int) -> int:
    return (k * 7 + g * 31) % 900 + 100


_W = "((doc_id * 7 + g * 31) % 900 + 100)"


@query(f"SELECT doc_id, string_agg(CASE WHEN g = 0 THEN '0' ELSE {_W}::VARCHAR END || CASE WHEN g = 3 THEN '-' ELSE '+' END, ' ' ORDER BY g) AS found FROM documents, range(0, 5) AS t(g) GROUP BY doc_id")
def font_true_type_advances(spark, sf_dir):
    """The advance of each glyph, and whether it is there: glyph 0 has no width, glyph 3 no outline."""

    def one(k: int) -> str:
        t = fonts.sfnt(made.build_sfnt([0, *(_width(k, g) for g in range(1, 5))], {65: 1}, empty=(0, 3)))
        return " ".join(f"{fonts.advance(t, g)}{'+' if fonts.present(t, g) else '-'}" for g in range(fonts.glyph_count(t)))

    return _each(spark, sf_dir, one)


@query("SELECT doc_id, string_agg((65 + (doc_id * 3 + g) % 40) || ':' || (g + 1), ' ' ORDER BY (doc_id * 3 + g) % 40) AS found FROM documents, range(0, 4) AS t(g) GROUP BY doc_id")
def font_character_maps(spark, sf_dir):
    """The codes of character maps of formats 0, 4 and 6."""

    def one(k: int) -> str:
        codes = {65 + (k * 3 + g) % 40: g + 1 for g in range(4)}
        t = fonts.sfnt(made.build_sfnt([0] * 5, codes, form=(0, 4, 6)[k % 3]))
        return " ".join(f"{c}:{g}" for c, g in sorted(fonts.code_map(fonts.cmaps(t)[3, 1]).items()))

    return _each(spark, sf_dir, one)


@query(f"SELECT doc_id, string_agg(['A', 'own', 'zcaron', 'Euro'][g] || '=' || {_W}, ' ' ORDER BY g) AS found FROM documents, range(1, 5) AS t(g) GROUP BY doc_id")
def font_compact_widths(spark, sf_dir):
    """Names and advances of a compact font, from its charstrings."""
    names = ["A", "own", "zcaron", "Euro"]
    return _each(spark, sf_dir, lambda k: " ".join(f"{n}={w}" for n, w in fonts.cff_widths(fonts.cff(made.build_cff(names, [_width(k, g) for g in range(1, 5)]))).items()))


@query(f"SELECT doc_id, '0=500 ' || string_agg((g * 10 + doc_id % 10) || '=' || {_W}, ' ' ORDER BY g) AS found FROM documents, range(1, 5) AS t(g) GROUP BY doc_id")
def font_compact_cid_widths(spark, sf_dir):
    """CIDs and advances of a compact font by CID, with its selection of dictionaries."""
    return _each(spark, sf_dir, lambda k: " ".join(f"{c}={w}" for c, w in fonts.cff_widths(fonts.cff(made.build_cff([], [_width(k, g) for g in range(1, 5)], [g * 10 + k % 10 for g in range(1, 5)]))).items()))


@query(f"SELECT doc_id, string_agg(['A', 'b', 'own'][g] || '=' || {_W}, ' ' ORDER BY g) || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'own' END AS found FROM documents, range(1, 4) AS t(g) GROUP BY doc_id")
def font_type1_widths(spark, sf_dir):
    """Advances of a Type 1 program, encrypted in bytes or digits, and what its encoding has at 65."""

    def one(k: int) -> str:
        p = fonts.type1(made.build_type1({n: _width(k, g) for g, n in enumerate(("A", "b", "own"), 1)}, None if k % 3 == 0 else {65: "own"}, hexadecimal=k % 2 == 0))
        return " ".join(f"{n}={w}" for n, w in fonts.type1_widths(p).items()) + " " + p.encoding[65]

    return _each(spark, sf_dir, one)


@query(f"SELECT doc_id, '{'{'}' || (doc_id % 50 + 10)::VARCHAR || ',' || (doc_id % 50 + 10)::VARCHAR || '{'}'} 1 4' AS found FROM documents")
def font_outlines(spark, sf_dir):
    """The size of a glyph's outline, how many contours it has, and how many corners."""

    def one(k: int) -> str:
        size = k % 50 + 10
        c = (
            fonts.true_type_outline(fonts.sfnt(made.build_sfnt([0, 500], {65: 1}, sizes=[0, size])), 1), fonts.cff_outline(fonts.cff(made.build_cff(["A"], [500], size=size)), 1),
            fonts.type1_outline(fonts.type1(made.build_type1({"A": 500}, size=size)), "A"),
        )[k % 3]
        points = list(dict.fromkeys((round(x), round(y)) for x, y in c[0]))
        return f"{{{max(x for x, _ in points)},{max(y for _, y in points)}}} {len(c)} {len(points)}"

    return _each(spark, sf_dir, one)


@query("SELECT doc_id, md5(text) AS found FROM documents")
def font_decryption(spark, sf_dir):
    """The whole text, encrypted as a font's private part is, comes back."""

    back = lambda x: None if x is None else fonts.decrypt(made.encrypt(x.encode(), 55665), 55665).decode()
    return _each_text(spark, sf_dir, back, "found").select("doc_id", F.md5("found").alias("found"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^ -~]', '', 'g')) AS found FROM documents")
def font_codes_to_unicode(spark, sf_dir):
    """The printable part of the whole text, as codes of WinAnsiEncoding, by the names of its glyphs."""
    to = fonts.code_to_unicode("WinAnsiEncoding")

    @F.pandas_udf("string")
    def decode(t: pd.Series) -> pd.Series:
        return t.map(lambda x: "".join(chr(to[c]) for c in x.encode("latin-1")))

    printable = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decode(printable)).alias("found"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity::INT)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def font_cid_width_pairs(spark, sf_dir):
    """Arrays of widths by CID, of an order's quantities in both forms."""

    @F.pandas_udf("n bigint, total bigint")
    def read(w: pd.Series) -> pd.DataFrame:
        found = []
        for x in w:
            v = [int(q) for q in x]
            pairs = fonts.cid_widths([1, v[:-1], len(v), len(v), v[-1]])
            found.append((len(pairs), sum(n for _, n in pairs)))
        return pd.DataFrame(found, columns=["n", "total"])

    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("w"))
    return g.withColumn("r", read("w")).select("l_orderkey", "r.n", "r.total")


@query("SELECT p_partkey, p_name IN ('Courier', 'Helvetica-Bold') OR p_partkey % 5 = 0 AS standard FROM part")
def font_standard_14(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.element_at(F.array(*map(F.lit, sorted(fonts.STANDARD_14))), (F.col("p_partkey") % 14 + 1).cast("int"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.isin(*sorted(fonts.STANDARD_14)).alias("standard"))


# functions and colours, of numbers of the line items


def _lines(spark, sf_dir, kind: str, run) -> DataFrame:
    f = F.pandas_udf(run, kind)
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    return table(spark, sf_dir, "lineitem").select(row, f("l_discount", "l_tax", "l_quantity").alias("r"))


_ROW = "l_orderkey * 10 + l_linenumber AS row_id"


@query(f"SELECT {_ROW}, round(CASE WHEN x < 1 THEN 100 * x WHEN x < 2 THEN 100 - 50 * (x - 1) ELSE 50 + 150 * (x - 2) END, 6) AS y FROM (SELECT *, least(l_discount * 10, 1) * 3 AS x FROM lineitem)")
def function_sampled(spark, sf_dir):
    f = fx.stream(bytes([0, 100, 50, 200]), FunctionType=0, Domain=[0, 1], Range=[0, 255], Size=[4], BitsPerSample=8)

    def run(d: pd.Series, t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(parse_function(f)(d.to_numpy()[:, None] * 10)[:, 0])

    return _lines(spark, sf_dir, "double", run).select("row_id", F.round("r", 6).alias("y"))


@query(f"SELECT {_ROW}, round(CASE WHEN l_discount * 10 > l_tax * 10 THEN l_discount * 10 - l_tax * 10 ELSE sqrt(l_discount * 10 * (l_tax * 10)) END + l_quantity::INT % 7, 6) AS y FROM lineitem")
def function_calculator(spark, sf_dir):
    f = fx.stream(b"{ cvi 7 mod 3 1 roll 2 copy gt { sub } { mul sqrt } ifelse add }", FunctionType=4, Domain=[0, 1, 0, 1, 0, 100], Range=[0, 100])

    def run(d: pd.Series, t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(parse_function(f)(np.stack([d * 10, t * 10, q], axis=1))[:, 0])

    return _lines(spark, sf_dir, "double", run).select("row_id", F.round("r", 6).alias("y"))


@query(f"SELECT {_ROW}, round(1 - least(1, l_discount * 5 + l_tax), 5) AS red, round(1 - least(1, l_tax), 5) AS green FROM lineitem")
def colour_separation(spark, sf_dir):
    """A tint through a space of a spot colour into red and green, by its function and its alternate."""
    tint = Dict(FunctionType=2, Domain=[0, 1], C0=[0, 0, 0, 0], C1=[0.5, 0, 0, 0], N=1)
    cs = [Name("DeviceN"), [Name("Spot"), Name("Black")], Name("DeviceCMYK"), fx.stream(b"{ exch 0.5 mul exch 0 exch 0 exch }", FunctionType=4, Domain=[0, 1, 0, 1], Range=[0, 1] * 4)]
    assert colour.components(cs) == 2 and parse_function(tint)(np.array([[1.0]]))[0, 0] == 0.5

    def run(d: pd.Series, t: pd.Series, q: pd.Series) -> pd.DataFrame:
        rgb = colour.to_rgb(cs, np.stack([d * 10, t], axis=1))
        return pd.DataFrame({"red": rgb[:, 0], "green": rgb[:, 1]})

    return _lines(spark, sf_dir, "red double, green double", run).select("row_id", F.round("r.red", 5).alias("red"), F.round("r.green", 5).alias("green"))


_FI = "CASE WHEN {0} > 6.0 / 29 THEN power({0}, 3) ELSE 3 * power(6.0 / 29, 2) * ({0} - 4.0 / 29) END"
_GAMMA = "CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * power({0}, 1 / 2.4) - 0.055 END"


@query(f"""WITH l AS (SELECT {_ROW}, l_quantity * 2.0::DOUBLE AS L, l_discount * 400 - 20 AS a, l_tax * 400 - 20 AS b FROM lineitem), f AS (SELECT row_id, (L + 16) / 116 AS fy, (L + 16) / 116 + a / 500 AS fx, (L + 16) / 116 - b / 200 AS fz FROM l),
x AS (SELECT row_id, 0.9642 * ({_FI.format('fx')}) AS x, {_FI.format('fy')} AS y, 0.8249 * ({_FI.format('fz')}) AS z FROM f),
r AS (SELECT row_id, greatest(0, least(1, 3.1338561 * x - 0.4906146 * z - 1.6168667 * y)) AS r, greatest(0, least(1, 1.4052427 * z + 0.0719453 * x - 0.2289914 * y)) AS b FROM x)
SELECT row_id, round({_GAMMA.format('r')}, 4) AS red, round({_GAMMA.format('b')}, 4) AS blue FROM r""")
def colour_lab(spark, sf_dir):
    def run(d: pd.Series, t: pd.Series, q: pd.Series) -> pd.DataFrame:
        rgb = colour.to_rgb([Name("Lab"), Dict()], np.stack([q * 2, d * 400 - 20, t * 400 - 20], axis=1))
        return pd.DataFrame({"red": rgb[:, 0], "blue": rgb[:, 2]})

    return _lines(spark, sf_dir, "red double, blue double", run).select("row_id", F.round("r.red", 4).alias("red"), F.round("r.blue", 4).alias("blue"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def facsimile_roundtrip(spark, sf_dir):
    """Names as rows of bits, in the codes of group 4 or 3 and back."""

    @F.pandas_udf("string")
    def trip(k: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for key, name in zip(k, names):
            raw = name.encode()
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(raw), 8)
            lines = [[int(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], row])))] for row in bits]
            group4 = key % 2 == 0
            out.append(ccitt.decode_ccitt(ccitt.encode_ccitt(lines, 8, group4), -1 if group4 else 0, 8, len(lines), black_is_1=True).decode())
        return pd.Series(out)

    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", trip("c_custkey", "c_name").alias("name"))


# painted pages


@query("SELECT doc_id, ((doc_id % 30 + 5) * (doc_id % 20 + 5) + (doc_id % 7 + 1) * (doc_id % 7 + 1) * 4)::VARCHAR AS found FROM documents")
def page_ink(spark, sf_dir):
    """The dark pixels of a page with a rectangle and a scaled square in a clip."""

    def one(k: int) -> str:
        o, t = fx.base("text")
        s = k % 7 + 1
        o[7] = fx.stream(b"0 g 2 2 %d %d re f q 60 60 %d %d re W n 2 0 0 2 60 60 cm 0 0 30 30 re f Q" % (k % 30 + 5, k % 20 + 5, 2 * s, 2 * s))
        doc = Document(fx.write_document(o, t)).open()
        pixels, _ = raster.render_page(doc, *next(page_dicts(doc)))
        return str(int((pixels == 0).all(axis=2).sum()))

    return _each(spark, sf_dir, one)


@query("SELECT doc_id, (256 + doc_id % 200 * 16)::VARCHAR AS found FROM documents")
def page_text_and_image(spark, sf_dir):
    """The darkness of a page with a glyph of 16 by 16 pixels and an image of one gray, in levels of a pixel."""

    def one(k: int) -> str:
        o, t = fx.base("text")
        o[11] = fx.stream(bytes([255 - k % 200]), **{**o[11], "ColorSpace": Name("DeviceGray")})
        o[7] = fx.stream(b"q 4 0 0 4 50 50 cm /Im0 Do Q BT /F0 32 Tf 8 8 Td (x) Tj ET")
        doc = Document(fx.write_document(o, t)).open()
        pixels, _ = raster.render_page(doc, *next(page_dicts(doc)))
        dark = 255 - pixels[:, :, 0].astype(int)
        return str(int((dark[:, :50] == 255).sum() + dark[:50, 50:].sum()))

    return _each(spark, sf_dir, one)


#: Defects that neither a fixer nor painting mends: text without glyphs, a map that no painting shows, and no file at all.
_UNPAINTED = "font_program font_missing symbolic_cmap font_shown cid_glyph cid_compact_glyph nothing".split()


@query(f"SELECT doc_id AS file_id, check_id, n::BIGINT AS n FROM documents JOIN {_WANTED} ON doc_id % {_N} = defect WHERE {_of(*_UNPAINTED)}")
def pdf_convert_raster(spark, sf_dir):
    return issues_by_check(convert(_files(spark, sf_dir), "strict_1b", raster=True)[2])


#: Defects of a form that no content shows, which the lenient profile passes over.
_UNREACHED = "form_ref form_opi form_subtype2 form_ps".split()
_OFF = sorted(set(range(1, 158)) - set(profiles()["a_1b"].enabled))


@query(f"SELECT doc_id AS file_id, coalesce(sum(n) FILTER (check_id NOT IN ({', '.join(map(str, _OFF))})), 0)::BIGINT AS n_issues FROM documents LEFT JOIN {_WANTED} ON doc_id % {_N} = defect AND NOT {_of(*_UNREACHED)} GROUP BY doc_id")
def pdf_verify_lenient(spark, sf_dir):
    return verify(_files(spark, sf_dir), "a_1b", reread=False)[1].select("file_id", F.col("n_issues").cast("bigint").alias("n_issues"))


@query("SELECT doc_id, string_agg(c || ':' || u, ' ' ORDER BY c) AS found FROM (SELECT doc_id, doc_id % 90 + i AS c, 65 + (doc_id + i) % 50 AS u FROM documents, range(0, 4) AS t(i)) GROUP BY doc_id")
def font_to_unicode(spark, sf_dir):
    """Maps of codes to characters, by single codes, by a range, or by a range of an array."""

    def one(k: int) -> str:
        pairs = [(k % 90 + i, 65 + (k + i) % 50) for i in range(4)]
        body = "".join(f"<{c:02x}> <{u:04x}>" for c, u in pairs)
        text = f"4 beginbfchar {body} endbfchar" if k % 2 else f"1 beginbfrange <{pairs[0][0]:02x}> <{pairs[-1][0]:02x}> [{' '.join(f'<{u:04x}>' for _, u in pairs)}] endbfrange"
        return " ".join(f"{c}:{u}" for c, u in sorted(fonts.to_unicode_map(text.encode()).items()))

    return _each(spark, sf_dir, one)


@query(f"SELECT doc_id, '3 glyphs, ' || string_agg((64 + g) || '=' || {_W}, ' ' ORDER BY g) AS found FROM documents, range(1, 5) AS t(g) WHERE g IN (doc_id % 4 + 1, (doc_id + 1) % 4 + 1) GROUP BY doc_id")
def font_subsets(spark, sf_dir):
    """The subset of a font of four glyphs by two of its characters."""

    def one(k: int) -> str:
        data, own = fonts.subset_true_type(made.build_sfnt([0, *(_width(k, g) for g in range(1, 5))], {64 + g: g for g in range(1, 5)}), [65 + k % 4, 65 + (k + 1) % 4])
        t = fonts.sfnt(data)
        return f"{fonts.glyph_count(t)} glyphs, " + " ".join(f"{c}={fonts.advance(t, g)}" for c, g in sorted(own.items()))

    return _each(spark, sf_dir, one)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE [c_acctbal, c_nationkey::DOUBLE] END AS v, c_custkey % 4 > 0 AS whole FROM customer")
def scalar_number_arrays(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    last = F.when(F.col("c_custkey") % 4 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", scalars.float_array(F.array(F.col("c_acctbal").cast("string"), last)).alias("v"), scalars.is_integer(last).alias("whole"))


@query("SELECT p_partkey, p_size::DOUBLE AS size, ['0.5 g', p_size || ' 0 1 rg'] AS colours FROM part")
def scalar_default_appearance(spark, sf_dir):
    text = F.format_string("/Helv %d Tf 0.5 g /%s %d Tf %d 0 1 rg", F.col("p_size") + 1, F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), "p_size", "p_size")
    size, colours = scalars.default_appearance(text)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), colours.alias("colours"))


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderkey) AS slots FROM orders GROUP BY o_custkey")
def parent_slots(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("dst"))
    text = F.array_join(F.transform("slots", lambda s: F.concat(s.src.cast("string"), F.lit(":"), s.key)), " ")
    return graph.parent_slots(e).select(F.col("dst").alias("o_custkey"), text.alias("slots"))


@query("SELECT doc_id, md5(text) AS found FROM documents")
def deflated_rows(spark, sf_dir):
    """The whole text, deflated in rows and in one, at both levels, comes back."""

    def trip(x: str | None) -> str | None:
        if x is None:
            return None
        raw = x.encode()
        ways = [decoders.deflate_rows(raw[k : k + 100] for k in range(0, len(raw), 100)), decoders.deflate(raw), decoders.deflate(raw, fast=True)]
        back = {decoders.inflate(w) for w in ways}
        return back.pop().decode() if len(back) == 1 else ""

    return _each_text(spark, sf_dir, trip, "found").select("doc_id", F.md5("found").alias("found"))


@query("SELECT doc_id AS file_id, 1::BIGINT AS files FROM documents")
def generated_files(spark, sf_dir):
    """A broken file for each number: each is read, or has its fault."""
    numbers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    rows = nodes(pdf_generator.build_files(spread(numbers)))
    return rows.where("kind = 'file'").groupBy("file_id").agg(F.count(F.lit(1)).alias("files"))
