"""Catalog, conditions, results, graphs and repair; queries against DuckDB."""

import os
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioscan.operators import graph, results, schema
from folioscan.operators.fixpoint import repair
from folioscan.operators.rules import verify
from folioscan.plans import conditions as c
from folioscan.plans import program_queries, queries
from folioscan.plans.catalog import all_checks, check_by_clause, check_by_name, checks_for_clause, clause_key, full_profile, profiles

DATA = "/root/testdata/sf0.001"


def test_catalog():
    checks = all_checks()
    assert (len(checks), sum(x.live for x in checks), len({x.repair for x in checks} - {None}), sum(bool(x.repair) for x in checks)) == (157, 145, 34, 80)
    assert check_by_clause("6.1.3", 2) is check_by_name("TrailerEncrypt") and len(checks_for_clause("6.1.12")) == 10
    assert sorted(["6.2.10", "6.2", "6.2.9", "objmodel"], key=clause_key) == ["6.2", "6.2.9", "6.2.10", "objmodel"]


def test_profiles():
    p = profiles()
    assert [len(p[k].enabled) for k in ("pdf", "strict_1b", "a_1b")] == [6, 157, 154] and p["pdf"].only_object_model() and not p["a_1b"].only_object_model()
    q = p["pdf"].add("XFA").remove("WrongValueType")
    assert q.has("XFA") and not q.has("WrongValueType") and p["pdf"].has("WrongValueType") and not q.clear().enabled
    assert q.allows("no.such", 1) and not q.allows("6.1.3", 1)


def test_conditions(spark):
    rows = spark.createDataFrame([(1, 5.0, "A"), (2, None, "A"), (3, 5.0, None), (4, None, None)], "k int, n double, t string")
    fields = schema.column_fields({"N": (F.col("n"), "real"), "T": (F.col("t"), "name")})
    table = {
        "present": (c.present("N"), [True, False, True, False]), "eq": (c.eq("T", "A"), [True, True, False, False]), "ne": (c.ne("T", "A"), [False, False, True, True]),
        "less": (c.order("N", "<", 6), [True, None, True, None]), "eps": (c.order("N", ">=", 5.000001), [True, None, True, None]), "mod": (c.modulo("N", 4, 1), [True, None, True, None]),
        "bits": (c.bits_set("N", 1, 1), [True, None, True, None]), "clear": (c.bits_clear("N", 1, 1), [False, None, False, None]),
        "or": (c.either(c.order("N", "<", 6), c.eq("T", "A")), [True, True, True, None]), "and": (c.both(c.order("N", "<", 6), c.eq("T", "A")), [True, None, False, False]),
        "not": (c.negate(c.order("N", "<", 6)), [False, None, False, None]), "absent": (c.eq("Z", "A"), [False] * 4), "unknown": (c.Cond("unknown"), [None] * 4),
    }
    got = rows.select("k", *[c.compile_cond(x, fields).alias(k) for k, (x, _) in table.items()]).orderBy("k").collect()
    for k, (_, want) in table.items():
        assert [r[k] for r in got] == want, k
    assert schema.condition_bounds(c.both(c.order("N", ">=", 1), c.order("N", "<=", 9), c.order("N", ">=", 3))) == (3.0, 9.0)


def test_schema_findings(spark):
    rows = spark.createDataFrame([(1, 5, "A", 2.5), (2, None, "C", None)], "k int, i int, t string, r double")
    fields = schema.column_fields({"I": (F.col("i"), "int"), "T": (F.col("t"), "name"), "R": (F.col("r"), "real")})
    defs = [schema.KeyDef("I", ("integer",), required=c.eq("T", "C")), schema.KeyDef("T", ("name",), enum=("A", "B")), schema.KeyDef("R", ("integer",), value_cond=c.order("R", ">", 9), later=True)]
    names = {x.check_id: x.name for x in all_checks()}
    got = sorted((r.file_id, names[r.check_id], r.om_key) for r in schema.validate(rows, F.col("k"), "X", defs, fields).collect())
    assert got == [(1, "KeyIntroducedAfterPDF14", "R"), (1, "WrongValueType", "R"), (2, "DisallowedValue", "T"), (2, "MissingRequiredKey", "I")]


def test_closure_over_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (4, None)], "src bigint, dst bigint")
    got = sorted(tuple(r) for r in graph.closure(e, spark.createDataFrame([(1,)], "node bigint")).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert graph.multiset_equal(e, e.repartition(3)) and not graph.multiset_equal(e, e.limit(2))
    one = graph.last_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, rev int, v string"), ["k"], "rev")
    assert sorted(tuple(r) for r in one.select("k", "v").collect()) == [(1, "b"), (2, "c")]


def test_walks_go_on_to_the_fixpoint(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED_ROUNDS", 3)
    e = spark.createDataFrame([(k, "k", k + 1) for k in range(9)] + [(9, "k", 4)], "src bigint, key string, dst bigint")
    root = spark.createDataFrame([(0, "A")], "node bigint, type string")
    links = spark.createDataFrame([("A", "*", "A")], "type string, key string, child string")
    assert sorted(tuple(r) for r in graph.closure(e, root).collect()) == [(0, k, k) for k in range(10)]
    assert sorted(tuple(r) for r in graph.propagate(e, root, links).collect()) == [(k, "A") for k in range(10)]
    assert graph.closure(e, root, max_rounds=9).count() == graph.propagate(e, root, links, max_rounds=9).count() == 10
    for walk in (lambda: graph.closure(e, root, max_rounds=8), lambda: graph.propagate(e, root, links, max_rounds=8)):
        with pytest.raises(RuntimeError):  # and no partial result
            walk()


def test_pages_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(0, None, 0)] + [(k, k - 1, 0) for k in range(1, 71)] + [(100, 0, 1)], "node bigint, parent bigint, pos bigint")
    assert sorted(tuple(r) for r in graph.page_index(tree).collect()) == [(70, 1), (100, 2)]
    with pytest.raises(RuntimeError):
        graph.page_index(tree, max_depth=5)


def test_unused_fonts_and_forms_of_a_lenient_profile(spark):
    from folioscan.functions import pdf_fixture
    from folioscan.sources.pdf_bytes import Name, write_document

    def build(content):
        o, t = pdf_fixture.base("text")
        o[7] = pdf_fixture.stream(content)
        o[9].pop("FontFile2")
        o[14]["OPI"] = Name("x")
        return write_document(o, t)

    files = spark.createDataFrame([(1, build(b"q Q")), (2, build(b"/Fm0 Do BT /F0 9 Tf (x) Tj ET"))], "file_id bigint, content binary")
    names = {x.check_id: x.name for x in all_checks()}
    got = lambda p: sorted((r.file_id, names[r.check_id]) for r in verify(files, p)[0].collect())
    both = [(k, n) for k in (1, 2) for n in ("FormOPI", "SimpleNotEmbedded")]
    assert got("strict_1b") == both and got("a_1b") == both[2:]


def test_repair_stops(spark):
    state = spark.createDataFrame([(1, 0), (2, 2), (3, 9), (4, -1)], "file_id bigint, n int")  # 4 can't be mended
    evaluate = lambda s: s.where("n <> 0").select("file_id", F.explode(F.when(F.col("n") < 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("n")))).alias("check_id"))
    fixed, issues, rounds = repair(state, evaluate, lambda s, i: s.withColumn("n", F.when(F.col("n") > 0, F.col("n") - 1).otherwise(F.col("n"))))
    assert dict(tuple(r) for r in fixed.collect()) == {1: 0, 2: 0, 3: 5, 4: -1}
    assert dict(tuple(r) for r in rounds.collect()) == {1: 0, 2: 2, 3: 4, 4: 1}
    assert {r.file_id for r in issues.collect()} == {3, 4}


def test_pruned_profile_is_filtered_full_profile(spark):
    from folioscan.functions import pdf_fixture

    files = pdf_fixture.make_files(spark.createDataFrame([(k, "a text") for k in range(len(pdf_fixture.DEFECTS))] + [(1000, None)], "file_id bigint, text string"))
    whole, valid = verify(files, full_profile())
    lenient = profiles()["a_1b"].remove("TrailerID")
    plain = replace(lenient, skip_unreachable_forms=False, skip_unused_simple_fonts=False)
    part, _ = verify(files, plain)
    want = results.filter_by_profile(whole, plain)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    # the flags of the lenient profile pass over what a form that nothing shows breaks, and nothing else
    flagged, _ = verify(files, lenient)
    names_of = {k: n for k, (n, _, _) in enumerate(pdf_fixture.DEFECTS)}
    less = Counter(key(part)) - Counter(key(flagged))
    assert {names_of[k] for k, _, _ in less} == {"form_ref", "form_opi", "form_subtype2", "form_ps"} and not Counter(key(flagged)) - Counter(key(part))
    assert key(part) == key(want) and {r.file_id for r in valid.where("valid").collect()} == {k for k, (_, _, w) in enumerate(pdf_fixture.DEFECTS) if not w}
    names = {x.check_id: x.name for x in all_checks()}
    found = {}
    for r in whole.collect():
        found.setdefault(r.file_id, []).append(names[r.check_id])
    for k, (_, _, rules) in enumerate(pdf_fixture.DEFECTS):
        assert sorted(found.get(k, [])) == sorted(rules)
    broken = spark.createDataFrame([(1, b""), (2, b"%PDF-1.4\nnothing"), (3, None)], "file_id bigint, content binary")
    assert {r.file_id for r in verify(broken)[1].where("not valid").collect()} == {1, 2, 3}


SOME = ["profile_filter", "summary_report", "checks_natural_order", "violation_multiset_equal", "range_eps", "three_valued_and_or", "inherited_attribute", "page_index", "graphics_nesting_depth", "hex_repair", "date_pdf_to_iso", "function_stitching", "matrix_invert", "ascii85_roundtrip", "pdf_metadata"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", [*SOME, *program_queries.QUERIES])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    con.execute("SET TimeZone = 'UTC'")
    want = con.sql((queries.SQL | program_queries.SQL)[name])
    cols = sorted(want.columns)
    rows = lambda table: sorted(repr(tuple(r[k] for k in cols)) for r in table.to_pylist())
    got = (queries.QUERIES | program_queries.QUERIES)[name](spark, DATA).toArrow()
    assert sorted(got.column_names) == cols and rows(got) == rows(want.to_arrow_table()) != []
