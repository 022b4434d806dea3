"""The registered queries: each applies operators to the given tables and has the same question in SQL where SQL can
ask it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import pdf_fixture, scalars
from folioscan.operators import graph, results, schema, usage
from folioscan.operators.convert import convert, text_of
from folioscan.operators.fixpoint import repair
from folioscan.operators.rules import OPERATORS, verify
from folioscan.plans import conditions as c
from folioscan.plans.catalog import all_checks, check_by_name, checks_frame, clause_key, profiles
from folioscan.sources.pdf import content_texts, files_meta, slices, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cid(name: str) -> int:
    return check_by_name(name).check_id


# issues over the line items: rules of the catalog, with predicates of their own here

RULES = {
    "IntegerOutOfRange": ("l_quantity > 45", lambda: F.col("l_quantity") > 45),
    "RealOutOfRange": ("l_extendedprice > 80000", lambda: F.col("l_extendedprice") > 80000),
    "StringTooLong": ("l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax > 0.07", lambda: (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.07)),
    "FormPostScript": ("l_discount > 0.095", lambda: F.col("l_discount") > 0.095),
    "ImageInterpolate": ("l_suppkey % 17 = 3", lambda: F.col("l_suppkey") % 17 == 3),
    "MissingRequiredKey": ("l_partkey % 23 = 5 AND l_linenumber > 3", lambda: (F.col("l_partkey") % 23 == 5) & (F.col("l_linenumber") > 3)),
    "TrailerEOF": ("l_linenumber = 7", lambda: F.col("l_linenumber") == 7),
}
ISSUES = "(" + " UNION ALL ".join(f"SELECT l_orderkey AS file_id, {cid(k)} AS check_id, l_linenumber AS page FROM lineitem WHERE {p}" for k, (p, _) in RULES.items()) + ")"
_USED = [check_by_name(k) for k in RULES]
CATALOG = "(VALUES " + ", ".join(f"({x.check_id}, '{x.name}', '{x.clause}', {x.subclause}, {sorted(_USED, key=lambda y: (clause_key(y.clause), y.subclause)).index(x)}, {'true' if x.repair else 'false'})" for x in _USED) + ") AS k(check_id, name, clause, subclause, natural_order, fixable)"


def lane_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return results.to_issues(d, F.col("l_orderkey"), {k: p() for k, (_, p) in RULES.items()}, F.col("l_linenumber"))


def _off(profile: str) -> str:
    p = profiles()[profile]
    return ", ".join(str(x.check_id) for x in all_checks() if x.check_id not in p.enabled)


@query(f"SELECT check_id, count(*) AS n FROM {ISSUES} WHERE check_id NOT IN ({_off('a_1b')}) GROUP BY check_id")
def profile_filter(spark, sf_dir):
    return results.filter_by_profile(lane_issues(spark, sf_dir), profiles()["a_1b"]).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT check_id, count(*) AS n FROM {ISSUES} WHERE check_id IN ({cid('TrailerEOF')}, {cid('ImageInterpolate')}) GROUP BY check_id")
def profile_add_remove(spark, sf_dir):
    p = profiles()["a_1b"].clear().add("TrailerEOF", "ImageInterpolate", "FormPostScript").remove("FormPostScript")
    return results.filter_by_profile(lane_issues(spark, sf_dir), p).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file_id, page FROM {ISSUES} WHERE check_id = {cid('MissingRequiredKey')}")
def profile_object_model_only(spark, sf_dir):
    return results.filter_by_profile(lane_issues(spark, sf_dir), profiles()["pdf"]).select("file_id", "page")


@query(f"SELECT file_id, check_id, count(*) AS n FROM {ISSUES} GROUP BY ALL")
def issues_by_check(spark, sf_dir):
    return results.issues_by_check(lane_issues(spark, sf_dir))


@query(f"SELECT file_id, check_id FROM {ISSUES} WHERE page = 2")
def issues_on_page(spark, sf_dir):
    return results.issues_on_page(lane_issues(spark, sf_dir), 2).select("file_id", "check_id")


@query(f"SELECT file_id, page FROM {ISSUES} WHERE check_id = {cid('RealOutOfRange')}")
def issues_for_check(spark, sf_dir):
    return results.issues_for_check(lane_issues(spark, sf_dir), cid("RealOutOfRange")).select("file_id", "page")


@query(f"SELECT o_orderkey AS file_id, count(i.check_id) = 0 AS valid, count(i.check_id) AS n_issues FROM orders LEFT JOIN {ISSUES} i ON o_orderkey = i.file_id GROUP BY o_orderkey")
def batch_results(spark, sf_dir):
    return results.results(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id")), lane_issues(spark, sf_dir))


@query(f"""SELECT file_id, string_agg(clause || '/' || subclause || ' ' || name || ': ' || n, chr(10) ORDER BY natural_order) AS report
FROM (SELECT file_id, check_id, count(*) AS n FROM {ISSUES} GROUP BY ALL) JOIN {CATALOG} USING (check_id) GROUP BY file_id""")
def summary_report(spark, sf_dir):
    return results.summary(lane_issues(spark, sf_dir))


_HEADS = "(VALUES " + ", ".join(f"({x.check_id}, '{x.clause}/{x.subclause} {x.description}')" for x in _USED) + ") AS h(check_id, head)"


@query(f"SELECT file_id, head || CASE WHEN page > 0 THEN ' on page ' || page ELSE ' in the document' END AS message FROM {ISSUES} JOIN {_HEADS} USING (check_id)")
def issue_messages(spark, sf_dir):
    return results.messages(lane_issues(spark, sf_dir))


@query(f"SELECT file_id, check_id, row_number() OVER (PARTITION BY file_id ORDER BY natural_order) AS rank FROM (SELECT DISTINCT file_id, check_id FROM {ISSUES}) JOIN {CATALOG} USING (check_id)")
def checks_natural_order(spark, sf_dir):
    return results.distinct_checks(lane_issues(spark, sf_dir)).select("file_id", "check_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT file_id, check_id, row_number() OVER (PARTITION BY file_id ORDER BY clause, subclause) AS rank FROM (SELECT DISTINCT file_id, check_id FROM {ISSUES}) JOIN {CATALOG} USING (check_id)")
def checks_lexicographic_order(spark, sf_dir):
    return results.lexicographic_checks(lane_issues(spark, sf_dir)).select("file_id", "check_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT file_id, string_agg(check_id || ':' || n, ',' ORDER BY check_id) AS signature FROM (SELECT file_id, check_id, count(*) AS n FROM {ISSUES} GROUP BY ALL) GROUP BY file_id")
def violation_counts(spark, sf_dir):
    return results.violation_counts(lane_issues(spark, sf_dir))


@query(f"""WITH a AS (SELECT file_id, string_agg(check_id || ':' || n, ',' ORDER BY check_id) AS s FROM (SELECT file_id, check_id, count(*) AS n FROM {ISSUES} GROUP BY ALL) GROUP BY file_id),
b AS (SELECT file_id, string_agg(check_id || ':' || n, ',' ORDER BY check_id) AS s FROM (SELECT file_id, check_id, count(*) AS n FROM {ISSUES} WHERE page <> 4 GROUP BY ALL) GROUP BY file_id)
SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.s, '') = coalesce(b.s, '') AS same FROM a FULL JOIN b USING (file_id)""")
def violation_multiset_equal(spark, sf_dir):
    i = lane_issues(spark, sf_dir)
    return results.same_multiset(i, i.where("page <> 4"))


@query(f"SELECT file_id, bool_or(fixable) AS fixable FROM {ISSUES} JOIN {CATALOG} USING (check_id) GROUP BY file_id")
def fixable_issues(spark, sf_dir):
    return results.has_fixable(lane_issues(spark, sf_dir))


@query(f"SELECT emit_part, count(*) AS n FROM (SELECT 0 AS emit_part FROM {ISSUES} WHERE page <= 2 UNION ALL SELECT 1 FROM {ISSUES} WHERE page > 2) GROUP BY emit_part")
def issue_parts_concat(spark, sf_dir):
    i = lane_issues(spark, sf_dir)
    return results.ordered_concat(i.where("page <= 2"), i.where("page > 2")).groupBy("emit_part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey % 7 AS supp, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_quantity > 45 GROUP BY ALL")
def first_failure_only(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select((F.col("l_suppkey") % 7).alias("supp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return results.first_failures(d, ["supp"], "at").select("supp", F.col("at").alias("first"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({x.check_id}, '{x.name}', '{x.clause}', {x.subclause}, {'true' if x.live else 'false'})" for x in all_checks()) + ") AS t(check_id, name, clause, subclause, live)")
def catalog(spark, sf_dir):
    return checks_frame(spark).select("check_id", "name", "clause", "subclause", "live")


@query("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 6 > 4 THEN 4 ELSE o_orderkey % 6 END AS rounds, greatest(o_orderkey % 6 - 4, 0) AS residual FROM orders""")
def fixpoint_repair_rounds(spark, sf_dir):
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 6).alias("faults"))
    evaluate = lambda s: s.where("faults > 0").select("file_id", F.explode(F.sequence(F.lit(1), F.col("faults").cast("int"))).alias("check_id"))
    fixed, _, rounds = repair(state, evaluate, lambda s, i: s.withColumn("faults", F.greatest(F.col("faults") - 1, F.lit(0))))
    return fixed.join(rounds, "file_id").select("file_id", F.col("rounds").cast("bigint").alias("rounds"), F.col("faults").alias("residual"))


# the schema engine over flat tables


def _part_fields():
    return schema.column_fields({"Size": (F.col("p_size"), "int"), "Price": (F.col("p_retailprice"), "real"), "Brand": (F.col("p_brand"), "name"), "Type": (F.nullif(F.col("p_type"), F.lit("")), "name"), "Name": (F.col("p_name"), "str")})


def _part(spark, sf_dir, *defs):
    return schema.validate(table(spark, sf_dir, "part"), F.col("p_partkey"), "Part", list(defs), _part_fields())


def _line_fields():
    x = F.col
    return schema.column_fields({
        "Quantity": (x("l_quantity"), "real"), "Line": (x("l_linenumber"), "int"), "Flag": (x("l_returnflag"), "name"), "Status": (x("l_linestatus"), "name"), "Tax": (x("l_tax"), "real"),
        "Supp": (x("l_suppkey"), "int"), "Part": (x("l_partkey"), "int"), "Odd": (F.when(x("l_linenumber") % 2 == 1, x("l_quantity")), "real"), "Price": (x("l_extendedprice"), "real"),
    })


def _line(spark, sf_dir, *defs):
    d = schema.validate(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), "Line", list(defs), _line_fields())
    return d.select("file_id", "check_id", "om_key")


def _line_sql(where: str, rule: str, key: str) -> str:
    return f"SELECT l_orderkey * 10 + l_linenumber AS file_id, {cid(rule)} AS check_id, '{key}' AS om_key FROM lineitem WHERE {where}"


@query(_line_sql("l_linenumber % 2 = 0", "MissingRequiredKey", "Odd"))
def required_key_missing(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Odd", required=True), schema.KeyDef("Quantity", required=True))


@query(_line_sql("TRUE", "WrongValueType", "Quantity"))
def wrong_value_type(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Quantity", types=("integer",), enum=("1",)), schema.KeyDef("Line", types=("number",)))


@query(_line_sql("l_returnflag NOT IN ('A', 'R')", "DisallowedValue", "Flag"))
def enum_disallowed(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Flag", types=("name",), enum=("A", "R")))


@query(_line_sql("NOT (l_quantity >= 3 - 0.00001 AND l_tax <= 0.05 + 0.00001)", "DisallowedValue", "Quantity"))
def range_eps(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Quantity", types=("number",), value_cond=c.both(c.order("Quantity", ">=", 3), c.order("Tax", "<=", 0.05))))


@query(_line_sql("l_returnflag = 'R' AND l_linestatus <> 'F'", "DisallowedValue", "Status") + " UNION ALL " + _line_sql("l_returnflag = 'N' AND l_linestatus <> 'O'", "DisallowedValue", "Status"))
def pinned_value(spark, sf_dir):
    pin = lambda flag, status: c.either(c.ne("Flag", flag), c.eq("Status", status))
    return _line(spark, sf_dir, schema.KeyDef("Status", value_cond=c.both(pin("R", "F"), pin("N", "O"))))


@query(_line_sql("l_linenumber % 2 = 0 AND l_returnflag = 'R'", "MissingRequiredKey", "Odd"))
def conditional_required(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Odd", required=c.eq("Flag", "R")))


@query("SELECT p_partkey AS file_id, '%s' AS om_key FROM part WHERE length(p_name) <> 4 + 2 * length(p_brand)" % "Name")
def coupled_array_length(spark, sf_dir):
    fields = _part_fields()
    both = lambda k: schema.Field(*[getattr(fields(k), x) for x in ("present", "text")], fields(k).length, fields(k).length, fields(k).kind, fields(k).reference)
    d = schema.KeyDef("Name", constraint=c.order("Name", "==", other="Brand", factor=2.0, add=4.0, use="length"))
    return schema.validate(table(spark, sf_dir, "part"), F.col("p_partkey"), "Part", [d], both).select("file_id", "om_key")


@query(_line_sql("l_suppkey % 4 <> 1", "ConstraintViolated", "Supp"))
def modulo_condition(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Supp", constraint=c.modulo("Supp", 4, 1)))


@query(_line_sql("(l_partkey & 12) <> 0", "ConstraintViolated", "Part"))
def bits_clear(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Part", constraint=c.bits_clear("Part", 3, 4)))


@query(_line_sql("(l_partkey & 3) <> 3", "ConstraintViolated", "Part"))
def bits_set(spark, sf_dir):
    return _line(spark, sf_dir, schema.KeyDef("Part", constraint=c.bits_set("Part", 1, 2)))


@query("SELECT p_partkey AS file_id FROM part WHERE NOT contains(p_type, 'E')")
def contains_condition(spark, sf_dir):
    return _part(spark, sf_dir, schema.KeyDef("Type", constraint=c.contains("Type", "E"))).select("file_id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id, ((CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) > 20.00001) AND (l_returnflag = 'R') AS both,
((CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) > 20.00001) OR (l_returnflag = 'R') AS either, NOT ((CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) > 20.00001) AS negated,
l_linenumber % 2 = 1 AS present FROM lineitem""")
def three_valued_and_or(spark, sf_dir):
    f, more, flag = _line_fields(), c.order("Odd", ">", 20), c.eq("Flag", "R")
    x = {"both": c.both(more, flag), "either": c.either(more, flag), "negated": c.negate(more), "present": c.present("Odd")}
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), *[c.compile_cond(v, f).alias(k) for k, v in x.items()])


@query("SELECT DISTINCT event_type AS key FROM events EXCEPT SELECT DISTINCT event_type FROM events WHERE event_id < 3")
def post14_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("T").alias("type"), F.col("event_type").alias("key"), F.when(F.col("event_id") < 3, 1.4).otherwise(1.5).alias("since"))
    return schema.later_keys(e, 1.4).select("key")


@query("SELECT p_brand AS a, p_size AS b, min(p_type) AS owner FROM part GROUP BY ALL HAVING count(DISTINCT p_type) = 1")
def self_identified_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_size").alias("b"), F.col("p_type").alias("owner"))
    return schema.identifying_pairs(t, ["a", "b"], "owner")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'OpenUrgent' WHEN o_orderstatus = 'F' THEN 'Finished' END AS type FROM orders")
def self_identified_type(spark, sf_dir):
    pairs = {("O", "1-URGENT"): "OpenUrgent", ("F", ""): "Finished"}
    return table(spark, sf_dir, "orders").select("o_orderkey", schema.self_identified(F.col("o_orderstatus"), F.col("o_orderpriority"), pairs).alias("type"))


@query("""WITH v AS (SELECT DISTINCT event_type AS candidate, k, x FROM (SELECT event_type, 'hour' AS k, hour(ts)::VARCHAR AS x FROM events UNION ALL SELECT event_type, 'name', event_type FROM events)),
a AS (SELECT k, x, min(candidate) AS candidate FROM v GROUP BY ALL HAVING count(*) = 1) SELECT k AS key, count(DISTINCT candidate) AS covered FROM a GROUP BY k ORDER BY covered DESC, key LIMIT 1""")
def discriminator_dispatch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = e.select(F.col("event_type").alias("candidate"), F.lit("hour").alias("key"), F.hour("ts").cast("string").alias("value")).unionByName(e.select(F.col("event_type").alias("candidate"), F.lit("name").alias("key"), F.col("event_type").alias("value")))
    return schema.best_discriminator(v)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def repair_enum_fill(spark, sf_dir):
    f = schema.column_fields({"Status": (F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "name")})("Status")
    return table(spark, sf_dir, "orders").select("o_orderkey", schema.fill_required(f, ["X"]).alias("status"))


@query("SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9a-z]', '', 'g') AS BIGINT) AS n, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM events")
def repair_coerce(spark, sf_dir):
    only = lambda p: schema.coerce_scalar(F.regexp_replace("props", p, ""), "integer")
    return table(spark, sf_dir, "events").select("event_id", only("[^0-9a-z]").alias("n"), only("[^0-9]").alias("digits"))


@query("SELECT p_partkey, greatest(least(p_size, 40), 5)::DOUBLE AS size FROM part")
def repair_clamp(spark, sf_dir):
    low, high = schema.condition_bounds(c.both(c.order("Size", ">=", 5), c.order("Size", "<=", 40)))
    return table(spark, sf_dir, "part").select("p_partkey", schema.clamp_to(F.col("p_size").cast("double"), low, high).alias("size"))


@query("SELECT p_partkey, p_partkey & ~12 AS bits FROM part")
def repair_clear_bits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", schema.clear_bits(F.col("p_partkey"), 12).alias("bits"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS priority FROM orders")
def repair_delete_optional(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", schema.replace_disallowed(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("priority"))


# references and graphs


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_refs(spark, sf_dir):
    objects = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return graph.dangling(table(spark, sf_dir, "orders").select("o_custkey").distinct(), objects, ["o_custkey"])


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey")
def resolve_coalesce(spark, sf_dir):
    objects = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return graph.resolve(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), objects, ["o_custkey"]).select("o_orderkey", "c_name")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY ALL")
def incremental_last_wins(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"), F.col("event_id").alias("revision"))
    return graph.last_wins(v, ["user_id", "event_type"], "revision").select("user_id", "event_type", "event_id", "value")


#: References among all customers: to two parents, and from the first back to the second, a cycle.
_EDGES = "(SELECT c_custkey AS src, greatest(c_custkey // 3, 1) AS dst, 'k' || (c_custkey % 3) AS key FROM customer UNION SELECT c_custkey, greatest(c_custkey // 5, 1), 'k' || (c_custkey % 2) FROM customer UNION SELECT 1, 2, 'k2')"


def _edges(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "customer").select("c_custkey")
    x = F.col("c_custkey")
    up = lambda n, m: k.select(x.alias("src"), F.greatest(F.floor(x / n), F.lit(1)).cast("bigint").alias("dst"), F.concat(F.lit("k"), (x % m).cast("string")).alias("key"))
    back = spark.createDataFrame([(1, 2, "k2")], "src bigint, dst bigint, key string")
    return up(3, 3).unionByName(up(5, 2)).unionByName(back)


@query(f"""WITH RECURSIVE e AS {_EDGES}, r AS (SELECT c_custkey AS root, c_custkey AS node FROM customer
UNION SELECT root, dst FROM r JOIN e ON node = src) SELECT root, count(*) AS reached, sum(node)::BIGINT AS total FROM r GROUP BY root""")
def reachable_closure(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    r = graph.closure(_edges(spark, sf_dir), roots)
    return r.groupBy("root").agg(F.count(F.lit(1)).alias("reached"), F.sum("node").cast("bigint").alias("total"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN c_custkey // 4 + 1 END AS parent, CASE WHEN c_custkey % 5 = 0 OR c_custkey = 1 THEN c_name END AS v FROM customer),
u AS (SELECT node, parent, v, 0 AS hops FROM n UNION ALL SELECT u.node, n.parent, n.v, hops + 1 FROM u JOIN n ON u.parent = n.node WHERE u.v IS NULL AND hops < 20)
SELECT node, v AS value, hops FROM u WHERE v IS NOT NULL""")
def inherited_attribute(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(k.alias("node"), F.when(k > 1, F.floor(k / 4) + 1).alias("parent"), F.when((k % 5 == 0) | (k == 1), F.col("c_name")).alias("v"))
    return graph.inherited(n, "v").where("value is not null")


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN c_custkey // 4 + 1 END AS parent FROM customer WHERE c_custkey = 1 OR c_custkey // 4 + 1 < c_custkey),
p AS (SELECT node, [node] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, list_append(path, t.node) FROM p JOIN t ON t.parent = p.node)
SELECT node, row_number() OVER (ORDER BY path) AS page FROM p WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)""")
def page_index(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("node"), F.when(k > 1, (F.floor(k / 4) + 1).cast("bigint")).alias("parent"), k.alias("pos")).where("node = 1 or parent < node")
    return graph.page_index(t)


_LINKS = [("A", "k0", "B"), ("A", "k1", "A"), ("B", "*", "A"), ("B", "k2", "C"), ("C", "k0", "C")]


@query(f"""WITH RECURSIVE e AS {_EDGES},
l AS (SELECT * FROM (VALUES {', '.join(map(str, _LINKS))}) AS t(type, key, child)),
r AS (SELECT c_custkey AS node, 'A' AS type FROM customer UNION
SELECT e.dst, coalesce(x.child, y.child) FROM r JOIN e ON r.node = e.src LEFT JOIN l x ON x.type = r.type AND x.key = e.key LEFT JOIN l y ON y.type = r.type AND y.key = '*' WHERE coalesce(x.child, y.child) IS NOT NULL)
SELECT node, type FROM r""")
def typed_propagation(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.lit("A").alias("type"))
    return graph.propagate(_edges(spark, sf_dir), roots, spark.createDataFrame(_LINKS, "type string, key string, child string"))


@query("SELECT a.o_orderkey, a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AS equal FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def structural_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", F.array("o_orderpriority").alias("more")).alias("v"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("v").alias("w"))
    return o.join(b, "o_orderkey").select("o_orderkey", graph.equal_values(F.col("v"), F.col("w")).alias("equal"))


# text, bytes and content state


@query("SELECT source, string_agg(DISTINCT code, '' ORDER BY code) AS codes FROM (SELECT source, unnest(string_split(text, '')) AS code FROM documents) WHERE code BETWEEN 'A' AND 'Z' GROUP BY source")
def used_codes_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return usage.used_codes(d, "source", F.col("text")).where("code between 'A' and 'Z'").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("code")), "").alias("codes"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING bool_and(value < 150)")
def invisible_only(spark, sf_dir):
    return usage.invisible_only(table(spark, sf_dir, "events"), "user_id", F.col("value") < 150)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unused_resource_prune(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return usage.unused(table(spark, sf_dir, "part").select("p_partkey"), used, ["p_partkey"])


_STEP = "CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END"


@query(f"""SELECT user_id, max(depth)::BIGINT AS deepest FROM (SELECT user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth
FROM (SELECT user_id, event_id, sum({_STEP}) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)) GROUP BY user_id""")
def graphics_nesting_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "q").otherwise("Q").alias("op"))
    return usage.nesting_depth(e, ["user_id"], "event_id").groupBy("user_id").agg(F.max("depth").alias("deepest"))


@query("SELECT event_id, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS colour_set FROM events")
def colour_set_prefix(spark, sf_dir):
    return usage.set_before(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id", F.col("set_before").alias("colour_set"))


@query("""SELECT doc_id, octet_length(encode(text)) > 3000 AS long_string, max_word > 40 AS long_name, lines > 20 AS large_array FROM
(SELECT doc_id, text, list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS max_word, len(string_split(text, chr(10))) AS lines FROM documents)""")
def text_limits(spark, sf_dir):
    words = F.array_max(F.transform(F.split("text", " "), lambda w: F.length(w)))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.too_long(F.octet_length("text"), 3000).alias("long_string"), scalars.too_long(words, 40).alias("long_name"), scalars.too_long(F.size(F.split("text", "\n")), 20).alias("large_array"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey > 2147 OR l_partkey < 5 AS int_out, abs(l_extendedprice::FLOAT) > 32767 AS real_out FROM lineitem")
def number_limits(spark, sf_dir):
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    return table(spark, sf_dir, "lineitem").select(row, scalars.integer_out_of_range(F.col("l_partkey"), 5, 2147).alias("int_out"), scalars.real_out_of_range(F.col("l_extendedprice")).alias("real_out"))


@query("""SELECT conv_id, turn, regexp_full_match(text, '[0-9A-Fa-f \\t\\r\\n]*') AS valid, length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) % 2 = 1 AS odd FROM conversations""")
def hex_string_rules(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.is_hex_string(F.col("text")).alias("valid"), scalars.hex_odd(F.col("text")).alias("odd"))


@query("""SELECT doc_id, CASE WHEN length(d) % 2 = 1 THEN d || '0' ELSE d END AS fixed FROM (SELECT doc_id, regexp_replace(text, '[^0-9A-Fa-f]', '', 'g') AS d FROM documents)""")
def hex_repair(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.fix_hex(F.col("text")).alias("fixed"))


@query("SELECT doc_id, text FROM documents")
def text_string_decode(spark, sf_dir):
    mark = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.text_string(mark).alias("text"))


@query("SELECT c_custkey, c_mktsegment || ' ' || c_custkey AS name FROM customer")
def name_unescape(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.unescape_name(F.concat(F.regexp_replace("c_mktsegment", "A", "#41"), F.lit("#20"), F.col("c_custkey").cast("string"))).alias("name"))


@query("""SELECT doc_id, replace(replace(regexp_replace(text, '([()\\\\])', '\\\\\\1', 'g'), chr(13), '\\r'), chr(10), '\\n') AS literal FROM documents""")
def literal_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.escape_literal(F.col("text")).alias("literal"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INT AS links FROM pages")
def html_properties(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.first_group(F.col("html"), "<title>([^<]*)</title>").alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("links"))


@query("SELECT prefix, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<([a-z]+[0-9]?)', ' xmlns:\\1=\"urn:\\1\" ', 'g'), 'xmlns:([a-z0-9]+)=\"[^\"]*\"', 1)) AS prefix FROM pages) GROUP BY prefix")
def xmp_namespace_bindings(spark, sf_dir):
    text = F.regexp_replace("html", "<([a-z]+[0-9]?)", ' xmlns:$1="urn:$1" ')
    b = table(spark, sf_dir, "pages").select(F.explode(scalars.namespace_bindings(text)).alias("b"))
    return b.where("b.uri = 'urn:' || b.prefix").groupBy("b.prefix").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.doc_id, a.lang = b.lang AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def xmp_info_sync(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit("  ")).alias("info"))
    b = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("packet"))
    return d.join(b, "doc_id").select("doc_id", scalars.same_text(F.col("info"), F.col("packet")).alias("same"))


@query("SELECT o_orderkey, regexp_full_match(d, '[0-9]{4}(-[0-9][0-9](-[0-9][0-9])?)?') AS valid FROM (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4 + o_orderkey % 7) AS d FROM orders)")
def xmp_date_valid(spark, sf_dir):
    d = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), (4 + F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_iso_date(d).alias("valid"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso FROM orders")
def date_pdf_to_iso(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.pdf_date_to_iso(scalars.pdf_date(F.col("o_orderdate"))).alias("iso"))


@query("SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d') AS pdf FROM orders")
def date_iso_to_pdf(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_to_pdf_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("pdf"))


_OPS = ", ".join("'" + o.replace("'", "''") + "'" for o in OPERATORS)


@query(f"SELECT doc_id, count(*) AS unknown FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS op FROM documents) WHERE op NOT IN ({_OPS}) GROUP BY doc_id")
def undefined_operator(spark, sf_dir):
    ops = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("op"))
    return usage.undefined_operators(ops).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unknown"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, round(0.2 + power(least(l_discount * 10, 1), 2) * 0.6, 6) AS y FROM lineitem")
def function_exponential(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.round(scalars.exponential(F.col("l_discount") * 10, 0.2, 0.8, 2.0), 6).alias("y"))


@query("SELECT p_partkey, round(CASE WHEN x < 0.5 THEN power(x / 0.5, 2) ELSE 1 - (x - 0.5) / 0.5 END, 6) AS y FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)")
def function_stitching(spark, sf_dir):
    y = scalars.stitching(F.col("p_size") / F.lit(50.0), [0.5], [lambda x: scalars.exponential(x, 0, 1, 2), lambda x: scalars.exponential(x, 1, 0, 1)], [(0, 1), (0, 1)])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(y, 6).alias("y"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, round(1 - least(1, l_discount * 5 + l_tax * 4), 6) AS r, round(1 - least(1, l_quantity / 50 + l_tax * 4), 6) AS g, round(1 - least(1, 0.25 + l_tax * 4), 6) AS b FROM lineitem")
def cmyk_to_rgb(spark, sf_dir):
    r, g, b = scalars.cmyk_to_rgb(F.col("l_discount") * 5, F.col("l_quantity") / 50, F.lit(0.25), F.col("l_tax") * 4)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


def _matrix():
    return [F.lit(x) for x in (2.0, 1.0, -1.0, 3.0, 5.0, -4.0)]


@query("SELECT p_partkey, round(2 * p_size - p_retailprice + 5, 6) AS x, round(p_size + 3 * p_retailprice - 4, 6) AS y FROM part")
def affine_apply(spark, sf_dir):
    x, y = scalars.matrix_apply(_matrix(), F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT p_partkey, p_size::DOUBLE AS x, round(p_retailprice, 4) AS y FROM part")
def matrix_invert(spark, sf_dir):
    x, y = scalars.matrix_apply(_matrix(), F.col("p_size"), F.col("p_retailprice"))
    u, v = scalars.matrix_apply(scalars.matrix_invert(_matrix()), x, y)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(u, 4).alias("x"), F.round(v, 4).alias("y"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)) AS back FROM documents")
def xml_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = scalars.xml_escape(F.col("text"))
    return d.select("doc_id", e.alias("escaped"), scalars.xml_unescape(e).alias("back"))


# decoders: what was encoded comes back


def _through(spark, sf_dir, name: str) -> DataFrame:
    import zlib

    from folioscan.functions import decoders as d

    pairs = {
        "ascii_hex": (lambda b: b.hex().encode() + b">", d.ascii_hex), "flate": (zlib.compress, d.inflate), "lzw": (d.encode_lzw, d.lzw), "ascii85": (d.encode_ascii85, d.ascii85),
        "predictor": (lambda b: d.encode_png_predictor(b, 16, 4), lambda b: d.png_predictor(b, 16)), "tiff": (lambda b: bytes((b[i] - (b[i - 1] if i % 8 else 0)) & 255 for i in range(len(b))), lambda b: d.tiff_predictor(b, 8)),
    }
    there, back = pairs[name]

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        raw = x.encode()
        return back(there(raw))[: len(raw)].decode()

    return _each_text(spark, sf_dir, one, "text")


def _each_text(spark, sf_dir, one: Callable[[str | None], str | None], name: str) -> DataFrame:
    """A function of each document's whole text, in the tasks of all cores, by slices of the batches."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x.as_py()) for x in b.column(1)], pa.string())], ["doc_id", name])

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(d, "doc_id").mapInArrow(run, f"doc_id bigint, {name} string")


for _name in ("ascii_hex", "flate", "lzw", "ascii85", "predictor", "tiff"):

    def _trip(spark, sf_dir, name=_name):
        return _through(spark, sf_dir, name)

    _trip.__name__ = f"{_name}_roundtrip"
    query("SELECT doc_id, text FROM documents")(_trip)


# files, made from the documents with one known defect each


def _files(spark, sf_dir) -> DataFrame:
    return pdf_fixture.make_files(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")))


_N = len(pdf_fixture.DEFECTS)
_VALID = ", ".join(str(k) for k, (_, _, w) in enumerate(pdf_fixture.DEFECTS) if not w)
_WANTED = "(VALUES " + ", ".join(f"({k}, {cid(r)}, {w.count(r)})" for k, (_, _, w) in enumerate(pdf_fixture.DEFECTS) for r in sorted(set(w))) + ") AS w(defect, check_id, n)"


@query(f"SELECT doc_id AS file_id, check_id, n::BIGINT AS n FROM documents JOIN {_WANTED} ON doc_id % {_N} = defect")
def pdf_verify_defects(spark, sf_dir):
    issues, _ = verify(_files(spark, sf_dir), "strict_1b", reread=False)
    return results.issues_by_check(issues)


@query(f"SELECT doc_id AS file_id, doc_id % {_N} IN ({_VALID}) AS valid FROM documents")
def pdf_verify_valid(spark, sf_dir):
    return verify(_files(spark, sf_dir), "strict_1b", reread=False)[1].select("file_id", "valid")


@query(f"SELECT count(*) AS files, count(*) FILTER (doc_id % {_N} IN ({_VALID})) AS valid, coalesce(sum(n), 0)::BIGINT AS issues FROM documents LEFT JOIN (SELECT defect, sum(n) AS n FROM {_WANTED} GROUP BY defect) ON doc_id % {_N} = defect")
def pdf_batch_totals(spark, sf_dir):
    r = verify(_files(spark, sf_dir), "strict_1b", reread=False)[1]
    return r.agg(F.count(F.lit(1)).alias("files"), F.count_if("valid").alias("valid"), F.sum("n_issues").cast("bigint").alias("issues"))


_D = {n: k for k, (n, _, _) in enumerate(pdf_fixture.DEFECTS)}


def _of(*names: str) -> str:
    """A test in SQL for the files of these defects."""
    return f"doc_id % {_N} IN ({', '.join(str(_D[k]) for k in names)})"


@query(f"""SELECT doc_id AS file_id, CASE WHEN {_of('header', 'nothing')} THEN NULL ELSE '1.4' END AS version, CASE WHEN {_of('nothing')} THEN 0 ELSE 1 END AS pages, CASE WHEN {_of('nothing')} THEN 0 ELSE 1 END AS declared_pages,
CASE WHEN {_of('xmp_missing', 'xmp_unread', 'xmp_no_id', 'xmp_id_part', 'nothing')} THEN NULL WHEN {_of('xmp_part')} THEN '2' ELSE '1' END AS part, CASE WHEN {_of('xmp_missing', 'xmp_unread', 'xmp_no_id', 'nothing')} THEN NULL WHEN {_of('xmp_level')} THEN 'U' ELSE 'B' END AS conformance,
CASE WHEN {_of('info_array', 'nothing')} THEN NULL WHEN {_of('info_differs')} THEN 'another' ELSE trim(substr(text, 1, 40), ' ' || chr(10)) END AS title FROM documents""")
def pdf_metadata(spark, sf_dir):
    return files_meta(_files(spark, sf_dir)).select("file_id", "version", "pages", "declared_pages", "part", "conformance", F.col("info")["Title"].alias("title"))


#: Defects that no fixer mends.
_LEFT = (
    "image_bits image_mask font_subtype font_base font_program font_missing separation cmap_name symbolic_cmap model_missing font_shown cid_glyph cid_compact_glyph cid_missing big_array big_dict colorants postscript nothing"
).split()


@query(f"SELECT doc_id AS file_id, check_id, n::BIGINT AS n FROM documents JOIN {_WANTED} ON doc_id % {_N} = defect WHERE {_of(*_LEFT)}")
def pdf_convert_residual(spark, sf_dir):
    return results.issues_by_check(convert(_files(spark, sf_dir), "strict_1b")[2])


@query(f"""SELECT doc_id AS file_id, CASE WHEN {_of('info_array', 'nothing')} THEN NULL WHEN {_of('info_differs')} THEN 'another' ELSE regexp_replace(trim(substr(text, 1, 40), ' ' || chr(10)), '\\s+', ' ', 'g') END AS title,
CASE WHEN doc_id % {_N} IN ({_VALID}) THEN 0 ELSE 1 END AS rounds FROM documents""")
def pdf_convert_roundtrip(spark, sf_dir):
    @F.pandas_udf("string")
    def title(content):
        return content.map(text_of)

    return convert(_files(spark, sf_dir), "strict_1b")[0].select("file_id", title("content").alias("title"), "rounds")


@query(f"SELECT doc_id AS file_id, CASE WHEN {_of('nothing')} THEN '' ELSE md5(text) END AS md5 FROM documents WHERE NOT {_of('cmyk', 'nesting', 'operator', 'intent_op', 'inline_lzw', 'invisible', 'default_cmyk', 'default_other', 'colorants_function')} AND NOT starts_with([{', '.join(repr(k) for k, _, _ in pdf_fixture.DEFECTS)}][doc_id % {_N} + 1], 'font_') AND NOT starts_with([{', '.join(repr(k) for k, _, _ in pdf_fixture.DEFECTS)}][doc_id % {_N} + 1], 'cid_')")
def pdf_content_text(spark, sf_dir):
    """The whole text of each file whose content keeps it, from its content's operators."""
    gone = [k for k, (n, _, _) in enumerate(pdf_fixture.DEFECTS) if n in ("cmyk", "nesting", "operator", "intent_op", "inline_lzw", "invisible", "default_cmyk", "default_other", "colorants_function") or n.startswith(("font_", "cid_"))]
    t = content_texts(_files(spark, sf_dir).where(~(F.col("file_id") % _N).isin(gone)))
    return t.select("file_id", F.when(F.col("pages") == 0, "").otherwise(F.md5("text")).alias("md5"))
