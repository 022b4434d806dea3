"""The algebra of results: filters, groups, orders and reports over issues (file_id, check_id, page, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.plans.catalog import Profile, all_checks, checks_frame, clause_key


def filter_by_profile(issues: DataFrame, profile: Profile) -> DataFrame:
    """The issues of enabled rules, and those of rules that the catalog lacks. The lists are short and constant, so
    they go into the predicate and no join is needed."""
    known = [c.check_id for c in all_checks()]
    off = [k for k in known if k not in profile.enabled]
    return issues.where(~F.col("check_id").isin(off)) if off else issues


def clause_sort_key(clause: Column) -> Column:
    """An array that orders dotted clauses by their numbers; a part that is no number comes after all numbers."""
    return F.transform(F.split(clause, "\\."), lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("k"), F.coalesce(p.try_cast("int"), F.lit(0)).alias("n"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("t")))


def with_checks(issues: DataFrame) -> DataFrame:
    """Adds the rule's columns; the catalog has 157 rows."""
    return issues.join(F.broadcast(checks_frame(issues.sparkSession)), "check_id", "left")


def count_issues(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_issues"))


def results(files: DataFrame, issues: DataFrame) -> DataFrame:
    """file_id, valid, n_issues for every file: valid without issues."""
    n = count_issues(issues)
    return files.select("file_id").join(n, "file_id", "left").select("file_id", F.col("n_issues").isNull().alias("valid"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def issues_by_check(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file_id", "check_id").agg(F.count(F.lit(1)).alias("n"))


def first_failures(failures: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of each group the failure that comes first, as where a check stops at the first."""
    return failures.groupBy(*group).agg(F.min(order).alias(order))


def issues_on_page(issues: DataFrame, page: int) -> DataFrame:
    """Those of a page; 0 is the document."""
    return issues.where(F.col("page") == page)


def issues_for_check(issues: DataFrame, check_id: int) -> DataFrame:
    return issues.where(F.col("check_id") == check_id)


def distinct_checks(issues: DataFrame) -> DataFrame:
    """file_id, check_id and the rank of each rule of a file in the natural order of clauses, then subclauses."""
    d = with_checks(issues.select("file_id", "check_id").distinct())
    w = Window.partitionBy("file_id").orderBy(clause_sort_key(F.col("clause")), "subclause", "check_id")
    return d.select("file_id", "check_id", "clause", "subclause", F.row_number().over(w).alias("rank"))


def lexicographic_checks(issues: DataFrame) -> DataFrame:
    """As distinct_checks(), in the textual order of clauses, in which repairs are applied."""
    d = with_checks(issues.select("file_id", "check_id").distinct())
    w = Window.partitionBy("file_id").orderBy("clause", "subclause", "check_id")
    return d.select("file_id", "check_id", F.row_number().over(w).alias("rank"))


def summary(issues: DataFrame) -> DataFrame:
    """file_id, report: a line for each rule with its number of issues, in natural order. The issues are counted once;
    the catalog is joined to the counts, with its order as a number."""
    spark = issues.sparkSession
    order = {c.check_id: k for k, c in enumerate(sorted(all_checks(), key=lambda c: (clause_key(c.clause), c.subclause, c.check_id)))}
    lines = spark.createDataFrame([(c.check_id, order[c.check_id], f"{c.clause}/{c.subclause} {c.name}: ") for c in all_checks()], "check_id int, rank int, head string")
    n = issues_by_check(issues).join(F.broadcast(lines), "check_id")
    line = F.struct("rank", F.concat("head", F.col("n").cast("string")).alias("text"))
    return n.groupBy("file_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(line)), lambda x: x.text)).alias("report"))


def messages(issues: DataFrame) -> DataFrame:
    """file_id, message: each issue as a sentence of its rule, and of its page, if it has one."""
    heads = issues.sparkSession.createDataFrame([(c.check_id, f"{c.clause}/{c.subclause} {c.description}") for c in all_checks()], "check_id int, head string")
    where = F.when(F.col("page") > 0, F.concat(F.lit(" on page "), F.col("page").cast("string"))).otherwise(F.lit(" in the document"))
    return issues.join(F.broadcast(heads), "check_id").select("file_id", F.concat("head", where).alias("message"))


def violation_counts(issues: DataFrame) -> DataFrame:
    """file_id, signature: the multiset of rules as a sorted text of check and count."""
    pair = F.struct("check_id", "n")
    text = F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat(p.check_id.cast("string"), F.lit(":"), p.n.cast("string")))
    return issues_by_check(issues).groupBy("file_id").agg(F.concat_ws(",", text).alias("signature"))


def same_multiset(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, same: whether two sets of issues have equal counts by rule."""
    a = violation_counts(before).withColumnRenamed("signature", "a")
    b = violation_counts(after).withColumnRenamed("signature", "b")
    return a.join(b, "file_id", "full").select("file_id", F.coalesce("a", F.lit("")).eqNullSafe(F.coalesce("b", F.lit(""))).alias("same"))


def has_fixable(issues: DataFrame) -> DataFrame:
    """file_id, fixable: whether any issue is of a rule with a repair."""
    fixable = [c.check_id for c in all_checks() if c.repair]
    return issues.groupBy("file_id").agg(F.max(F.col("check_id").isin(fixable)).alias("fixable"))


def ordered_concat(*parts: DataFrame) -> DataFrame:
    """The parts one after another, with emit_part for their order."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("emit_part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def to_issues(df: DataFrame, file_id: Column, rules: dict[str, Column], page: Column | None = None) -> DataFrame:
    """Evaluates rules, a predicate for each name, over rows in one projection: file_id, check_id, page. A predicate
    that is null doesn't flag."""
    from folioscan.plans.catalog import check_by_name

    found = F.array_compact(F.array(*[F.when(p, F.lit(check_by_name(n).check_id)) for n, p in rules.items()]))
    return df.select(file_id.alias("file_id"), (page if page is not None else F.lit(0)).alias("page"), F.explode(found).alias("check_id")).select("file_id", "check_id", "page")
