"""Reference resolution, closure and propagation over node and edge tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which what was found becomes one table, as a plan over very many is slow.
MERGED_ROUNDS = 20
#: Levels of a page tree below its root beyond which it is an error.
MAX_TREE_DEPTH = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local master, as in tests, may do without: it
    gets a temporary one that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("folioscan.graph.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("folioscan.graph.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder instead of a growing plan."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolve(refs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """Each reference with its object's columns; one without an object gets nulls. A self-reference is null too."""
    return refs.join(objects, on, "left")


def dangling(refs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    return refs.join(objects.select(*on).distinct(), on, "left_anti")


def last_wins(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest version of each key: a partial aggregate, so one key with very many versions is no burden."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(*keys, "v.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found(parts: list[DataFrame], new: DataFrame, name: str) -> list[DataFrame]:
    """The tables of all that was found, with that of a further round."""
    parts = [*parts, new]
    return [written(_union(parts).coalesce(parts[0].sparkSession.sparkContext.defaultParallelism), name)] if len(parts) > MERGED_ROUNDS else parts


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """root, node, depth of all that roots (a column node) reach over edges (src, dst), themselves at depth 0; depth is
    the least number of steps. Each round extends only what the round before found first, so cycles end it. Paths of
    more than max_rounds steps, if that is given, are an error."""
    e = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    new = written(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "reached")
    parts, k = [new], 0
    while True:
        k += 1
        step = new.join(e, new.node == e.src).select("root", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        new = written(step.join(_union(parts).select("root", "node"), ["root", "node"], "left_anti"), "reached")
        if not new.limit(1).count():
            return _union(parts)
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"paths of more than {max_rounds} steps")
        parts = _found(parts, new, "reached")


def inherited(nodes: DataFrame, value: str, max_hops: int = 20) -> DataFrame:
    """node, value, hops: the value of the nearest node on the way up (parent) that has one, in max_hops steps."""
    n = written(nodes.select("node", "parent", F.col(value).alias("value")), "nodes")
    up = n.select("node", F.col("parent").alias("at"), "value", F.lit(0).alias("hops"))
    for k in range(1, max_hops + 1):
        p = n.select(F.col("node").alias("at"), F.col("parent").alias("next"), F.col("value").alias("found"))
        ask = F.col("value").isNull()
        up = up.join(p, "at", "left").select("node", F.when(ask, F.col("next")).alias("at"), F.coalesce("value", "found").alias("value"), F.when(ask & F.col("found").isNotNull(), k).otherwise(F.col("hops")).alias("hops"))
        if k % 5 == 0:
            up = written(up, "up")
            if not up.where("value is null and at is not null").limit(1).count():
                break
    return up.select("node", "value", "hops")


def propagate(edges: DataFrame, roots: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, type of all that typed roots (node, type) reach: an edge (src, key, dst) gives its target the type that
    links (type, key, child) states for it; key '*' holds for all keys without a link of their own. A node may have
    several types; each pair is visited once. Paths of more than max_rounds steps, if that is given, are an error."""
    e = written(edges.select("src", "key", "dst"), "edges")
    named = links.select(F.col("type").alias("t"), F.col("key").alias("k"), F.col("child").alias("named"))
    star = links.where("key = '*'").select(F.col("type").alias("st"), F.col("child").alias("any"))
    new = written(roots.select("node", "type").distinct(), "typed")
    parts, k = [new], 0
    while True:
        k += 1
        j = new.join(e, new.node == e.src).join(named, (F.col("type") == F.col("t")) & (F.col("key") == F.col("k")), "left").join(star, F.col("type") == F.col("st"), "left")
        step = j.select(F.col("dst").alias("node"), F.coalesce("named", "any").alias("type")).where("type is not null").distinct()
        new = written(step.join(_union(parts), ["node", "type"], "left_anti"), "typed")
        if not new.limit(1).count():
            return _union(parts)
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"paths of more than {max_rounds} steps")
        parts = _found(parts, new, "typed")


def page_index(tree: DataFrame, max_depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """node, page: leaves of a tree (node, parent, pos) numbered from 1 in the order of their paths. A tree with more
    than max_depth levels below its root is an error."""
    t = written(tree.select("node", "parent", "pos"), "tree")
    level = t.where("parent is null").select("node", F.array("pos").alias("path"))
    parts, depth = [level], 0
    while True:
        level = written(t.alias("c").join(level.select(F.col("node").alias("up"), "path"), F.col("c.parent") == F.col("up")).select("c.node", F.concat("path", F.array("c.pos")).alias("path")), "paths")
        if not level.limit(1).count():
            break
        depth += 1
        if depth > max_depth:
            raise RuntimeError(f"a tree of more than {max_depth} levels")
        parts = _found(parts, level, "paths")
    paths = _union(parts)
    leaves = paths.join(t.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    # ordered by range, then numbered within ranges from the ranges' counts
    ordered = written(leaves.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()), "leaves")
    from pyspark.sql.window import Window

    counts = ordered.groupBy("part").count()
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    w = Window.partitionBy("part").orderBy("path")
    return ordered.withColumn("row", F.row_number().over(w)).join(starts, "part").select("node", (F.col("row") + F.col("start")).cast("bigint").alias("page"))


def equal_values(a: Column, b: Column) -> Column:
    """Whether two structured values are equal throughout; nulls are equal to nulls alone."""
    return a.eqNullSafe(b)


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    cols = a.columns
    x = a.groupBy(*cols).count().withColumnRenamed("count", "n")
    y = b.select(*cols).groupBy(*cols).count().withColumnRenamed("count", "m")
    on = [x[c].eqNullSafe(y[c]) for c in cols]
    return x.join(y, on, "full").where(~F.col("n").eqNullSafe(F.col("m"))).limit(1).count() == 0


def parent_slots(edges: DataFrame) -> DataFrame:
    """dst, slots of edges (src, key, dst): where each node is referred to from, in order."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set(F.struct("src", "key"))).alias("slots"))
