"""Mixing of sources to target weights by Poisson replication.

Each source has a mean number of repetitions: its share of the output over its share of the input. A document draws its
own number from the Poisson distribution of that mean, by inverting the distribution at a hash of its doc_id, so the
draw needs no state and a repeated task makes the same. Copies are ordered by a hash of doc_id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import HOT_KEYS, fresh, materialize, number_gapless, only, read_table

#: Without stated weights a source weighs its size to this power.
TEMPERATURE = 0.5
#: Output over input, in code points.
EPOCHS = 1.0
SEED = "mix"
BITS = 52
#: A larger mean is the sum of equal ones below this, each with a draw of its own.
LARGEST_MEAN = 300.0
#: Copies that one task numbers at most, about.
PART_ROWS = 1_000_000


def hashed(*parts: Column | str) -> Column:
    """A number of BITS bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def rates(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """source, size (code points, and one for each document) and rate, the mean number of repetitions. Sources without
    a stated weight weigh 0 if weights are given. A null source is a source of its own, named None in the weights."""
    s = documents.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"))
    if weights is None:
        s = s.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        stated = F.lit(0.0)
        for k, v in weights.items():
            stated = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(stated)
        s = s.withColumn("weight", stated)
    s = materialize(s, "sources")
    total, all_weights = s.agg(F.sum("size"), F.sum("weight")).first()
    return s.select("source", "size", (F.lit(total or 0) * epochs * F.col("weight") / F.lit(all_weights or 1.0) / F.col("size")).alias("rate"))


def with_distribution(r: DataFrame) -> DataFrame:
    """Adds draws, the number of draws of a document, and below, the cumulative probabilities of 0, 1, 2, ... for one."""
    r = r.withColumn("draws", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")).withColumn("_mean", F.col("rate") / F.col("draws"))
    top = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 40).cast("int")
    start = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("below"))

    def step(a: Column, k: Column) -> Column:
        p = a.p * F.col("_mean") / k
        return F.struct(p.alias("p"), F.concat(a.below, F.array(F.element_at(a.below, -1) + p)).alias("below"))

    return r.withColumn("below", F.aggregate(F.sequence(F.lit(1), top), start, step).below).drop("_mean")


def _repeated(documents: DataFrame, weights: dict[str, float] | None, epochs: float, seed: str, rate: str, copies: str) -> DataFrame:
    """The columns of documents, and the rate and the number of copies of each row under names of their own."""
    r = with_distribution(rates(documents, weights, epochs))
    names = {c: fresh(f"_mix_{c}", documents) for c in r.columns}
    r = materialize(r.select(*[F.col(c).alias(n) for c, n in names.items()]), "rates")
    source, size, draws, below = (names[c] for c in ("source", "size", "draws", "below"))
    total = r.agg(F.sum(size)).first()[0] or 0
    # fewer than HOT_KEYS sources hold more than this share each: they are sent to all tasks, the rest meet by source
    hot = F.broadcast(r.where(F.col(size) > total / HOT_KEYS))
    cold = r.where(F.col(size) <= total / HOT_KEYS)
    u = lambda k: (hashed(seed, F.col("doc_id"), k) + 0.5) / float(1 << BITS)
    one = lambda k: F.size(F.filter(F.col(below), lambda p: p <= u(k)))
    number = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, k: a + one(k)).alias(copies)
    out = [documents[c] for c in documents.columns]
    parts = [documents.join(t, documents.source.eqNullSafe(t[source])).select(*out, F.col(names["rate"]).alias(rate), number) for t in (hot, cold)]
    return parts[0] if cold.limit(1).count() == 0 else parts[0].unionByName(parts[1])


def repetitions(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds rate and copies, the number of repetitions of each row, to a table with doc_id, text and source. Columns of
    the input with these names are replaced."""
    return _repeated(documents.drop("rate", "copies"), weights, epochs, seed, "rate", "copies")


def in_order(repeated: DataFrame, seed: str = SEED) -> DataFrame:
    """Explodes rows by copies and numbers them in the order of a hash of doc_id and copy."""
    d = repeated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    d = materialize(d.withColumn("shuffle_key", hashed(seed, F.col("doc_id"), "copy", F.col("copy"))), "copies")
    bits = max(0, (d.count() // PART_ROWS).bit_length())
    d = d.withColumn("_part", F.shiftrightunsigned("shuffle_key", BITS - bits).cast("bigint"))
    return number_gapless(d, [], "_part", [F.col("shuffle_key"), F.col("doc_id"), F.col("copy")], "position").drop("_part")


def mix(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The copies of each document in their global order: the columns of documents, and rate, copy (from 1),
    shuffle_key and position (gapless from 0).

    documents has doc_id, source and text; a null text has size 0. A document may have no copy. Rows with equal doc_id
    and source get equal numbers of copies. No documents give no rows. Columns of the input named as a new one
    are replaced.
    """
    return in_order(repetitions(documents.drop("rate", "copies", "copy", "shuffle_key", "position"), weights, epochs, seed), seed)


def shuffled(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The copies of mix() in the columns of documents alone, whatever their names, in partitions by ranges of the
    global order. Nulls, ties and empty tables are as in mix()."""
    rate, copies, copy, key = (fresh(f"_mix_{x}", documents) for x in ("rate", "copies", "copy", "key"))
    d = _repeated(documents, weights, epochs, seed, rate, copies).where(F.col(copies) > 0)
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    d = d.withColumn(key, hashed(seed, F.col("doc_id"), "copy", F.col(copy)))
    return d.repartitionByRange(F.col(key)).sortWithinPartitions(key, copy).select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = only(read_table(spark, sf_dir, "documents"), doc_id="bigint", source="string", text="string")
    return in_order(repetitions(d).select("doc_id", "source", F.length("text").alias("n_chars"), F.round("rate", 6).alias("rate"), "copies"))


SQL = f"""
WITH s AS (
  SELECT source, sum(length(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY source
), r AS (
  SELECT source, (SELECT sum(size) FROM s) * {EPOCHS} * size::DOUBLE ^ {TEMPERATURE} / (SELECT sum(size::DOUBLE ^ {TEMPERATURE}) FROM s) / size AS rate FROM s
), k AS (
  SELECT source, k, sum(exp(-rate) * rate ^ k / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS below
  FROM r, (SELECT range AS k FROM range(0, 120)) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)
), d AS (
  SELECT doc_id, source, length(text)::INT AS n_chars, round(rate, 6) AS rate,
    (('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, {BITS // 4}))::BIGINT + 0.5) / {1 << BITS} AS u
  FROM documents JOIN r USING (source)
), n AS (
  SELECT d.doc_id, d.source, d.n_chars, d.rate, count(*)::INT AS copies FROM d JOIN k ON d.source = k.source AND k.below <= d.u GROUP BY ALL
), c AS (
  SELECT doc_id, source, n_chars, rate, copy::INT AS copy, ('0x' || substr(md5('{SEED}:' || doc_id || ':copy:' || copy), 1, {BITS // 4}))::BIGINT AS shuffle_key
  FROM n, (SELECT range AS copy FROM range(1, 1000)) WHERE copy <= copies
)
SELECT *, row_number() OVER (ORDER BY shuffle_key, doc_id, copy) - 1 AS position FROM c
"""
