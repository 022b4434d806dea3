"""Near duplicates by SimHash and random bit sampling.

A document's fingerprint has BITS signs of weighted sums over its words and its pairs of following words. Fingerprints
that are equal are one row from then on. Each of several tables groups the rows by a random sample of coordinates;
larger samples take more tables, so that a pair at DISTANCE is as likely to meet at any number of rows. All rows of a
bucket are compared; a bucket of more than about BUCKET_ROWS rows is cut by additional coordinates, and every pair of
its parts is compared as a bucket of its own, so none of its pairs is left out. A pair counts in the first table alone
in which it meets. A bucket gives each row its number of links and one link to its connected part of the bucket, so what
leaves a bucket grows with its rows and not with their pairs. Classes are the connected components of these links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from folioscan.llm.common import materialize, read_table, schema, unsent

BITS, WORDS = 256, 4
#: Tables at the least sample, the least and the most sampled coordinates, and how many fewer than the logarithm of the
#: rows.
TABLES, LEAST_SAMPLE, MOST_SAMPLE, FEWER = 48, 10, 24, 10
#: Greatest Hamming distance of near duplicates.
DISTANCE = 58
#: Rows of a bucket beyond which it is cut, about; additional coordinates that cut it; one row in so many is counted
#: to find such buckets.
BUCKET_ROWS, EXTRA, COUNTED = 4096, 4, 64
#: A bucket's number has its table's from this bit on.
TABLE_BIT = 52
SEED = 20240501
WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: By the length of a word: long words tell documents apart, of the short ones all texts of a language are full.
_WEIGHTS = np.array([1, 1, 1, 1, *[(n - 2) ** 2 for n in range(4, 13)]], np.float32)


def _sum(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the features' signs, over its length if they were independent."""
    total = np.zeros(BITS, np.float32)
    for s in range(0, len(features), 8192):
        x = features[s : s + 8192, None] * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX[::-1]
        x ^= x >> np.uint64(29)
        w = weights[s : s + 8192]
        total += 2 * np.einsum("i,ij->j", w, np.unpackbits(x.view(np.uint8), axis=1)) - w.sum()
    return total / np.sqrt((weights * weights).sum())


def simhash(text: str) -> bytes | None:
    """BITS bits of a text; None of one without words. The distinct words weigh by their length, the pairs by the root
    of their number, and both halves alike."""
    found = WORD.findall(text.lower())
    if not found:
        return None
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    words, first = np.unique(h, return_index=True)
    lengths = np.fromiter(map(len, found), np.int64, len(found))[first]
    v = _sum(words, _WEIGHTS[np.minimum(lengths, 12)])
    if len(h) > 1:
        pairs, n = np.unique(h[:-1] * _MIX[0] + (h[1:] ^ h[1:] >> np.uint64(31)) * _MIX[1], return_counts=True)
        v += _sum(pairs, np.sqrt(n).astype(np.float32))
    return np.packbits(v > 0).tobytes()


FINGERPRINTS = "doc_id bigint, text_hash bigint, fingerprint binary"


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (null: empty) and its fingerprint. A text without words has a hash of itself, so it
    is like its exact copies alone."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [simhash(t) or blake2b(t.encode(), digest_size=BITS // 8).digest() for x in b.column(2) for t in (x.as_py(),)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary())], ["doc_id", "text_hash", "fingerprint"])

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(compute, FINGERPRINTS)


def sample_size(rows: int) -> int:
    """So many coordinates that a row meets at most about 2^FEWER unlike ones in a table."""
    return max(LEAST_SAMPLE, min(MOST_SAMPLE, int(np.ceil(np.log2(max(rows, 2)))) - FEWER))


def recall(size: int, tables: int, distance: int = DISTANCE) -> float:
    """The chance that two rows at this distance meet in any of the tables, if coordinates were drawn independently."""
    return 1 - (1 - (1 - distance / BITS) ** size) ** tables


def table_count(size: int, tables: int = TABLES) -> int:
    """So many tables of samples of this size that the recall at DISTANCE is that of tables of LEAST_SAMPLE."""
    meet = lambda k: np.log1p(-((1 - DISTANCE / BITS) ** k))
    return int(np.ceil(tables * meet(LEAST_SAMPLE) / meet(size) - 1e-9))


def coordinates(tables: int, size: int) -> np.ndarray:
    """The coordinates of each table, and EXTRA more for its large buckets. A larger sample extends a smaller one."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS)[: size + EXTRA] for _ in range(tables)])


def masks(chosen: np.ndarray) -> np.ndarray:
    """Coordinates as bits of WORDS unsigned numbers, a row a table."""
    m = np.zeros((len(chosen), BITS), np.uint8)
    np.put_along_axis(m, chosen, 1, axis=1)
    return np.packbits(m, axis=1).view(np.uint64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of WORDS unsigned numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The differing bits, by words, of pairs of rows, and whether they are few enough."""
    x = a ^ b
    return x, np.bitwise_count(x).sum(axis=-1, dtype=np.int16) <= DISTANCE


def _first_here(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether pairs with these differing bits meet in none of the tables before."""
    ok = np.ones(len(x), bool)
    for m in before:
        at = np.flatnonzero(ok)
        if not len(at):
            break
        ok[at] = (x[at] & m).any(axis=1)
    return ok


def _pairs(keys: np.ndarray, sides: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i < j of near rows of one key, and their differing bits. keys is in order. Of rows with a side other than
    0 only those of different sides are paired."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= 64, sizes)
    alone = lambda i, j: (sides[i] == 0) | (sides[i] != sides[j])
    lag = 1
    i = np.flatnonzero(small)
    while len(i):  # all pairs at this distance in the order, of all small buckets at once
        i = i[i + lag < len(keys)]
        i = i[keys[i] == keys[i + lag]]
        for part in np.array_split(i, max(1, len(i) // 500_000)):
            x, near = _near(fp[part], fp[part + lag])
            near &= alone(part, part + lag)
            if near.any():
                yield part[near], part[near] + lag, x[near]
        lag += 1
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        word = np.ascontiguousarray(fp[s : s + n].T)
        step = max(1, 200_000 // n)
        for a in range(0, n, step):
            here = word[:, a : a + step, None]
            some = np.bitwise_count(here[0] ^ word[0, a:])
            for k in range(1, WORDS - 1):
                some += np.bitwise_count(here[k] ^ word[k, a:])
            # of at most 192 and 64 bits: the sum that counts doesn't overflow
            near = (some <= DISTANCE) & (some + np.bitwise_count(here[-1] ^ word[-1, a:]) <= DISTANCE)
            r, c = np.nonzero(near)
            r, c = s + a + r, s + a + c
            ok = (r < c) & alone(r, c)
            if ok.any():
                r, c = r[ok], c[ok]
                yield r, c, fp[r] ^ fp[c]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one it is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]


LINKS = "id bigint, other bigint, links bigint"


def compare(rows: DataFrame, before: list) -> DataFrame:
    """id, other, links of rows (bucket, side, id, fp) in the order of bucket: a row for each place with a near one in
    its bucket, with the number of its links that its table is the first to find, and one link towards the least place
    that it reaches. The upper bits of bucket are the table's number."""
    before = np.array(before, np.uint64).reshape(-1, WORDS)

    def run(bucket: np.ndarray, side: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b, n = [], [], np.zeros(len(ids), np.int64)
        table = bucket >> TABLE_BIT
        for k in np.unique(table):
            at = np.flatnonzero(table == k)
            for i, j, x in _pairs(bucket[at], side[at], fp[at]):
                i, j = at[i], at[j]
                a.append(i)
                b.append(j)
                first = _first_here(x, before[:k])
                n += np.bincount(i[first], minlength=len(n)) + np.bincount(j[first], minlength=len(n))
        if not a:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["id", "other", "links"])
        a, b = np.concatenate(a), np.concatenate(b)
        root = _roots(len(ids), a, b)
        touched = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(ids[root[touched]]), pa.array(n[touched])], ["id", "other", "links"])

    def all_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [_matrix(batch.column(3))]
            held = new if held is None else [np.concatenate([h, x]) for h, x in zip(held, new)]
            done = np.flatnonzero(held[0] != held[0][-1])  # the last bucket may go on
            if len(done):
                yield run(*[h[: done[-1] + 1] for h in held])
                held = [h[done[-1] + 1 :] for h in held]
        if held is not None:
            yield run(*held)

    return rows.select("bucket", "side", "id", "fp").mapInArrow(all_buckets, LINKS)


def bucketed(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """bucket, id, fp: each row (id, fp) in each table, which has a row of coordinates."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                part = b.slice(s, 20_000)
                bits = np.unpackbits(_matrix(part.column(1)).view(np.uint8), axis=1)
                for t, own in enumerate(chosen):
                    key = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64)) | t << TABLE_BIT
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), part.column(1)], ["bucket", "id", "fp"])

    return rows.select("id", "fp").mapInArrow(sample, "bucket bigint, id bigint, fp binary")


def _part(chosen: np.ndarray):
    """A column function: the part of a large bucket that a row is in, by the additional coordinates of its table."""

    @F.pandas_udf("int")
    def part(bucket: pd.Series, fp: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1)
        at = chosen[(bucket.to_numpy(np.int64) >> TABLE_BIT)]
        return pd.Series(np.take_along_axis(bits, at, 1).astype(np.int32) @ (1 << np.arange(EXTRA, dtype=np.int32)), dtype="int32")

    return part


def near_links(rows: DataFrame, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id, other, links over rows with distinct fingerprints (id, fp), as compare() gives them. tables is the number at
    LEAST_SAMPLE; larger samples take more."""
    size = sample_size(rows.count())
    chosen = coordinates(table_count(size, tables), size)
    before = masks(chosen[:, :size]).tolist()
    b = bucketed(rows, chosen[:, :size])
    # which buckets are cut changes no result, so they are found from a part of the rows
    counted = COUNTED if bucket_rows >= COUNTED else 1
    some = bucketed(rows.where(F.pmod("id", F.lit(counted)) == 0), chosen[:, :size])
    large = materialize(some.groupBy("bucket").count().where(F.col("count") > bucket_rows // counted).select(F.col("bucket").alias("large")), "large")
    found = large.count()
    if not found:
        parts = b.withColumn("side", F.lit(0))
    else:
        large = F.broadcast(large) if found <= 100_000 else large
        j = b.join(large, b.bucket == F.col("large"), "left")
        ordinary = j.where(F.col("large").isNull()).select("bucket", F.lit(0).alias("side"), "id", "fp")
        # a row of part e goes to the pairs {e, f} of parts; in that of {e, e} all rows are paired, else those of e with those of f
        cut = j.where(F.col("large").isNotNull()).withColumn("e", _part(chosen[:, size:])("bucket", "fp"))
        cut = cut.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit((1 << EXTRA) - 1))))
        own = F.shiftrightunsigned(F.xxhash64("bucket", F.least("e", "f"), F.greatest("e", "f")), 64 - TABLE_BIT).bitwiseOR(F.shiftleft(F.shiftright("bucket", TABLE_BIT), TABLE_BIT))
        cut = cut.select(own.alias("bucket"), F.when(F.col("e") == F.col("f"), 0).when(F.col("e") < F.col("f"), 1).otherwise(2).alias("side"), "id", "fp")
        parts = ordinary.unionByName(cut)
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    return compare(parts, before).groupBy("id", "other").agg(F.sum("links").alias("links"))


def components(links: DataFrame) -> DataFrame:
    """id, root: for each id of the links (id, other) the least id it is connected with. Each round every id takes the
    least root among its neighbours and its root's, so long chains halve."""
    edges = links.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("id"), "root"), "roots")
    while True:
        near = edges.join(unsent(roots.select(F.col("id").alias("b"), "root")), "b").select(F.col("a").alias("id"), "root")
        least = near.unionByName(roots).groupBy("id").agg(F.min("root").alias("root"))
        # a root's own root, and the least root that the members of a root have found
        found = least.join(unsent(roots.select("id", F.col("root").alias("old"))), "id")
        told = found.groupBy(F.col("old").alias("id")).agg(F.min("root").alias("root"))
        least = least.unionByName(told).groupBy("id").agg(F.min("root").alias("root"))
        jump = least.select(F.col("id").alias("jid"), F.col("root").alias("far"))
        new = materialize(least.join(unsent(jump), F.col("root") == F.col("jid"), "left").select("id", F.least("root", "far").alias("root")), "roots")
        changed = new.join(unsent(roots.select("id", F.col("root").alias("old"))), "id").where("root <> old").limit(1).count()
        roots = new
        if not changed:
            return roots


def near_duplicates(documents: DataFrame, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, class_id, links, copies, text_hash and first of each document (doc_id, text).

    class_id is the least doc_id of the document's class: documents are in one class if a chain of links connects them.
    links is the number of other distinct fingerprints within DISTANCE that share a bucket with the document's in any
    table, and copies the number of documents with the document's own fingerprint, itself among them; equal texts have
    equal fingerprints. first marks the document of the class with the least doc_id and, of those, the least text_hash;
    all of equal rows are marked. A text without words (null: empty) is like its exact copies alone. A null doc_id
    counts as the least. Repeated rows give repeated rows, no documents none; other columns are ignored.
    """
    lowest = -(1 << 63)
    f = materialize(fingerprints(documents).withColumn("number", F.coalesce("doc_id", F.lit(lowest))), "fingerprints")
    rows = f.groupBy("fingerprint").agg(F.min(F.struct("number", "text_hash")).alias("least"), F.count(F.lit(1)).alias("copies"))
    # a number for each fingerprint, from the fingerprint itself; two with one number are unlikely even among 10^9, and caught
    rows = materialize(rows.select(F.xxhash64("fingerprint").alias("id"), F.col("fingerprint").alias("fp"), "least", "copies"), "rows")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("two fingerprints with one number")
    links = materialize(near_links(rows, tables, bucket_rows), "links")
    roots = components(links)
    by = links.groupBy("id").agg(F.sum("links").alias("links"))
    r = rows.join(unsent(roots), "id", "left").join(unsent(by), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = r.groupBy("root").agg(F.min("least").alias("class"))
    r = materialize(r.join(unsent(least), "root").select("fp", "copies", "class", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    # only fingerprints of several rows can be hot; fewer than 1000 have more than a thousandth of the rows each
    total = f.count()
    hot = F.broadcast(r.where(F.col("copies") > total / 1000).select(*[F.col(c).alias(f"h{c}") for c in r.columns]))
    j = f.join(hot, F.col("fingerprint") == F.col("hfp"), "left")
    key = F.when(F.col("hfp").isNull(), F.col("fingerprint")).otherwise(F.xxhash64("doc_id").cast("string").cast("binary"))
    cold = r.where(F.col("copies") <= total / 1000)
    j = j.withColumn("key", key).join(unsent(cold), F.col("key") == F.col("fp"), "left").withColumn("class", F.coalesce("hclass", "class"))
    first = (F.col("class.number") == F.col("number")) & (F.col("class.text_hash") == F.col("text_hash"))
    class_id = F.when(F.col("class.number") != lowest, F.col("class.number"))
    return j.select("doc_id", class_id.alias("class_id"), F.coalesce("hlinks", "links").alias("links"), F.coalesce("hcopies", "copies").alias("copies"), "text_hash", first.alias("first"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")
