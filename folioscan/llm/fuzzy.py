"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk wherever it is -1 modulo the block size, so chunks depend on their
context alone and an edit changes only the chunks it touches. Each chunk gives one of 64 signs. A fingerprint is
`block size:signs at it:signs at its double:signs at its fourfold`. Two fingerprints are compared where they share a block size, by the edit
distance of their signs. All bytes of a text are hashed at once with numpy: the rolling hash as a sum of shifted
arrays, the chunks' hashes as differences of one polynomial prefix sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only, range_bounds, range_of, read_table, schema

WINDOW, LEAST_BLOCK, SIGNS = 7, 3, 64
#: Block sizes of a fingerprint, each the double of the one before.
LEVELS = 3
#: Boundaries below which the block size is halved; signs at most; equal signs in a row at most.
FEW_SIGNS, MOST_SIGNS, RUN = 24, 256, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signs that two signatures must share in a row, else they are unlike; fewer for short signatures.
COMMON = 7
#: Documents that one range of doc_id holds, about.
RANGE_DOCS = 4_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SIGN_CODES = np.frombuffer(ALPHABET.encode(), np.uint8)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse modulo 2^64."""
    out = []
    for base in (_ODD, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: of the last WINDOW bytes, zeros before the first."""
    x = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    out = np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        w = x[WINDOW - 1 - k : WINDOW - 1 - k + n]
        out += w * np.uint32(0x01000193 * pow(0x85EBCA6B, k, 1 << 32) % (1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _signs(sums: np.ndarray, inverse: np.ndarray, ends: np.ndarray, n: int) -> str:
    """A sign for each chunk, the last of which is what follows the last boundary, if anything does; at most
    MOST_SIGNS, of which the last is then of all the rest. Of a run of equal signs RUN stay."""
    ends = ends[: MOST_SIGNS - 1]
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = (sums[ends] - before) * inverse[starts]  # of the chunk's bytes alone, wherever it stands
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    signs = _SIGN_CODES[(h >> np.uint64(58)).astype(np.int64)]
    if len(signs) > RUN:
        same = signs[1:] == signs[:-1]
        kept = np.ones(len(signs), bool)
        kept[RUN:] = ~np.logical_and.reduce([same[k : len(same) - RUN + 1 + k] for k in range(RUN)])
        signs = signs[kept]
    return signs.tobytes().decode()


def fuzzy_hash(raw: bytes) -> str:
    """The fingerprint of some bytes; that of none is `3:::`. The block size is the least of 3, 6, 12, ... at which
    SIGNS of them would cover the text, or the next smaller one at which there are FEW_SIGNS boundaries."""
    n = len(raw)
    if not n:
        return f"{LEAST_BLOCK}" + ":" * LEVELS
    data = np.frombuffer(raw, np.uint8)
    # powers in steps, so that few arrays are ever made
    size = 1 << max(12, (n - 1).bit_length())
    power, inverse = _powers(size) if size <= 1 << 21 else _powers.__wrapped__(size)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)
    r = rolling(data)
    block = LEAST_BLOCK
    while block * SIGNS < n:
        block *= 2
    at = np.flatnonzero(r % np.uint32(block) == block - 1)
    while len(at) < FEW_SIGNS and block > LEAST_BLOCK:
        block //= 2
        at = np.flatnonzero(r % np.uint32(block) == block - 1)
    parts, size = [f"{block}"], block
    for _ in range(LEVELS):  # boundaries of the double are among those of the single
        at = at[r[at] % np.uint32(size) == size - 1]
        parts.append(_signs(sums, inverse, at, n))
        size *= 2
    return ":".join(parts)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over the summed length; 0 without a common run of signs."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(COMMON, min(len(a), len(b)) // 3))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str | None, b: str | None) -> float | None:
    """Of two fingerprints, 0 to 1: the best over the block sizes that both have; 0 if none; null if either is."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (na, *sa), (nb, *sb) = a.split(":"), b.split(":")
    at = {int(na) << k: x for k, x in enumerate(sa)}
    found = max([0.0, *(_alike(x, y) for k, x in enumerate(sb) if (y := at.get(int(nb) << k)) is not None and (x or y))])
    return found if found < 1 else 0.999999  # equal at one block size, but not the same


def fingerprint(text: Column) -> Column:
    """A column of fingerprints of the UTF-8 bytes of a text; a null text is empty."""

    @F.pandas_udf("string")
    def hash_all(t: pd.Series) -> pd.Series:
        return t.map(lambda x: fuzzy_hash(x.encode()))

    return hash_all(F.coalesce(text, F.lit("")))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """A column of the likeness of two columns of fingerprints."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return compare(a, b)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _key(spark: SparkSession, part: Column, parts: list[int]) -> Column:
    """A number for each part that hash partitioning sends to a partition of its own."""
    n = len(parts)
    if n < 2:
        return F.lit(0)
    number = F.col("id").cast("int")
    found = {r[0]: r[1] for r in spark.range(64 * n).groupBy(F.pmod(F.hash(number), F.lit(n))).agg(F.min(number)).collect()}
    at = {p: found.get(k, k) for k, p in enumerate(parts)}
    return F.lit([at.get(p, 0) for p in range(-1, max(parts) + 1)])[part + 1]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(documents: DataFrame) -> DataFrame:
    """The fingerprint of each text (null: empty) and of its edited text, and its likeness to that and to the next.

    The next document is the one before in doc_id, and the last one's is the first; a null doc_id is the least. Rows with
    equal doc_id go by their text, descending, null last. One document is its own next. No documents give no rows; other columns are
    ignored.

    Texts move once, to ranges of doc_id. The first document of a range also goes to the range above it, which it
    follows. Tasks read their ranges in order, one document at a time.
    """
    d = only(documents, doc_id="bigint", text="string")
    ids = materialize(d.select("doc_id"), "ids")
    n = ids.count()
    bounds = range_bounds(ids, "doc_id", n, RANGE_DOCS)
    part = range_of(F.col("doc_id"), bounds)
    # the greatest doc_id of each range: as many rows as ranges, at most 4098
    tops = sorted((r[0], r[1]) for r in ids.groupBy(part.alias("p")).agg(F.max("doc_id").alias("top")).collect())
    above = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    spark = documents.sparkSession
    also = spark.createDataFrame(list(above.items()), "top bigint, above int") if above else spark.createDataFrame([], "top bigint, above int")
    d = d.withColumn("part", part.cast("int")).join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own, lent = F.struct(F.col("part"), F.lit(False).alias("lent")), F.struct(F.col("above").alias("part"), F.lit(True).alias("lent"))
    d = d.select("doc_id", "text", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("to"))
    d = d.select("doc_id", "text", "to.part", "to.lent").withColumn("key", _key(spark, F.col("part"), [p for p, _ in tops]))
    d = d.repartition(max(1, len(tops)), "key").drop("key")
    d = d.sortWithinPartitions("part", "lent", F.desc("doc_id"), F.desc("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the part, doc_id, text and fingerprint of the document that awaits its next
        closed: int | None = None  # the part whose lent document was used
        rows: list[tuple] = []
        for b in batches:
            for doc_id, text, part, lent in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if lent and closed == part:
                    continue  # ties of the first document
                text = text.as_py() or ""
                own = fuzzy_hash(text.encode())
                if held is not None:
                    _, before, t, f = held
                    raw = edited(t, text).encode()
                    g = fuzzy_hash(raw)
                    rows.append((before, len(t), hashlib.sha256(raw).hexdigest(), f, g, likeness(f, g), likeness(f, own)))
                held = None if lent else (part, doc_id, text, own)
                closed = part if lent else closed
            if rows:
                cols = list(zip(*rows))
                rows = []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return d.mapInArrow(compute, schema(RESULT))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))
