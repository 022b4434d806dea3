"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. A row descends level by level: at each node it draws for every child an
exponential variate, a hash of the row's key and the child divided by the child's weight, and goes to the child with
the least; a rack weighs as much as its shards together and a region as its racks. So a row is at a child with a
probability in proportion to its weight, and a change of weights moves rows only into or out of the nodes that it is
above: within any other subtree every row stays where it is.

The first BASE shards fill racks and regions. Each further shard is a rack and a region of its own, so the draws among
the others stay as they are and rows move into the new shard alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, number_gapless, only, ordered_part, range_bounds, read_table

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 40, 4, 5
#: Shards that share racks and regions.
BASE = 40
PRIME = (1 << 31) - 1
#: Of the numbers of the nodes that are drawn for.
REGION, RACK, SHARD = 1 << 26, 1 << 27, 0

Tree = list[tuple[int, list[tuple[int, list[tuple[int, float]]]]]]


def tree(shards: int, weights: dict[int, float] | None = None, per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION, base: int = BASE) -> Tree:
    """Regions (number, racks) of racks (number, shards) of shards (number, weight)."""
    weigh = lambda s: (s, float((weights or {}).get(s, 1.0)))
    shared = min(shards, base)
    racks = [(r // per_rack, [weigh(s) for s in range(r, min(r + per_rack, shared))]) for r in range(0, shared, per_rack)]
    regions = [(r // per_region, racks[r : r + per_region]) for r in range(0, len(racks), per_region)]
    return regions + [(base + s, [(base + s, [weigh(s)])]) for s in range(base, shards)]


def constant(node: int) -> int:
    """A fixed number in 1..PRIME-1 for each node, far from its neighbours'."""
    return (node + 1) * 1_103_515_245 % PRIME or 1


def key_parts(key: Column) -> list[Column]:
    """Four numbers below 2^31 from the MD5 of a key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") % PRIME for i in range(4)]


def draws(parts: list[np.ndarray], node: int, weight: float) -> np.ndarray:
    """-ln(u) / weight, with u from a cubic polynomial in the node's constant over the field of PRIME; infinite for a
    node without weight."""
    if not weight:
        return np.full(len(parts[0]), np.inf)
    c = constant(node)
    x = parts[0]
    for p in parts[1:]:
        x = (x * c + p) % PRIME
    return -np.log((x + 0.5) / PRIME) / weight


def choose(parts: list[np.ndarray], nodes: list[tuple[int, float]]) -> np.ndarray:
    """The place in the list of the node (number, weight) with the least draw for each key; the first of equals."""
    if len(nodes) == 1:
        return np.zeros(len(parts[0]), np.int64)
    return np.stack([draws(parts, n, w) for n, w in nodes]).argmin(axis=0)


def descend(parts: list[np.ndarray], regions: Tree) -> np.ndarray:
    """The shard of each key, level by level."""
    out = np.empty(len(parts[0]), np.int32)
    weigh = lambda rack: sum(w for _, w in rack[1])
    region_at = choose(parts, [(REGION + r, sum(map(weigh, racks))) for r, racks in regions])
    for i, (_, racks) in enumerate(regions):
        in_region = np.flatnonzero(region_at == i)
        own = [p[in_region] for p in parts]
        rack_at = choose(own, [(RACK + rack[0], weigh(rack)) for rack in racks])
        for k, (_, shards) in enumerate(racks):
            in_rack = np.flatnonzero(rack_at == k)
            shard_at = choose([p[in_rack] for p in own], [(SHARD + s, w) for s, w in shards])
            out[in_region[in_rack]] = np.array([s for s, _ in shards], np.int32)[shard_at]
    return out


def place(df: DataFrame, key: str, shards: int, name: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds the shard of each row: a function of the key, the number of shards and their weights alone. A null key is
    a key of its own. Rows with equal keys share a shard."""
    regions = tree(shards, weights)

    @F.pandas_udf("int")
    def find(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(descend([x.to_numpy(np.int64) for x in (a, b, c, d)], regions), dtype="int32")

    return df.withColumn(name, find(*key_parts(F.col(key))))


def shard_documents(documents: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document (doc_id, text).

    The law is `key`: doc_id and the tree decide. grown_shard is the shard in the tree with one more, of weight 1: from
    BASE shards on it is the old one or the new; below, where the new one joins a rack, rows move within its region or
    into it. slot numbers a shard's documents from 0 by doc_id (null first), then text_crc32
    and size; repeated rows have slots of their own. A null text has size 16 and the CRC of no bytes. No documents
    give no rows; other columns are ignored.
    """
    d = only(documents, doc_id="bigint", text="string")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = d.select("doc_id", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).cast("bigint").alias("text_crc32"))
    d = place(place(d, "doc_id", shards, "shard", weights), "doc_id", shards + 1, "grown_shard", weights)
    d = materialize(d, "shards")
    bounds = range_bounds(d, "doc_id", d.count())
    d = d.withColumn("_part", ordered_part(F.col("doc_id"), F.col("text_crc32"), bounds))
    d = number_gapless(d, ["shard"], "_part", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
