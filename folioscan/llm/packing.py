"""Packing of documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of the squared lengths of its pieces).
All three are functions of a piece's length, so the plan is made from the histogram of lengths, which has at most
`capacity` entries whatever the size of the corpus: sequences with equal residuals form one group, and the pieces of a
length fill a group's sequences one after the other. A piece then finds its place by its length and its rank among the
pieces of that length. The plan is the one that best fit gives piece by piece, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, number_gapless, only, ordered_part, range_bounds, read_table

CAPACITY, END_ID = 1024, 2
#: By default neither of these binds before the tokens do.
MAX_DOCUMENTS, MAX_COST = CAPACITY, CAPACITY * CAPACITY
#: Of tokens, documents and cost, in the dot product and the norm.
WEIGHTS = (1.0, 0.1, 0.1)
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoding(path: str | None):
    """The byte-level BPE of a rank file with the added tokens of the tokenizer file beside it, so that it gives the
    ids of byte_bpe_50k.json without its special tokens around the text."""
    import base64
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    beside = Path(path).with_suffix(".json")
    added = {t["content"]: t["id"] for t in json.loads(beside.read_text())["added_tokens"]} if beside.exists() else {}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(text: str, path: str | None = None) -> list[int]:
    """The ids of a text; an added token that is written in it is one id."""
    return encoding(path).encode(text, allowed_special="all", disallowed_special=())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what the others leave."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or "", path), END_ID], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(documents, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: float = MAX_COST, rule: str = "norm", weights: tuple = WEIGHTS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, each, first sequence, offset): the count pieces of a length from that rank on
    go to consecutive sequences, `each` of them to one after another from that offset on.

    Lengths are taken in descending order. Each piece goes to the sequence that it fits under all capacities and that
    the rule prefers: `norm`, the least weighted norm of what remains free; `dot`, the greatest weighted dot product of
    its demand and the free capacities; of equals to the first sequence opened. If it fits none, one is opened. A piece
    that fits no empty sequence is an error.

    Under `norm` a sequence that took a piece is preferred for the next of this length as long as it fits, and a newly
    opened one is the only one that fits under either rule. Under `dot` a sequence that took a piece comes after its
    group. So whole groups are filled at once, and the result is that of single pieces.
    """
    caps = np.array([capacity, max_documents, max_cost], float)
    w = np.array(weights, float)
    # groups: free tokens, documents, cost, sequences, first sequence, tokens used; emptied ones are reused
    free, many, first, used = np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
    size, spare, runs, opened = 0, [], [], 0

    def add(state: np.ndarray, n: int, at: int, tokens: int) -> None:
        nonlocal free, many, first, used, size
        if not n:
            return
        if spare:
            g = spare.pop()
        else:
            if size == len(many):
                free, many, first, used = np.vstack([free, np.zeros_like(free)]), np.append(many, many * 0), np.append(first, first * 0), np.append(used, used * 0)
            g, size = size, size + 1
        free[g], many[g], first[g], used[g] = state, n, at, tokens

    for length in sorted(histogram, reverse=True):
        rest, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while rest:
            fits = (many[:size] > 0) & (free[:size] >= need).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                if rule == "dot":
                    score = -((free[at] / caps) * (need / caps) * w).sum(axis=1)
                else:
                    score = ((((free[at] - need) / caps) ** 2) * w).sum(axis=1)
                g = int(at[np.lexsort((first[at], score))[0]])
                state, begin, offset, here = free[g].copy(), int(first[g]), int(used[g]), int(many[g])
                room = 1 if rule == "dot" else int((state // need).min())
            else:
                state, begin, offset = caps.copy(), opened, 0
                room = int((caps // need).min())
                here = -(-rest // room)
                opened += here
                g = None
            full, over = min(here, rest // room), 0
            if full < here:
                over = rest - full * room  # of one sequence more, fewer than room
            touched = full + (over > 0)
            if g is not None:
                many[g] -= touched
                first[g] += touched
                if not many[g]:
                    spare.append(g)
            if full:
                runs.append((length, rank, full * room, room, begin, offset))
                add(state - room * need, full, begin, offset + room * length)
            if over:
                runs.append((length, rank + full * room, over, over, begin + full, offset))
                add(state - over * need, 1, begin + full, offset + over * length)
            rank += full * room + over
            rest -= full * room + over
    return runs


def pack(documents: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: float = MAX_COST, rule: str = "norm", path: str | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text (null: empty) and END_ID, so an empty one has a piece of one id. Only a
    document of more than `capacity` ids is cut; its first piece takes the remainder. Repeated rows are documents of
    their own. No documents give no rows; other columns are ignored.
    """
    pieces = materialize(tokenize(documents, capacity, path), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity, max_documents, max_cost, rule))
    table = np.array(runs, np.int64).reshape(-1, 6)
    starts = table[:, 0] << 44 | table[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy(np.int64)
        length = length.to_numpy(np.int64)
        at = np.searchsorted(starts, length << 44 | rank, "right") - 1
        sequence, place = np.divmod(rank - table[at, 1], table[at, 3])
        return pd.DataFrame({"sequence_id": table[at, 4] + sequence, "offset": table[at, 5] + place * length})

    bounds = range_bounds(pieces, "doc_id", sum(histogram.values()))
    pieces = pieces.withColumn("_part", ordered_part(F.col("doc_id"), F.col("ids_crc32"), bounds))
    ranked = number_gapless(pieces, ["length"], "_part", [F.col("doc_id"), F.col("ids_crc32"), F.col("piece")], "_rank")
    return ranked.withColumn("_at", find("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
