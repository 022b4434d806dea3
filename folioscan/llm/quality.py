"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are characters. Its counts stay in tables sharded by n-gram. The n-grams of the corpus, each once,
are joined order by order with the counts, the contexts' sums and the probabilities of the shorter n-grams, so the
tables that meet grow with the distinct n-grams and not with the text. Texts are shuffled once, those of the folds that
are counted, and only to meet more trusted ids than may be sent. The resulting
probabilities are sent to the tasks, slice by slice, if they are few enough; if not, each bucket of documents is joined with those it
needs. A document is rejected if its perplexity exceeds a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import materialize, read_table, schema, unsent

ORDER = 5
#: One fold in FOLDS of the trusted documents sets the thresholds, and all of it. The counts come from all of the
#: others, so no document is judged by a model that has seen the ones that set its threshold.
FOLDS = 4
#: Ids of the documents counted that may be sent to every task; the texts are shuffled to meet more of them.
SENT_IDS = 10_000
#: Of the trusted documents of a language in that fold, and the fewest that a language of its own needs.
QUANTILE, LEAST_TRUSTED = 0.995, 20
#: Log-perplexity that is allowed above the quantile, and more for a short text: this over the root of its symbols.
SLACK, SHORT_SLACK = 0.1, 4.0
#: Rows of probabilities (16 bytes each) that may be sent to every task, and of those that the driver holds at once, about.
SENT_ROWS, HELD_ROWS = 3_000_000, 500_000
#: Characters handled at once; documents of a bucket in the way by buckets, about.
CHUNK_CHARS, BUCKET_DOCS = 2_000_000, 5_000
BEGIN, END = "\x02", "\x03"
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(3, 3 + 16)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each window of n codes."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out += codes[k : len(codes) - n + 1 + k].astype(np.uint64) * np.uint64(_MULTIPLIERS[k])
    out ^= out >> np.uint64(31)
    return out.view(np.int64)


def normal(text: str | None) -> str:
    """White space runs are one space; the signs of beginning and end don't occur in a text."""
    return " ".join((text or "").replace(BEGIN, " ").replace(END, " ").split())


def _windows(texts: list[str], n: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The padded texts in one, the places of their n-grams, the keys there, and each text's first among them."""
    joined = "".join(BEGIN * (n - 1) + t + END for t in texts)
    lengths = np.array([len(t) + n for t in texts])
    ends = np.cumsum(lengths)
    keys = _keys(_codes(joined), n)
    inside = np.ones(len(joined), bool)
    for k in range(1, n):
        inside[ends - k] = False
    at = np.flatnonzero(inside)
    counts = lengths - (n - 1)
    return joined, at, keys[at[at < len(keys)]], np.cumsum(counts) - counts


def _firsts(codes: np.ndarray) -> np.ndarray:
    """The first place of each code."""
    first = np.empty(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with some CHUNK_CHARS of normalised text each."""
    for b in batches:
        texts, start, held = [], 0, 0
        for k, t in enumerate(b.column(column)):
            texts.append(normal(t.as_py()))
            held += len(texts[-1])
            if held >= CHUNK_CHARS:
                yield b.slice(start, k + 1 - start), texts
                texts, start, held = [], k + 1, 0
        if texts:
            yield b.slice(start), texts


def count_grams(texts: DataFrame, n: int) -> DataFrame:
    """g, c: how often each n-gram occurs in a table with a column of texts. Tasks add up their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for _, ts in _chunks(batches, 0):
            joined, at, keys, _ = _windows(ts, n)
            codes, _ = pd.factorize(keys)
            for p, c in zip(at[_firsts(codes)].tolist(), np.bincount(codes).tolist()):
                g = joined[p : p + n]
                total[g] = total.get(g, 0) + c
            if len(total) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["g", "c"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["g", "c"])

    return texts.mapInArrow(count, "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def distinct_grams(texts: DataFrame, n: int) -> DataFrame:
    """g: each n-gram of a table with a column of texts, once. Tasks drop their own repetitions first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for _, ts in _chunks(batches, 0):
            joined, at, keys, _ = _windows(ts, n)
            codes, unique = pd.factorize(keys)
            new = ~np.isin(unique, seen)
            if new.any():
                places = at[_firsts(codes)[new]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([joined[p : p + n] for p in places], pa.string())], ["g"])
                seen = np.sort(np.concatenate([seen, unique[new]]))
                if len(seen) > 2_000_000:
                    seen = np.empty(0, np.int64)

    return texts.mapInArrow(find, "g string").distinct()


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, each between 0 and its count."""
    n1, n2, n3, n4 = (counts_of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


class Counts:
    """Counts by order (the highest of occurrences, the others of distinct preceding symbols), and discounts."""

    def __init__(self, highest: DataFrame, n: int = ORDER):
        self.n, self.c, self.d = n, {n: materialize(highest, "counts")}, {}
        for k in range(n - 1, 0, -1):
            self.c[k] = materialize(self.c[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c")), "counts")
        for k in range(1, n + 1):
            of = self.c[k].where("c <= 4").groupBy("c").count()
            self.d[k] = discounts({r[0]: r[1] for r in of.collect()})
        self.symbols = self.c[1].count()

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """g, p of each of a table's distinct n-grams."""
        asked = {self.n: grams}
        for k in range(self.n - 1, 0, -1):
            asked[k] = asked[k + 1].select(F.substring("g", 2, k).alias("g")).distinct()
        lower = None
        for k in range(1, self.n + 1):
            d1, d2, d3 = self.d[k]
            c = self.c[k]
            context = c.groupBy(F.substring("g", 1, k - 1).alias("h")).agg(
                F.sum("c").alias("total"), (d1 * F.sum((F.col("c") == 1).cast("int")) + d2 * F.sum((F.col("c") == 2).cast("int")) + d3 * F.sum((F.col("c") >= 3).cast("int"))).alias("left")
            )
            q = asked[k].join(unsent(c), "g", "left").withColumn("h", F.substring("g", 1, k - 1)).join(unsent(context), "h", "left")
            own = F.coalesce((F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)) / F.col("total"), F.lit(0.0))
            rest = F.coalesce(F.col("left") / F.col("total"), F.lit(1.0))
            if lower is None:
                p = own + rest / (self.symbols + 1)
            else:
                q = q.withColumn("s", F.substring("g", 2, k - 1)).join(unsent(lower.select(F.col("g").alias("s"), F.col("p").alias("ps"))), "s")
                p = own + rest * F.col("ps")
            lower = q.select("g", p.alias("p"))
        return lower


#: Slices of the probabilities: sorted keys, and their logarithms.
Slices = list[tuple[np.ndarray, np.ndarray]]


def _logs(keys: np.ndarray, slices: Slices) -> np.ndarray:
    """The logarithms of keys, each of which one of the slices has."""
    out = np.full(len(keys), np.nan)
    for known, logs in slices:
        if len(known):
            inside = np.flatnonzero((keys >= known[0]) & (keys <= known[-1]))
            at = np.searchsorted(known, keys[inside])
            hit = known[at] == keys[inside]
            out[inside[hit]] = logs[at[hit]]
    if np.isnan(out).any():
        raise ValueError("an n-gram without a probability")
    return out


def _score(texts: list[str], n: int, slices: Slices) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of the logarithms and the number of symbols; slices have all n-grams."""
    _, _, own, starts = _windows(texts, n)
    codes, unique = pd.factorize(own)
    return np.add.reduceat(_logs(unique, slices)[codes], starts), np.array([len(t) + 1 for t in texts])


SCORED = "doc_id bigint, lang string, text_hash bigint, symbols bigint, log_perplexity double"


def _scored(b: pa.RecordBatch, texts: list[str], n: int, slices: Slices) -> pa.RecordBatch:
    sums, symbols = _score(texts, n, slices)
    nll = [None if not t else float(x) for t, x in zip(texts, -sums / symbols)]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(symbols, pa.int64()), pa.array(nll, pa.float64())], ["doc_id", "lang", "text_hash", "symbols", "log_perplexity"])


def _sorted(grams: pa.ChunkedArray, p: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and logarithms of a table of n-grams; their characters are read as one text."""
    parts = [c.cast(pa.large_string()) for c in grams.chunks if len(c)]
    texts = []
    for c in parts:
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, np.int64)[[c.offset, c.offset + len(c)]]
        texts.append(data[int(at[0]) : int(at[1])].to_pybytes())
    codes = _codes(b"".join(texts).decode())
    keys, logs = (_keys(codes, n)[::n] if len(codes) else np.empty(0, np.int64)), np.log(p.to_numpy())
    at = np.argsort(keys, kind="stable")
    return keys[at], logs[at]


def _send(p: DataFrame, rows: int, n: int) -> list[Broadcast]:
    """The rows (g, p) of a table of n-grams as broadcast slices. Tasks turn the n-grams into keys, and the driver holds
    one slice at a time, the keys with the same first bits."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, logs = _sorted(pa.chunked_array([b.column(0)]), pa.chunked_array([b.column(1)]), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs)], ["key", "log"])

    keyed, sent = materialize(p.select("g", "p").mapInArrow(key, "key bigint, log double"), "keys"), []
    bits = (max(0, rows - 1) // HELD_ROWS).bit_length()
    for k in range(1 << bits):
        part = keyed.where(F.shiftrightunsigned("key", 64 - bits) == k) if bits else keyed
        table = part.toArrow()
        keys = table.column("key").to_numpy()
        at = np.argsort(keys, kind="stable")
        sent.append(p.sparkSession.sparkContext.broadcast((keys[at], table.column("log").to_numpy()[at])))
    return sent


def score(documents: DataFrame, counts: Counts, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, lang, text_hash, symbols and log_perplexity (null for a text without symbols) of each of documents."""
    n = counts.n
    texts = documents.select("text")
    p = materialize(counts.probabilities(materialize(distinct_grams(texts, n), "grams")), "probabilities")
    d = documents.select("doc_id", "lang", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    if (rows := p.count()) <= sent_rows:
        sent = _send(p, rows, n)

        def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices = [s.value for s in sent]
            for b, ts in _chunks(batches, 3):
                yield _scored(b, ts, n, slices)

        return d.mapInArrow(score_all, schema(SCORED))
    # by buckets of documents, each with the probabilities of its own n-grams
    buckets = max(8, documents.count() // BUCKET_DOCS)
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ts in _chunks(batches, 1):
            joined, at, keys, starts = _windows(ts, n)
            owner = np.repeat(np.array(b.column(0).to_pylist(), np.int64), np.diff(np.append(starts, len(keys))))
            pairs = pd.DataFrame({"bucket": owner, "key": keys, "at": at}).drop_duplicates(["bucket", "key"])
            yield pa.RecordBatch.from_arrays([pa.array(pairs["bucket"], pa.int32()), pa.array([joined[k : k + n] for k in pairs["at"]], pa.string())], ["bucket", "g"])

    asked = d.select("bucket", "text").mapInArrow(ask, "bucket int, g string").distinct().join(unsent(p), "g").select("bucket", "g", "p")

    def score_bucket(docs: pa.Table, probs: pa.Table) -> pa.Table:
        slices = [_sorted(probs.column("g"), probs.column("p"), n)]
        out = [_scored(b, ts, n, slices) for b, ts in _chunks(iter(docs.select(["doc_id", "lang", "text_hash", "text"]).to_batches()), 3)]
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64()), ("symbols", pa.int64()), ("log_perplexity", pa.float64())]))

    return d.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(score_bucket, schema(SCORED))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the labelled documents of good quality that aren't toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> DataFrame:
    """lang, threshold: the quantile of the log-perplexity, less what a short text is allowed, in thousandths, of the
    documents given, by language; a language with fewer than least takes that of all. The histograms have some
    thousand bins a language."""
    s = scored.join(unsent(trusted), "doc_id", "left_semi").where("log_perplexity is not null")
    bins = s.select("lang", F.floor((F.col("log_perplexity") - SHORT_SLACK / F.sqrt("symbols")) * 1000).alias("bin")).groupBy("lang", "bin").count()
    bins = materialize(bins, "bins")

    def cut(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys or [F.lit(0)])
        df = df.groupBy(*keys, "bin").agg(F.sum("count").alias("count"))
        df = df.withColumn("below", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
        return df.where(F.col("below") >= quantile * F.col("all")).groupBy(*keys).agg(((F.min("bin") + 1) / 1000).alias("cut"), F.max("all").alias("n"))

    whole = cut(bins, []).first()
    langs = scored.select("lang").distinct()
    own = cut(bins, ["lang"]).where(F.col("n") >= least).select(F.col("lang").alias("own_lang"), F.col("cut").alias("own"))
    t = langs.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    return t.select("lang", F.coalesce("own", F.lit(whole[0] if whole else None).cast("double")).alias("threshold"))


def judge(documents: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, lang, symbols, perplexity, threshold, keep and text_hash of each document (doc_id, lang, text).

    labels has doc_id, quality and toxic; trusted are documents with quality 1 that aren't toxic. symbols counts the
    characters, white space runs as one, and the end. A text without symbols (null too) has no perplexity and isn't
    kept. threshold is the largest perplexity that is kept, by language and length; without trusted documents it is
    null and all texts are kept. A null lang is a language of its own. Repeated rows give repeated rows, no documents
    none; other columns are ignored.
    """
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = trusted_ids(labels)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))
    chosen = materialize(trusted.where(fold != 0), "trusted")
    ids = F.broadcast(chosen) if chosen.count() <= SENT_IDS else unsent(chosen)
    counts = Counts(count_grams(d.where(fold != 0).join(ids, "doc_id", "left_semi").select("text"), order), order)
    scored = materialize(score(d, counts, sent_rows), "scored")
    t = thresholds(scored, trusted.where(fold == 0), quantile)
    t = t.select(F.col("lang").alias("t_lang"), "threshold")
    limit = F.exp(F.col("threshold") + SHORT_SLACK / F.sqrt("symbols") + SLACK)
    # a row for each language: joined by shuffle unless Spark finds it small
    j = scored.join(t, scored.lang.eqNullSafe(F.col("t_lang")), "left")
    p = F.exp("log_perplexity")
    return j.select("doc_id", "lang", "symbols", p.alias("perplexity"), limit.alias("threshold"), F.coalesce(p <= limit, p.isNotNull()).alias("keep"), "text_hash")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
