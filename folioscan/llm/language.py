"""Language identification by words first, with character n-grams for the words that no language knows.

A known word scores in each language the negative decimal logarithm of its relative frequency there, or PENALTY if it
doesn't occur. An unseen word scores the mean of its longest n-grams of which any is known, from MAX_N characters down
to one. A text scores the mean over its words and takes the language with the least.

No count is left out: the scores of the most frequent words are sent to the tasks, and the other words of the texts are
joined with the tables of all words and n-grams. Which words are sent changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, read_table, unsent

MAX_N, PENALTY, UNKNOWN = 5, 7.0, "und"
#: Most words, about, whose scores are sent to the tasks.
MODEL_WORDS = 200_000
#: Of the CRC of doc_id modulo FOLDS, this one is held out of training.
FOLDS, HELD_OUT = 4, 2
#: Words that count as evidence in the score, at most.
EVIDENCE = 10
#: A counter is passed on at this many entries; unseen words are kept up to as many.
HELD = 400_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The maximal runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def has_letter(found: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in found)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


COUNTS = "lang string, item string, n bigint"


def _batch(counts: Counter) -> pa.RecordBatch:
    langs, items = zip(*counts) if counts else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "item", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            by.setdefault(lang, Counter()).update(words(text.as_py()))
        if sum(map(len, by.values())) > HELD:
            yield _batch({(k, w): n for k, c in by.items() for w, n in c.items()})
            by = {}
    yield _batch({(k, w): n for k, c in by.items() for w, n in c.items()})


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, dict] = {}
    for b in batches:
        for lang, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            c = by.setdefault(lang, {})
            get = c.get
            for k in range(1, MAX_N + 1):
                for g in grams(word, k):
                    c[g] = get(g, 0) + n
        if sum(map(len, by.values())) > HELD:
            yield _batch({(k, w): n for k, c in by.items() for w, n in c.items()})
            by = {}
    yield _batch({(k, w): n for k, c in by.items() for w, n in c.items()})


def _scores(counts: DataFrame, total, langs: list[str]) -> DataFrame:
    """item, n and a score by language, s0, s1, ..., of all items of counts; total is a function of a language to a
    column."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{k}") for k, x in enumerate(langs)]
    by = counts.groupBy("item").agg(F.sum("n").alias("n"), *each)
    score = lambda k, x: F.coalesce(F.least(F.lit(PENALTY), -F.log10(F.col(f"n{k}") / total(x))), F.lit(PENALTY)).cast("float")
    return by.select("item", "n", *[score(k, x).alias(f"s{k}") for k, x in enumerate(langs)])


def _frequent(scores: DataFrame, bound: int) -> DataFrame:
    """The rows of the most frequent items, at most bound: all with a count over the least one that fits."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096)
    hist = sorted(((r[0], r[1]) for r in scores.groupBy(level).count().collect()), reverse=True)  # at most 4097 rows
    total, least = 0, None
    for n, rows in hist:
        if total + rows > bound:
            break
        total, least = total + rows, n
    return scores.orderBy(F.desc("n"), "item").limit(bound) if least is None else scores.where(F.col("n") >= least)


class Entry(NamedTuple):
    lang: str
    item: str
    n: int


class Model:
    """Words and n-grams as rows of a matrix of scores by language; picklable."""

    def __init__(self, word_rows: list, gram_rows: list, totals: dict[str, int], gram_totals: dict[tuple[str, int], int]):
        self.langs = sorted(totals)
        column = {lang: k for k, lang in enumerate(self.langs)}

        def table(rows: list, total) -> tuple[dict[str, int], np.ndarray]:
            index: dict[str, int] = {}
            for r in rows:
                index.setdefault(r.item, len(index))
            m = np.full((len(index), len(self.langs)), PENALTY, np.float32)
            for r in rows:
                m[index[r.item], column[r.lang]] = min(PENALTY, -np.log10(r.n / total(r)))
            return index, m

        self.words, self.word_scores = table(word_rows, lambda r: totals[r.lang])
        self.grams, self.gram_scores = table(gram_rows, lambda r: gram_totals[r.lang, len(r.item)])

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(MAX_N, len(word) + 2), 0, -1):
            if at := [k for g in grams(word, n) if (k := self.grams.get(g)) is not None]:
                return self.gram_scores[at].mean(axis=0)
        return np.full(len(self.langs), PENALTY, np.float32)

    def predictor(self):
        """A function from a text to (language, score); it remembers unseen words."""
        index, matrix, extra = dict(self.words), self.word_scores, np.empty((1024, len(self.langs)), np.float32)
        known, used = len(index), 0

        def predict(text: str | None) -> tuple[str, float]:
            nonlocal index, extra, used
            found = words(text)
            if not self.langs or not has_letter(found):
                return UNKNOWN, 0.0
            at = list(map(index.get, found))
            if None in at:
                for i, k in enumerate(at):
                    if k is None:
                        w = found[i]
                        if (k := index.get(w)) is None:
                            k = index[w] = known + used
                            if used == len(extra):
                                extra = np.vstack([extra, np.empty_like(extra)])
                            extra[used] = self.unseen(w)
                            used += 1
                        at[i] = k
            rows = np.array(at)
            new = rows >= known
            total = matrix[rows[~new]].sum(axis=0, dtype=np.float64) + extra[rows[new] - known].sum(axis=0, dtype=np.float64)
            mean = total / len(rows)
            best = int(mean.argmin())
            p = np.exp((mean[best] - mean) * np.log(10) * min(len(rows), EVIDENCE))
            if used > HELD:
                index, used = dict(self.words), 0
            return self.langs[best], float(1 / p.sum())

        return predict


def train(documents: DataFrame) -> Counts:
    """Counts the words of all documents (doc_id, text, lang) outside the held-out fold with a language. Without any,
    the model predicts nothing. The language UNKNOWN isn't learned."""
    d = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("out"), F.col("doc_id").isNotNull().alias("has"))
    d = d.where(~F.col("out") & F.col("has") & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull()).select("lang", "text")
    counts = materialize(d.mapInArrow(_count_words, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    by_gram = materialize(counts.mapInArrow(_count_grams, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")), "grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    gram_totals = {(r[0], r[1]): r[2] for r in by_gram.groupBy("lang", F.length("item")).agg(F.sum("n")).collect()}
    return Counts(counts, by_gram, totals, gram_totals)


class Counts(NamedTuple):
    """All counts as tables (lang, item, n), and their totals."""

    words: DataFrame
    grams: DataFrame
    totals: dict[str, int]
    gram_totals: dict[tuple[str, int], int]

    def predictor(self):
        """Model.predictor() with all counts on the driver, for small tables."""
        word_rows, gram_rows = ([Entry(*r) for r in t.select("lang", "item", "n").collect()] for t in (self.words, self.grams))
        return Model(word_rows, gram_rows, self.totals, self.gram_totals).predictor()


def _unseen(words_: DataFrame, gram_scores: DataFrame, langs: list[str]) -> DataFrame:
    """item and scores of words (item) that no language knows, as Model.unseen() has them."""
    s = [f"s{k}" for k in range(len(langs))]

    def spread(sizes: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 5000):
                    found = [(w, g) for w in b.column(0).slice(at, 5000).to_pylist() for n in sizes for g in grams(w, n)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], ["word", "item"])

        return run

    left, parts = words_, []
    for sizes in ((MAX_N,), tuple(range(MAX_N - 1, 0, -1))):  # most words have a known n-gram of the most characters
        known = left.mapInArrow(spread(sizes), "word string, item string").join(unsent(gram_scores), "item")
        by = known.groupBy("word", F.length("item").alias("size")).agg(*[F.avg(x).cast("float").alias(x) for x in s])
        best = by.groupBy("word").agg(F.max_by(F.struct(*s), "size").alias("v")).select(F.col("word").alias("item"), "v.*")
        parts.append(materialize(best, "backed"))
        left = materialize(left.join(unsent(parts[-1]), "item", "left_anti"), "left")
    return parts[0].unionByName(parts[1]).unionByName(left.select("item", *[F.lit(PENALTY).cast("float").alias(x) for x in s]))


def predictions(texts: DataFrame, counts: Counts) -> DataFrame:
    """The columns of texts other than text, and lang_pred and score. texts has text and key, which is equal for equal
    texts alone. A text that is null or has no letter is `und` with score 0. Equal means go to the first language in
    order."""
    langs = sorted(counts.totals)
    others = [c for c in texts.columns if c != "text"]
    if not langs:
        return texts.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    s = [f"s{k}" for k in range(len(langs))]
    word_scores = materialize(_scores(counts.words, lambda x: F.lit(float(counts.totals[x])), langs), "scores")
    by_size = lambda x: F.element_at(F.create_map(*[F.lit(v) for n in range(1, MAX_N + 1) for v in (n, float(counts.gram_totals.get((x, n), 1)))]), F.length("item"))
    gram_scores = _scores(counts.grams, by_size, langs).drop("n")
    frequent = _frequent(word_scores, MODEL_WORDS).select("item", *s).toArrow()
    matrix = np.stack([frequent.column(x).to_numpy() for x in s], axis=1).astype(np.float32)
    sent = texts.sparkSession.sparkContext.broadcast((frequent.column("item").combine_chunks(), matrix))
    width = len(langs)

    def known_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, m = sent.value
        index = {w: k for k, w in enumerate(items.to_pylist())}
        for b in batches:
            sums, number, rest, times = [], [], [], []
            for x in b.column(b.num_columns - 1):
                found = words(x.as_py())
                if not has_letter(found):
                    found = []
                at = list(map(index.get, found))
                other = Counter(w for w, k in zip(found, at) if k is None) if None in at else {}
                if other:
                    at = [k for k in at if k is not None]
                sums.append(m[at].sum(axis=0, dtype=np.float64) if at else np.zeros(width))
                number.append(len(found))
                rest.append(list(other))
                times.append(list(other.values()))
            flat = pa.array(np.concatenate(sums) if sums else np.zeros(0), pa.float64())
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), flat)
            new = [total, pa.array(number, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*others, "total", "number", "rest", "times"])

    source = texts.select(*others, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    p = materialize(source.mapInArrow(known_part, f"{kept}, total array<double>, number bigint, rest array<string>, times array<bigint>"), "known")
    # the rest of each distinct text, a row a word
    rest = p.where(F.size("rest") > 0).select("key", "rest", "times").dropDuplicates(["key"])
    rest = materialize(rest.select("key", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("key", F.col("x.rest").alias("item"), F.col("x.times").alias("times")), "rest")
    items = materialize(rest.select("item").distinct(), "items")
    known = items.join(unsent(word_scores.select("item", *s)), "item")
    unseen = materialize(items.join(unsent(word_scores.select("item")), "item", "left_anti"), "unseen")
    scores = materialize(known.unionByName(_unseen(unseen, gram_scores, langs)), "rare")
    more = rest.join(unsent(scores), "item").groupBy("key").agg(F.array(*[F.sum(F.col(x).cast("double") * F.col("times")) for x in s]).alias("more"))
    j = p.join(unsent(more), "key", "left").withColumn("total", F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda a, b: a + b)))
    j = j.withColumn("mean", F.transform("total", lambda x: x / F.greatest("number", F.lit(1)))).withColumn("best", F.array_min("mean"))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("mean", F.col("best")).cast("int"))
    power = F.transform("mean", lambda x: F.exp((F.col("best") - x) * float(np.log(10)) * F.least("number", F.lit(EVIDENCE))))
    score = 1 / F.aggregate(power, F.lit(0.0), lambda a, b: a + b)
    none = F.col("number") == 0
    return j.select(*others, F.when(none, UNKNOWN).otherwise(lang).alias("lang_pred"), F.when(none, 0.0).otherwise(score).alias("score"))


def text_key(text: Column) -> Column:
    """A number of a text; two texts with one number are unlikely even among 10^8."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def identify(documents: DataFrame, counts: Counts | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each document (doc_id, text, lang), by a model trained on
    those of them outside the held-out fold. Prediction reads the text alone. Repeated rows give repeated rows, no
    documents none; a null doc_id is neither held out nor trained on; other columns are ignored."""
    counts = counts or train(documents)
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_key(F.col("text")).alias("key"), "text")
    return predictions(d, counts).select("doc_id", "held_out", "lang_pred", "score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
