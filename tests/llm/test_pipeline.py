"""The stages of the pipeline, each on its own input, and the whole of it."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import language, packing, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, tmp_path):
    rng = random.Random(11)
    syllables = {"en": "th ing er on re at ha".split(), "de": "sch ung ein ich ge zu be".split()}
    clean = lambda k: " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 5))) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choices("XQZ#$%&!", k=6)) for _ in range(60))
    data = []
    for k in range(240):
        lang = rng.choice(["en", "de"])
        data.append((k, junk() if k % 12 == 0 else clean(lang), lang, f"s{k % 3}"))
    data += [(240 + k, data[k + 1][1], data[k + 1][2], "s0") for k in range(20)]  # copies
    data += [(300, None, "en", "s1"), (301, "", None, None), (302, "12 34", "de", "s1"), (None, clean("en"), "en", None), (303, data[5][1], "en", "s2"), (303, data[5][1], "en", "s2")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k % 12 != 0), 0) for k in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return spark.read.parquet(f"{sf}/documents.parquet"), sf


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def slow_copies(found):
    """How often each row stays, by the Poisson distribution of its source's rate."""
    size = Counter()
    for r in found:
        size[r.source] += len(r.text) + 1
    weight = {k: n**0.5 for k, n in size.items()}
    out = Counter()
    for r in found:
        rate = sum(size.values()) * weight[r.source] / sum(weight.values()) / size[r.source]
        u = (int(hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        below = p
        while below <= u:
            n += 1
            p *= rate / n
            below += p
        out[tuple(r)] += n
    return out


def test_stages(spark, tmp_path):
    docs, sf = corpus(spark, tmp_path)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "near-dedup", "mixing", "packing"]
    # language: what a model of the same documents calls und or unclear
    predict = language.train(docs).predictor()
    out = corpus_pipeline.identify_language(spark, docs, sf)
    assert out.columns == COLUMNS
    want = Counter({r: n for r, n in rows(docs).items() if (p := predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE})
    assert rows(out) == want and not {300, 301, 302} & {r[0] for r in want}
    # quality: all that judge() keeps; the junk goes and the clean stays
    docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {(r.doc_id, r.text_hash) for r in quality.judge(docs, labels).where("keep").collect()}
    out = corpus_pipeline.judge_quality(spark, docs, sf)
    assert out.columns == COLUMNS and sum(rows(out).values()) <= docs.count() and {r[0] for r in rows(out)} == {k for k, _ in kept}
    assert {r[0] for r in rows(out) if r[0] is not None and r[0] < 240} >= {k for k in range(240) if k % 12}
    # near duplicates: one row of each class
    docs = spark.createDataFrame(out.collect(), out.schema)
    classes = simhash.near_duplicates(docs).collect()
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert out.columns == COLUMNS and sorted(r[0] if r[0] is not None else -1 for r in rows(out).elements()) == sorted({r.class_id if r.class_id is not None else -1 for r in classes})
    assert not {r[0] for r in rows(out)} & {240 + k for k in range(20)}
    # mixing: each document as often as its draw says
    docs = spark.createDataFrame(out.collect(), out.schema)
    times = slow_copies(docs.collect())
    out = corpus_pipeline.mix_sources(spark, docs, sf)
    assert out.columns == COLUMNS and rows(out) == Counter({k: n for k, n in times.items() if n})
    # packing: every token of every copy has a place
    docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.pack_sequences(spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(len(packing.encode(t)) + 1 for _, t, *_ in docs.collect())
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_quality_stage_counts_all_trusted_documents(spark, tmp_path):
    # a sample by the least hashes of doc_id would never see the texts of those with the greatest
    data = spark.range(60_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FOLDS))
    late = data.where(fold != 0).orderBy("h").offset(40_000).first().h
    text = F.when(F.col("h") >= late, "zyxwv uzyxw vuzyx").otherwise("abcde fabcd efabc")
    docs = data.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    more = spark.createDataFrame([(10**6, "zyxwv uzyxw vuzyx", "en", "s"), (10**6 + 1, "QQQ### QQQ### QQQ", "en", "s")], docs.schema)
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.judge_quality(spark, docs.unionByName(more), str(tmp_path))
    assert [r.doc_id for r in kept.where("doc_id >= 1000000").collect()] == [10**6]


def clashing(df):
    """Further columns with the names that stages and operators use themselves."""
    return df.selectExpr("*", "1 as rate", "2 as copies", "'c' as copy", "'k' as _key", "'h' as _hash", "3 as _id", "4 as _chosen", "5 as _mix_rate", "6 as _mix_source", "7 as key", "'l' as _language", "8 as text_hash", "true as keep", "'x' as class_id")


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    docs, sf = corpus(spark, tmp_path)
    more = clashing(docs)
    for name, stage in corpus_pipeline.STAGES:
        plain, got = stage(spark, docs, sf), stage(spark, more, sf)
        if name != "packing":
            assert got.columns == more.columns
            assert rows(got) == rows(clashing(plain))
            assert rows(got.select("rate", "_hash", "_key", "_mix_rate")) == Counter({(1, "h", "k", 5): sum(rows(plain).values())})
        else:
            assert rows(got.select("doc_id", "piece", "length", "ids_crc32")) == rows(plain.select("doc_id", "piece", "length", "ids_crc32"))
        none = stage(spark, more.limit(0), sf)
        assert none.count() == 0


def test_run_is_its_stages(spark, tmp_path):
    docs, sf = corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert rows(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(docs.select("doc_id", "piece", "start", "length", "ids_crc32"))
