"""All ten operators over one table with awkward rows and columns named like helpers of theirs."""

import pytest
from pyspark.sql import functions as F

from tracelore.llm import arc_warc, compaction, decontaminate, host_rules, lm, near_dup, packing, sanitise, secret_scan, toxicity

OTHERS = ("Weight", "__k", "__gone", "__t", "ID", "UID", "Hits", "block", "Train", "score", "kept", "spans", "BASE", "set_key", "Salt", "length", "c0", "value", "__value", "item_id", "Coverage")


@pytest.fixture(scope="module")
def docs(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    texts = [None, "", " \n\t", "one", passage, passage, "you idiot", f"call a.b@c.de or 1.2.3.4, {passage} again", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "word " * 30_000, "é" * 50_000]
    rows = [(i, t, f"s{i % 2}", *range(len(OTHERS))) for i, t in enumerate(texts)] + [(4, passage, None, *range(len(OTHERS))), (None, passage, "s1", *range(len(OTHERS))), (None, None, None, *([None] * len(OTHERS)))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in OTHERS)).repartition(3)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(6, 1), (5, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert toxicity.score(docs, lexicon).count() == 14
    kept = toxicity.clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 13


def test_warc(spark, docs, tmp_path):
    records, _ = arc_warc.archive(docs.withColumn("url", F.lit(None).cast("string")), key="doc_id", payload="text", folder=f"file://{tmp_path}")
    assert records.count() == 14 and records.where("payload_bytes = 0").count() == 3


def test_near_duplicates(spark, docs):
    assert near_dup.classes(docs).count() == 14
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 4").count() == 2
    with pytest.raises(ValueError):
        near_dup.classes(docs.select("source", "text"), key="source")


def test_host_rules(spark, docs):
    out = host_rules.judge(docs)
    assert out.count() == 14 and out.where("kept").count() <= 2


def test_sharding(spark, docs, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", arrival_rows=3)
    store.append(docs)
    store.compact()
    assert store.read().columns == docs.columns and sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old stone", 3), (2, None, 4), (None, "", 5)], "item_id long, text string, hits int")
    assert decontaminate.contaminated(docs, items).count() == 5
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 9


def test_sanitisation(spark, docs):
    assert sanitise.detect(docs).count() == 14
    out = sanitise.sanitise(docs)
    assert out.columns == docs.columns and out.count() == 14 and out.where("text like '%[EMAIL] or [IP]%'").count() == 1


def test_packing(spark, docs):
    out = packing.pack_documents(docs)
    assert out.agg(F.sum("length")).first()[0] == 30_000 + 1 + 1 + 14 * 4 + 2 + 19 + 3
    assert out.where("bin_id is null").count() == 4


def test_secret_scan(spark, docs):
    out = secret_scan.scan(docs, secret_scan.train(docs), keep=docs.columns)
    assert out.count() == 14 and out.where("size(base) = 2").count() == 1


def test_lm_scoring(spark, docs):
    out = lm.score(docs, train=F.col("Weight") >= 0)
    assert out.count() == 14 and out.where("n_tokens = 1").count() == 4 and out.where("not trained").count() == 1
