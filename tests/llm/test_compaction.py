import time

import pytest
from pyspark.sql import functions as F

from tracelore.llm.compaction import Conflict, Manifest, ShardStore


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store", target=200_000, smallest=1000, fan_in=3, arrival_rows=200)


def rows(spark, low, high):
    return spark.range(low, high, 1, 4).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_appends_then_compacts(spark, store):
    store.append(rows(spark, 0, 3000))
    first = store.append(rows(spark, 3000, 4000))
    assert first.version == 2 and all(s.size > 0 for s in first.shards) and len(first.shards) >= 20
    last = store.compact()
    assert last.version > 2 and len(last.shards) < len(first.shards) / 3
    assert ids(store.read()) == ids(store.read(2)) == list(range(4000))
    assert ids(store.read(1)) == list(range(3000))
    assert store.compact().version == last.version  # nothing left to merge
    placed = store.located()
    assert placed.where("shard = ''").count() == 0 and placed.select("shard").distinct().count() == len(last.shards)
    assert {r["shard"] for r in placed.select("shard").distinct().collect()} == {s.path for s in last.shards}
    assert store.vacuum() == len(first.shards)
    assert store.versions() == [last.version] and ids(store.read()) == list(range(4000))


def test_full_tiers_only(spark, store):
    for i in range(2):
        store.append(rows(spark, i * 100, i * 100 + 100).coalesce(1))
    assert store.compact().version == 2
    store.append(rows(spark, 200, 300).coalesce(1))
    after = store.compact()
    assert after.version == 4 and len(after.shards) == 1


def test_tiers(store):
    assert [store.tier(s) for s in (0, 1, 999, 1000, 2999, 3000, 9000)] == [0, 0, 0, 1, 1, 2, 3]


def test_one_author_for_a_version(spark, store):
    store.append(rows(spark, 0, 10))
    with pytest.raises(Conflict):
        store.commit(Manifest(1, (), ""))
    assert ids(store.read()) == list(range(10))


def test_lost_writer_leaves_no_trace(spark, store):
    store.append(rows(spark, 0, 10))
    store._write(rows(spark, 10, 20))  # shards that no manifest names
    assert ids(store.read()) == list(range(10))


def test_vacuum_takes_orphans_after_their_grace(spark, store):
    store.append(rows(spark, 0, 10))
    lost = store._write(rows(spark, 10, 20))
    assert store.vacuum() == 0 and store._listed(lost[0].path.rpartition("/")[0])
    time.sleep(1.1)
    assert store.vacuum(grace_s=1.0) == len(lost)
    assert not store._listed(lost[0].path.rpartition("/")[0]) and ids(store.read()) == list(range(10))
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_loser_of_a_race_cleans_up(spark, store, monkeypatch):
    store.append(rows(spark, 0, 10))
    before = len(store._listed("shards"))
    old = store.manifest()
    store.append(rows(spark, 10, 20))
    monkeypatch.setattr(store, "manifest", lambda version=None: old)
    with pytest.raises(Conflict):
        store.append(rows(spark, 20, 30))
    assert len(store._listed("shards")) == before + 1


def test_a_tier_that_stays_does_not_hold_up_the_next(spark, store, monkeypatch):
    for i in range(3):
        store.append(rows(spark, i * 10, i * 10 + 10).coalesce(1))
    for i in range(3):
        store.append(rows(spark, 1000 + i * 1000, 2000 + i * 1000).coalesce(1).limit(200))
    merge, asked = store._merge, []

    def once(runs, now):
        asked.append(min(s.tier for s in runs))
        return store._write(store._read(runs, now).repartition(len(runs)), 0) if len(asked) == 1 else merge(runs, now)

    monkeypatch.setattr(store, "_merge", once)
    after = store.compact()
    assert len(asked) >= 2 and len(after.shards) < 6 and store.read().count() == 630


def test_columns_nulls_empty_and_repeats(spark, store):
    assert store.manifest().version == 0
    empty = store.append(rows(spark, 0, 0))
    assert empty.version == 1 and store.read().count() == 0 and store.located().columns[-1] == "manifest_version"
    store.append(spark.createDataFrame([(None, None), (1, "x" * 100_000), (1, "x" * 100_000)], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, 7)], "doc_id long, size long"))
    got = store.read()
    assert got.columns == ["doc_id", "text", "size"] and got.count() == 4 and got.where("doc_id = 1").count() == 2
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("a",)], "doc_id string"))
