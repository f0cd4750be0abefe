import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import shards


def test_append_compact_read(spark, documents, edge, tmp_path):
    docs = documents.select("doc_id", "text")
    store = shards.Store(spark, f"file://{tmp_path}/store", target_bytes=200_000, fan_in=3)
    parts = docs.randomSplit([1.0] * 5, seed=1)
    for p in parts:
        store.append(p.coalesce(2))
    assert store.version() == 5
    before = store.manifest()
    small = before.count()
    store.compact()
    after = store.manifest()
    assert after.count() < small
    assert after.agg(F.sum("rows")).first()[0] == docs.count()
    assert not store.plan(after).count()
    got, want = store.read().select("doc_id", "text"), docs
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    with pytest.raises(shards.Conflict):
        store.commit(after.drop("version"), store.version())
    store.append(edge.select("doc_id", "text"))
    assert store.read().count() == docs.count() + edge.count()


def test_summary_and_empty(edge, empty):
    got = shards.summary(edge).collect()
    want = [(str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge.collect()]
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted(want)
    rows = Counter(r.shard for r in got)
    assert all(r.shard_rows == rows[r.shard] for r in got)
    with pytest.raises(ValueError):
        shards.sharded(edge.withColumn("__path", F.lit(1)))
    assert shards.summary(empty).count() == 0


def test_versions_stay_readable_until_they_expire(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text")
    store = shards.Store(spark, f"file://{tmp_path}/store", target_bytes=200_000, fan_in=3)
    parts = docs.randomSplit([1.0] * 4, seed=1)
    for p in parts:
        store.append(p.coalesce(2))
    want = {v: store.read(v).count() for v in range(1, 5)}
    last = store.compact()
    assert last > 4
    for v in range(1, last + 1):
        assert store.read(v).count() == want.get(v, docs.count())
    store.expire(keep_versions=2)
    assert store.read(last - 1).count() == store.read().count() == docs.count()
    store.expire()
    assert store.version() == last
    assert store.read().select("doc_id", "text").exceptAll(docs).count() == 0 and store.read().count() == docs.count()
    assert len(list(tmp_path.glob("store/shards/**/*.parquet"))) == store.manifest().count()
    assert [p.name for p in tmp_path.glob("store/manifest/v=*")] == [f"v={last:08d}"]


def test_plan_against_a_plain_one(spark, tmp_path):
    rng = random.Random(3)
    store = shards.Store(spark, f"file://{tmp_path}/store", target_bytes=1000, fan_in=3)
    tier = lambda size: int(math.floor(math.log(max(size, 1), store.tier_factor) + 1e-12))
    for n in (0, 2, 40):
        listed = [(i, f"p{i}", rng.choice([3, 17, 70, 90, 300, 450, 600, 2000]), 1) for i in range(n)]
        rows = [(*r, tier(r[2]), 1) for r in listed]
        runs = defaultdict(list)
        for t in {r[4] for r in rows}:
            each = sorted((r[2], r[0]) for r in rows if r[4] == t and r[2] < 500)
            at = 0
            for size, shard in each if len(each) >= 3 else ():
                runs[f"{t}-{at // 1000}"].append((shard, size))
                at += size
        want, at, room = [], 0, int(sum(r[2] for r in rows) * shards.ROUND_SHARE)
        for name in sorted(k for k, v in runs.items() if len(v) > 1):
            size = sum(s for _, s in runs[name])
            if at + size <= max(room, size):
                want.append({s for s, _ in runs[name]})
            at += size
        got = defaultdict(set)
        for r in store.plan(spark.createDataFrame(rows, shards.MANIFEST)).collect():
            got[r.run].add(r.shard)
        assert [got[k] for k in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_a_lost_race_leaves_no_files(spark, documents, tmp_path, monkeypatch):
    store = shards.Store(spark, f"file://{tmp_path}/store", target_bytes=20_000_000, fan_in=2)
    for p in documents.select("doc_id", "text").randomSplit([1.0] * 3, seed=1):
        store.append(p.coalesce(1))
    commit, lost = store.commit, []

    def late(content, version):
        if not lost:
            lost.append(version)
            raise shards.Conflict("another writer")
        return commit(content, version)

    monkeypatch.setattr(store, "commit", late)
    store.compact()
    named = {r.path for v in range(1, store.version() + 1) for r in store.manifest(v).collect()}
    assert lost and {f"file://{p}" for p in tmp_path.glob("store/shards/**/*.parquet")} == {re.sub("^file:/+", "file:///", x) for x in named}
