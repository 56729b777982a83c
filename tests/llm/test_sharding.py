import zlib
from collections import Counter

import numpy as np

from splatframe.llm import sharding
from splatframe.llm.common import new_folder

from . import cases


def test_fisher_yates_is_a_seeded_permutation():
    for n in (0, 1, 2, 100):
        a = sharding.fisher_yates(n, [1, 2])
        assert sorted(a) == list(range(n)) and (a == sharding.fisher_yates(n, [1, 2])).all()
    counts = Counter(tuple(sharding.fisher_yates(3, [s])) for s in range(6000))
    assert len(counts) == 6 and min(counts.values()) > 850


def check(rows, docs, shards):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    sizes = [len(per.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(per) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in per.values())


def test_query(spark):
    docs = cases.documents(spark)
    rows = sharding.shard_documents(docs).collect()
    check(rows, docs.collect(), 16)
    again = sharding.shard_documents(docs.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert Counter(map(tuple, rows)) != Counter(map(tuple, sharding.shard_documents(docs, seed=3).collect()))
    assert sharding.shard_documents(cases.empty(spark)).count() == 0


def test_many_buckets_keep_columns(spark):
    docs = cases.documents(spark, extra=False)
    stored = sharding.write_shards(docs, new_folder(spark, "t"), shards=5, bucket_bytes=4096)
    assert stored.columns == [*docs.columns, "shard", "slot"]
    assert Counter(map(tuple, stored.drop("shard", "slot").collect())) == Counter(map(tuple, docs.collect()))
    sizes = Counter(r.shard for r in stored.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    order = [r.doc_id for r in stored.where("doc_id < 60").orderBy("shard", "slot").collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.4


def test_one_row_very_often_is_scattered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 100)
    docs = spark.createDataFrame([(None, "the same", "en", "s", 1)] * 3000 + [(i, f"text {i}", "en", "s", 1) for i in range(3000)], cases.SCHEMA)
    stored = sharding.write_shards(docs, new_folder(spark, "t"), shards=6, bucket_bytes=2048).collect()
    assert Counter(r.doc_id is None for r in stored) == {True: 3000, False: 3000}
    assert all(380 < n < 620 for n in Counter(r.shard for r in stored if r.doc_id is None).values())
    for s in range(6):
        assert sorted(r.slot for r in stored if r.shard == s) == list(range(1000))


def test_clashing_names(spark):
    names = ["_mark", "_bucket", "bucket", "mark", "row", "first", "hash", "many", "a`b"]
    ddl = cases.SCHEMA + "".join(f", `{n.replace('`', '``')}` string" for n in names) + ", shard string, slot string"
    docs = spark.createDataFrame([(i % 7, f"t{i}", "en", "s", 1, *names, "x", "y") for i in range(40)], ddl)
    stored = sharding.write_shards(docs, new_folder(spark, "t"), shards=3)
    assert stored.columns == [*docs.columns[:-2], "shard", "slot"]
    assert sorted(r.text for r in stored.collect()) == sorted(f"t{i}" for i in range(40)) and all(list(r)[5:-2] == names for r in stored.collect())
