import zlib
from collections import Counter

import corpus_pipeline
from splatframe.llm import mixing
from splatframe.llm.common import folders

from . import cases
from .test_mixing import check as check_mix
from .test_simhash import fingerprint, groups
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert out.columns == columns and sum(toxic.get(d, 1) == 0 for d in gone) <= 1
            held = [d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0]
            assert sum((d in gone) == bool(toxic[d]) for d in held) >= 0.9 * len(held)
        elif name == "near_duplicates":
            fps = [fingerprint(r.text) for r in before]
            least = {min(before[j].doc_id for j in reach) for reach in groups(fps).values()}
            assert out.columns == columns and sorted(r.doc_id for r in after) == sorted(least)
        elif name == "mixing":
            check_mix(before, mixing.mixed_sizes(docs).collect())
            taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
            got = Counter()
            for r in after:
                got[r.doc_id] += len(r.text.split())
            assert out.columns == columns and got == Counter({d: t for d, t in taken.items() if t})
        else:
            merged = Counter((r.doc_id, r.text) for r in before)
            assert len(merged) >= len({r.doc_id for r in before})
            assert sum(r.length for r in after) > 0 and max(r.offset + r.length for r in after) <= 2048
            assert check_packing(before, after) > 0.95
        docs = out


def test_run(spark):
    before = folders()
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert len(folders()) == len(before) + 1  # the last stage's rows


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    for name, docs in (("some", cases.documents(spark)), ("none", cases.empty(spark))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() > 0) == (name == "some")


