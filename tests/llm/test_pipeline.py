"""The stages of the corpus pipeline: shape, effect and order."""

import zlib

import corpus_pipeline
from quarry.llm import decontam
from tests.conftest import SF001
from tests.llm.test_documents import components_by_hand


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.dtypes
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF001).cache()
        before = {r.doc_id: r.text for r in given.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if name != "pieces":
            assert out.dtypes == columns and set(after) <= set(before)
        if name == "quality":
            marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
            good = [d for d, q in marks.items() if q == 1 and d in before and zlib.crc32(str(d).encode()) % 5]
            assert sum(d in after for d in good) >= 0.95 * len(good)
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in components_by_hand(sorted(before.items()))}
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.matches(given, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad
        if name == "secrets":
            assert set(after) == set(before)
            assert {d for d in before if after[d].text != before[d]} == {d for d in before if "[SECRET]" in after[d].text}
        if name == "pieces":
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        given = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF001).collect()} == set(after)
