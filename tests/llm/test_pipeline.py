"""The pipeline's stages, each on what the one before kept."""

import pytest

import corpus_pipeline as pipeline
from sylva.llm import jaccard, mixing, quality


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        from sylva.llm._common import stage_table

        out.append(stage_table(stage(spark, out[-1], sf_dir), "t"))
    return out


def test_stages(results):
    docs, good, single, masked, mixed, packed = results
    for df in results[1:5]:
        assert df.columns == pipeline.COLUMNS
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == ids(quality.judge(docs).where("doc_id is not null").select("doc_id", "kept").toPandas().query("kept").pipe(lambda p: docs.sparkSession.createDataFrame(p)))
    assert ids(single) == {r.doc_id for r in jaccard.near_duplicates(good).collect() if r.doc_id == r.component_id}
    assert ids(masked) == ids(single)
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (single, masked))
    assert any("@" in x for x in before.values()) and not any("@mail" in x and ".example.com" in x for x in after.values())
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect()}
    assert mixed.count() == sum(copies.values()) and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    rows = packed.collect()
    assert {r.doc_id for r in rows} == ids(mixed)
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, sf_dir, results):
    assert pipeline.run(spark, sf_dir).count() == results[-1].count()
