"""The pipeline's stages and the registered corpus queries on the smallest tables."""

import os

import pytest

from checks.compare import compare, connect
from listmill.llm import decontam, mixing, near_dup, quality
from listmill.llm.queries import ORACLES, QUERIES, WEIGHTS
from tests.llm import odd

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = odd.frame(spark).withColumnRenamed("component", "label")
    names, sizes = [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        names.append(name)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        want = {"quality_rules": lambda: quality.judge_quality(before).filter("kept").count(),
                "near_duplicates": lambda: near_dup.grouped(before).filter("doc = component").select("doc").distinct().count(),
                "decontamination": lambda: before.count() - len(decontam.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().collect()),
                "source_mix": lambda: sum(r.taken // r.size for r in mixing.mix_sources(before, WEIGHTS).collect() if r.size),
                "token_files": before.count}[name]()
        assert sizes[-1] == want, name
    assert names == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "token_files"]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run_on_the_smallest_tables_and_on_no_rows(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert rows and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    docs = odd.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
