from __future__ import annotations

import pytest

import corpus_pipeline
from pickline.llm import grades, jaccard, phrases, templates
from pickline.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that each stage reads, and what the last one returns."""
    docs, found = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*found, docs]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_each_stage_does_its_work_on_its_input(spark, stages):
    start, good, lined, apart, clean, packed = stages
    for df in (good, lined, apart, clean):
        assert df.dtypes == start.dtypes
    accepted = grades.graded_documents(start, table(spark, SF, "labels")).filter("accepted")
    assert rows(good) == rows(start.join(accepted.select("doc_id"), "doc_id").select(start.columns))
    assert 0 < good.count() < start.count()
    want = {r.doc_id: r.text for r in templates.drop_template_lines(good).collect()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert any(want[r.doc_id] != r.text for r in good.collect())
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    groups = jaccard.similar_groups(lined)
    assert rows(apart.select("doc_id")) == rows(groups.filter("doc_id = component_id").select("doc_id"))
    assert apart.count() < lined.count()
    dirty = phrases.contamination(apart, table(spark, SF, "benchmark")).filter("contaminated")
    assert rows(clean) == rows(apart.join(dirty.select("doc_id"), "doc_id", "left_anti").select(start.columns))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert rows(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")) == rows(
        packed.select("doc_id", "piece", "length", "ids_crc32"))


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, empty):
    odd = [] if empty else [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "a b c", None, None, None),
                            (2, "a b c", "en", "s", 5), (2, "A b C", "en", "s", 5), (3, "", "en", "s", 0),
                            (4, "long " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "quality":
            docs = spark.createDataFrame(odd, docs.schema)
    docs.collect()
