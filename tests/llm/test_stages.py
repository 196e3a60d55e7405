"""Stages own their tables; rows are kept where they lie; the pipeline on awkward tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm.common import ROW, kept_in_place, numbered, table
from tracewell.session import recording, release, stage


def test_rows_are_kept_where_they_lie(spark, folder):
    rows = numbered(table(spark, folder, "documents").repartition(5))
    for chosen in (rows.where("doc_id % 3 = 0"), rows.where("false"), rows, rows.where("doc_id is null").union(rows.where("doc_id is null"))):
        ids = {r[ROW] for r in chosen.select(ROW).collect()}
        out = kept_in_place(rows, chosen.select(ROW))
        assert out.columns == rows.columns
        assert sorted(r[ROW] for r in out.select(ROW).collect()) == sorted(ids)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_stage_deletes_what_the_one_before_left(spark, folder):
    corpus_pipeline._LEFT.clear()
    docs = table(spark, folder, "documents")
    with recording() as paths:
        one = stage(dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, folder), "test-stage")
    left = list(corpus_pipeline._LEFT)
    assert left and set(left) < set(paths)
    dict(corpus_pipeline.STAGES)["pii"](spark, one, folder)
    assert not any(os.path.exists(p) for p in left)
    assert one.count()  # what a caller wrote stays
    release(spark, corpus_pipeline._LEFT)


def test_pipeline_without_rows_and_without_labels(spark, empty, folder, tmp_path):
    assert corpus_pipeline.run(spark, empty).count() == 0
    pq.write_table(pq.read_table(f"{folder}/documents.parquet"), tmp_path / "documents.parquet")
    labels = pq.read_table(f"{empty}/labels.parquet")
    pq.write_table(labels, tmp_path / "labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toArrow()
    assert isinstance(out, pa.Table) and out.num_rows > 100
    spans = sorted(zip(out["sequence_id"].to_pylist(), out["offset"].to_pylist(), out["length"].to_pylist()))
    for (s, a, n), (t, b, _) in zip(spans, spans[1:]):
        assert b == (a + n if s == t else 0)


def test_pipeline_keeps_clean_documents(spark, folder):
    docs = table(spark, folder, "documents")
    assert dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder).count() > 0.8 * docs.count()
    assert docs.where(F.col("doc_id").isNull()).count() == 1
