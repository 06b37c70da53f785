"""The operators' queries over the driver's tables, and the pipeline stage by stage."""

import importlib

import fixtures as fx
import pytest
from oracle import rows_of, rows_of_sql

from rulewright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(ORACLES[name], sf_dir)


def test_pipeline_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    passage = fx.prose(90_077, 25)  # no clean document begins like it
    clean = [(i, fx.prose(i, 80), "en") for i in range(700)]
    copies = [(1000 + i, fx.edited(fx.prose(i, 80), i, 0.005), "en") for i in range(10)] + [(1100, fx.prose(3, 80), "en"), (1101, fx.prose(3, 80), "en")]
    leaks = [(2000 + i, f"{fx.prose(3000 + i, 40)} {passage} {fx.prose(4000 + i, 40)}", "en") for i in range(5)]
    short = [(5000, "too short", "en"), (5001, None, None), (5002, "", "en")]
    rows = clean + copies + leaks + short
    df = spark.createDataFrame([(i, t, g, "src", len(t) if t else None) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _, _ in clean], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, counts = df, []
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert now.columns == df.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append({r.doc_id for r in now.select("doc_id").collect()})
    assert counts[0] == {i for i, _, _ in clean + copies + leaks} == counts[1]
    assert counts[2] >= {i for i, _, _ in clean + leaks} and not counts[2] & {1100, 1101} and len(counts[2]) <= 707
    assert counts[3] == counts[2] - {i for i, _, _ in leaks} == counts[4]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == counts[4]


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns, with nothing to learn from and no benchmark; and no rows at all."""
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = []
    for df in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns
        kept.append(sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect()))
    # texts under 50 words or of repeated words go, of copies the row with the least id stays, a null id before all others
    assert (True, 0) in kept[0] and (True, 70) in kept[0] and (True, 51) not in kept[0] and (True, 40) not in kept[0]
    assert kept[1] == []
