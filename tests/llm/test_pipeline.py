import pyarrow as pa
import pytest

pytest.importorskip("meterwise.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] <= counts[3] and counts[5] == counts[4]


def test_run_takes_an_empty_table(spark, tmp_path, sf):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_works_in_small_runs(monkeypatch):
    """The arrays of a run of texts are large, so the last stage takes at most 128 kB of text at once."""
    sent = {}
    stub = type("Rows", (), {"mapInArrow": lambda self, f, schema: sent.update(f=f)})()
    monkeypatch.setattr(corpus_pipeline.segment, "documents", lambda docs: stub)
    corpus_pipeline.pieces(None, None, "")
    text = "the old man and his dog went over a long road to see the house by the sea " * 100
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": [text] * 40})
    assert max(b.num_rows for b in sent["f"](iter([batch]))) * len(text) <= 1 << 17
