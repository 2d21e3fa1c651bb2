"""The pipeline's stages on odd rows, on an empty table, on columns with clashing names and over tables of their own."""

import pytest
from odd_rows import SF

import corpus_pipeline
from treeline.llm import common

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage(spark, odd, empty, name):
    out = STAGES[name](spark, odd, SF)
    rows = out.collect()
    assert STAGES[name](spark, empty, SF).count() == 0
    if name == "SentencePiece":
        assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and len(rows) == odd.count()
        return
    assert out.columns == odd.columns and out.schema == odd.schema
    known = {(r.doc_id, r.text) for r in odd.collect()}
    if name != "substring dedup":
        assert {(r.doc_id, r.text) for r in rows} <= known
    # Columns whose names operators use keep what they held.
    assert {(r.score, r["size"], r.shard, r.key, r.ids, r.label) for r in rows} <= {(0.5, 7, 7, "k", "x", 7)}


def test_run_over_odd_tables(spark, odd, empty, labels, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    again = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))
    assert all(r.round_trip for r in out.collect()) and corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_tables_go_with_their_scratch(spark):
    files = lambda path: common._file_system(spark, path)[0].exists(common._file_system(spark, path)[1])
    with common.scratch(spark) as gone:
        common.durable(spark.range(3))
        outer = list(gone)
        with common.scratch(spark) as inner:
            kept, path = common.written(common.durable(spark.range(5)))
        assert files(outer[0]) and not files(inner[0])
    assert not files(outer[0]) and files(path) and kept.count() == 5
    common.drop(spark, [path])


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
