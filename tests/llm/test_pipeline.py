import pytest
import brute
from pyspark.sql import functions as F

import corpus_pipeline
from scorepool.llm import decontaminate, pii
from scorepool.llm.common import scratch_root

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "packing":
            assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
            break
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert kept == {d for d, t in rows if any(c.isalpha() for c in t)}
        elif name == "ngram_join":
            assert kept == {d for d, _, c in brute.shingle_components(rows) if d == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {d for d, t in rows if any(" ".join(i.lower().split()) in " ".join(t.lower().split()) for _, i in items)}
            assert kept.isdisjoint(whole)
        elif name == "pii":
            assert kept == {d for d, _ in rows}
            assert all(not [s for s in pii.base_spans(r["text"])] for r in docs.select("text").collect())


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect()))


def test_odd_rows(spark, docs):
    docs = docs.withColumn("lang", F.lit("xx")).withColumn("n_chars", F.length("text").cast("long"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs.count()
        none = stage(spark, docs.where("false"), SF)
        assert none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_scratch_folder_is_the_session_s():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.checkpoint.dir": "file:///shared/x/"}.get(name, default)

    assert scratch_root(Session) == "file:///shared/x"


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"this is a clean text about number {i} and some words " * 3) for i in range(5)], "doc_id long, text string")
    assert decontaminate.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 5
    assert pii.redact(docs).exceptAll(docs).count() == 0


def test_scratch_tables(spark, monkeypatch):
    """Written tables can be released; on a cluster without a shared folder there is an error, not a local table."""
    from types import SimpleNamespace

    from scorepool.llm import common

    kept = common._written[:]
    common._written.clear()
    frame = common.materialise(spark.range(3), "t")
    assert frame.count() == 3 and common.release(spark) == 1 and not common._written
    common._written.extend(kept)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=dict, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(cluster)
