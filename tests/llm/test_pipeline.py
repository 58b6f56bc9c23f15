from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline as pipeline
from acctlens.llm import line_dedup, near_dedup, quality_rules, secret_scan
from acctlens.sources.tables import settle


def test_stages(spark, documents, sf_dir):
    """Each stage does on all that it is given what its operator says."""
    docs, seen = documents, []
    for name, stage in pipeline.STAGES:
        out = settle(stage(spark, docs, sf_dir), name)
        seen.append(name)
        if name == "quality_rules":
            kept = quality_rules.quality_report(docs).where("kept").select("doc_id")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())
        elif name == "line_dedup":
            wanted = {r.doc_id: r.text for r in line_dedup.line_report(docs).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == wanted
            assert out.where(F.char_length("text") != F.col("n_chars")).count() == 0
        elif name == "near_dedup":
            classes = near_dedup.near_duplicates(docs).select("class_id").distinct()
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.class_id for r in classes.collect())
        elif name == "secret_scan":
            before = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                spans = secret_scan.find_secrets(before[r.doc_id])
                assert (r.text == before[r.doc_id]) == (not spans)
                assert not secret_scan.find_secrets(r.text)
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
            assert used.where("n <> m OR n > 4096").count() == 0
        if name != "packing":
            assert out.columns == documents.columns
        docs = out
    assert seen == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_take_odd_rows(spark, docs, odd_rows, sf_dir):
    for rows in (odd_rows, []):
        frame = docs(rows)
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            if name != "packing":
                assert out.columns == frame.columns
            assert (out.count() > 0) == bool(rows)


def test_registered():
    names = set(entry_points.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
