"""The pipeline on the smallest tables, its stages against plain versions."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = {r.doc_id for r in after}
        assert ids <= {r.doc_id for r in before} and after
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = [(r.doc_id, r.text) for r in before]
        if name == "near_duplicates":
            assert ids == set(brute.components([d for d, _ in rows], brute.fingerprints(rows)))
        if name == "decontamination":
            assert ids == {d for d, *_, bad in brute.decontaminate(rows, bench) if not bad}
        if name == "pii":
            assert not any(brute.base_pii(r.text) for r in after)
        before = after


def test_edge_rows(spark):
    """Nulls in every column, empty, blank and repeated rows, an extra column, and an empty table go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__place", F.lit("kept"))
    edge = spark.createDataFrame([(None, None, None, None, None, None), (-1, "", "en", "s", 0, "kept"), (-2, " \n", None, None, 1, None), (-3, None, "en", "s", None, "kept")], "doc_id long, text string, lang string, source string, n_chars long, __place string")
    docs = docs.unionByName(edge).unionByName(docs.limit(20)).unionByName(edge)
    for part in (docs, docs.limit(0)):
        some = part.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, SF)
            got = out.count()
            assert got <= some and out.columns[:6] == docs.columns
            assert {r[0] for r in out.select("__place").distinct().collect()} <= {"kept", None}
            if name in ("decontamination", "pii"):
                assert out.where("doc_id is null").count() == part.where("doc_id is null").count()
            if name == "near_duplicates" and some:
                assert out.where("trim(replace(coalesce(text, ''), '\n', '')) = ''").count() == 1 and got == out.dropDuplicates(["doc_id", "text"]).count()
            if name == "mixing":
                assert out.where("text is null or text = ''").count() == 0


def test_run(spark):
    import os
    from urllib.parse import urlparse

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    folder = os.path.dirname(os.path.dirname(urlparse(out.inputFiles()[0]).path))
    assert os.listdir(folder) == ["4-mixing"]  # the others are gone
