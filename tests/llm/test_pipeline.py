"""The pipeline's stages: each works on what its predecessor kept, and takes effect."""

import corpus_pipeline as C

from quillmark.llm import pii, simhash


def test_stages_on_odd_rows(spark, odd, labels, tmp_path):
    docs = odd
    for name in ("documents", "labels"):
        (odd if name == "documents" else labels).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 3:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
    kept = spark.read.parquet(str(tmp_path / "stage1"))
    found = simhash.simhash_components(kept)
    assert found.select("component_id", "fingerprint").distinct().count() == kept.count()
    cleaned = sorted(r["text"] or "" for r in spark.read.parquet(str(tmp_path / "stage2")).collect())
    assert cleaned == sorted(r["text"] or "" for r in pii.redacted(kept).collect()) and not any("a@b.co" in t for t in cleaned)
    assert docs.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert C.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_on_an_empty_table(spark, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = empty
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
