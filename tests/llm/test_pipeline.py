"""The pipeline's stages, against what each operator's brute force says of its input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    from gleaner.llm import line_quality, positional_index, simhash
    from gleaner.llm.common import staged, table

    docs = table(spark, small, "documents")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = staged(stage(spark, docs, small), "test")
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(inputs["near_duplicates"]) == ids(line_quality.judge(inputs["quality_rules"]).filter("kept"))
    assert ids(inputs["repeated_passages"]) == ids(simhash.fingerprint_components(inputs["near_duplicates"]).filter("doc_id = component_id"))
    assert ids(inputs["decontamination"]) == ids(inputs["repeated_passages"])
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids(inputs["best_fit_packing"]) == ids(positional_index.contamination(inputs["decontamination"], bench).filter("NOT contaminated"))
    assert sorted(set(ids(docs))) == ids(inputs["best_fit_packing"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows, null ids and clashing columns go through all stages; each stage's rows are those its brute force names."""
    from pyspark.sql import functions as F

    own = lambda k: " ".join(f"w{k}x{j}" for j in range(70))
    rows = [(1, own(1), "en", "s", 1), (1, own(1), "en", "s", 1), (2, own(1), "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, own(5), None, "s", 1), (6, "too short", "en", "s", 1), (7, own(7) + " " + own(2)[:300], "en", None, 1), (8, own(2), "en", "s", 1), (9, own(9) + " the test passage of thirteen words that is found in a benchmark item here", "en", "s", 1)]
    names = ["keep", "kept", "__id", "__gone", "c0", "c1", "id", "gone", "bad", "score", "chunk"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("extra") for n in names})
    spark.createDataFrame([(1, "the test passage of thirteen words that is found in a benchmark item here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality_rules": [None, 1, 1, 2, 7, 8, 9], "near_duplicates": [None, 1, 7, 8, 9], "repeated_passages": [None, 1, 7, 8, 9], "decontamination": [None, 1, 7, 8]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name in want:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted(want[name], key=repr), name
            assert {r["__gone"] for r in docs.collect()} == {"extra"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[7] == rows[7][1] and len(texts[8]) < len(own(2))  # the passage stays where the id is smaller
    assert sorted({r.doc_id for r in out.collect()}, key=repr) == sorted(want["decontamination"], key=repr)


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
