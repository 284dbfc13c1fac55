"""The pipeline's stages on small planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
common = pytest.importorskip("wayfold.llm.common")


def test_stages_take_effect(spark, tmp_path):
    base = [" ".join(f"word{(i * 7 + j) % 90}x{i}" for j in range(80)) for i in range(12)]
    near = base[3].replace("word5x3", "other")
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(50, near, "en", "s0", len(near)), (51, base[4], "en", "s1", len(base[4])), (52, "first line here\n" + passage, "en", "s2", 1), (53, "another start\n" + passage, "en", "s2", 1), (54, None, "en", None, 0), (55, "", None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    deduped = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, d).collect()}
    assert 51 not in deduped and deduped[53] == "another start" and passage in deduped[52]
    unique = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, d).collect()}
    assert 50 not in unique and 51 not in unique and {3, 4, 54, 55} <= unique
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), d).collect() == []
    got = corpus_pipeline.run(spark, d).collect()
    assert got and all(r.round_trip for r in got)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["id", "gone_id", "key", "row", "nth", "rep", "component_id", "mix_id", "score", "base", "runs", "n_lines", "line"]
    base = [" ".join(f"w{(i * 7 + j) % 90}x{i}" for j in range(70)) for i in range(8)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *range(len(names))) for i, t in enumerate(base)]
    rows += [(3, "quite another text of some words", "en", None, 5, *range(len(names))), (3, base[3], "en", "s1", 5, *range(len(names))), (None, base[1] + " tail", None, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        kept = [tuple(r) for r in out.collect()]
        own = {r[:1] + r[2:4] + r[5:] for r in rows}
        assert out.columns == docs.columns and {r[:1] + r[2:4] + r[5:] for r in kept} <= own, name
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(i for i in ids if i is not None) == list(range(8)) and ids.count(None) == 1
    assert corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).count() == len(rows)


def test_stages_leave_little_behind(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = set(common._WRITTEN)
    kept = corpus_pipeline.line_dedup(spark, docs, "/root/testdata/sf0.001")
    left = set(common._WRITTEN) - before
    assert [path.rpartition("/")[2].rpartition("-")[0] for path in left] == ["runs"]
    rows = corpus_pipeline.near_dedup(spark, kept, "/root/testdata/sf0.001")
    left = set(common._WRITTEN) - before - left
    assert [path.rpartition("/")[2].rpartition("-")[0] for path in left] == ["gone"]
    assert 0 < rows.count() < kept.count() <= docs.count()
