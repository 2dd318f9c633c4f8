import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    line = "the quick brown fox jumps over the lazy dog while a small cat looks on from afar and says nothing at all "
    rows = [(1, line * 3 + "one."), (2, line * 3 + "one."), (3, None), (4, "123 456"), (5, "mail joe@mail.example.com about the meeting of tomorrow please and thank you very much"), (6, "some other words that nobody else has written so far in this collection")]
    item = "which of these answers is the right one if all of them seem plausible to a careful reader"
    rows += [(7, item), (8, "before it all " + "many plain words of an ordinary text come first and more of them follow here " * 2 + item + " after it")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    assert set(kept["language_id"]) == {1, 2, 5, 6, 7, 8}
    assert set(kept["near_dedup"]) == {1, 5, 6, 7, 8}
    assert set(kept["benchmark_decontamination"]) == {1, 5, 6, 8} and item not in kept["benchmark_decontamination"][8]
    assert kept["pii"][5].startswith("mail <EMAIL> about") and kept["pii"][6] == dict(rows)[6]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept["pii"].items()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
