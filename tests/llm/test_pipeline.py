import random

import corpus_pipeline


def test_stages_on_a_small_folder(spark, make_docs, tmp_path):
    rng = random.Random(6)
    line = "This very line occurs in many of the documents here."
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    rows = [(i, f"{line}\n{text()}", f"s{i % 3}") for i in range(30)]
    rows += [(30 + i, rows[i][1], "s0") for i in range(5)] + [(50, " ".join(f"w{i}***" for i in range(60)), "s1"), (51, None, "s1"), (52, "short", None)]
    make_docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(50, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert {r.doc_id for r in seen["quality_rules"].collect()} >= set(range(35)) and not {51, 52} & {r.doc_id for r in seen["quality_rules"].collect()}
    assert sum(line in r.text for r in seen["line_dedup"].collect()) == 1
    assert {r.doc_id for r in seen["ngram_join"].collect()} & set(range(30, 35)) == set()
    assert seen["ngram_join"].count() >= 30
    assert seen["packing"].where("bin_id is null").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_null_and_repeated_ids(spark, make_docs, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    one, two, three = text(), text(), text()
    rows = [(None, one, "a"), (None, one, "a"), (4, two, None), (4, two, None), (4, three, "b"), (9, text(), "b"), (5, None, "b"), (6, "", "a")]
    make_docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {None, 4, 9} and all(r.n_words == 60 and r.capacity >= 60 for r in out)
    make_docs(rows, clash=False).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
