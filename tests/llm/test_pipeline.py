import corpus_pipeline
from ratepanel.llm import decontaminate, mixing, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, SF))
        if name != "sharding":
            assert docs.columns == columns
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        if name == "quality":
            found = quality.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(docs) == ids(found.where("predicted = 1"))
        elif name == "near_duplicates":
            found = simhash.near_duplicates(before)
            assert ids(docs) == {r["component_id"] for r in found.collect()} and docs.count() == len(ids(docs))
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids(docs) == ids(before) - ids(decontaminate.find_leaks(before, items))
        elif name == "mixing":
            taken = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(before).collect() if r["copies"]}
            rows = {}
            for r in docs.select("doc_id").collect():
                rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + 1
            assert rows == taken
    assert docs.count() == before.count()
    assert sorted((r["shard"], r["slot"]) for r in docs.collect()) == sorted(
        (s, p) for s in range(8) for p in range(docs.where(docs["shard"] == s).count())
    )


def test_odd_rows_run_through(spark, odd_docs, no_docs, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
