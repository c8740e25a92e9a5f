import numpy as np
from ratepanel.llm import quality
from pyspark.sql import functions as F


def test_statistics_are_finite(odd_rows):
    values = np.array([quality.statistics((r[1] or "").encode()) for r in odd_rows])
    assert values.shape[1] == quality.SIZE and np.isfinite(values).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert right[0] >= 0.95 and right[1] > 30


def test_model_matches_the_densities(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(k, 1 + k, (400, quality.SIZE)) for k in (0, 1)]
    rows = [(k, row.tolist()) for k in (0, 1) for row in x[k]]
    model = quality.fit(spark.createDataFrame(rows, "quality int, stats array<double>"), pooled=0.0, diagonal=0.0)
    point = rng.normal(0.5, 1, (5, quality.SIZE))
    density = []
    for k in (0, 1):
        mean, cov = x[k].mean(axis=0), np.cov(x[k].T, bias=True) + 1e-6 * np.eye(quality.SIZE)
        d = point - mean
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-9)


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (5, 1, 0), (6, 1, 1), (7, 0, 0), (12, 0, None), (12, 1, 0), (None, 0, 0), (13, None, 0), (14, 7, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    found = quality.score_documents(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert quality.score_documents(no_docs, labels).count() == 0
    none = quality.score_documents(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    good = quality.score_documents(odd_docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in good} == {1.0}
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()
