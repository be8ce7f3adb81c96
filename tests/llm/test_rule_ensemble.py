import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm.common import held_out
from noteloom.llm.rule_ensemble import STATISTICS, accept_documents, fit_model, lasso_logistic, quality, score_documents, statistics, train


def test_held_out_accuracy(spark, sf_dir):
    """Few documents are labelled here; the sample of the larger table is fitted the same way."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scored = score_documents(docs, labels)
    assert scored.count() == docs.count()
    judged = scored.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).cast("int").alias("hit"))
    assert judged.agg(F.avg("hit")).first()[0] >= 0.95
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_expression_equals_the_model(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    assert model.rules
    rows = docs.select(statistics(F.col("text")).alias("s"), quality(model, F.col("text")).alias("q")).select("s.*", "q").collect()
    values = {n: np.array([r[n] for r in rows]) for n in STATISTICS}
    assert np.allclose(model.predict(values), [r.q for r in rows], atol=1e-12)


def test_only_labels_outside_the_holdout_count(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(docs, labels) == train(docs, turned)


def test_repeated_ids_and_labels_count_once(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    many = docs.unionByName(docs).unionByName(docs.where("doc_id % 3 = 0"))
    assert train(many, labels.unionByName(labels)) == train(docs, labels)


def test_lasso_drops_noise():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 10)) < 0.5).astype(float)
    y = (x[:, 0] * (rng.random(2000) < 0.95)).astype(float)
    _, w = lasso_logistic(x, y, 0.02, 500)
    assert w[0] > 1 and np.count_nonzero(w[1:]) == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "abc def", 0.3), (2, "", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (1, 5)], "doc_id long, quality int")
    got = score_documents(docs, one).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0.5 < got[0].score < 1
    assert accept_documents(docs, one).columns == docs.columns and accept_documents(docs, one).count() == 4
    assert score_documents(docs.limit(0), one).count() == 0
    assert fit_model(np.zeros((0, len(STATISTICS))), np.zeros(0)).rules == ()


@pytest.mark.parametrize("text", ["x " * 200_000, "|" * 100_000])
def test_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert score_documents(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first().score > 0
