from pyspark.sql import functions as F

from tapeloom.plans import model_queries as Q


def moved(spark, sf, tmp_path):
    """The vectors with ids that start at 1,000,000."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e.withColumn("vec_id", F.col("vec_id") + 1_000_000).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_any_ids(spark, sf, tmp_path):
    at = moved(spark, sf, tmp_path)
    n = spark.read.parquet(f"{at}/embeddings.parquet").count()
    rows = Q.train_mlp(spark, at).collect()
    assert sum(r.n for r in rows) == n and all(0 < r.test_accuracy <= 1 for r in rows)
    assert sorted(r.feature for r in Q.feature_ablation(spark, at).collect()) == list(range(16))


def test_sample_is_no_prefix_and_all_test_rows_count(spark, sf):
    rows = Q._split_rows(spark, sf)
    n, val, test = rows.count(), rows.where("split = 'val'").count(), rows.where("split = 'test'").count()
    (x, _, val_x, _), _, _ = Q._sample(rows, 100)
    assert 50 < len(x) + len(val_x) < 160 and len(val_x) < val and n > 160
    got = Q.train_mlp(spark, sf, 100).first().test_accuracy * test
    assert abs(got - round(got)) < 1e-6
