from pyspark.sql import functions as F

from opslog.llm import fitting


def test_samples_bound_rows_and_not_keys_only(spark):
    """One key on most rows, null keys and labels, a key with several labels, columns of the same names."""
    docs = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit(7)).when(F.col("id") < 4900, F.col("id")).alias("k"),
        F.concat(F.lit("t"), F.col("id") % 1500).alias("text"))
    labels = spark.range(3000, 5000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("v")).union(
        spark.createDataFrame([(7, 0), (7, 1), (None, 1), (8, None)], "k long, v int"))
    whole = fitting.sample(docs, labels, "k", "v", 10_000).collect()
    assert len(whole) == 901 and len({r.k for r in whole}) == 901
    assert {r.k: r._label for r in whole}[7] == 1
    cut = fitting.sample(docs, labels, "k", "v", 10).collect()
    assert 1 <= len(cut) <= 10  # labels without a document count too
    assert sorted(cut) == sorted(fitting.sample(docs.repartition(7), labels, "k", "v", 10).collect())
    assert fitting.sample(docs.limit(0), labels, "k", "v", 10).count() == 0


def test_samples_of_each_label(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id")).alias("k"),
        F.concat(F.lit("l"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("label"),
        F.col("id").cast("string").alias("text"))
    found = fitting.sample_each(docs, "k", "label", 5, 40)
    per = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    assert len(per) == 40 and max(per.values()) <= 5
    assert found.groupBy("k", "label").count().where("count > 1").count() == 0
    # very many labels are joined by a shuffle and give the same rows
    assert sorted(found.collect()) == sorted(fitting.sample_each(docs, "k", "label", 5, 10**9).collect())
