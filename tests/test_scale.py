"""Ranking, hot keys and joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslog.operators import ranking, skew


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key; another share has none."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 1000).alias("v"),
    )


def test_ranked_positions(spark, hot):
    got = ranking.ranked(hot.where("k is not null"), ["k"], ["v", "id"], partitions=7).toPandas()
    want = got.sort_values(["k", "v", "id"]).groupby("k").cumcount() + 1
    assert (got.loc[want.index, "pos"] == want).all()
    whole = ranking.ranked(hot, [], ["v", "id"], "n", partitions=5).toPandas().sort_values(["v", "id"])
    assert whole["n"].tolist() == list(range(1, 3001))


def test_a_hot_key_spans_ranges(spark, hot):
    spread = hot.repartitionByRange(7, "k", "v", "id").withColumn("p", F.spark_partition_id())
    assert spread.where("k = 'hot'").select("p").distinct().count() > 1


def test_quantiles(spark, hot):
    values = np.array([r["v"] for r in hot.select("v").collect()], dtype=float)
    df = hot.select("id", F.col("v").cast("double").alias("v"))
    probs = [0.0, 0.025, 0.5, 0.9137, 1.0]
    assert np.allclose(ranking.quantiles(df, "v", "id", probs), np.quantile(values, probs))
    four = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])], "id long, v double")
    assert ranking.quantiles(four, "v", "id", [0.25]) == [1.75]


def test_first_per_key(spark, hot):
    got = ranking.first_per_key(hot.where("k is not null"), ["k"], ["v", "id"], 20, groups=3).toPandas()
    whole = hot.where("k is not null").toPandas().sort_values(["v", "id"]).groupby("k").head(20)
    assert sorted(got["id"]) == sorted(whole["id"])


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("split_rows", [10, 100, 10 ** 9])
def test_skew_join_equals_plain_join(spark, hot, how, split_rows):
    small = hot.where("k is not null and k != 'k7'").select("k").distinct().withColumn("w", F.hash("k"))
    got = skew.skew_join(hot, small, "k", "id", how, split_rows).select("id", "k", "v", "w").collect()
    want = hot.join(small, "k", how).select("id", "k", "v", "w").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_hot_key_is_split(spark, hot):
    keys = {r["k"]: r["_splits"] for r in skew.hot_keys(hot, "k", 100).collect()}
    assert keys == {"hot": 10}
    assert skew.hot_keys(hot, "k", 1, max_hot=5).count() == 5
