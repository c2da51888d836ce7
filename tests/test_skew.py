import random

import pytest

from readalike.operators.skew import hot_keys, join_per_key
from tests.conftest import rows


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_per_key_equals_a_plain_join(spark, how):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 1500)}", i) for i in range(4000)]
    data += [(None, -1), ("absent", -2)]
    df = spark.createDataFrame(data, "key string, value int")
    per_key = df.filter("key <> 'absent'").groupBy("key").agg({"value": "max"}).toDF("key", "top")
    hot = [r.key for r in hot_keys(df, ["key"]).collect()]
    assert "hot" in hot and len(hot) < 1000
    assert rows(join_per_key(df, per_key, "key", how)) == rows(df.join(per_key, "key", how))


def test_no_cold_key_exceeds_the_share_of_a_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        data = [("warm", i) for i in range(9)] + [(f"k{i}", i) for i in range(9991)]
        df = spark.createDataFrame(data, "key string, value int")
        assert [r.key for r in hot_keys(df, ["key"]).collect()] == ["warm"]
        assert hot_keys(df, ["key"], 1000).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
