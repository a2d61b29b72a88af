import pytest

from stewardry.runtime import ensure_checkpoint_dir, free_name, join_hot


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_join_hot_is_an_inner_join(spark, hot):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(100)] + [(None, 1), (55, 2)], "k bigint, hot_ bigint")
    right = spark.createDataFrame([(k, f"v{k}", 100 - k) for k in range(9)], "k bigint, v string, n bigint")
    got = sorted(map(tuple, join_hot(left, right, ["k"], "n", hot).collect()))
    assert got == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_names_and_folder(spark):
    df = spark.createDataFrame([(1, 2)], "slot int, Slot_ int")
    assert free_name(df, "slot") == "slot__" and free_name(df, "x") == "x"
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
