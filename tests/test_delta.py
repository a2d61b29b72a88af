"""Incremental results equal full recomputation over random changes; streams keep stored views."""

import random

import pytest
from pyspark.sql import functions as F

from stewardry.operators import relational as R
from stewardry.plans import delta
from stewardry.streaming.maintain import StoredView, maintain, maintain_aggregate

SCHEMA = "g bigint, v bigint, id bigint"


def random_case(spark, seed):
    r = random.Random(seed)
    row = lambda: (r.choice([1, 2, 3, None]), r.choice([r.randint(0, 9), None]), r.randint(0, 9))
    old = [row() for _ in range(25)]
    gone, new = r.sample(old, 10), [row() for _ in range(12)]
    kept = list(old)
    for x in gone:
        kept.remove(x)
    change = delta.weighted(spark.createDataFrame(new, SCHEMA)).unionByName(delta.weighted(spark.createDataFrame(gone, SCHEMA), -1))
    return spark.createDataFrame(old, SCHEMA), change, spark.createDataFrame(kept + new, SCHEMA)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_incremental_equals_recomputed(spark, seed):
    old, change, new = random_case(spark, seed)
    same(delta.apply(old, change), new)
    same(delta.apply(old.distinct(), delta.distinct(old, change)), new.distinct())
    state, moved = delta.aggregate(delta.aggregate_state(old, ["g"], "v"), change, ["g"], "v")
    same(state, delta.aggregate_state(new, ["g"], "v"))
    same(delta.apply(delta.aggregate_state(old, ["g"], "v"), moved), delta.aggregate_state(new, ["g"], "v"))
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    same(delta.apply(R.top_per_key(old, ["g"], order, 2), delta.top(old, change, ["g"], order, 2)), R.top_per_key(new, ["g"], order, 2))
    old2, change2, new2 = (x.withColumnRenamed("v", "w").withColumnRenamed("id", "id2") for x in random_case(spark, seed + 100))
    same(delta.apply(old.join(old2, "g"), delta.join(old, change, old2, change2, "g")), new.join(new2, "g"))
    for how in ("left", "right"):
        same(delta.apply(old.join(old2, "g", how), delta.outer_join(old, change, old2, change2, "g", how)), new.join(new2, "g", how))


def test_order_of_changes_does_not_matter(spark):
    a = spark.createDataFrame([(1, 1, 1, -1), (1, 1, 1, 1), (2, 2, 2, 2)], SCHEMA + ", _w bigint")
    assert [tuple(r) for r in delta.apply(spark.createDataFrame([], SCHEMA), a).collect()] == [(2, 2, 2)] * 2


def test_streams_maintain_views(spark, tmp_path):
    schema, source = "g bigint, v bigint, _w bigint", str(tmp_path / "in")
    batches = [[(1, 5, 1), (1, 7, 1), (2, 1, 1)], [(1, 5, -1), (3, 4, 1)], [(2, 1, -1), (3, 6, 1)]]
    rows, sums = StoredView(spark, str(tmp_path / "rows"), "g bigint, v bigint"), StoredView(spark, str(tmp_path / "sums"), "g bigint, n bigint, total bigint, known bigint")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(schema).parquet(source)
        maintain(stream(), rows, str(tmp_path / "c1"), lambda df: df.where("v < 7")).awaitTermination()
        maintain_aggregate(stream(), sums, ["g"], "v", str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, rows.rows().collect())) == [(3, 4), (3, 6)]
    assert sorted(map(tuple, sums.rows().collect())) == [(1, 1, 7, 1), (3, 2, 10, 2)]
    before = rows.store.version
    rows.apply(spark.createDataFrame(batches[0], schema), 0)  # a replayed batch
    assert rows.store.version == before


def test_compatible_semantics(spark):
    left, right = spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, x string"), spark.createDataFrame([(1, "r"), (None, "s"), (9, "t")], "j bigint, y string")
    assert R.join(left, right, "k", "j").count() == 1 and R.join(left, right, "k", "j", compat=True).count() == 2
    assert {r.k for r in R.join(left, right, "k", "j", "right").collect()} == {1, None, 9}
    assert [r.k for r in R.join(left, right, "k", "j", "right", True).where("y = 't'").collect()] == [None]
    with pytest.raises(ValueError):
        R.join(left, right, "k", "j", "full")
    with pytest.raises(ValueError):
        R.aggregate(left, ["x"], "max", "k")
    with pytest.raises(ValueError):
        R.union(left, right)
    empty = left.where("false")
    assert R.aggregate(empty, [], "avg", "k").first()[0] is None and R.aggregate(empty, ["x"], "count").count() == 0
