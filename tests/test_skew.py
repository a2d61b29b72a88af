from collections import Counter

import pytest

from stewardry.operators.skew import heavy_keys, rounds_for, tree_aggregate, tree_latest

SCHEMA = "k bigint, v bigint, t bigint, slot string"


def rows(n=2000):
    return [(None if i % 50 == 0 else 7 if i % 3 == 0 else i % 40, None if i % 11 == 0 else i, i // 2, "s") for i in range(n)]


@pytest.mark.parametrize("chunk_rows,fan_in", [(65536, 32), (10, 2), (7, 3)])
def test_tree_equals_plain_grouping(spark, chunk_rows, fan_in):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r.k: r for r in tree_aggregate(df, ["k"], {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "t")}, chunk_rows, fan_in).collect()}
    assert {k: r.n for k, r in got.items()} == Counter(d[0] for d in data)
    for k, r in got.items():
        values = [d[1] for d in data if d[0] == k and d[1] is not None]
        assert (r.s, r.lo, r.hi) == (sum(values), min(values), max(d[2] for d in data if d[0] == k))
    latest = tree_latest(df, ["k"], ["t"], 3, chunk_rows, fan_in).where("k = 7").orderBy("rank").collect()
    assert [r.t for r in latest] == sorted((d[2] for d in data if d[0] == 7), reverse=True)[:3]


def test_empty_and_rounds(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tree_aggregate(df, ["k"], {"n": ("count", None)}).count() == 0
    assert tree_latest(df, ["k"], ["t"]).count() == 0
    assert [rounds_for(n, 32) for n in (0, 1, 32, 33, 1024, 1025)] == [2, 2, 2, 2, 2, 3]  # two at least, as one alone is no tree
    with pytest.raises(ValueError):
        rounds_for(4, 1)


def test_heavy_keys_count_repeats_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1, "")] * 3 + [(None, 2, 2, "")] * 96 + [(9, 3, 3, "")], SCHEMA)
    found = {(r.key_field, r.key_value) for r in heavy_keys(df, ["k", "v"], 0.02).collect()}
    assert found == {("k", 1), ("v", 1), ("v", 2)}
