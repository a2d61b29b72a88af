import random
from collections import defaultdict

from stewardry.llm import bitmaps

SCHEMA = "day string, story bigint, user bigint, code string, words string"


def test_exact_counts_merge_and_intersect(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.choice([7, r.randint(0, 4000), r.randint(-(2**60), 2**60), None]), "x", "y") for _ in range(6000)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    codes = bitmaps.dictionary(df, "user")
    known = {x.identifier: x.code for x in codes.collect()}
    users = {x[2] for x in rows} - {None}
    assert set(known) == users and sorted(known.values()) == list(range(len(users)))
    assert known[7] == 0  # the most frequent first
    want = defaultdict(set)
    for day, story, user, *_ in rows:
        if user is not None:
            want[day, story].add(user)
    built = bitmaps.build(df, ["day", "story"], "user", codes)
    assert {(x.day, x.story): x.n_distinct for x in bitmaps.count(built, ["day", "story"]).collect()} == {k: len(v) for k, v in want.items()}
    assert all(w.bits for x in built.limit(20).collect() for w in x.words)  # no zero words
    days = bitmaps.merge(built, ["day"])
    by_day = defaultdict(set)
    for (day, _), s in want.items():
        by_day[day] |= s
    assert {x.day: x.n_distinct for x in bitmaps.count(days, ["day"]).collect()} == {k: len(v) for k, v in by_day.items()}
    halves = [bitmaps.build(df.where(f"pmod(story, 2) = {i}"), ["day"], "user", codes) for i in (0, 1)]
    merged = bitmaps.merge(halves[0].unionByName(halves[1]), ["day"])  # partial results of parts of the data
    both = defaultdict(set)
    for (day, story), s in want.items():
        if story is not None:
            both[day] |= s
    assert {x.day: x.n_distinct for x in bitmaps.count(merged, ["day"]).collect()} == {k: len(v) for k, v in both.items()}
    other = days.where("day = 'b'").replace("b", "a", "day")
    got = bitmaps.count(bitmaps.intersect(days, other, ["day"]), ["day"]).collect()
    assert [(x.day, x.n_distinct) for x in got] == [("a", len(by_day["a"] & by_day["b"]))]


def test_many_identifiers_cross_buckets(spark):
    df = spark.range(200_000).selectExpr("id % 3 AS g", "id * 1000003 AS user")
    built = bitmaps.build(df, ["g"], "user", bitmaps.dictionary(df, "user"))
    assert {x.g: x.n_distinct for x in bitmaps.count(built, ["g"]).collect()} == {0: 66667, 1: 66667, 2: 66666}
    assert built.count() == 12  # four buckets of 65,536 bits per group
    assert built.selectExpr("max(size(words))").first()[0] <= 1024


def test_empty_and_null_only(spark):
    for rows in ([], [("a", 1, None, None, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert bitmaps.count(bitmaps.build(df, ["day"], "user", bitmaps.dictionary(df, "user")), ["day"]).count() == 0
