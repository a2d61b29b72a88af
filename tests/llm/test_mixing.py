from collections import defaultdict

import numpy as np

from stewardry.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string, key string, draw string"
PLAN = "mix_id bigint, source string, target_share double, max_repeats bigint, own bigint, total string"


def mixes(spark, docs, plan, **kw):
    placed, full = mixing.place(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), **kw)
    return placed, {(r.mix_id, r.source): r for r in mixing.report(placed, full).collect()}


def data():
    docs = [(i, "x" * (i % 90), ["Big", "big ", "Small", None][(i % 4) if i % 8 else 0], "", "", "") for i in range(800)]
    return docs + [(5000, None, "Small", None, None, None), (5001, "", "Small", "", "", "")]


PLAN_ROWS = [(1, "Big", 0.5, 1, 0, ""), (1, "Small", 0.5, 3, 0, ""), (2, "Big", 0.9, 2, 0, ""), (2, "small", 0.05, 1, 0, ""), (2, "Gone", 0.05, 4, 0, ""), (3, None, 1.0, 1, 0, ""), (4, "Big", None, 1, 0, "")]


def test_shares_repeats_and_totals(spark):
    docs = data()
    own = defaultdict(int)
    for d in docs:
        own[(d[2] or "-").strip().lower()] += len((d[1] or "").encode()) + 1
    for buckets in (50_000, 40):
        placed, report = mixes(spark, docs, PLAN_ROWS, rows_per_bucket=buckets)
        assert set(report) == {(1, "Big"), (1, "Small"), (2, "Big"), (2, "small"), (2, "Gone")}
        for (mix, source), r in report.items():
            total = sum(own[s.lower()] for m, s, *_ in PLAN_ROWS if m == mix and s and s.lower() != "gone")
            share, most = next((p[2], p[3]) for p in PLAN_ROWS if p[0] == mix and p[1] == source)
            goal = min(share * total, most * own[source.lower()] if source != "Gone" else 0)
            assert abs(r.tokens - goal) <= 45.5  # half of the largest document
            assert r.short == (most * (own[source.lower()] if source != "Gone" else 0) < share * total)
            assert r.repeats <= most
        uses = defaultdict(int)
        for r in placed.collect():
            uses[r.mix_id, r.source, r.doc_id] += 1
            assert 0 <= r.position <= 1
        assert all(n <= next(p[3] for p in PLAN_ROWS if p[:2] == k[:2]) for k, n in uses.items())


def test_weights_follow_the_schedule(spark):
    """Tokens placed up to time t match the integral of the source's weight up to t."""
    docs = [(i, "x" * 99, "A" if i % 3 else "B", "", "", "") for i in range(3000)]
    placed, _ = mixes(spark, docs, [(1, "A", 0.6, 2, 0, ""), (1, "B", 0.4, 4, 0, "")])
    full = mixing.place(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "A", 0.6, 2, 0, ""), (1, "B", 0.4, 4, 0, "")], PLAN))[1].collect()
    assert abs(sum(r.target_share * r.slope for r in full)) < 1e-12
    for r in full:
        at = np.sort([x.position for x in placed.where(f"source = '{r.source}'").collect()])
        for t in (0.1, 0.35, 0.5, 0.8):
            assert abs((at <= t).mean() - (t + r.slope * (t * t - t))) < 0.01
    ordered = [x.position for x in mixing.in_order(placed).collect()]
    assert ordered == sorted(ordered)


def test_empty(spark):
    for docs, plan in (([], PLAN_ROWS), (data(), [])):
        placed, report = mixes(spark, docs, plan)
        assert placed.count() == 0 and all(r.tokens == 0 for r in report.values())
