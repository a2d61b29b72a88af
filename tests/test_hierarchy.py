import random

import pytest

from stewardry.operators.hierarchy import descendants, flaws, hierarchy

SCHEMA = "id bigint, parent bigint, thread bigint, node string"


def brute(rows):
    """Follow every node upwards by itself."""
    parent, thread = {}, {}
    for i, p, t in sorted(rows, key=lambda r: [(x is not None, x) for x in r]):
        if i is not None and i not in parent:
            parent[i], thread[i] = p, t
    out = {}
    for i in parent:
        way, at = [i], i
        while (p := parent[at]) is not None and p in parent and p not in way:
            way.append(p)
            at = p
        p = parent[at]
        if p is not None and p in parent:
            out[i] = ("cycle" if p == i else "below_cycle", False, None, None)
        else:
            missing = p is not None
            wrong = not missing and thread[at] is not None and thread[i] is not None and thread[at] != thread[i]
            out[i] = ("missing_parent" if missing and at == i else "ok", wrong, at, way[::-1])
    return out


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r.node: r for r in hierarchy(df, "id", "parent", "thread", **kw).collect()}


@pytest.mark.parametrize("limits", [{}, {"max_component": 2}, {"solve_rows": 0}, {"max_component": 0, "solve_rows": 3}, {"solve_rows": 60}, {"solve_rows": 45}])
def test_random_forests_match_walking_up(spark, limits):
    rng = random.Random(str(limits))
    rows = []
    for i in range(1, 121):
        p = rng.choice([None, rng.randint(1, 140), rng.randint(max(1, i - 4), max(1, i - 1)), rng.randint(max(1, i - 4), max(1, i - 1))])
        rows.append((i, p, rng.choice([None, 1, 2])))
    rows += rows[:10]
    # cycles of even length, with something below
    rows += [(201, 202, 1), (202, 201, 1), (203, 202, 1), (211, 212, 1), (212, 213, 1), (213, 214, 1), (214, 211, 1), (215, 213, 1), (216, 215, 1)]
    want, got = brute(rows), result(spark, rows, **limits)
    assert set(got) == set(want)
    for i, (state, wrong, root, way) in want.items():
        r = got[i]
        assert (r.state, r.wrong_thread, r.root, r.path) == (state, wrong, root, way), i
        if way:
            assert r.depth == len(way) - 1
            assert r.n_descendants == sum(i in w[3] for w in want.values() if w[3]) - 1


def test_edge_cases(spark):
    assert result(spark, []) == {}
    got = result(spark, [(1, 1, 5), (2, 1, 5), (None, 1, 1), (3, 99, 1), (4, 3, 7), (5, None, None), (6, 5, 8)])
    assert {i: r.state for i, r in got.items()} == {1: "cycle", 2: "below_cycle", 3: "missing_parent", 4: "ok", 5: "ok", 6: "ok"}
    assert not any(r.wrong_thread for r in got.values())


def test_long_chain_and_flaws(spark):
    rows = [(i, i - 1 if i > 1 else None, 1 if i != 700 else 2) for i in range(1, 1001)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    for kw in ({}, {"max_component": 10, "solve_rows": 10}):
        tree = hierarchy(df, "id", "parent", "thread", **kw)
        assert tree.agg({"depth": "max"}).first()[0] == 999
        assert [tuple(r) for r in flaws(tree).collect()] == [(700, "wrong_thread")]
    bare = hierarchy(df, "id", "parent", "thread", paths=False, max_component=10, solve_rows=10)
    assert bare.agg({"depth": "max"}).first()[0] == 999 and bare.where("path IS NOT NULL OR n_descendants IS NOT NULL").count() == 0
    assert descendants(tree).where("node = 990").count() == 10
