"""Full hierarchies from parent-child links.

1. Connected components: every node follows its parent by pointer doubling until
   it meets a top (a node without parent, or whose parent does not exist). What
   no round resolves any more leads into a cycle and is labelled by the least
   node on that cycle, again by doubling.
2. Components are co-located (one shuffle on the label) and an iterative
   depth-first traversal with white, grey and black nodes gives depth, root,
   path, subtree size and the back edges that close cycles.
3. A component of more than ``max_component`` nodes is never put into one task;
   its paths, depths and sizes come from doubling as well, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.runtime import cut

ROOT, MISSING, CYCLE, BELOW = "ok", "missing_parent", "cycle", "below_cycle"

#: Unresolved nodes (two numbers each) that one task may follow to the end; more go on doubling across all tasks.
SOLVE_ROWS = 500_000

_NODE = "node bigint, parent bigint, thread bigint, component bigint, top_thread bigint, top_missing boolean"
_OUT = "node bigint, parent bigint, component bigint, root bigint, depth int, state string, wrong_thread boolean, n_descendants bigint, path array<bigint>"


def links(df: DataFrame, node: str, parent: str, thread: str | None = None) -> DataFrame:
    """One row (node, parent, thread) per node: repeats merge, of differing repeats the least counts, null nodes are no nodes."""
    value = F.struct(F.col(parent).cast("bigint").alias("parent"), (F.col(thread) if thread else F.lit(None)).cast("bigint").alias("thread"))
    one = df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("bigint").alias("node")).agg(F.min(value).alias("v"))
    return one.select("node", "v.parent", "v.thread")


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within one bounded set of (node, ptr): the pointer by which each node leaves the set, or its cycle's least node."""
    held = pd.concat(list(batches), ignore_index=True)
    if held.empty:
        return
    held = held.sort_values("node", ignore_index=True)
    node, ptr = held["node"].to_numpy(np.int64), held["ptr"].to_numpy(np.int64)
    n = len(node)
    at = np.minimum(np.searchsorted(node, ptr), n - 1)
    inside = node[at] == ptr
    jump, least = np.where(inside, at, np.arange(n)), node.copy()
    for _ in range(n.bit_length() + 1):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    loose = inside[jump]  # still inside after more steps than there are nodes
    held["exit"] = np.where(loose, least[jump], ptr[jump])
    held["cyclic"] = loose
    yield held[["node", "exit", "cyclic"]]


def components(nodes: DataFrame, solve_rows: int = SOLVE_ROWS) -> DataFrame:
    """Adds component, top_thread (null in cyclic components) and top_missing to (node, parent, thread).

    Pointer doubling over all nodes goes on until at most ``solve_rows`` nodes are
    unresolved; those are few enough for one task to follow to the end.
    """
    base = nodes.alias("a").join(nodes.select(F.col("node").alias("there")), F.col("a.parent") == F.col("there"), "left")
    state = base.select(
        "node", "parent", "thread",
        F.when(F.col("there").isNull(), F.col("node")).otherwise(F.col("parent")).alias("ptr"),
        F.col("there").isNull().alias("done"),
        F.when(F.col("there").isNull(), F.col("thread")).alias("top_thread"),
        (F.col("parent").isNotNull() & F.col("there").isNull()).alias("top_missing"),
    )
    state = cut(state)
    resolved, active = [state.where("done")], state.where(~F.col("done"))
    left, stuck = active.count(), False
    while left > solve_rows and not stuck:
        known = reduce(DataFrame.unionByName, resolved, active)
        ahead = known.select(F.col("node").alias("at"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), F.col("top_thread").alias("thread2"), F.col("top_missing").alias("missing2"))
        moved = cut(active.join(ahead, F.col("ptr") == F.col("at")).select(
            "node", "parent", "thread", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), F.col("thread2").alias("top_thread"), F.col("missing2").alias("top_missing")
        ))
        resolved.append(moved.where("done"))
        active = moved.where(~F.col("done"))
        still = active.count()
        stuck = still == left  # no depth between 2^r and 2^(r+1): what is left has no top at all
        left = still
    columns = ["node", "parent", "thread", F.col("ptr").alias("component"), "top_thread", "top_missing"]
    tree = reduce(DataFrame.unionByName, resolved).select(*columns)
    if not left:
        return tree
    if left <= solve_rows:
        # along parents, not along jumps: jumps of even length would split a cycle
        ends = active.select("node", F.col("parent").alias("ptr")).coalesce(1).mapInPandas(_solve, "node bigint, exit bigint, cyclic boolean")
        tops = reduce(DataFrame.unionByName, resolved).select(F.col("node").alias("exit"), F.col("ptr").alias("top"), "top_thread", "top_missing")
        met = active.drop("top_thread", "top_missing").join(ends, "node").join(tops, "exit", "left")
        # the least node of a cycle is not among the resolved ones, so it meets no top
        return tree.unionByName(met.select("node", "parent", "thread", F.coalesce("top", "exit").alias("component"), "top_thread", F.coalesce("top_missing", F.lit(False)).alias("top_missing")))
    ring = cut(active.select("node", "parent", "thread", F.col("parent").alias("ptr"), F.col("node").alias("least")))
    steps = 1
    while steps < 2 * left:
        ahead = ring.select(F.col("node").alias("at"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"))
        ring = cut(ring.join(ahead, F.col("ptr") == F.col("at")).select("node", "parent", "thread", F.col("ptr2").alias("ptr"), F.least("least", "least2").alias("least")))
        steps *= 2
    on_cycle = ring.select(F.col("node").alias("at"), F.col("least").alias("component"))
    ring = ring.join(on_cycle, F.col("ptr") == F.col("at")).select(
        "node", "parent", "thread", "component", F.lit(None).cast("bigint").alias("top_thread"), F.lit(False).alias("top_missing")
    )
    return tree.unionByName(ring)


def _traverse(nodes: list, parents: list, threads: list, component: int, top_thread, top_missing: bool, paths: bool) -> Iterator[tuple]:
    """Depth-first over one component; parents lie in it, or it has one top. A node's row goes out when the node is left, its path being the stack."""
    at = {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    children: list[list[int]] = [[] for _ in range(n)]
    start = -1
    for i, p in enumerate(parents):
        j = at.get(p) if p is not None else None
        if j is None:
            start = i
        else:
            children[j].append(i)
    size, colour, back = [0] * n, bytearray(n), set()
    cyclic = start < 0
    if cyclic:
        start = at[component]
    colour[start], stack = 1, [(start, iter(children[start]))]
    way = [nodes[start]]
    while stack:
        i, rest = stack[-1]
        for j in rest:
            if colour[j] == 0:
                colour[j] = 1
                stack.append((j, iter(children[j])))
                way.append(nodes[j])
                break
            if colour[j] == 1:  # a back edge: the grey nodes from j to i form a cycle
                back.update(k for k, _ in stack[next(x for x, (k, _) in enumerate(stack) if k == j) :])
        else:
            colour[i] = 2
            if not cyclic:
                state = MISSING if top_missing and i == start else ROOT
                wrong = not top_missing and top_thread is not None and threads[i] is not None and threads[i] != top_thread
                yield nodes[i], parents[i], component, nodes[start], len(stack) - 1, state, wrong, size[i] if paths else None, way.copy() if paths else None
            stack.pop()
            way.pop()
            if stack:
                size[stack[-1][0]] += size[i] + 1
    if cyclic:
        for i in range(n):
            yield nodes[i], parents[i], component, None, None, CYCLE if i in back else BELOW, False, None, None


_ARROW = pa.schema(
    [("node", pa.int64()), ("parent", pa.int64()), ("component", pa.int64()), ("root", pa.int64()), ("depth", pa.int32()), ("state", pa.string()), ("wrong_thread", pa.bool_()), ("n_descendants", pa.int64()), ("path", pa.list_(pa.int64()))]
)


#: Nodes of paths that a task holds before it sends them on.
_FRAME = 100_000


def _co_located(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        def done(rows: list[tuple]) -> Iterator[tuple]:
            n, p, t, c, top, missing = zip(*rows)
            return _traverse(list(n), list(p), list(t), c[0], top[0], missing[0], paths)

        def finished() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:  # a component may go on in the next batch
                for row in zip(*[batch.column(c).to_pylist() for c in ("node", "parent", "thread", "component", "top_thread", "top_missing")]):
                    if held and held[0][3] != row[3]:
                        yield from done(held)
                        held = []
                    held.append(row)
            if held:
                yield from done(held)

        out: list[tuple] = []
        entries = 0
        for row in finished():
            out.append(row)
            entries += 1 + len(row[-1] or ())
            if entries > _FRAME:  # so that long paths never pile up
                yield frame(out)
                out, entries = [], 0
        if out:
            yield frame(out)

    return run


def _doubled(giant: DataFrame, paths: bool) -> DataFrame:
    """The same result for components too large for one task, by doubling alone."""
    own = cut(giant)
    top = F.col("node") == F.col("component")
    there = own.select(F.col("node").alias("there"), F.col("component").alias("its"))
    known = own.join(there, F.col("parent") == F.col("there"), "left")
    state = known.select(
        "node", "parent", "thread", "component", "top_thread", "top_missing",
        F.when(top, F.lit(None)).otherwise(F.col("parent")).cast("bigint").alias("ptr"),
        F.when(top & F.col("there").isNotNull(), F.lit(True)).otherwise(F.lit(False)).alias("ring"),
        (F.array("node") if paths else F.lit(None).cast("array<bigint>")).alias("path"), F.lit(1).alias("far"),
    )
    # a component whose least cycle node keeps an existing parent is cyclic as a whole
    rings = state.where("ring").select(F.col("component").alias("c"))
    cyclic = state.join(rings, F.col("component") == F.col("c"), "left_semi")
    state = cut(state.join(rings, F.col("component") == F.col("c"), "left_anti").drop("ring"))
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        ahead = state.select(F.col("node").alias("at"), F.col("ptr").alias("ptr2"), F.col("path").alias("path2"), F.col("far").alias("far2"))
        state = cut(state.join(ahead, F.col("ptr") == F.col("at"), "left").select(
            "node", "parent", "thread", "component", "top_thread", "top_missing", F.col("ptr2").alias("ptr"),
            F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
        ))
    wrong = ~F.col("top_missing") & F.coalesce(F.col("thread") != F.col("top_thread"), F.lit(False))
    if paths:
        sizes = state.select(F.explode("path").alias("at")).groupBy("at").agg((F.count(F.lit(1)) - 1).alias("n_descendants"))
        state = state.join(sizes, F.col("node") == F.col("at"))
    else:
        state = state.withColumn("n_descendants", F.lit(None).cast("bigint"))
    straight = state.select(
        "node", "parent", "component", F.col("component").alias("root"), (F.col("far") - 1).alias("depth"),
        F.when(F.col("top_missing") & top, MISSING).otherwise(ROOT).alias("state"), wrong.alias("wrong_thread"), "n_descendants", "path",
    )
    # on the cycle: reached again from its least node; the way is followed by doubling of the on-cycle set
    ring = cut(cyclic.select("node", "parent", "component", F.col("parent").alias("ptr")))
    total, steps = ring.count(), 1
    while steps < total:
        ahead = ring.select(F.col("node").alias("at"), F.col("ptr").alias("ptr2"))
        ring = cut(ring.join(ahead, F.col("ptr") == F.col("at")).select("node", "parent", "component", F.col("ptr2").alias("ptr")))
        steps *= 2
    on = ring.select(F.col("ptr").alias("on")).distinct()
    null = F.lit(None).cast("bigint")
    round_ = ring.join(on, F.col("node") == F.col("on"), "left").select(
        "node", "parent", "component", null.alias("root"), F.lit(None).cast("int").alias("depth"),
        F.when(F.col("on").isNotNull(), CYCLE).otherwise(BELOW).alias("state"), F.lit(False).alias("wrong_thread"), null.alias("n_descendants"),
        F.lit(None).cast("array<bigint>").alias("path"),
    )
    return straight.unionByName(round_)


def hierarchy(df: DataFrame, node: str, parent: str, thread: str | None = None, paths: bool = True, max_component: int = 200_000, solve_rows: int = SOLVE_ROWS) -> DataFrame:
    """One row per node: node, parent, component, root, depth, state, wrong_thread, n_descendants, path (root first).

    state: ``ok``, ``missing_parent`` (the node's own parent does not exist; it
    then tops its tree), ``cycle`` or ``below_cycle``; the last two have no root,
    depth, path or descendants, and without ``paths`` no node has the last two. wrong_thread: the top has no parent and another
    thread (both not null). Null nodes are left out, repeated rows merge, a node
    that is its own parent is a cycle, an empty table gives no rows, further columns are ignored.
    """
    labelled = cut(components(links(df, node, parent, thread), solve_rows))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    giants = labelled.groupBy("component").count().where(F.col("count") > max_component).select("component")
    giants = cut(giants)
    some = giants.limit(1).count() > 0
    small = labelled.join(giants, "component", "left_anti") if some else labelled
    near = small.select(*columns).repartition("component").sortWithinPartitions("component", "node")
    result = near.mapInArrow(_co_located(paths), _OUT)
    if some:
        result = result.unionByName(_doubled(labelled.join(giants, "component", "left_semi").select(*columns), paths))
    return result


def flaws(tree: DataFrame) -> DataFrame:
    """(node, flaw) rows of a hierarchy."""
    named = F.array(F.when(F.col("state") != ROOT, F.col("state")), F.when(F.col("wrong_thread"), F.lit("wrong_thread")))
    return tree.select("node", F.explode(F.array_compact(named)).alias("flaw"))


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every node of a tree and everything below it, one row each."""
    up = tree.where(F.col("path").isNotNull()).select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return up.where(F.col("at") < F.col("depth")).select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
