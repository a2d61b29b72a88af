"""Who owns and who sees which row, derived by joins instead of kept as copies."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.plans.catalog import Catalog
from stewardry.plans.graph import edges, order, owned_tables
from stewardry.runtime import cut


def _pk(catalog: Catalog, table: str):
    return F.col(catalog.table(table).key)


def owners(catalog: Catalog, tables: dict[str, DataFrame], wanted: set[str] | None = None) -> dict[str, DataFrame]:
    """By table: distinct (pk, kind, subject) of the rows somebody owns; ``subject`` is the subject's key as text.

    A foreign key straight to a data subject that nobody else owns needs no join.
    Rows owned through others take one join per hop; several ways unite.
    """
    owned = owned_tables(catalog)
    out: dict[str, DataFrame] = {}
    for name in order(catalog):
        t, df, ways = catalog.table(name), tables[name], []
        pk = F.col(t.key).alias("pk")
        if t.data_subject:
            ways.append(df.select(pk, F.lit(name).alias("kind"), F.col(t.key).cast("string").alias("subject")))
        for e in owned.get(name, []):
            parent = catalog.table(e.parent)
            if not e.reverse and parent.data_subject and not owned.get(e.parent):
                ways.append(df.where(F.col(e.column).isNotNull()).select(pk, F.lit(e.parent).alias("kind"), F.col(e.column).cast("string").alias("subject")))
                continue
            above = out[e.parent].withColumnRenamed("pk", "at__")
            if e.reverse:
                link = tables[e.parent].select(F.col(parent.key).alias("at__"), F.col(e.column).alias("pk")).where(F.col("pk").isNotNull())
                link = link.join(df.select(pk), "pk", "left_semi")
            else:
                link = df.select(pk, F.col(e.column).alias("at__")).where(F.col("at__").isNotNull())
            ways.append(link.join(above, "at__").select("pk", "kind", "subject"))
        if ways:
            out[name] = reduce(DataFrame.unionByName, ways).distinct() if len(ways) > 1 or not t.data_subject else ways[0]
    return out if wanted is None else {k: v for k, v in out.items() if k in wanted}


def one_owner(catalog: Catalog, name: str) -> bool:
    """Whether no row of the table can have two owners: one foreign key per hop up to a data subject that nobody owns."""
    owned = owned_tables(catalog)
    while not catalog.table(name).data_subject:
        ways = owned.get(name, [])
        if len(ways) != 1 or ways[0].reverse:
            return False
        name = ways[0].parent
    return name not in owned


def copies(catalog: Catalog, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """By table: (pk, shard) of every copy a store with one shard per subject would hold; rows without owner have one in the default shard."""
    owned = owners(catalog, tables)
    out = {}
    for name, df in tables.items():
        pk = df.select(_pk(catalog, name).alias("pk"))
        own = owned.get(name)
        shard = F.concat_ws("/", "kind", "subject")
        out[name] = pk.withColumn("shard", F.lit("default")) if own is None else pk.join(own, "pk", "left").select("pk", F.when(F.col("kind").isNull(), "default").otherwise(shard).alias("shard")).distinct()
    return out


def orphans(catalog: Catalog, tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of an owned table that nobody owns."""
    own = owners(catalog, tables).get(name)
    return tables[name].limit(0) if own is None else tables[name].join(own.select(F.col("pk").alias(catalog.table(name).key)), catalog.table(name).key, "left_anti")


def ownership_index(catalog: Catalog, tables: dict[str, DataFrame], name: str, column: str) -> DataFrame:
    """(_col, _shard, _c), names that are fixed: for every value of a column the subjects whose shards hold rows with it, and how many ways lead there."""
    owned = owned_tables(catalog)
    t, df = catalog.table(name), tables[name]
    ways = []
    for e in owned.get(name, []):
        parent = catalog.table(e.parent)
        if parent.data_subject and not e.reverse:
            ways.append(df.where(F.col(e.column).isNotNull()).select(F.col(column).alias("_col"), F.col(e.column).cast("string").alias("_shard"), F.lit(1).cast("bigint").alias("_c")))
        elif e.reverse and parent.data_subject:
            link = tables[e.parent].select(F.col(parent.key).cast("string").alias("_shard"), F.col(e.column).alias("at__"))
            ways.append(df.join(link, F.col(t.key) == F.col("at__")).select(F.col(column).alias("_col"), "_shard", F.lit(1).cast("bigint").alias("_c")))
        else:
            above = ownership_index(catalog, tables, e.parent, parent.key).withColumnRenamed("_col", "at__")
            if e.reverse:
                link = tables[e.parent].select(F.col(parent.key).alias("at__"), F.col(e.column).alias("to")).where(F.col("to").isNotNull())
                above = above.join(link, "at__").drop("at__").withColumnRenamed("to", "at__")
                ways.append(df.join(above, F.col(t.key) == F.col("at__")).select(F.col(column).alias("_col"), "_shard", "_c"))
            else:
                ways.append(df.join(above, F.col(e.column) == F.col("at__")).select(F.col(column).alias("_col"), "_shard", "_c"))
    if not ways:
        raise ValueError(f"nobody owns {name}")
    every = reduce(DataFrame.unionByName, ways)
    return every.groupBy("_col", "_shard").agg(F.sum("_c").alias("_c")).where("_c > 0")


class Reached(NamedTuple):
    """(pk, via) of the rows a subject owns and of those it may see; the rows themselves with ``via_`` where a single way leads to them."""

    owned: DataFrame
    accessed: DataFrame
    rows: DataFrame | None = None


def reach(catalog: Catalog, tables: dict[str, DataFrame], kind: str, subject: object) -> dict[str, Reached]:
    """By table: what one subject reaches; ``via`` names the foreign keys that lead to a row.

    Starts at the subject's own row and follows edges by semi-joins, so only what
    the subject reaches is ever joined. Access adds to ownership and goes on
    along every edge, also around self-references, until no new rows appear.
    """
    itself = tables[kind].where(_pk(catalog, kind) == F.lit(subject))
    start = itself.select(_pk(catalog, kind).alias("pk"), F.lit("").alias("via"))
    owned: dict[str, DataFrame] = {kind: start}
    single: dict[str, DataFrame] = {kind: itself.withColumn("via_", F.array(F.lit("")))}
    every = edges(catalog)

    alone = kind not in owned_tables(catalog)  # then the subject owns one row of its own table, itself

    def found_rows(e, parents: DataFrame) -> DataFrame:
        child, parent = catalog.table(e.child), catalog.table(e.parent)
        if e.parent == kind and not e.reverse and alone and parents is start:
            return tables[e.child].where(F.col(e.column) == F.lit(subject))  # reaches the scan
        at = parents.select(F.col("pk").alias("at__")).distinct()
        if e.reverse:
            links = tables[e.parent].join(at, F.col(parent.key) == F.col("at__"), "left_semi").select(F.col(e.column).alias("at__")).where(F.col("at__").isNotNull()).distinct()
            return tables[e.child].join(links, F.col(child.key) == F.col("at__"), "left_semi")
        return tables[e.child].join(at, F.col(e.column) == F.col("at__"), "left_semi")

    def step(e, parents: DataFrame) -> DataFrame:
        return found_rows(e, parents).select(_pk(catalog, e.child).alias("pk"), F.lit(e.via).alias("via"))

    for name in order(catalog):
        steps = [e for e in every if not e.access and e.child == name and e.parent in owned]
        ways = [step(e, owned[e.parent]) for e in steps]
        if steps and name in single or len(steps) > 1:
            single.pop(name, None)
        elif steps:
            single[name] = found_rows(steps[0], owned[steps[0].parent]).withColumn("via_", F.array(F.lit(steps[0].via)))
        if ways:
            owned[name] = reduce(DataFrame.unionByName, ways, owned[name]) if name in owned else reduce(DataFrame.unionByName, ways)
    accessed: dict[str, DataFrame] = {}
    if any(e.access for e in every):
        frontier, allowed = dict(owned), True
        while frontier:  # ends, as every round adds rows that were not known or is the last
            fresh: dict[str, DataFrame] = {}
            for e in every:
                if e.parent in frontier and (e.access or not allowed):
                    if e.child == e.parent and not e.reverse:
                        # all levels at once; what came by this edge has been followed to the end
                        source = frontier[e.parent].where(F.col("via") != e.via)
                        if not source.limit(1).count():
                            continue
                        found = below(tables[e.child], catalog.table(e.child).key, e.column, source).select("pk", F.lit(e.via).alias("via"))
                    else:
                        found = step(e, frontier[e.parent])
                    fresh[e.child] = fresh[e.child].unionByName(found) if e.child in fresh else found
            grown: dict[str, DataFrame] = {}
            for name, found in fresh.items():
                known = accessed.get(name)
                new = cut((found if known is None else found.join(known, ["pk", "via"], "left_anti")).distinct())
                if new.limit(1).count():
                    accessed[name] = new if known is None else known.unionByName(new)
                    grown[name] = new
            frontier, allowed = grown, False
    none = {n: _none(tables[n], catalog, n) for n in {*owned, *accessed}}
    return {n: Reached(owned.get(n, none[n]), accessed.get(n, none[n]), None if n in accessed else single.get(n)) for n in none}


def below(df: DataFrame, key: str, column: str, start: DataFrame) -> DataFrame:
    """(pk) of all rows under the rows ``start`` (pk) along a self-reference, however deep, also around cycles.

    Every row learns by pointer doubling whether any row above it is among
    ``start``, so the number of rounds grows with the logarithm of the depth.
    """
    given = start.select(F.col("pk").alias("ptr"), F.lit(True).alias("seen")).distinct()
    links = df.select(F.col(key).alias("pk"), F.col(column).alias("ptr")).where(F.col("ptr").isNotNull()).distinct()
    state = cut(links.join(given, "ptr", "left").select("pk", "ptr", F.coalesce("seen", F.lit(False)).alias("seen")))
    left, before = state.where(~F.col("seen")).count(), -1
    while left and left != before:  # a round that settles no row leaves only cycles without any of ``start``
        ahead = state.select(F.col("pk").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seen").alias("seen2"))
        moved = state.where(~F.col("seen")).join(ahead, "ptr").select("pk", F.col("ptr2").alias("ptr"), F.col("seen2").alias("seen"))
        # a row whose pointer runs out has nothing of ``start`` above it and drops out
        state = cut(state.where("seen").unionByName(moved))
        left, before = state.where(~F.col("seen")).count(), left
    return state.where("seen").select("pk").distinct()


def _none(df: DataFrame, catalog: Catalog, name: str) -> DataFrame:
    return df.limit(0).select(_pk(catalog, name).alias("pk"), F.lit("").alias("via"))
