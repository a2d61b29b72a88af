"""Subject access and erasure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.operators.ownership import one_owner, owners, reach
from stewardry.plans.catalog import Catalog, Rule
from stewardry.plans.graph import edges


def _with_via(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The found rows once each, with the set of foreign keys that lead to them."""
    via = found.groupBy(F.col("pk").alias("pk__")).agg(F.array_sort(F.collect_set("via")).alias("via_"))
    return df.join(via, F.col(key) == F.col("pk__")).drop("pk__")


def _apply(df: DataFrame, rules: list[Rule], names: list[str]) -> DataFrame:
    """Nulls the columns of all rules that hold; a rule without columns drops the row."""
    hidden: dict[str, list] = {}
    for r in rules:
        hit = F.array_contains("via_", r.column)
        if r.delete_row:
            df = df.where(~hit)
        for c in r.columns:
            hidden.setdefault(c, []).append(hit)
    by = {n.lower(): n for n in names}
    out = []
    for n in names:
        hits = [h for c, hs in hidden.items() if by.get(c.lower()) == n for h in hs]
        out.append(F.when(~_any(hits), F.col(n)).alias(n) if hits else F.col(n))
    return df.select(*out, "via_")


def _any(hits: list):
    total = hits[0]
    for h in hits[1:]:
        total = total | h
    return total


def get(catalog: Catalog, tables: dict[str, DataFrame], kind: str, subject: object) -> dict[str, DataFrame]:
    """By visited table: every row the subject owns or may see, once, with the rules for GET applied."""
    out = {}
    for name, (owned, accessed, rows) in reach(catalog, tables, kind, subject).items():
        t = catalog.table(name)
        if rows is None:
            rows = _with_via(tables[name], t.key, owned.unionByName(accessed))
        out[name] = _apply(rows, [r for r in t.rules if r.on == "GET"], t.names).select(*t.names)
    return {n: out[n] for n in catalog.tables if n in out}


@dataclass
class Forgotten:
    """New contents of the changed tables, their changes (with weights ``_w``), and the number of copies deleted or updated."""

    tables: dict[str, DataFrame]
    deltas: dict[str, DataFrame]
    count: DataFrame


def forget(catalog: Catalog, tables: dict[str, DataFrame], kind: str, subject: object) -> Forgotten:
    """Erases a subject: rows without any other owner go; of what stays, the rules for DEL null columns or drop the row everywhere."""
    changed, deltas, counts = {}, {}, []
    all_owners = owners(catalog, tables)
    seen_by_others = any(e.access for e in edges(catalog))
    for name, (owned, accessed, rows) in reach(catalog, tables, kind, subject).items():
        t = catalog.table(name)
        if rows is None:
            rows = _with_via(tables[name], t.key, owned.unionByName(accessed))
            mine = owned.select(F.col("pk").alias(t.key), F.lit(True).alias("mine_")).distinct()
            rows = rows.join(mine, t.key, "left").withColumn("mine_", F.coalesce("mine_", F.lit(False)))
        else:
            rows = rows.withColumn("mine_", F.lit(True))
        # rows that only their one owner can reach have no others
        only_mine = one_owner(catalog, name) and not seen_by_others
        if name in all_owners and not only_mine:
            others = all_owners[name].where((F.col("kind") != kind) | (F.col("subject") != F.lit(subject).cast("string")))
            others = others.join(rows.select(F.col(t.key).alias("pk")), "pk", "left_semi").groupBy(F.col("pk").alias(t.key)).agg(F.count(F.lit(1)).alias("others_"))
            rows = rows.join(others, t.key, "left").withColumn("others_", F.coalesce("others_", F.lit(0)))
        else:
            rows = rows.withColumn("others_", F.lit(0))
        stays = (F.col("others_") > 0) | ~F.col("mine_")
        rules = [r for r in t.rules if r.on == "DEL"]
        drop = _any([F.array_contains("via_", r.column) for r in rules if r.delete_row]) if any(r.delete_row for r in rules) else F.lit(False)
        anon = _any([F.array_contains("via_", r.column) for r in rules if not r.delete_row]) if any(not r.delete_row for r in rules) else F.lit(False)
        left = F.greatest(F.col("others_"), F.lit(1))
        counts.append(rows.select((F.col("mine_").cast("bigint") + F.when(stays & (drop | anon), left).otherwise(0)).alias("n")))
        kept = _apply(rows.where(stays & ~drop & anon), [r for r in rules if not r.delete_row], t.names)
        touched = rows.where(~stays | drop | anon).select(t.key)
        same = tables[name].join(touched, t.key, "left_anti")
        changed[name] = same.select(*t.names).unionByName(kept.select(*t.names))
        minus = rows.where(~stays | drop | anon).select(*t.names, F.lit(-1).alias("_w"))
        deltas[name] = minus.unionByName(kept.select(*t.names, F.lit(1).alias("_w")))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return Forgotten(changed, deltas, total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
