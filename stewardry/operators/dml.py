"""Changes of base tables: new contents, weighted deltas, and how many copies of rows a sharded store would touch."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.functions.compat import is_in, minus, plus
from stewardry.operators.ownership import owners
from stewardry.plans.catalog import Catalog, CatalogError, Table
from stewardry.plans.graph import edges, owned_tables
from stewardry.runtime import cut

WEIGHT = "_w"


@dataclass
class Change:
    """What a statement does: new contents and delta of its table, and its count of copies."""

    table: str
    contents: DataFrame
    delta: DataFrame
    count: int = 0
    orphans: dict[str, DataFrame] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)


def condition(where: list[tuple[str, str, object]], t: Table) -> Column:
    """A conjunction of column conditions; = and IN compare by value, so that null meets null."""
    made = F.lit(True)
    for name, sign, value in where:
        c = F.col(t.column(name).name)
        if sign in {"=", "IS"}:
            made &= is_in(c, [value])
        elif sign == "IN":
            made &= is_in(c, value)
        elif sign in {"IS NOT", "<>", "!="}:
            made &= c.isNotNull() if value is None else c != F.lit(value)
        else:
            made &= {"<": c < F.lit(value), ">": c > F.lit(value), "<=": c <= F.lit(value), ">=": c >= F.lit(value)}[sign]
    return made


def _value(expression: tuple, t: Table) -> Column:
    what, *rest = expression
    if what == "lit":
        return F.lit(rest[0])
    if what == "col":
        return F.col(t.column(rest[0]).name)
    left, right = (_value(x, t) for x in rest)
    return plus(left, right) if what == "+" else minus(left, right)


def new_row(t: Table, columns: list[str], values: list, following: int) -> dict[str, object]:
    """A row with defaults and the next number of the counter."""
    names = [t.column(c).name for c in columns] or t.names
    if len(names) != len(values):
        raise CatalogError(f"{len(names)} columns but {len(values)} values")
    row = dict(zip(names, values))
    return {c.name: row[c.name] if c.name in row else following if c.auto_increment else c.default for c in t.columns}


def numbered(df: DataFrame, column: str, above: int) -> DataFrame:
    """Fills nulls of an AUTO_INCREMENT column of a bulk load with numbers above ``above``, without one task seeing all rows."""
    at = F.monotonically_increasing_id()
    part = F.spark_partition_id()
    held = cut(df.withColumn("at_", at).withColumn("part_", part))  # numbered once, whatever is computed again
    sizes = held.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    base = sizes.select("part_", (F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + above + 1).alias("base_"))
    number = F.col("base_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(base), "part_").withColumn(column, F.coalesce(column, number)).select(*df.columns)


def check_targets(catalog: Catalog, tables: dict[str, DataFrame], t: Table, rows: DataFrame) -> None:
    """Every owner a row names, and every row it is to own, must exist."""
    implicit = {e.column for e in edges(catalog) if e.child == t.name and not e.access and not e.reverse}
    for f in t.foreign_keys:
        if f.kind in {"OWNED_BY", "OWNS"} or f.column in implicit:
            target = catalog.table(f.table)
            named = rows.select(F.col(f.column).alias("to")).where(F.col("to").isNotNull())
            if named.join(tables[target.name].select(F.col(target.key).alias("to")), "to", "left_anti").limit(1).count():
                raise CatalogError(f"{t.name}.{f.column} refers to a row of {target.name} that does not exist")


def check_free(catalog: Catalog, tables: dict[str, DataFrame], t: Table, rows: DataFrame) -> None:
    """No row may go on which an owned row, or a row that owns it, still depends."""
    pk = rows.select(F.col(t.key).alias("at"))
    for e in edges(catalog):
        if e.access:
            continue
        if not e.reverse and e.parent == t.name:
            holder, column = tables[e.child], e.column
        elif e.reverse and e.child == t.name:
            holder, column = tables[e.parent], e.column
        else:
            continue
        if holder.select(F.col(column).alias("at")).join(pk, "at", "left_semi").limit(1).count():
            raise CatalogError(f"rows of {t.name} are still referred to by {e.parent if e.reverse else e.child}.{column}")


def _affected(catalog: Catalog, old: dict[str, DataFrame], new: dict[str, DataFrame], name: str, pks: DataFrame) -> dict[str, DataFrame]:
    """By table: keys of rows whose owners may differ because rows ``pks`` of ``name`` changed."""
    out, waiting = {name: pks}, [name]
    while waiting:
        at = waiting.pop(0)
        for e in edges(catalog):
            if e.access or e.parent != at:
                continue
            child, parent = catalog.table(e.child), catalog.table(e.parent)
            found = []
            for tables in (old, new):
                if e.reverse:
                    rows = tables[e.parent].join(out[at].select(F.col("pk").alias(parent.key)), parent.key, "left_semi")
                    found.append(rows.select(F.col(e.column).alias("pk")).where(F.col("pk").isNotNull()))
                else:
                    rows = tables[e.child].join(out[at].select(F.col("pk").alias(e.column)), e.column, "left_semi")
                    found.append(rows.select(F.col(child.key).alias("pk")))
            both = found[0].unionByName(found[1])
            out[e.child] = (out[e.child].unionByName(both) if e.child in out else both).distinct()
            waiting.append(e.child)
    return out


def _copies(catalog: Catalog, tables: dict[str, DataFrame], affected: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """By table: (pk, shard) of every copy of the affected rows, the default shard being empty."""
    own = owners(catalog, tables)
    out = {}
    for name, pks in affected.items():
        t = catalog.table(name)
        rows = tables[name].select(F.col(t.key).alias("pk")).join(pks, "pk", "left_semi")
        if name in own:
            rows = rows.join(own[name], "pk", "left").select("pk", F.when(F.col("kind").isNull(), "").otherwise(F.concat_ws("/", "kind", "subject")).alias("shard"))
        else:
            rows = rows.withColumn("shard", F.lit(""))
        out[name] = rows.distinct()
    return out


def settle(catalog: Catalog, tables: dict[str, DataFrame], t: Table, contents: DataFrame, delta: DataFrame, moved: bool | None = None) -> Change:
    """Counts the copies that a change touches and finds the rows it orphans.

    ``moved``: None for inserts and deletes; for updates, whether an ownership
    column changed. Only the changed rows and what they own are looked at.
    """
    new = {**tables, t.name: contents}
    pks = cut(delta.select(F.col(t.key).alias("pk")).distinct())
    affected = _affected(catalog, tables, new, t.name, pks)
    before, after = _copies(catalog, tables, affected), _copies(catalog, new, affected)
    owned = owned_tables(catalog)
    count, lost = 0, {}
    for name in affected:
        both = before[name].withColumn("side", F.lit(1)).unionByName(after[name].withColumn("side", F.lit(2)))
        sides = cut(both.groupBy("pk", "shard").agg(F.sum("side").alias("side")))
        own_update = name == t.name and moved is not None
        weight = F.when(F.col("side") == 3, 2 if moved else 1).when(F.col("side") == 2, 1).otherwise(1 if moved else 0) if own_update else (F.col("side") != 3).cast("int")
        count += sides.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        if name in owned and not catalog.table(name).data_subject:
            orphaned = sides.where((F.col("side") == 2) & (F.col("shard") == "")).select("pk")
            if orphaned.limit(1).count():
                lost[name] = orphaned
    return Change(t.name, contents, delta, int(count), lost)


def insert(catalog: Catalog, tables: dict[str, DataFrame], name: str, columns: list[str], values: list, counters: dict[str, int]) -> Change:
    t = catalog.table(name)
    spark = tables[t.name].sparkSession
    auto = next((c.name for c in t.columns if c.auto_increment), None)
    following = counters.get(t.name, 0) + 1
    if auto and t.name not in counters:
        following = (tables[t.name].agg(F.max(auto)).first()[0] or 0) + 1
    row = new_row(t, columns, values, following)
    rows = spark.createDataFrame([tuple(row[n] for n in t.names)], ", ".join(f"`{c.name}` {'string' if c.type == 'DATETIME' else 'bigint' if c.type != 'TEXT' else 'string'}" for c in t.columns))
    rows = rows.select(*[F.col(c.name).cast("timestamp_ntz") if c.type == "DATETIME" else F.col(c.name) for c in t.columns])
    if tables[t.name].where(F.col(t.key) == F.lit(row[t.key])).limit(1).count():
        raise CatalogError("PK exists!")
    check_targets(catalog, tables, t, rows)
    change = settle(catalog, tables, t, tables[t.name].unionByName(rows), rows.withColumn(WEIGHT, F.lit(1)))
    change.counters = {t.name: max(following, row[auto] or 0) if auto else 0} if auto else {}
    return change


def delete(catalog: Catalog, tables: dict[str, DataFrame], name: str, where: list) -> Change:
    t = catalog.table(name)
    hit = condition(where, t)
    gone = tables[t.name].where(hit)
    check_free(catalog, tables, t, gone)
    return settle(catalog, tables, t, tables[t.name].where(~F.coalesce(hit, F.lit(False))), gone.withColumn(WEIGHT, F.lit(-1)))


def update(catalog: Catalog, tables: dict[str, DataFrame], name: str, sets: dict[str, tuple], where: list) -> Change:
    t = catalog.table(name)
    sets = {t.column(c).name: _value(x, t) for c, x in sets.items()}
    if t.key in sets:
        raise CatalogError("a primary key cannot be updated")
    hit = condition(where, t)
    made = {c: F.when(hit, x).otherwise(F.col(c)).cast(tables[t.name].schema[c].dataType) for c, x in sets.items()}
    old = tables[t.name].where(hit)
    new = old.select(*[made[n].alias(n) if n in made else F.col(n) for n in t.names])
    contents = tables[t.name].select(*[made[n].alias(n) if n in made else F.col(n) for n in t.names])
    owning = [e.column for e in edges(catalog) if not e.access and (e.child == t.name and not e.reverse or e.parent == t.name and e.reverse)]
    differs = reduce(lambda a, b: a | b, [~made[c].eqNullSafe(F.col(c)) for c in sets if c in owning], F.lit(False))
    moved = bool(old.where(differs).limit(1).count()) if set(owning) & set(sets) else False
    if moved:
        check_targets(catalog, tables, t, new)
    delta = old.withColumn(WEIGHT, F.lit(-1)).unionByName(new.withColumn(WEIGHT, F.lit(1)))
    return settle(catalog, tables, t, contents, delta, moved)


def replace(catalog: Catalog, tables: dict[str, DataFrame], name: str, columns: list[str], values: list, counters: dict[str, int]) -> Change:
    t = catalog.table(name)
    if any(c.auto_increment for c in t.columns):
        raise CatalogError("REPLACE is not possible with AUTO_INCREMENT")
    row = new_row(t, columns, values, 0)
    where = [(t.key, "=", row[t.key])]
    if not tables[t.name].where(condition(where, t)).limit(1).count():
        return insert(catalog, tables, name, columns, values, counters)
    return update(catalog, tables, name, {c: ("lit", v) for c, v in row.items() if c != t.key}, where)


def upsert(contents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Bulk REPLACE: rows take the place of those with their key."""
    return contents.join(rows.select(key), key, "left_anti").select(*contents.columns).unionByName(rows.select(*contents.columns))
