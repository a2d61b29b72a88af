"""The engine: one SQL entry point over stored tables, views and the rights of data subjects."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators import dml, gdpr
from stewardry.operators.ownership import copies, orphans
from stewardry.plans import ddl, delta, graph, incremental, views
from stewardry.plans.catalog import CatalogError, View
from stewardry.runtime import cut, cut_bare
from stewardry.sources.store import Store


def _rows_of(view: View) -> str:
    """The name under which the store keeps a view's rows; no table can have it."""
    return f"{view.name}.view"


@dataclass
class Result:
    """What a statement gives: success, a number of touched copies, or result sets by name."""

    ok: bool = True
    updated: int | None = None
    sets: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        return next(iter(self.sets.values()))

    def lines(self) -> list[str]:
        """All rows as text, fields joined by ``|``."""
        out = []
        for df in self.sets.values():
            shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`") for c, t in df.dtypes]
            out += ["|".join("NULL" if v is None else str(v) for v in row) for row in df.select(*shown).collect()]
        return out


class Engine:
    """``compat=True`` follows the older semantics in which DESC is ignored and UNION keeps repeats."""

    def __init__(self, spark: SparkSession, root: str, compat: bool = False):
        self.spark, self.store, self.compat = spark, Store(spark, root), compat
        self.catalog = self.store.catalog
        self.ctx: dict[str, DataFrame] | None = None
        self.auto_ctx = False
        self.prepared: dict[int, str] = {}
        self.attached: dict[str, DataFrame] = {}

    # --- tables

    def attach(self, name: str, df: DataFrame) -> None:
        """Lets statements of this session read ``df`` as a table; it cannot be changed and is not stored."""
        if self.catalog.taken(name):
            raise CatalogError(f"{name} exists")
        self.attached[name.lower()] = df

    def table(self, name: str) -> DataFrame:
        if name.lower() in self.attached:
            return self.attached[name.lower()]
        return self.store.table(self.catalog.table(name).name)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: self.store.table(n) for n in self.catalog.tables}

    def load(self, name: str, df: DataFrame) -> None:
        """Bulk load of distinct, new keys with existing owners; one pass instead of a statement per row."""
        t = self.catalog.table(name)
        auto = next((c.name for c in t.columns if c.auto_increment), None)
        if auto:
            top = self.table(name).agg(F.max(auto)).first()[0] or 0
            df = cut(dml.numbered(df if auto in df.columns else df.withColumn(auto, F.lit(None).cast("bigint")), auto, top))
        rows = df.select(*t.names)
        if rows.groupBy(t.key).count().where("count > 1").limit(1).count() or rows.join(self.table(name).select(t.key), t.key, "left_semi").limit(1).count():
            raise CatalogError("PK exists!")
        dml.check_targets(self.catalog, self.tables, t, rows)
        self._commit({t.name: (delta.weighted(rows), self.table(name).unionByName(rows))}, added=True, rows={} if t.name in self.store.tables else {t.name: rows.count()})

    def _commit(self, changed: dict[str, tuple[DataFrame, DataFrame]], counters: dict[str, int] | None = None, added: bool = False, rows: dict[str, int] | None = None) -> None:
        """Commits changes of tables, given as (weighted rows, new contents), together with those of all stored views that read them, in order of creation."""
        stored = [v for v in self.catalog.views.values() if v.stored]
        changes = {name: cut_bare(d) if stored or not added else d for name, (d, _) in changed.items()}
        known: dict[str, incremental.Source] = {}
        for name in self.catalog.tables if stored else ():
            old = self.table(name)
            known[name.lower()] = incremental.Source(old, changed[name][1] if name in changed else old, changes.get(name))
        for v in stored:
            old = self._read_view(v)
            read = {n.lower(): known[n.lower()] for n in self._needed(v.plan) if n.lower() != v.name.lower()}
            moved = incremental.change(self.spark.sql, v.plan, read, old)
            if moved is not None:
                moved = cut_bare(moved)
                changes[_rows_of(v)] = moved
            known[v.name.lower()] = incremental.Source(old, old if moved is None else delta.apply(old, moved), moved)
        self.store.commit(changes, counters, set(changed) if added else set(), rows)

    def materialise(self, name: str) -> None:
        """Keeps the rows of a view, and of the views it reads; from now on every statement changes only the rows that it affects."""
        v = self.catalog.view(name)
        if v is None or v.params:
            raise CatalogError(f"no view {name}, or one with parameters that reads must bind")
        for other in self._needed(v.plan):
            if other.lower() in self.attached:
                raise CatalogError(f"{other} is attached: its changes are not seen")
            if (below := self.catalog.view(other)) and below is not v and not below.stored:
                self.materialise(other)
        made = self._read_view(v)
        self.store.declare(_rows_of(v), made, (v.keys or made.columns)[0], made.count())
        self.store.commit({_rows_of(v): delta.weighted(made)}, added={_rows_of(v)})
        v.stored = True
        self.store.save_catalog()

    # --- statements

    def sql(self, text: str, args: list | None = None) -> Result:
        s = ddl.parse(text, args)
        return getattr(self, f"_{s.what}")(s)

    def script(self, text: str) -> list[Result]:
        """Statements separated by semicolons at line ends."""
        return [self.sql(x) for x in re.split(r";[ \t]*(?:\n|$)", ddl.strip_comments(text)) if x.strip()]

    def prepare(self, text: str) -> int:
        """A statement with ``?`` for later ``execute``; ``IN (?, ?)`` takes its arguments in order."""
        self.prepared[len(self.prepared)] = text
        return len(self.prepared) - 1

    def execute(self, number: int, args: list) -> Result:
        return self.sql(self.prepared[number], args)

    def _create_table(self, s: ddl.Statement) -> Result:
        graph.validate(self.catalog, s.table)
        self.catalog.tables[s.name] = s.table
        self.store.save_catalog()
        return Result()

    def _create_index(self, s: ddl.Statement) -> Result:
        t = self.catalog.table(s.index.table)
        columns = [t.column(c) for c in s.index.columns]
        if [c.name for c in columns] == [t.key]:
            raise CatalogError("the primary key has an index")
        if len(columns) > 1 and any(c.unique for c in columns):
            raise CatalogError("a composite index may not hold a UNIQUE column")
        self.catalog.indexes[s.name] = s.index
        self.store.save_catalog()
        return Result()

    def _create_view(self, s: ddl.Statement) -> Result:
        if self.catalog.taken(s.name):
            raise CatalogError(f"{s.name} exists")
        view = views.keyed(s.name, s.select, self.compat)
        self._read_view(view, [None] * len(view.params))  # must be sound now
        self.catalog.views[s.name] = view
        if not s.name.startswith("_"):
            self.store.save_catalog()
        return Result()

    def _drop_view(self, s: ddl.Statement) -> Result:
        view = self.catalog.view(s.name)
        if view is None or any(re.search(rf"\b{s.name}\b", v.plan, re.I) for v in self.catalog.views.values() if v is not view):
            raise CatalogError(f"no view {s.name}, or another one reads it")
        del self.catalog.views[view.name]
        self.store.drop(_rows_of(view))
        self.store.save_catalog()
        return Result()

    def _query(self, text: str, args: list | None = None) -> DataFrame:
        for name in self._needed(text):
            view = self.catalog.view(name)
            df = self._read_view(view) if view else self.table(name)
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _read_view(self, view: View, args: list | None = None) -> DataFrame:
        """A view's rows; parameters that stay in its plan are bound now."""
        if view.stored:
            return self.store.table(_rows_of(view))
        if view.params and args is None:
            raise CatalogError(f"{view.name} is read by lookup(), with values for its parameters")
        return self._query(view.plan, args)

    def _needed(self, text: str) -> list[str]:
        return [n for n in (*self.catalog.tables, *self.catalog.views, *self.attached) if re.search(rf"(?<![\w.]){re.escape(n)}\b", text, re.I)]

    def _select(self, s: ddl.Statement) -> Result:
        text = views.semantics(s.select, self.compat)
        if (at_read := self._bound_read(text, s.values)) is not None:
            return Result(sets={"result": at_read})
        m = re.fullmatch(r"\s*SELECT\s+\*\s+FROM\s+`?(\w+)`?(.*)", text, re.I | re.S)
        view = self.catalog.view(m.group(1)) if m else None
        if view and view.hidden:
            shown = [c for c in self._read_view(view).columns if c.lower() not in {h.lower() for h in view.hidden}]
            text = f"SELECT {', '.join(f'`{c}`' for c in shown)} FROM {m.group(1)}{m.group(2)}"
        return Result(sets={"result": self._query(text, s.values)})

    def _bound_read(self, text: str, args: list | None) -> DataFrame | None:
        """``SELECT * FROM view WHERE column = value`` of a view whose parameters stay in its plan: the values are the parameters'."""
        m = re.fullmatch(r"\s*SELECT\s+\*\s+FROM\s+`?(\w+)`?\s+(WHERE\s.*?)\s*", text, re.I | re.S)
        view = self.catalog.view(m.group(1)) if m else None
        if view is None or not view.params:
            return None
        given = {(c.lower(), sign): value for c, sign, value in ddl._where(ddl.Tokens(m.group(2)), list(args or []))}
        wanted = [(c.lower(), sign) for c, sign in view.params]
        if set(given) != set(wanted):
            raise CatalogError(f"{view.name} needs a value for each of its parameters and nothing else")
        return self._read_view(view, [given[w] for w in wanted])

    def lookup(self, view: str, keys: list | None = None, greater: dict[str, object] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows of a keyed view for the values of its keys (a list of values asks for each), or beyond bounds, in the bounds' order.

        A ``>`` bound is included, as a ``>=`` one; ``<`` is not, ``<=`` is. Of a view
        whose parameters stay in its plan, ``keys`` are their values in order.
        """
        from stewardry.operators.relational import lookup, lookup_greater

        v = self.catalog.view(view)
        if v is None:
            raise CatalogError(f"no view {view}")
        if v.params:
            if len(keys or []) != len(v.params):
                raise CatalogError(f"{v.name} has {len(v.params)} parameters")
            asked = itertools.product(*[x if isinstance(x, list) else [x] for x in keys])
            df = reduce(DataFrame.unionByName, [self._read_view(v, list(one)) for one in asked])
        else:
            df = self._read_view(v)
            if keys is not None:
                df = lookup(df, {k: x if isinstance(x, list) else [x] for k, x in zip(v.keys, keys)})
        if greater or limit is not None or offset:
            signs = {c.lower(): s for c, s in v.bounds}
            df = lookup_greater(df, greater or {}, list(greater or []), limit, offset, {c: signs.get(c.lower(), ">=") for c in greater or {}})
        return df.drop(*v.hidden)

    def _change(self, change: dml.Change, added: bool = False) -> Result:
        if change.orphans and self.ctx is None and not self.auto_ctx:
            some = {n: [r.pk for r in df.limit(5).collect()] for n, df in change.orphans.items()}
            raise CatalogError(f"Orphaned data: {some}")
        if self.ctx is not None:
            for name, pks in change.orphans.items():
                self.ctx[name] = self.ctx[name].unionByName(pks) if name in self.ctx else pks
        self._commit({change.table: (change.delta, change.contents)}, change.counters, added)
        return Result(updated=change.count)

    def _insert(self, s: ddl.Statement) -> Result:
        return self._change(dml.insert(self.catalog, self.tables, s.name, s.columns, s.values, self.store.counters), added=True)

    def _replace(self, s: ddl.Statement) -> Result:
        return self._change(dml.replace(self.catalog, self.tables, s.name, s.columns, s.values, self.store.counters))

    def _update(self, s: ddl.Statement) -> Result:
        return self._change(dml.update(self.catalog, self.tables, s.name, s.sets, s.where))

    def _delete(self, s: ddl.Statement) -> Result:
        return self._change(dml.delete(self.catalog, self.tables, s.name, s.where))

    # --- rights of data subjects

    def _subject(self, s: ddl.Statement) -> tuple[str, object]:
        t = self.catalog.table(s.name)
        if not t.data_subject:
            raise CatalogError(f"{s.name} holds no data subjects")
        return t.name, s.values[0]

    def _get(self, s: ddl.Statement) -> Result:
        return Result(sets=gdpr.get(self.catalog, self.tables, *self._subject(s)))

    def _forget(self, s: ddl.Statement) -> Result:
        gone = gdpr.forget(self.catalog, self.tables, *self._subject(s))
        count = int(gone.count.first()[0])
        self._commit({name: (gone.deltas[name], contents) for name, contents in gone.tables.items()})
        self.store.vacuum()  # no file of the store holds what was erased
        return Result(updated=count)

    def _ctx(self, s: ddl.Statement) -> Result:
        """Rows that lost or never had an owner since START must have one at COMMIT; ROLLBACK forgets what it watched and keeps the data."""
        if s.name == "START":
            self.ctx = {}
        elif s.name == "ROLLBACK":
            self.ctx = None
        elif s.name == "COMMIT":
            for name, pks in (self.ctx or {}).items():
                key = self.catalog.table(name).key
                if orphans(self.catalog, self.tables, name).join(pks.select(F.col("pk").alias(key)), key, "left_semi").limit(1).count():
                    raise CatalogError("Orphaned data detected")
            self.ctx = None
        else:
            raise CatalogError(f"CTX {s.name}?")
        return Result()

    def _set(self, s: ddl.Statement) -> Result:
        if s.name.upper().startswith("AUTO_CTX"):
            self.auto_ctx = not s.name.upper().endswith(("OFF", "FALSE", "0"))
        return Result()

    # --- introspection

    def _rows(self, rows: list[tuple], schema: str) -> Result:
        return Result(sets={"result": self.spark.createDataFrame(rows, schema)})

    def _explain_compliance(self, s: ddl.Statement) -> Result:
        return self._rows(graph.explain_compliance(self.catalog), "table string, status string, level string, text string")

    def _indexes(self, name: str) -> list[tuple[tuple[str, ...], str]]:
        t = self.catalog.table(name)
        own = [((t.key,), "PK")] + [((c.name,), "UNIQUE") for c in t.columns if c.unique and c.name != t.key]
        own += [((f.column,), "TOTAL") for f in t.foreign_keys]
        own += [(tuple(i.columns), "TOTAL") for i in self.catalog.indexes.values() if i.table.lower() == t.name.lower()]
        return list(dict.fromkeys(own))

    def _access(self, name: str, where: list) -> str:
        """The text of an access path: the key before unique columns before the longest index whose columns are all bound."""
        bound = [c for c, *_ in where]
        low = {c.lower() for c in bound}
        fitting = [(c, k) for c, k in self._indexes(name) if {x.lower() for x in c} <= low]
        best = max(fitting, key=lambda x: ({"PK": 2, "UNIQUE": 1}.get(x[1], 0), len(x[0])), default=None)
        if best is None:
            return f"{name} [SCAN]" + (f" WITH FILTERS ({', '.join(bound)}) [INMEMORY]" if bound else "")
        rest = [c for c in bound if c.lower() not in {x.lower() for x in best[0]}]
        return f"{name} USING ({', '.join(best[0])}) [{best[1]}]" + (f" WITH FILTERS ({', '.join(rest)}) [INMEMORY]" if rest else "")

    def _explain(self, s: ddl.Statement) -> Result:
        i = s.inner
        rows: list[tuple[str, str]] = []
        if i.what == "select":
            m = re.match(r"\s*SELECT\s+.*?\s+FROM\s+`?(\w+)`?\s*(WHERE\s+.*?)?(?:\s+LIMIT\s+.*)?$", i.select, re.I | re.S)
            if m and self.catalog.view(m.group(1)):
                rows.append(("VIEW LOOKUP", m.group(1)))
            elif m and not re.search(r"\b(JOIN|GROUP|ORDER|UNION|SUM|COUNT|AVG)\b", i.select, re.I):
                t = ddl.Tokens(m.group(2) or "")
                rows.append(("SELECT", self._access(self.catalog.table(m.group(1)).name, ddl._where(t, [None] * i.select.count("?")))))
            else:
                rows.append(("VIEW LOOKUP", "one-off plan over " + ", ".join(self._needed(i.select))))
        elif i.what in {"insert", "replace", "update", "delete"}:
            name = self.catalog.table(i.name).name
            own = [f"{e.parent}#{e.column}" for e in graph.owned_tables(self.catalog).get(name, [])] or ([f"{name}#{self.catalog.table(name).key}"] if self.catalog.table(name).data_subject else ["default"])
            if i.what in {"update", "delete"}:
                rows.append(("SELECT", self._access(name, i.where)))
                rows.append((i.what.upper(), name))
            else:
                rows += [(i.what.upper(), f"{name} [{o}]") for o in own]
            rows += [("INDEX UPDATE", f"{name} ({', '.join(c)}) [{k}]") for c, k in self._indexes(name)]
            rows += [("VIEW UPDATE", v.name) for v in self.catalog.views.values() if re.search(rf"\b{re.escape(name)}\b", v.plan, re.I)]
        else:
            rows.append((i.what.upper(), i.name))
        return self._rows(rows, "Type string, Name string")

    def _show(self, s: ddl.Statement) -> Result:
        if s.name == "SHARDS":
            out = None
            for name, df in copies(self.catalog, self.tables).items():
                one = df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "shard", "rows")
                out = one if out is None else out.unionByName(one)
            return Result(sets={"result": out}) if out is not None else self._rows([], "table string, shard string, rows bigint")
        if s.name == "VIEW":
            v = self.catalog.view(s.columns[0])
            if v is None:
                raise CatalogError(f"no view {s.columns[0]}")
            return self._rows([(v.name, v.sql, ",".join(v.keys), ",".join(f"{c} {x}" for c, x in v.bounds))], "name string, sql string, keys string, bounds string")
        if s.name == "MEMORY":
            return self._rows([(v.name, self._read_view(v).count()) for v in self.catalog.views.values() if not v.params], "view string, rows bigint")
        if s.name == "PREPARED":
            return self._rows(list(self.prepared.items()), "id bigint, statement string")
        if s.name == "INDICES":
            return self._rows([(t, ", ".join(c), k) for t in self.catalog.tables for c, k in self._indexes(t)], "table string, columns string, kind string")
        raise CatalogError(f"SHOW {s.name}?")
