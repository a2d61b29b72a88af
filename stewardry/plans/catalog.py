"""Tables, keys, annotated foreign keys, anonymisation rules, indexes and views; kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

TYPES = {"INT": "bigint", "UINT": "bigint", "TEXT": "string", "DATETIME": "timestamp_ntz"}

#: Kinds of foreign keys: a plain one owns implicitly where its target is owned, ONLY never does.
PLAIN, ONLY, OWNED_BY, OWNS, ACCESSED_BY, ACCESSES = "REFERENCES", "REFERENCES ONLY", "OWNED_BY", "OWNS", "ACCESSED_BY", "ACCESSES"


class CatalogError(ValueError):
    """A statement that the schema does not allow."""


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    auto_increment: bool = False
    default: object = None
    has_default: bool = False


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str
    kind: str = PLAIN


@dataclass
class Rule:
    """What happens to a row on GET or DEL for the subject that reaches it through ``column``; no columns: the row goes."""

    on: str
    column: str
    columns: list[str] = field(default_factory=list)

    @property
    def delete_row(self) -> bool:
        return not self.columns


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: str
    data_subject: bool = False
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    sql: str = ""

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise CatalogError(f"no column {name} in {self.name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {TYPES[c.type]}" for c in self.columns)


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]


@dataclass
class View:
    name: str
    sql: str
    plan: str
    keys: list[str] = field(default_factory=list)
    bounds: list[tuple[str, str]] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)
    #: Parameters that stay in the plan, in order, with the column and sign that each is compared with.
    params: list[tuple[str, str]] = field(default_factory=list)
    #: Whether its rows are kept, and changed with what it reads.
    stored: bool = False


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        for known, t in self.tables.items():
            if known.lower() == name.lower():
                return t
        raise CatalogError(f"no table {name}")

    def view(self, name: str) -> View | None:
        return next((v for k, v in self.views.items() if k.lower() == name.lower()), None)

    def taken(self, name: str) -> bool:
        return name.lower() in {x.lower() for x in (*self.tables, *self.views)}

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()], "indexes": [asdict(i) for i in self.indexes.values()], "views": [asdict(v) for v in self.views.values()]})

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw = json.loads(text)
        catalog = Catalog()
        for t in raw["tables"]:
            parts = {"columns": [Column(**c) for c in t.pop("columns")], "foreign_keys": [ForeignKey(**f) for f in t.pop("foreign_keys")], "rules": [Rule(**r) for r in t.pop("rules")]}
            catalog.tables[t["name"]] = Table(**t, **parts)
        for i in raw["indexes"]:
            catalog.indexes[i["name"]] = Index(**i)
        for v in raw["views"]:
            v["bounds"], v["params"] = [tuple(b) for b in v["bounds"]], [tuple(b) for b in v.get("params", [])]
            catalog.views[v["name"]] = View(**v)
        return catalog
