"""The ownership graph of a catalog: validation of new tables, edges, and what they mean for compliance."""

from __future__ import annotations

import re
from dataclasses import dataclass

from stewardry.plans.catalog import ACCESSED_BY, ACCESSES, OWNED_BY, OWNS, PLAIN, Catalog, CatalogError, Table


@dataclass(frozen=True)
class Edge:
    """``child`` rows belong to, or are seen by, whoever owns the ``parent`` rows they are linked with.

    Of a reverse edge (OWNS, ACCESSES) the foreign key lies in the parent.
    """

    child: str
    parent: str
    column: str
    access: bool
    reverse: bool
    implicit: bool

    @property
    def via(self) -> str:
        return f"{self.parent}({self.column})" if self.reverse else self.column


def owned_tables(catalog: Catalog) -> dict[str, list[Edge]]:
    """Ownership edges by child table, of tables that are owned at all."""
    out: dict[str, list[Edge]] = {}
    for e in edges(catalog):
        if not e.access:
            out.setdefault(e.child, []).append(e)
    return out


def edges(catalog: Catalog) -> list[Edge]:
    """All edges, ownership before access, parents before children where links allow.

    A plain foreign key owns only if its table has no explicit owner and its
    target is a data subject or owned.
    """
    owned = {t.name for t in catalog.tables.values() if t.data_subject}
    out: list[Edge] = []
    for t in catalog.tables.values():  # in order of creation, so targets come first
        direct = [f for f in t.foreign_keys if f.kind == OWNED_BY]
        implicit = [f for f in t.foreign_keys if f.kind == PLAIN and catalog.table(f.table).name in owned]
        for f in direct or implicit:
            out.append(Edge(t.name, catalog.table(f.table).name, f.column, False, False, not direct))
            owned.add(t.name)
        for f in t.foreign_keys:
            if f.kind == OWNS:
                out.append(Edge(catalog.table(f.table).name, t.name, f.column, False, True, False))
                owned.add(catalog.table(f.table).name)
    for t in catalog.tables.values():
        for f in t.foreign_keys:
            if f.kind == ACCESSED_BY:
                out.append(Edge(t.name, catalog.table(f.table).name, f.column, True, False, False))
            elif f.kind == ACCESSES:
                out.append(Edge(catalog.table(f.table).name, t.name, f.column, True, True, False))
    return out


def order(catalog: Catalog) -> list[str]:
    """Tables with every owner table before what it owns."""
    waiting = {t: {e.parent for e in es} for t, es in owned_tables(catalog).items()}
    done: list[str] = []
    left = list(catalog.tables)
    while left:
        ready = [t for t in left if not waiting.get(t, set()) - set(done) - {t}]
        if not ready:
            raise CatalogError("ownership runs in a circle")
        done += ready
        left = [t for t in left if t not in ready]
    return done


def validate(catalog: Catalog, new: Table) -> None:
    """Raises if the table may not be added."""
    if catalog.taken(new.name):
        raise CatalogError(f"{new.name} exists")
    owned = owned_tables(catalog)
    subjects = {t.name for t in catalog.tables.values() if t.data_subject}
    accessed = {e.child for e in edges(catalog) if e.access}
    for f in new.foreign_keys:
        new.column(f.column)
        own = f.table.lower() == new.name.lower()
        if own and f.kind in {OWNED_BY, OWNS}:
            raise CatalogError(f"{f.kind} may not refer to its own table")
        target = new if own else catalog.table(f.table)
        target.column(f.target)
        f.table = target.name
        if f.kind in {OWNED_BY, OWNS, ACCESSED_BY, ACCESSES} and target.key.lower() != f.target.lower():
            raise CatalogError(f"{f.kind} must refer to a primary key")
        known = own or target.name in subjects or target.name in owned
        if f.kind == OWNED_BY and not known:
            raise CatalogError(f"OWNED_BY refers to {target.name}, which nobody owns")
        if f.kind == ACCESSED_BY and not known and target.name not in accessed:
            raise CatalogError(f"ACCESSED_BY refers to {target.name}, which nobody owns or accesses")
        if f.kind in {OWNS, ACCESSES} and any(e.parent == target.name for e in edges(catalog)):
            raise CatalogError(f"{f.kind} refers to {target.name}, on which other tables depend already")
    explicit = [f for f in new.foreign_keys if f.kind == OWNED_BY]
    implicit = [f for f in new.foreign_keys if f.kind == PLAIN and f.table in subjects | set(owned)]
    if not explicit and len(implicit) > 1:
        raise CatalogError("Many potential OWNERs, be explicit")
    if any(f.kind in {OWNS, ACCESSES} for f in new.foreign_keys) and not (new.data_subject or explicit or implicit):
        raise CatalogError("OWNS and ACCESSES need a table that is owned itself")
    _validate_rules(catalog, new)


def _validate_rules(catalog: Catalog, new: Table) -> None:
    owners = {f.column.lower() for f in new.foreign_keys if f.kind == OWNED_BY}
    for r in new.rules:
        if "(" not in r.column:
            new.column(r.column)
        for c in r.columns:
            new.column(c)
            if r.on == "DEL" and c.lower() == new.key.lower():
                raise CatalogError("a primary key may not be anonymised")
            if r.on == "DEL" and c.lower() in owners and c.lower() != r.column.lower():
                raise CatalogError("a rule may not anonymise the ownership of another owner")


# --- explain compliance -----------------------------------------------------------

#: Fixed value: column names that sound personal.
PERSONAL = re.compile(r"email|password|(first|last|middle|user)[-_]?name|gender", re.I)


@dataclass(frozen=True)
class Chain:
    """A way from a table up to a kind of data subject."""

    edges: tuple[Edge, ...]

    @property
    def kind(self) -> str:
        return self.edges[-1].parent

    @property
    def variable(self) -> int:
        return sum(e.reverse for e in self.edges)


def chains(catalog: Catalog, table: str) -> list[Chain]:
    owned = owned_tables(catalog)
    out: list[Chain] = []
    stack: list[tuple[Edge, ...]] = [(e,) for e in owned.get(table, [])]
    while stack:
        way = stack.pop(0)
        parent = way[-1].parent
        if catalog.table(parent).data_subject:
            out.append(Chain(way))
        stack += [(*way, e) for e in owned.get(parent, []) if e not in way]
    return out


def nullable(catalog: Catalog, chain: Chain) -> bool:
    return any(not catalog.table(e.parent if e.reverse else e.child).column(e.column).not_null for e in chain.edges)


def explain_compliance(catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """(table, status, level, text) rows: the ways of each table to its data subjects, and what may be amiss."""
    rows: list[tuple[str, str, str, str]] = []
    for t in catalog.tables.values():
        ways = chains(catalog, t.name)
        # fixed values: the words for how a table is stored
        status = "DATASUBJECT AND SHARDED" if t.data_subject and ways else "DATASUBJECT" if t.data_subject else "SHARDED" if ways else "UNSHARDED"
        rows.append((t.name, status, "status", status))
        for w in ways:
            how = "from a plain foreign key" if w.edges[0].implicit else "as declared"
            steps = " -> ".join(f"{e.parent}({e.column})" if e.reverse else f"{e.child}({e.column}) -> {e.parent}({catalog.table(e.parent).key})" for e in w.edges)
            rows.append((t.name, status, "path", f"{w.edges[0].via} leads to {w.kind} at distance {len(w.edges)} ({how}) via {steps}"))
            if w.variable > 1:
                rows.append((t.name, status, "severe", f"{w.variable} variable ownerships follow each other on the way to {w.kind}: the number of copies may multiply"))
        if ways and not t.data_subject and all(nullable(catalog, w) for w in ways):
            rows.append((t.name, status, "warning", "every way to an owner may be null, so rows may have none"))
        if sum(w.edges[0].reverse for w in ways) > 1:
            rows.append((t.name, status, "warning", "the table has several variable ownerships"))
        if len(ways) > 2:
            rows.append((t.name, status, "severe" if len(ways) > 5 else "warning", f"the table is sharded in {len(ways)} ways"))
        names = [c.name for c in t.columns if PERSONAL.search(c.name)]
        if names and status == "UNSHARDED":
            rows.append((t.name, status, "warning", "columns that sound personal in a table nobody owns: " + ", ".join(names)))
    return rows

