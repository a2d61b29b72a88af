"""Changes of views from changes of what they read, for the SQL text of a view.

A projection, filter or inner join is linear in each of its sources: its change is
the sum, over the sources, of the text run with that source's change in its place,
the sources before it new and those after it old. Of an aggregation the touched
groups alone are computed again. What is neither is computed as a whole and compared.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.plans import delta
from stewardry.plans.views import _at_top, _protect, _restore, _short, clauses, output_name, select_items

_SOURCE = re.compile(r"(?:^|,|\bJOIN\b)\s*`?(?P<name>\w+)`?(?P<as>\s+(?:AS\s+)?(?!ON\b|JOIN\b|INNER\b|LEFT\b|RIGHT\b|FULL\b|CROSS\b|NATURAL\b|USING\b|WHERE\b)`?(?P<alias>\w+)`?)?", re.I)
_NOT_LINEAR = re.compile(r"\b(?:LEFT|RIGHT|FULL|CROSS|NATURAL|UNION|INTERSECT|EXCEPT|OVER|LATERAL|EXISTS)\b|\(\s*SELECT\b|^\s*SELECT\s+DISTINCT\b", re.I)
_AGGREGATE = re.compile(r"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(", re.I)


@dataclass
class Source:
    """What a view reads, before and after a change, and the change itself (None if there is none)."""

    old: DataFrame
    new: DataFrame
    change: DataFrame | None = None


def sources(plan: str) -> list[str]:
    """The names in FROM, in order."""
    return [m.group("name") for m in _at_top(clauses(_protect(plan)[0]).get("FROM", ""), _SOURCE)]


def _run(run: Callable[[str], DataFrame], text: str, tables: list[DataFrame], kept: list[str]) -> DataFrame:
    """The text with the sources in FROM replaced, in order."""
    at = _at_top(text, re.compile(r"\bFROM\b", re.I))[0].end()
    body = clauses(text)["FROM"]
    start = text.index(body, at)
    made, last = [], 0
    for m, df in zip(_at_top(body, _SOURCE), tables, strict=True):
        name = f"source_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        made += [body[last : m.start("name")].rstrip("`"), name, "" if m.group("as") else f" AS {m.group('name')}"]
        last = m.end("name") + (body[m.end("name") : m.end("name") + 1] == "`")
    return run(_restore(text[:start] + "".join([*made, body[last:]]) + text[start + len(body) :], kept))


def _linear(run: Callable[[str], DataFrame], text: str, kept: list[str], read: list[Source]) -> DataFrame | None:
    """The change of a text that is linear in each source."""
    aliases = [m.group("alias") or m.group("name") for m in _at_top(clauses(text)["FROM"], _SOURCE)]
    head, items, rest = select_items(text)
    parts = []
    for i, s in enumerate(read):
        if s.change is None:
            continue
        tables = [x.new for x in read[:i]] + [s.change] + [x.old for x in read[i + 1 :]]
        star = any(x.strip() in {"*", f"{aliases[i]}.*"} for x in items)
        parts.append(_run(run, f"{head}{', '.join(items)}{'' if star else f', {aliases[i]}.{delta.W}'} {rest}", tables, kept))
    if not parts:
        return None
    columns = [c for c in parts[0].columns if c != delta.W]
    return reduce(DataFrame.unionByName, [p.select(*columns, delta.W) for p in parts])


def change(run: Callable[[str], DataFrame], plan: str, known: dict[str, Source], rows: DataFrame) -> DataFrame | None:
    """The weighted change of a view with stored ``rows``, or None if nothing it reads has changed. ``known`` has all it reads, by name in lower case."""
    if all(s.change is None for s in known.values()):
        return None
    text, kept = _protect(plan)
    c = clauses(text)
    names = [n.lower() for n in sources(plan)]
    linear = not _NOT_LINEAR.search(text) and not c.keys() & {"LIMIT", "OFFSET"} and all(n in known for n in names)
    if linear:
        read = [known[n] for n in names]
        if "ORDER BY" in c:
            text = text[: _at_top(text, re.compile(r"\bORDER\s+BY\b", re.I))[0].start()]
        _, items, _ = select_items(text)
        if "GROUP BY" not in c and not _AGGREGATE.search(text):
            return delta.consolidate(_linear(run, text, kept, read))
        if "GROUP BY" in c:
            groups = [g.strip() for g in c["GROUP BY"].split(",")]
            plain = {re.sub(r"\s+AS\s+\S+$", "", i, flags=re.I).strip().lower(): output_name(i) for i in items}
            shown = {g: plain.get(g.lower()) or next((o for o in plain.values() if o == _short(g).lower()), None) for g in groups}
            if all(shown.values()):
                where = f" WHERE {c['WHERE']}" if "WHERE" in c else ""
                body = f"SELECT {', '.join(f'{g} AS `{shown[g]}`' for g in groups)} FROM {c['FROM']}{where}"
                touched = _linear(run, body, kept, read).select(*[F.col(shown[g]).alias(f"{shown[g]}_touched") for g in groups]).distinct()

                def of_touched(df: DataFrame) -> DataFrame:
                    return df.join(touched, reduce(lambda a, b: a & b, [df[shown[g]].eqNullSafe(touched[f"{shown[g]}_touched"]) for g in groups]), "left_semi")

                # the semi-join on the grouping columns goes below the aggregation
                fresh = of_touched(_run(run, text, [s.new for s in read], kept))
                return delta.consolidate(delta.weighted(of_touched(rows), -1).unionByName(delta.weighted(fresh)))
    for name, s in known.items():
        s.new.createOrReplaceTempView(name)
    return delta.consolidate(delta.weighted(rows, -1).unionByName(delta.weighted(run(plan))))
