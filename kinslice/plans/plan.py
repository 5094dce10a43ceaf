"""The order of a run's steps, computed on the driver from names only."""

from __future__ import annotations

from dataclasses import dataclass

from .. import graph
from ..catalog import Catalog, Relationship
from ..config import Config, ConfigError


@dataclass(frozen=True)
class Step:
    kind: str  # direct, upstream, passthrough, downstream or disconnected
    table: str
    relationships: tuple[Relationship, ...] = ()


@dataclass(frozen=True)
class SubsetPlan:
    order: tuple[frozenset[str], ...]
    steps: tuple[Step, ...]
    disconnected: tuple[str, ...]
    warnings: tuple[str, ...] = ()

    def explain(self) -> str:
        lines = [f"strata: {' < '.join('{' + ', '.join(sorted(s)) + '}' for s in self.order)}"]
        for s in self.steps:
            via = "; ".join(f"{r.child}({', '.join(r.child_columns)}) -> {r.parent}({', '.join(r.parent_columns)})" for r in s.relationships)
            lines.append(f"{s.kind:<12} {s.table}" + (f"  [{via}]" if via else ""))
        return "\n".join([*lines, *(f"warning: {w}" for w in self.warnings)])


def make_plan(catalog: Catalog, config: Config) -> SubsetPlan:
    """Targets, then children level by level, full copies, then parents level by level.

    Parents aren't looked for through a relationship that selected all of the child's rows. A passthrough table is copied whole, so it isn't selected as a child; it gets no parents added.
    """
    for name in (*config.target_tables, *config.passthrough):
        if name not in catalog.tables:
            raise ConfigError(f"table {name} doesn't exist or is excluded")
    edges = catalog.relationships
    usable = graph.unbroken(edges, config.broken)
    roots = [*config.target_tables, *config.passthrough]
    apart = graph.disconnected(catalog.tables, edges, roots)
    connected = [t for t in catalog.tables if t not in apart]
    order = graph.strata(usable, connected)
    steps = [Step("direct", t) for t in config.target_tables if t not in config.passthrough]
    processed = set(config.target_tables) | set(config.passthrough)
    matched: dict[str, set[Relationship]] = {}
    for level in graph.upstream(order, config.target_tables):
        reached = []
        for table in sorted(level - processed):
            via = tuple(r for r in usable if r.child == table and r.parent in processed - set(config.passthrough))
            if via:
                steps.append(Step("upstream", table, via))
                matched[table] = set(via)
                reached.append(table)
        processed |= set(reached)
    steps += [Step("passthrough", t) for t in config.passthrough]
    for level in graph.downstream(order, {*config.passthrough, *apart}):
        for table in sorted(level):
            # rows that were selected by their parents have those; rows that others need may lack any
            via = tuple(r for r in usable if r.parent == table and r.child in connected and r not in matched.get(r.child, ()))
            if via:
                steps.append(Step("downstream", table, via))
                matched.pop(table, None)
    if config.keep_disconnected:
        steps += [Step("disconnected", t) for t in apart]
    in_order = {t for level in order for t in level} | set(roots)
    warnings = [f"{t} is only reached through broken relationships and is left empty" for t in connected if t not in in_order]
    return SubsetPlan(tuple(map(frozenset, order)), tuple(steps), tuple(apart), tuple(warnings))
