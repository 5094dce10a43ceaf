"""The graph of relationships: tables are nodes, edges lead from child to parent."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from graphlib import CycleError, TopologicalSorter

from .catalog import Relationship


class CircularDependency(ValueError):
    """Relationships form a cycle; a dependency break must open it."""


class Forest:
    """Disjoint sets with union by size."""

    def __init__(self, items: Iterable[str] = ()):
        self._up: dict[str, str] = {}
        self._size: dict[str, int] = {}
        for item in items:
            self.add(item)

    def add(self, item: str) -> None:
        if item not in self._up:
            self._up[item], self._size[item] = item, 1

    def find(self, item: str) -> str:
        root = item
        while self._up[root] != root:
            root = self._up[root]
        while self._up[item] != root:
            self._up[item], item = root, self._up[item]
        return root

    def link(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)), key=self._size.__getitem__)
        if a != b:
            self._up[a] = b
            self._size[b] += self._size[a]

    def members(self, item: str) -> set[str]:
        root = self.find(item)
        return {x for x in self._up if self.find(x) == root}


def unbroken(relationships: Iterable[Relationship], broken: Collection[tuple[str, str]]) -> tuple[Relationship, ...]:
    """All relationships but those between broken pairs."""
    return tuple(r for r in relationships if r.pair not in broken)


def strata(relationships: Iterable[Relationship], tables: Collection[str]) -> list[set[str]]:
    """Levels of the tables that have edges, parents before children."""
    sorter: TopologicalSorter[str] = TopologicalSorter()
    for r in relationships:
        if r.child not in tables or r.parent not in tables:
            continue
        if r.child == r.parent:
            raise ValueError(f"{r.child} refers to itself; add a dependency break")
        sorter.add(r.child, r.parent)
    try:
        sorter.prepare()
    except CycleError as e:
        raise CircularDependency(" -> ".join(reversed(e.args[1]))) from None
    out = []
    while sorter.is_active():
        ready = set(sorter.get_ready())
        out.append(ready)
        sorter.done(*ready)
    return out


def upstream(order: list[set[str]], targets: Collection[str]) -> list[set[str]]:
    """Levels after the first one with a target."""
    first = next((k for k, level in enumerate(order) if level & set(targets)), len(order))
    return order[first + 1 :]


def downstream(order: list[set[str]], without: Collection[str]) -> list[set[str]]:
    """Levels from children to parents, less some tables."""
    return [level for level in (s - set(without) for s in reversed(order)) if level]


def disconnected(tables: Iterable[str], relationships: Iterable[Relationship], roots: Collection[str]) -> list[str]:
    """Tables whose component, with broken edges counted, has none of ``roots``."""
    tables = list(tables)
    forest = Forest(tables)
    for r in relationships:
        if r.child in forest._up and r.parent in forest._up:
            forest.link(r.child, r.parent)
    reached = {forest.find(r) for r in roots if r in forest._up}
    return [t for t in tables if forest.find(t) not in reached]
