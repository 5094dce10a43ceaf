"""Tables with their declared keys: what a database's catalog knows and Parquet files don't."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .config import Config, ConfigError, LogicalKey


@dataclass(frozen=True)
class TableRef:
    """A name ``schema.table``; the first dot divides, and the schema may be missing."""

    schema: str
    name: str

    @classmethod
    def parse(cls, full: str) -> TableRef:
        schema, dot, name = full.partition(".")
        return cls(schema, name) if dot else cls("", full)

    def __str__(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name


@dataclass(frozen=True)
class Relationship:
    """Ordered columns of a child that refer to the ordered columns of a parent."""

    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def pair(self) -> tuple[str, str]:
        return self.child, self.parent


@dataclass(frozen=True)
class UniqueKey:
    columns: tuple[str, ...]
    primary: bool = False
    valid: bool = True
    immediate: bool = True
    not_null: bool = True
    generated: bool = False
    predicate: str | None = None
    expression: bool = False
    exclusion: bool = False

    @property
    def eligible(self) -> bool:
        """Whether it can name rows across runs."""
        plain = not (self.predicate or self.expression or self.exclusion or self.generated)
        return plain and self.valid and self.immediate and self.not_null


@dataclass(frozen=True)
class Table:
    name: str
    read: Callable[[], DataFrame]
    keys: tuple[UniqueKey, ...] = ()
    generated: frozenset[str] = frozenset()
    always_identity: frozenset[str] = frozenset()
    sequences: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    kind: str = "r"
    inherited: bool = False
    partitioned: bool = False
    temporal: bool = False
    write_triggers: bool = False
    #: What the source's own catalog says, if it has one.
    native: object = None

    @property
    def primary(self) -> tuple[str, ...]:
        return next((k.columns for k in self.keys if k.primary), ())


@dataclass
class Catalog:
    tables: dict[str, Table]
    relationships: tuple[Relationship, ...] = ()
    _frames: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def names(self) -> list[str]:
        """Ordinary tables."""
        return [n for n, t in self.tables.items() if t.kind == "r"]

    def schemas(self) -> list[str]:
        return sorted({TableRef.parse(n).schema for n in self.tables})

    def frame(self, name: str) -> DataFrame:
        """The table as of this catalog's first look: one file listing for a whole run."""
        if name not in self._frames:
            self._frames[name] = self.tables[name].read()
        return self._frames[name]

    def columns(self, name: str) -> list[str]:
        return self.frame(name).columns

    def kinds(self) -> dict[str, str]:
        """Each relation's kind: r table, p partitioned, v view, m materialized view, f foreign table."""
        return {n: t.kind for n, t in self.tables.items()}

    def datatypes(self, name: str) -> list[tuple[str, str, bool, bool]]:
        """Each column's name, type, and whether it is computed and always counted up by the database."""
        t = self.tables[name]
        return [(f.name, f.dataType.simpleString(), f.name in t.generated, f.name in t.always_identity) for f in self.frame(name).schema]

    def restricted(self, names: Iterable[str]) -> Catalog:
        keep = [n for n in names if n in self.tables]
        inside = tuple(r for r in self.relationships if r.child in keep and r.parent in keep)
        return Catalog({n: self.tables[n] for n in keep}, inside, self._frames)

    def for_run(self, config: Config) -> Catalog:
        """Without excluded tables and with the configuration's logical keys."""
        seen = self.restricted([n for n in self.names() if n not in config.excluded])
        return replace(seen, relationships=augmented(seen, config.logical_keys))


def augmented(catalog: Catalog, extra: Iterable[LogicalKey]) -> tuple[Relationship, ...]:
    """Declared and logical relationships, each once."""
    out = dict.fromkeys(catalog.relationships)
    for key in extra:
        for table, columns in ((key.child, key.child_columns), (key.parent, key.parent_columns)):
            if table not in catalog.tables:
                raise ConfigError(f"fk_augmentation: table {table} doesn't exist")
            missing = [c for c in columns if c not in catalog.columns(table)]
            if missing:
                raise ConfigError(f"fk_augmentation: {table} has no columns {', '.join(missing)}")
        out[Relationship(key.child, key.child_columns, key.parent, key.parent_columns)] = None
    return tuple(out)


def grouped_keys(rows: DataFrame) -> DataFrame:
    """Relationships from one row per constraint and column, as databases list them.

    ``rows``: name, child, parent, ord, child_column, parent_column. Columns stay in the order of
    ``ord``.
    """
    from pyspark.sql import functions as F

    pairs = F.array_sort(F.collect_list(F.struct("ord", "child_column", "parent_column")))
    return rows.groupBy("name", "child", "parent").agg(pairs.alias("pairs")).select(
        "name", "child", "parent",
        F.transform("pairs", lambda p: p["child_column"]).alias("child_columns"),
        F.transform("pairs", lambda p: p["parent_column"]).alias("parent_columns"),
    )


def from_frames(frames: Mapping[str, DataFrame], *, keys: Mapping[str, Iterable[UniqueKey]] | None = None, relationships: Iterable[Relationship] = (), **facts: Mapping[str, object]) -> Catalog:
    """A catalog of given DataFrames; ``facts`` sets further fields of Table by table name."""
    keys = keys or {}
    tables = {}
    for name, df in frames.items():
        more = {f: values[name] for f, values in facts.items() if name in values}
        tables[name] = Table(name, lambda df=df: df, tuple(keys.get(name, ())), **more)
    return Catalog(tables, tuple(relationships))
