"""The subset configuration: JSON in, checked immutable values out."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from enum import StrEnum
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be run."""


class Mode(StrEnum):
    RECREATE = "recreate"
    TOPUP = "topup"
    GROW = "grow"


class Backend(StrEnum):
    POSTGRES = "postgres"
    MYSQL = "mysql"
    PARQUET = "parquet"
    JDBC = "jdbc"


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _text(value: Any, what: str) -> str:
    _need(isinstance(value, str) and bool(value.strip()), f"{what} must be a non-empty string")
    return value


def _columns(value: Any, what: str) -> tuple[str, ...]:
    _need(isinstance(value, list | tuple) and len(value) > 0, f"{what} must be a non-empty string list")
    names = tuple(_text(c, f"each column of {what}") for c in value)
    _need(len(set(names)) == len(names), f"{what} must not repeat columns")
    return names


@dataclass(frozen=True)
class PreFilter:
    name: str
    query: str
    column: str

    def __post_init__(self):
        for part in ("name", "query", "column"):
            _text(getattr(self, part), f"pre-filter {part}")


@dataclass(frozen=True)
class Target:
    table: str
    where: str | None = None
    percent: float | None = None
    pre_filter: str | None = None

    def __post_init__(self):
        _need((self.where is None) != (self.percent is None), f"target {self.table}: give exactly one of where and percent")


@dataclass(frozen=True)
class UpstreamFilter:
    condition: str
    table: str | None = None
    column: str | None = None

    def __post_init__(self):
        _need((self.table is None) != (self.column is None), "upstream filter: give exactly one of table and column")


@dataclass(frozen=True)
class Break:
    child: str
    parent: str
    keep_values: bool = False


@dataclass(frozen=True)
class LogicalKey:
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    def __post_init__(self):
        _text(self.child, "fk_table")
        _text(self.parent, "target_table")
        object.__setattr__(self, "child_columns", _columns(self.child_columns, "fk_columns"))
        object.__setattr__(self, "parent_columns", _columns(self.parent_columns, "target_columns"))
        _need(len(self.child_columns) == len(self.parent_columns), "fk_columns and target_columns must be equally long")


@dataclass(frozen=True)
class Connection:
    """Where tables are: a database, by its parts or by a JDBC ``url``, or a folder of Parquet tables (``path``)."""

    user_name: str = ""
    host: str = ""
    db_name: str = ""
    port: int = 0
    ssl_mode: str | None = None
    password: str | None = None
    path: str | None = None
    url: str | None = None
    driver: str | None = None


@dataclass(frozen=True)
class Config:
    backend: Backend
    targets: tuple[Target, ...]
    source: Connection
    destination: Connection
    keep_disconnected: bool = False
    upstream_filters: tuple[UpstreamFilter, ...] = ()
    excluded: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    breaks: tuple[Break, ...] = ()
    logical_keys: tuple[LogicalKey, ...] = ()
    identities: tuple[tuple[str, tuple[str, ...]], ...] = ()
    max_rows: int | None = None
    limit_upstream: bool = False
    use_temp_tables: bool = False
    mode: Mode = Mode.RECREATE
    workers: int = 1
    pre_filters: tuple[PreFilter, ...] = ()
    pre_constraint_sql: tuple[str, ...] = ()
    post_subset_sql: tuple[str, ...] = ()
    legacy_empty_prefilter: bool = False
    seed: int = 0

    def __post_init__(self):
        _need(isinstance(self.workers, int) and self.workers >= 1, "parallel_read_workers must be an integer of 1 or more")
        _need(self.max_rows is None or (isinstance(self.max_rows, int) and self.max_rows >= 0), 'max_rows_per_table must be a number, "ALL" or null')
        if self.backend is Backend.MYSQL:
            _need(self.mode is not Mode.GROW, 'destination_mode "grow" isn\'t available for mysql')
            _need(not self.identities, "incremental_keys aren't available for mysql")
        tables = [t for t, _ in self.identities]
        _need(len(tables) == len(set(tables)), "incremental_keys: one entry per table at most")
        known = {p.name for p in self.pre_filters}
        _need(len(known) == len(self.pre_filters), "pre_filters: names must differ")
        for t in self.targets:
            _need(t.pre_filter is None or t.pre_filter in known, f"target {t.table}: pre-filter {t.pre_filter} isn't defined")

    @property
    def incremental(self) -> bool:
        # a topup of a mysql source is parsed but runs as a plain copy into what is there
        return self.mode is not Mode.RECREATE and self.backend is not Backend.MYSQL

    @property
    def target_tables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.table for t in self.targets))

    @property
    def broken(self) -> frozenset[tuple[str, str]]:
        return frozenset((b.child, b.parent) for b in self.breaks)

    @property
    def opportunistic(self) -> frozenset[tuple[str, str]]:
        return frozenset((b.child, b.parent) for b in self.breaks if b.keep_values)


_VARIABLE = re.compile(r"\$\{([^}]+)\}")


def _connection(raw: Mapping[str, Any]) -> Connection:
    def value(key: str, default: Any = None) -> Any:
        found = raw.get(key, default)
        if isinstance(found, str) and (m := _VARIABLE.fullmatch(found)):
            _need(m[1] in os.environ, f"environment variable {m[1]} is not set")
            return os.environ[m[1]]
        return found

    return Connection(
        user_name=value("user_name", ""), host=value("host", ""), db_name=value("db_name", ""), port=int(value("port", 0) or 0),
        ssl_mode=value("ssl_mode"), password=value("password"), path=value("path"),
        url=value("url"), driver=value("driver"),
    )


def _logical(raw: Mapping[str, Any]) -> LogicalKey:
    child, parent = raw["fk_table"], raw["target_table"]
    if raw.get("fk_schema"):
        child = f"{raw['fk_schema']}.{child}"
    if raw.get("target_schema"):
        parent = f"{raw['target_schema']}.{parent}"
    return LogicalKey(child, raw["fk_columns"], parent, raw["target_columns"])


def _mode(raw: Mapping[str, Any]) -> Mode:
    if "destination_mode" in raw:
        try:
            return Mode(raw["destination_mode"])
        except ValueError:
            raise ConfigError(f"destination_mode: {raw['destination_mode']} isn't one of recreate, topup, grow") from None
    return Mode.TOPUP if raw.get("skip_schema_setup") else Mode.RECREATE


REQUIRED = ("db_type", "initial_targets", "source_db_connection_info", "destination_db_connection_info")


def parse(raw: Mapping[str, Any]) -> Config:
    for key in REQUIRED:
        _need(key in raw, f"{key} is missing")
    try:
        backend = Backend(raw["db_type"])
    except ValueError:
        raise ConfigError(f"db_type: {raw['db_type']} isn't one of postgres, mysql, parquet, jdbc") from None
    rows = raw.get("max_rows_per_table")

    def each(key: str) -> Iterable[Any]:
        return raw.get(key) or ()

    return Config(
        backend=backend,
        targets=tuple(Target(t["table"], t.get("where"), t.get("percent"), t.get("pre_filter")) for t in raw["initial_targets"]),
        source=_connection(raw["source_db_connection_info"]),
        destination=_connection(raw["destination_db_connection_info"]),
        keep_disconnected=bool(raw.get("keep_disconnected_tables", False)),
        upstream_filters=tuple(UpstreamFilter(f["condition"], f.get("table"), f.get("column")) for f in each("upstream_filters")),
        excluded=tuple(each("excluded_tables")),
        passthrough=tuple(dict.fromkeys(each("passthrough_tables"))),
        breaks=tuple(Break(b["fk_table"], b["target_table"], bool(b.get("preserve_fk_opportunistically", False))) for b in each("dependency_breaks")),
        logical_keys=tuple(map(_logical, each("fk_augmentation"))),
        identities=tuple((_text(k["table"], "incremental key table"), _columns(k["columns"], "incremental key columns")) for k in each("incremental_keys")),
        max_rows=None if rows is None or rows == "ALL" else rows,
        limit_upstream=bool(raw.get("limit_upstream", False)),
        use_temp_tables=bool(raw.get("use_temp_tables", False)),
        mode=_mode(raw),
        workers=raw.get("parallel_read_workers", 1),
        pre_filters=tuple(PreFilter(p["name"], p["query"], p["column"]) for p in each("pre_filters")),
        pre_constraint_sql=tuple(each("pre_constraint_sql")),
        post_subset_sql=tuple(each("post_subset_sql")),
        legacy_empty_prefilter=bool(raw.get("legacy_empty_prefilter", False)),
        seed=int(raw.get("seed", 0)),
    )


def load(path: str | Path) -> Config:
    return parse(json.loads(Path(path).read_text(encoding="utf-8")))
