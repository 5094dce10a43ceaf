"""Folders of Parquet tables, with a ``catalog.json`` for the keys that files don't hold."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..catalog import Catalog, Relationship, Table, UniqueKey


def open_folder(spark: SparkSession, folder: str) -> Catalog:
    """All Parquet tables of a folder: ``<table>.parquet`` files and folders of files.

    What ``catalog.json`` declares is known of them; without that file they have no keys.
    """
    fs, at, hadoop = _folder(spark, folder)
    names = {}
    for item in fs.listStatus(at):
        name = item.getPath().getName()
        if name.startswith((".", "_")) or not (name.endswith(".parquet") or item.isDirectory()):
            continue
        names[name.removesuffix(".parquet")] = {"file": name}
    declared = {"tables": {}}
    if fs.exists(hadoop.Path(at, "catalog.json")):
        declared = json.loads("\n".join(r.value for r in spark.read.text(f"{folder.rstrip('/')}/catalog.json").collect()))
    filed = {about.get("file") for about in declared["tables"].values()}
    extra = {n: a for n, a in names.items() if n not in declared["tables"] and a["file"] not in filed}
    return catalog(spark, folder, {**declared, "tables": {**extra, **declared["tables"]}})


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop


def catalog(spark: SparkSession, folder: str, declared: Mapping[str, Any]) -> Catalog:
    """A catalog of the tables that ``declared`` describes.

    ``declared``: tables by name, with optional file (default: name + .parquet), primary (columns),
    unique (lists of columns, or objects of UniqueKey's fields), sequences, checks, not_null,
    generated, always_identity and kind; and relationships of fk_table, fk_columns, target_table, target_columns.
    """
    tables = {}
    for name, about in declared["tables"].items():
        path = f"{folder.rstrip('/')}/{about.get('file', name + '.parquet')}"
        keys = [UniqueKey(tuple(about["primary"]), primary=True)] if about.get("primary") else []
        for u in about.get("unique", ()):
            keys.append(UniqueKey(**{**u, "columns": tuple(u["columns"])}) if isinstance(u, Mapping) else UniqueKey(tuple(u)))
        tables[name] = Table(
            name, lambda path=path: spark.read.parquet(path), tuple(keys),
            generated=frozenset(about.get("generated", ())), sequences=tuple(about.get("sequences", ())),
            checks=tuple(about.get("checks", ())), not_null=tuple(about.get("not_null", ())),
            always_identity=frozenset(about.get("always_identity", ())), kind=about.get("kind", "r"),
            **{f: bool(about.get(f)) for f in ("inherited", "partitioned", "temporal", "write_triggers")},
        )
    return Catalog(tables, tuple(relationships(declared.get("relationships", ()))))


def relationships(rows: Iterable[Mapping[str, Any]]) -> Iterable[Relationship]:
    for r in rows:
        yield Relationship(r["fk_table"], tuple(r["fk_columns"]), r["target_table"], tuple(r["target_columns"]))


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    fs, at, _ = _folder(spark, path)
    return fs.getContentSummary(at).getLength()
