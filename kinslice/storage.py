"""Versioned Parquet destinations: numbered manifests name immutable segments.

Works on any Hadoop file system. A run writes segments into folders that no other run uses, then one
manifest ``_versions/<number>.json``, which is renamed into place whole and never replaced. The largest
number is current, so readers see all tables of one version or of another, and a run that fails anywhere
leaves the current version as it was. Tables that a run doesn't touch are carried over by name. A file that
only one writer can create locks the destination.

A segment is a folder of Parquet files. One that an incremental run wrote has an ``_action`` column: its
rows are added to those before, and rows that they refresh are hidden.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .operators import merge

#: Segments of a table from which its next version is written anew.
MANY = 16


class Locked(RuntimeError):
    """Another run holds the destination."""


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which executors share; where it is unset on one machine, a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def written(spark: SparkSession):
    """A function that writes an intermediate table to the scratch folder and reads it again.

    The folders are removed when the session's JVM ends.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def keep(name: str, df: DataFrame) -> DataFrame:
        at = f"{scratch_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        hadoop.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.Path(at))
        return spark.read.schema(df.schema).parquet(at)

    return keep


@dataclass
class Segment:
    path: str
    #: Rows that refresh earlier ones; None if the segment is a plain part of the table.
    refreshed: int | None = None


@dataclass
class Stored:
    """A table of a version."""

    schema: str
    segments: list[Segment] = field(default_factory=list)
    identity: list[str] = field(default_factory=list)

    @property
    def worn(self) -> bool:
        return len(self.segments) >= MANY


class Destination:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        #: Folders by the name that they were written under.
        self.folders: dict[str, str] = {}

    def _at(self, *parts: str):
        return self._path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read_text(self, *parts: str) -> str | None:
        if not self._fs.exists(self._at(*parts)):
            return None
        stream = self._fs.open(self._at(*parts))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, text: str, *parts: str) -> None:
        """Makes a small file that readers see whole or not at all; it must not exist."""
        self._fs.mkdirs(self._at(*parts).getParent())
        new = self._at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(*parts)) or not self._fs.rename(new, self._at(*parts)):
            self._fs.delete(new, False)
            raise FileExistsError("/".join((self.path, *parts)))

    def lock(self) -> None:
        self._fs.mkdirs(self._at())
        if not self._fs.createNewFile(self._at("_LOCK")):
            raise Locked(f"another run holds {self.path}; remove _LOCK if it is gone")

    def unlock(self) -> None:
        self._fs.delete(self._at("_LOCK"), False)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if re.fullmatch(r"\d+\.json", n))

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version if version is None else version
        return json.loads(self.read_text("_versions", f"{version:020d}.json") or '{"tables": {}}')

    def stored(self, version: int | None = None) -> dict[str, Stored]:
        """The tables of a version, the current one by default."""
        out = {}
        for name, t in self.manifest(version)["tables"].items():
            out[name] = Stored(t["schema"], [Segment(**s) for s in t["segments"]], t["identity"])
        return out

    def read(self, table: Stored) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        out = None
        for s in table.segments:
            if s.refreshed is None:
                rows = self.spark.read.schema(schema).parquet(f"{self.path}/{s.path}")
            else:
                change = self.spark.read.schema(StructType([*schema.fields]).add("_action", "string")).parquet(f"{self.path}/{s.path}")
                if out is not None and s.refreshed:
                    out = merge.without(out, change.where("_action = 'refresh'"), table.identity)
                rows = change.drop("_action")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self.read(t) for n, t in self.stored(version).items()}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a new segment and reads it again, so that lineage ends and samples are drawn once."""
        self.folders[name] = at = f"data/{re.sub('[^A-Za-z0-9_.-]', '_', name)}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}")

    def publish(self, tables: dict[str, Stored], **more: object) -> int:
        """Makes ``tables`` the current version; True to all readers from one rename on."""
        version = self.version + 1
        body = {"tables": {n: asdict(t) for n, t in sorted(tables.items())}, **more}
        self.create_text(json.dumps(body), "_versions", f"{version:020d}.json")
        return version

    def vacuum(self, keep_versions: int | None = None, keep: Sequence[str] = ()) -> None:
        """Removes segments that no version names; with ``keep_versions``, older versions too."""
        versions = self.versions()
        gone = versions[:-keep_versions] if keep_versions else []
        for v in gone:
            self._fs.delete(self._at("_versions", f"{v:020d}.json"), False)
        used = {s.path for v in versions if v not in gone for t in self.stored(v).values() for s in t.segments} | set(keep)
        for name in self._names("data"):
            if f"data/{name}" not in used:
                self._fs.delete(self._at("data", name), True)

    def truncate(self, name: str) -> int:
        """A version in which one table has no rows."""
        tables = self.stored()
        tables[name] = Stored(tables[name].schema, [], tables[name].identity)
        return self.publish(tables)

    def remove(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)

    def teardown(self) -> None:
        """Removes everything but the lock."""
        for name in self._names():
            if name != "_LOCK":
                self.remove(name)
