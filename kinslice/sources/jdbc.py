"""Databases through JDBC: their catalogs, parallel reads, and loads in one transaction.

Catalogs come from the driver's own metadata, so any database with a JDBC driver on the class path works;
what that metadata lacks is asked of PostgreSQL's own catalog. Databases give each reader its own snapshot,
so stage tables to Parquet before a run that needs one.
"""

from __future__ import annotations

import getpass
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph, storage
from ..catalog import Catalog, Relationship, Table, UniqueKey
from ..config import Backend, ConfigError, Connection, Mode

#: Rows of one range of a table that is read in parallel, and ranges at most.
RANGE_ROWS, RANGES = 500_000, 10_000
ACTION = "kinslice_action"
#: Kinds of relations by what metadata calls them.
KINDS = {"TABLE": "r", "BASE TABLE": "r", "PARTITIONED TABLE": "p", "VIEW": "v", "MATERIALIZED VIEW": "m", "FOREIGN TABLE": "f"}
_SYSTEM = ("pg_catalog", "information_schema", "pg_toast", "mysql", "performance_schema", "sys")
_INTEGERS = {-6, 5, 4, -5}  # java.sql.Types: TINYINT, SMALLINT, INTEGER, BIGINT

#: What metadata doesn't tell, by dialect: one row each of table, a name, and flags.
_INDEXES = {
    "postgresql": """SELECT n.nspname || '.' || t.relname, i.relname, x.indimmediate, x.indisvalid
FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace
WHERE x.indisunique OR x.indisexclusion""",
}
_TABLES = {
    "postgresql": """SELECT n.nspname || '.' || c.relname,
  EXISTS (SELECT 1 FROM pg_inherits h WHERE (h.inhparent = c.oid OR h.inhrelid = c.oid) AND NOT c.relispartition AND c.relkind = 'r'),
  c.relispartition OR c.relkind = 'p',
  EXISTS (SELECT 1 FROM pg_trigger g WHERE g.tgrelid = c.oid AND NOT g.tgisinternal AND g.tgenabled <> 'D'),
  EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conrelid = c.oid AND to_jsonb(k) ->> 'conperiod' = 'true')
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p')""",
}
_ALWAYS = {
    "postgresql": "SELECT table_schema || '.' || table_name, column_name FROM information_schema.columns WHERE identity_generation = 'ALWAYS'",
}
_EXCLUSIONS = {
    "postgresql": """SELECT n.nspname || '.' || t.relname, k.conname FROM pg_constraint k
JOIN pg_class t ON t.oid = k.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE k.contype = 'x'""",
}


def options(backend: Backend, c: Connection) -> dict[str, str]:
    """Options of Spark's JDBC source; a password that is needed and not given is asked for."""
    if c.url:
        out = {"url": c.url}
    else:
        kind, ssl = {Backend.POSTGRES: ("postgresql", "sslmode"), Backend.MYSQL: ("mysql", "sslMode")}.get(backend, (None, None))
        if kind is None:
            raise ConfigError(f"a {backend} connection needs a path or a url")
        out = {"url": f"jdbc:{kind}://{c.host}:{c.port}/{c.db_name}" + (f"?{ssl}={c.ssl_mode}" if c.ssl_mode else "")}
    if c.driver:
        out["driver"] = c.driver
    if c.user_name:
        out |= {"user": c.user_name, "password": c.password if c.password is not None else getpass.getpass(f"Password of {c.user_name}: ")}
    return out


def dialect(opts: dict[str, str]) -> str:
    return opts["url"].split(":")[1]


@contextmanager
def connected(spark: SparkSession, opts: dict[str, str]):
    """A connection of the driver's."""
    jvm = spark.sparkContext._jvm
    if "driver" in opts:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(opts["driver"])
    props = jvm.java.util.Properties()
    for key in ("user", "password"):
        if key in opts:
            props.setProperty(key, opts[key])
    con = jvm.java.sql.DriverManager.getConnection(opts["url"], props)
    try:
        yield con
    finally:
        con.close()


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _imported(con, name: str, df: DataFrame, folder: str) -> None:
    """Loads a Derby table from files that executors write: columns by place, strings quoted, nulls empty."""
    fields = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(f"`{c}`").cast("string"), F.lit("")) for c, kind in df.dtypes]
    df.select(F.concat_ws(",", *fields)).write.text(f"file://{folder}")
    for n in sorted(os.listdir(folder)):
        if n.startswith("part-") and os.path.getsize(f"{folder}/{n}"):
            call = con.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
            call.setString(1, name)
            call.setString(2, f"{folder}/{n}")
            call.execute()
            call.close()


def derby_archive(spark: SparkSession, ddl: Iterable[str], tables: dict[str, DataFrame]) -> dict[str, str]:
    """Options of a read-only Derby database with these tables, an archive in the folder that executors share.

    The driver's JVM creates and fills it, with integers and strings. Derby can then be started on it in any
    number of JVMs, which isn't so for a database in memory or in a folder. Entries aren't compressed, so pages
    can be read anywhere. It is removed when the session's JVM ends.
    """
    home = urlsplit(storage.scratch_folder(spark))
    if home.scheme not in ("", "file"):
        raise ConfigError(f"{home.geturl()} isn't a mounted folder, and Derby opens archives only there")
    os.makedirs(f"{home.path}/tables", exist_ok=True)
    archive = f"{home.path}/tables/derby-{uuid.uuid4().hex}.jar"
    with tempfile.TemporaryDirectory(dir=f"{home.path}/tables") as top:
        url = f"jdbc:derby:{os.path.realpath(top)}/db"
        with connected(spark, {"url": f"{url};create=true", "driver": DERBY}) as con:
            for line in ddl:
                made = con.createStatement()
                made.executeUpdate(line)
                made.close()
            for name, df in tables.items():
                _imported(con, name, df, f"{os.path.realpath(top)}/{name}")
        with suppress(Py4JJavaError), connected(spark, {"url": f"{url};shutdown=true"}):  # says by an error that it has ended
            pass
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_STORED) as out:
            for folder, _, names in os.walk(f"{top}/db"):
                for n in names:
                    if not n.endswith(".lck"):
                        out.write(f"{folder}/{n}", os.path.relpath(f"{folder}/{n}", top))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file:{archive}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return {"url": f"jdbc:derby:jar:({archive})db", "driver": DERBY}


def _rows(found, *columns: str | int) -> Iterator[tuple[str | None, ...]]:
    try:
        while found.next():
            yield tuple(found.getString(c) for c in columns)
    finally:
        found.close()


def _asked(con, query: str | None, width: int) -> list[tuple[str | None, ...]]:
    if query is None:
        return []
    statement = con.createStatement()
    try:
        return list(_rows(statement.executeQuery(query), *range(1, width + 1)))
    finally:
        statement.close()


def _true(flag: str | None) -> bool:
    return str(flag).lower() in ("t", "true", "1", "yes")


@dataclass(frozen=True)
class ColumnFacts:
    type_name: str
    #: Of java.sql.Types.
    number: int
    size: int
    digits: int
    nullable: bool
    #: Counts up by itself.
    auto: bool
    computed: bool

    @property
    def definition(self) -> str:
        """The type as a table's definition has it."""
        sized = self.number in _SIZED and 0 < self.size < 1 << 24
        length = f"({self.size}{f', {self.digits}' if self.number in _EXACT else ''})" if sized else ""
        head, gap, tail = self.type_name.partition("()")
        return f"{head.strip()}{length}{tail}" if gap or "(" not in self.type_name else self.type_name


#: java.sql.Types with a length (CHAR, VARCHAR, NCHAR, NVARCHAR, BINARY, VARBINARY), and with digits (NUMERIC, DECIMAL).
_EXACT = {2, 3}
_SIZED = {1, 12, -15, -9, -2, -3} | _EXACT
#: Types of columns that no database has defined.
_SPARK = {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "string": "VARCHAR(4000)"}


@dataclass
class Facts:
    """What a database says of one table."""

    schema: str
    name: str
    kind: str
    columns: dict[str, ColumnFacts] = field(default_factory=dict)


def quoted(con, *names: str) -> str:
    mark = (con.getMetaData().getIdentifierQuoteString() or "").strip()
    return ".".join(mark + n.replace(mark, mark * 2) + mark if mark else n for n in names if n)


def _place(con, schema: str) -> tuple[str | None, str | None]:
    """Catalog and schema arguments; some databases call their schemas catalogs."""
    return (schema, None) if "mysql" in con.getMetaData().getURL().split(":")[1] or "mariadb" in con.getMetaData().getURL() else (None, schema)


def facts(con) -> dict[str, Facts]:
    """Relations of all but system schemas."""
    meta, out = con.getMetaData(), {}
    for catalog, schema, name, kind in _rows(meta.getTables(con.getCatalog(), None, "%", None), "TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE"):
        schema = schema or catalog or ""
        if kind not in KINDS or schema.lower() in _SYSTEM or schema.upper().startswith("SYS"):
            continue
        out[f"{schema}.{name}" if schema else name] = Facts(schema, name, KINDS[kind])
    for f in out.values():
        found = meta.getColumns(*_place(con, f.schema), f.name, "%")
        for column, type_name, number, size, digits, nullable, auto, computed in _rows(found, "COLUMN_NAME", "TYPE_NAME", "DATA_TYPE", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "IS_AUTOINCREMENT", "IS_GENERATEDCOLUMN"):
            f.columns[column] = ColumnFacts(type_name, int(number), int(size or 0), int(digits or 0), nullable != "NO", auto == "YES", computed == "YES" and auto != "YES")
    return out


def unique_keys(con, f: Facts, indexes: dict[tuple[str, str], tuple[bool, bool]] | None = None, exclusions: Iterable[str] = ()) -> tuple[UniqueKey, ...]:
    """The primary key first, then unique indexes; ``indexes``: immediate and valid by table and index name."""
    meta, full = con.getMetaData(), f"{f.schema}.{f.name}"
    indexes = indexes or {}
    primary = sorted(_rows(meta.getPrimaryKeys(*_place(con, f.schema), f.name), "KEY_SEQ", "COLUMN_NAME", "PK_NAME"), key=lambda r: int(r[0]))
    immediate, valid = indexes.get((full, primary[0][2]), (True, True)) if primary else (True, True)
    out = [UniqueKey(tuple(c for _, c, _ in primary), primary=True, immediate=immediate, valid=valid)] if primary else []
    by_name: dict[str, list[tuple]] = defaultdict(list)
    for index, ord_, column, predicate in _rows(meta.getIndexInfo(*_place(con, f.schema), f.name, True, False), "INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME", "FILTER_CONDITION"):
        if index and column:
            by_name[index].append((int(ord_), column.strip('"'), predicate))
    for index, rows in sorted(by_name.items()):
        columns = tuple(c for _, c, _ in sorted(rows))
        if index in exclusions or (out and out[0].primary and columns == out[0].columns):
            continue
        immediate, valid = indexes.get((full, index), (True, True))
        named = all(c in f.columns for c in columns)
        out.append(UniqueKey(
            columns, valid=valid, immediate=immediate, predicate=rows[0][2], expression=not named,
            not_null=named and not any(f.columns[c].nullable for c in columns), generated=named and any(f.columns[c].computed for c in columns),
        ))
    out += [UniqueKey((), exclusion=True) for _ in exclusions]
    return tuple(out)


def foreign_keys(con, f: Facts) -> list[Relationship]:
    """One relationship for each constraint, its columns in the constraint's order."""
    groups: dict[tuple, list[tuple]] = defaultdict(list)
    found = con.getMetaData().getImportedKeys(*_place(con, f.schema), f.name)
    for catalog, schema, parent, key, child_column, parent_column, name in _rows(found, "PKTABLE_CAT", "PKTABLE_SCHEM", "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKCOLUMN_NAME", "FK_NAME"):
        home = schema or catalog or ""
        groups[name, f"{home}.{parent}" if home else parent].append((int(key), child_column, parent_column))
    own = f"{f.schema}.{f.name}" if f.schema else f.name
    return [Relationship(own, tuple(c for _, c, _ in sorted(rows)), parent, tuple(p for _, _, p in sorted(rows))) for (_, parent), rows in sorted(groups.items())]


def read(spark: SparkSession, opts: dict[str, str], table: str, *, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1) -> DataFrame:
    """A table; with a numeric column and its bounds, in ``parts`` ranges that are read in parallel."""
    reader = spark.read.format("jdbc").options(**opts).option("dbtable", table).option("fetchsize", 10_000)
    if column and bounds and parts > 1:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_ranges(spark: SparkSession, opts: dict[str, str], f: Facts, keys: Sequence[UniqueKey]) -> DataFrame:
    """A table in ranges of about RANGE_ROWS rows, if its primary key is one integer."""
    column = next((k.columns[0] for k in keys if k.primary and len(k.columns) == 1 and f.columns[k.columns[0]].number in _INTEGERS), None)
    with connected(spark, opts) as con:
        name = quoted(con, f.schema, f.name)
        if column is None:
            return read(spark, opts, name)
        key = quoted(con, column)
        ((least, most, n),) = _asked(con, f"SELECT min({key}), max({key}), count(*) FROM {name}", 3)
    if least is None:
        return read(spark, opts, name)
    parts = min(-(-int(n) // RANGE_ROWS), RANGES, int(most) - int(least) + 1)
    return read(spark, opts, name, column=key, bounds=(int(least), int(most) + 1), parts=parts)


def catalog(spark: SparkSession, opts: dict[str, str]) -> Catalog:
    """All relations with their keys and the facts that topup and grow check."""
    kind, tables, relationships = dialect(opts), {}, []
    with connected(spark, opts) as con:
        found = facts(con)
        indexes = {(t, i): (_true(a), _true(b)) for t, i, a, b in _asked(con, _INDEXES.get(kind), 4)}
        flags = {t: tuple(map(_true, more)) for t, *more in _asked(con, _TABLES.get(kind), 5)}
        always, exclusions = defaultdict(set), defaultdict(list)
        for t, c in _asked(con, _ALWAYS.get(kind), 2):
            always[t].add(c)
        for t, c in _asked(con, _EXCLUSIONS.get(kind), 2):
            exclusions[t].append(c)
        for name, f in found.items():
            keys = unique_keys(con, f, indexes, exclusions[name])
            inherited, partitioned, triggers, temporal = flags.get(name, (False, f.kind == "p", False, False))
            tables[name] = Table(
                name, lambda f=f, keys=keys: read_ranges(spark, opts, f, keys), keys, kind=f.kind,
                generated=frozenset(c for c, t in f.columns.items() if t.computed), always_identity=frozenset(always[name]),
                sequences=tuple(c for c, t in f.columns.items() if t.auto), not_null=tuple(c for c, t in f.columns.items() if not t.nullable), native=f,
                inherited=inherited, partitioned=partitioned, write_triggers=triggers, temporal=temporal,
            )
            relationships += foreign_keys(con, f)
    usable = tuple(r for r in relationships if r.child in tables and r.parent in tables)
    return Catalog(tables, usable)


class Database:
    """A database that runs load into. A run from scratch creates the tables that it lacks."""

    def __init__(self, spark: SparkSession, opts: dict[str, str]):
        self.spark, self.opts = spark, opts
        #: Name of a folder that stages its runs.
        self.folder = "load-" + hashlib.sha256(opts["url"].encode()).hexdigest()[:16]
        self.catalog = catalog(spark, opts)
        schemas = self.catalog.schemas()
        #: Where schemas are databases and there is one, tables of all schemas go there.
        self.only = schemas[0] if dialect(opts) in ("mysql", "mariadb") and len(schemas) == 1 else None

    def here(self, name: str) -> str:
        """A table's name in this database."""
        found = f"{self.only}.{name.rpartition('.')[2]}" if self.only else name
        if found not in self.catalog.tables and "." not in found:
            # a name without schema is in the user's own
            return next((t for t in self.catalog.tables if t.rpartition(".")[2] == found), found)
        return found

    def create(self, tables: dict[str, DataFrame], source: Catalog) -> list[str]:
        """Creates the tables that are missing, with their primary keys; returns their names.

        Columns have the types of the source's database, if it is one. Computed columns are left out.
        """
        missing = [n for n in tables if self.here(n) not in self.catalog.tables]
        with connected(self.spark, self.opts) as con:
            schemas = {x for (x,) in _rows(con.getMetaData().getSchemas(), "TABLE_SCHEM")}
            for name in missing:
                schema = self.here(name).rpartition(".")[0]
                if schema and schema not in schemas and dialect(self.opts) not in ("mysql", "mariadb"):
                    self._run(con, f"CREATE SCHEMA {quoted(con, schema)}")
                    schemas.add(schema)
                table, native = source.tables[name], getattr(source.tables[name].native, "columns", {})
                lines = []
                for f in tables[name].schema:
                    kind = native[f.name].definition if f.name in native else _SPARK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                    lines.append(f"{quoted(con, f.name)} {kind}" + (" NOT NULL" if f.name in (*table.not_null, *table.primary) else ""))
                if table.primary:
                    lines.append(f"PRIMARY KEY ({', '.join(quoted(con, c) for c in table.primary)})")
                self._run(con, f"CREATE TABLE {self._name(con, name)} ({', '.join(lines)})")
        if missing:
            self.catalog = catalog(self.spark, self.opts)
        return missing

    def add_constraints(self, names: Sequence[str], source: Catalog, relationships: Sequence[Relationship]) -> None:
        """Unique and foreign keys of tables that have been created, once their rows are there."""
        with connected(self.spark, self.opts) as con:
            listed = lambda columns: ", ".join(quoted(con, c) for c in columns)
            for name in names:
                for k in source.tables[name].keys:
                    if not (k.primary or k.predicate or k.expression or k.exclusion):
                        self._run(con, f"ALTER TABLE {self._name(con, name)} ADD UNIQUE ({listed(k.columns)})")
            for r in relationships:
                if r.child in names:
                    self._run(con, f"ALTER TABLE {self._name(con, r.child)} ADD FOREIGN KEY ({listed(r.child_columns)}) REFERENCES {self._name(con, r.parent)} ({listed(r.parent_columns)})")

    def teardown(self) -> None:
        """Drops all tables."""
        with connected(self.spark, self.opts) as con:
            found = {n: f for n, f in facts(con).items() if f.kind == "r"}
            word = "FOREIGN KEY" if dialect(self.opts) in ("mysql", "mariadb") else "CONSTRAINT"
            for f in found.values():
                links = {x for (x,) in _rows(con.getMetaData().getImportedKeys(*_place(con, f.schema), f.name), "FK_NAME")}
                for link in sorted(links):
                    self._run(con, f"ALTER TABLE {quoted(con, f.schema, f.name)} DROP {word} {quoted(con, link)}")
            for f in found.values():
                self._run(con, f"DROP TABLE {quoted(con, f.schema, f.name)}")
        self.catalog = catalog(self.spark, self.opts)

    def frames(self) -> dict[str, DataFrame]:
        """What is there, in full; computed columns are left out."""
        return {n: t.read().drop(*t.generated) for n, t in self.catalog.tables.items() if t.kind == "r"}

    def load(self, run, tables: dict[str, DataFrame], relationships: Sequence[Relationship]) -> None:
        """Replaces all rows, or in topup and grow adds and refreshes the rows that the run has written.

        Executors write to side tables in parallel. One transaction then moves the rows over, parents before
        children, so that others see all of the load or nothing.
        """
        order = [t for level in graph.strata(relationships, list(tables)) for t in sorted(level)]
        order += [t for t in tables if t not in order]
        made = self.create({n: tables[n] for n in order}, run.catalog) if run.config.mode is Mode.RECREATE else []
        staged = {}
        for name in order:
            if self.here(name) not in self.catalog.tables:
                raise ConfigError(f"table {self.here(name)} doesn't exist in the destination")
            if run.incremental:
                changes = [c for c in run.changes.get(name, ()) if not c.empty]
                if not changes:
                    continue
                rows = run.changed(name, inserted_only=None)
                staged[name] = rows.withColumn(ACTION, F.when(F.col("_inserted"), "insert").otherwise("refresh")).drop("_inserted")
            else:
                own = [df for _, df in run.parts.get(name, ())]
                rows = tables[name] if run.config.mode is Mode.RECREATE else reduce(DataFrame.unionByName, own) if own else None
                if rows is not None:
                    staged[name] = rows.withColumn(ACTION, F.lit("insert"))
        try:
            side = {name: self._stage(name, df) for name, df in staged.items()}
            with connected(self.spark, self.opts) as con:
                con.setAutoCommit(False)
                try:
                    if run.config.mode is Mode.RECREATE:
                        for name in reversed(order):
                            self._run(con, f"DELETE FROM {self._name(con, name)}")
                    for name in order:
                        if name in side:
                            self._move(con, name, side[name], staged[name].columns, run.identities.get(name, ()))
                    con.commit()
                except BaseException:
                    con.rollback()
                    raise
        finally:
            with connected(self.spark, self.opts) as con:
                for name in staged:
                    if self._side(name) in {t.split(".")[-1] for t in facts(con)}:
                        self._run(con, f"DROP TABLE {self._side_name(con, name)}")
        self.add_constraints(made, run.catalog, [r for r in relationships if r.pair not in {(x.child, x.parent) for x in run.config.logical_keys}])

    def truncate(self, name: str) -> None:
        with connected(self.spark, self.opts) as con:
            self._run(con, f"DELETE FROM {self._name(con, name)}")

    def _run(self, con, statement: str) -> None:
        made = con.createStatement()
        try:
            made.executeUpdate(statement)
        finally:
            made.close()

    def _name(self, con, name: str) -> str:
        schema, _, table = self.here(name).rpartition(".")
        return quoted(con, schema, table)

    def _side(self, name: str) -> str:
        """A short name that differs for each table, whatever its length."""
        return "KINSLICE_" + hashlib.md5(self.here(name).encode()).hexdigest()[:16].upper()

    def _side_name(self, con, name: str) -> str:
        return quoted(con, self.here(name).rpartition(".")[0], self._side(name))

    def _stage(self, name: str, df: DataFrame) -> str:
        with connected(self.spark, self.opts) as con:
            side, target = self._side_name(con, name), self._name(con, name)
            columns = ", ".join(quoted(con, c) for c in df.columns if c != ACTION)
            if self._side(name) in {t.split(".")[-1] for t in facts(con)}:
                self._run(con, f"DROP TABLE {side}")
            empty = "WHERE 1 = 0" if dialect(self.opts) in ("mysql", "mariadb") else "WITH NO DATA"
            self._run(con, f"CREATE TABLE {side} AS SELECT {columns} FROM {target} {empty}")
            self._run(con, f"ALTER TABLE {side} ADD COLUMN {quoted(con, ACTION)} VARCHAR(10)")
        df.write.format("jdbc").options(**self.opts).option("dbtable", side).option("batchsize", 1000).mode("append").save()
        return side

    def _move(self, con, name: str, side: str, columns: Sequence[str], identity: Sequence[str]) -> None:
        target, own = self._name(con, name), [c for c in columns if c != ACTION]
        action = quoted(con, ACTION)
        if identity:
            rest = [c for c in own if c not in identity]
            same = " AND ".join(f"s.{quoted(con, c)} = {target}.{quoted(con, c)}" for c in identity)
            if rest:
                sets = ", ".join(f"{quoted(con, c)} = (SELECT s.{quoted(con, c)} FROM {side} s WHERE {same})" for c in rest)
                self._run(con, f"UPDATE {target} SET {sets} WHERE EXISTS (SELECT 1 FROM {side} s WHERE {same} AND s.{action} = 'refresh')")
        listed = ", ".join(quoted(con, c) for c in own)
        always = self.catalog.tables[self.here(name)].always_identity
        override = " OVERRIDING SYSTEM VALUE" if always and dialect(self.opts) == "postgresql" else ""
        self._run(con, f"INSERT INTO {target} ({listed}){override} SELECT {listed} FROM {side} s WHERE s.{action} = 'insert'")


def renamed(cat: Catalog, schema: str) -> Catalog:
    """A catalog whose tables all are in another schema."""
    to = lambda n: f"{schema}.{n.rpartition('.')[2]}"
    tables = {to(n): replace(t, name=to(n)) for n, t in cat.tables.items()}
    return Catalog(tables, tuple(replace(r, child=to(r.child), parent=to(r.parent)) for r in cat.relationships))
