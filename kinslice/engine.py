"""Runs a plan: the driver orders the steps, DataFrames do the work."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import checks, incremental, report
from .catalog import Catalog
from .config import Config, ConfigError, Mode, load
from .functions import next_values
from .operators import direct, downstream, keys, merge, project, upstream
from .plans import Step, SubsetPlan, make_plan
from .sources import jdbc, parquet
from .storage import Destination, Segment, Stored, scratch_folder

#: Tables that are selected side by side if the configuration doesn't say how many.
WORKERS = 4

#: Ends the lineage of an intermediate table, or returns it as it is.
Keep = Callable[[str, DataFrame], DataFrame]


@dataclass
class SubsetResult:
    plan: SubsetPlan
    catalog: Catalog
    tables: dict[str, DataFrame]
    deltas: dict[str, DataFrame] = field(default_factory=dict)
    checks: DataFrame | None = None
    version: int | None = None
    elapsed: float = 0.0

    @cached_property
    def report(self) -> DataFrame:
        """Rows by table of source and destination."""
        return report.counts({n: self.catalog.frame(n) for n in self.catalog.names()}, self.tables)

    @cached_property
    def sequences(self) -> DataFrame | None:
        return next_values(self.tables, {n: t.sequences for n, t in self.catalog.tables.items()})


@dataclass
class Change:
    """What one step wrote in an incremental run: rows with ``_action``, and how many of each if known."""

    name: str
    rows: DataFrame
    inserted: int | None = None
    refreshed: int | None = None

    @property
    def empty(self) -> bool:
        return self.inserted == 0 and self.refreshed == 0


class Run:
    """State of one run: selected rows, and in incremental modes what has been written."""

    def __init__(self, spark: SparkSession, catalog: Catalog, config: Config, *, existing: dict[str, DataFrame] | None = None, keep: Keep | None = None, journal: incremental.Journal | None = None, log: Callable[[str], None] | None = None):
        self.spark, self.config = spark, config
        self.catalog = catalog.for_run(config)
        self.plan = make_plan(self.catalog, config)
        self.keep, self.journal, self.log = keep, journal, log
        #: What steps of a run from scratch wrote, by table.
        self.parts: dict[str, list[tuple[str, DataFrame]]] = {}
        self.changes: dict[str, list[Change]] = {}
        self.identities: dict[str, tuple[str, ...]] = {}
        self.incremental = config.incremental
        if self.incremental:
            used = {s.table for s in self.plan.steps if s.kind != "disconnected" or config.keep_disconnected}
            self.identities = incremental.identities(self.catalog, config, sorted(used))
        self.tables: dict[str, DataFrame] = {n: df for n, df in (existing or {}).items() if n in self.catalog.tables}
        #: Tables whose rows aren't what steps wrote.
        self.rewritten: set[str] = set()

    # source and destination of a step

    def source(self, table: str) -> DataFrame:
        df = project.null_broken(self.catalog.frame(table), table, self.catalog.relationships, self.config.broken, self.config.opportunistic)
        return project.without_generated(df, self.catalog.tables[table].generated)

    def selected(self, table: str) -> DataFrame:
        return self.tables[table] if table in self.tables else self.source(table).limit(0)

    def write(self, step: str, table: str, rows: Callable[[], DataFrame]) -> None:
        """``rows`` isn't called if a run that is taken up has written them already."""
        if not self.incremental:
            df, name = rows(), f"{step}:{table}"
            df = self.keep(name, df) if self.keep else df
            old = self.tables.get(table)
            self.tables[table] = df if old is None else old.unionByName(df)
            self.parts.setdefault(table, []).append((name, df))
            return
        change = self.changed_by(step, table, rows)
        self.changes.setdefault(table, []).append(change)
        if change.empty:
            return
        old = self.selected(table)
        if change.refreshed != 0:
            old = merge.without(old, change.rows.where("_action = 'refresh'"), self.identities[table])
        self.tables[table] = old.unionByName(change.rows.drop("_action"))

    def changed_by(self, step: str, table: str, rows: Callable[[], DataFrame]) -> Change:
        name, current = f"{step}:{table}", self.selected(table)
        if self.journal and (done := self.journal.finished.get(name)):
            if done["columns"] != current.columns:
                raise ConfigError(f"{table}: the unfinished run wrote other columns")
            dest = self.journal.destination
            dest.folders[name] = done["path"]
            schema = StructType([*current.schema.fields]).add("_action", "string")
            return Change(name, self.spark.read.schema(schema).parquet(f"{dest.path}/{done['path']}"), done["inserted"], done["refreshed"])
        df = merge.changes(current, rows(), self.identities[table])
        if not self.keep:
            return Change(name, df)
        df = self.keep(name, df)
        n = {r["_action"]: r["count"] for r in df.groupBy("_action").count().collect()}
        change = Change(name, df, n.get("insert", 0), n.get("refresh", 0))
        if self.journal:
            self.journal.done(name, self.journal.destination.folders[name], current.columns, change.inserted, change.refreshed)
        return change

    def changed(self, table: str, *, inserted_only: bool | None) -> DataFrame | None:
        """Destination rows that this run has written; None if it hasn't come to that table.

        With ``inserted_only`` None, all of them with ``_inserted``.
        """
        if table not in self.changes:
            return None
        some = [c for c in self.changes[table] if not c.empty]
        if not some:
            return self.selected(table).limit(0)
        rows = merge.latest([(c.rows, c.refreshed != 0) for c in some], self.identities[table])
        return rows if inserted_only is None else (rows.where("_inserted") if inserted_only else rows).drop("_inserted")

    def unchanged(self, table: str, *, inserted_only: bool) -> bool:
        """Whether this run is known to have written no row of a table that it came to."""
        found = self.changes.get(table)
        return found is not None and all(c.inserted == 0 and (inserted_only or c.refreshed == 0) for c in found)

    # steps

    def run(self, only: Iterable[str] | None = None) -> None:
        values = direct.load_pre_filters(self.spark, self.config)
        steps = self.plan.steps if only is None else self.needed(set(only))
        for group in independent(steps):
            if self.keep and len(group) > 1:
                # the jobs of tables that don't depend on each other run side by side
                with ThreadPoolExecutor(self.config.workers if self.config.workers > 1 else WORKERS) as pool:
                    for done in [pool.submit(inheritable_thread_target(self.step), step, values) for step in group]:
                        done.result()
            else:
                for step in group:
                    self.step(step, values)
        self.resolve_opportunistic()

    def step(self, step: Step, values: dict[str, DataFrame]) -> None:
        began = time.time()
        if self.skipped(step):
            self.changes.setdefault(step.table, [])
            if self.log:
                self.log(f"{step.kind} {step.table}: nothing has changed")
            return
        rows = self.rows_of(step, values)
        if rows is not None:
            self.write(step.kind, step.table, lambda: rows)
        if self.log:
            self.log(f"{step.kind} {step.table}: {time.time() - began:.2f}s")

    def skipped(self, step: Step) -> bool:
        """Whether no row that the step looks at has been written in this run."""
        if not self.incremental or not step.relationships:
            return False
        if step.kind == "upstream":
            return self.config.mode is Mode.TOPUP and all(self.unchanged(r.parent, inserted_only=True) for r in step.relationships)
        return step.kind == "downstream" and all(self.unchanged(r.child, inserted_only=False) for r in step.relationships)

    def needed(self, tables: set[str]) -> list[Step]:
        """The steps that ``tables`` depend on."""
        tables = tables | {p for _, p in self.config.opportunistic}
        out = []
        for step in reversed(self.plan.steps):
            if step.table in tables:
                out.append(step)
                tables = tables | {r.parent if step.kind == "upstream" else r.child for r in step.relationships}
        return out[::-1]

    def rows_of(self, step: Step, values: dict[str, DataFrame]) -> DataFrame | None:
        config, table = self.config, step.table
        if step.kind == "direct":
            targets = [t for t in config.targets if t.table == table]
            return direct.select_target(self.source(table), targets, values, config)
        if step.kind == "upstream":
            source = upstream.apply_filters(self.source(table), table, upstream.filters_for(config.upstream_filters, table, self.catalog.columns(table)))
            deltas = None
            if self.incremental and config.mode is Mode.TOPUP:
                # a parent without new rows can't be the new match of any child
                deltas = [None if self.unchanged(r.parent, inserted_only=True) else self.changed(r.parent, inserted_only=True) for r in step.relationships]
            out = upstream.select_children(source, step.relationships, [self.selected(r.parent) for r in step.relationships], deltas)
            return out.limit(config.max_rows) if config.limit_upstream and config.max_rows is not None else out
        if step.kind == "passthrough":
            return self.source(table) if config.max_rows is None else self.source(table).limit(config.max_rows)
        if step.kind == "disconnected":
            return self.source(table)
        some = []
        for r in step.relationships:
            # incremental runs look at the rows they have written; a child they haven't come to counts whole
            if self.incremental and self.unchanged(r.child, inserted_only=False):
                continue
            rows = self.changed(r.child, inserted_only=False) if self.incremental else None
            rows = self.tables.get(r.child) if rows is None else rows
            if rows is not None:
                some.append((r, rows))
        if not some:
            return None
        missing = downstream.missing_parents([r for r, _ in some], [rows for _, rows in some], self.tables.get(table))
        return downstream.fetch_parents(self.source(table), missing)

    def resolve_opportunistic(self) -> None:
        """Values of broken relationships stay where the parent was selected after all."""
        for r in self.catalog.relationships:
            if r.pair in self.config.opportunistic and r.child in self.tables and r.parent in self.catalog.tables:
                self.tables[r.child] = project.null_dangling(self.tables[r.child], r.child_columns, self.selected(r.parent), r.parent_columns)
                self.rewritten.add(r.child)

    def result(self) -> SubsetResult:
        names = self.catalog.names()
        tables = {n: self.selected(n) for n in names if n in self.tables}
        deltas = {}
        for n, found in self.changes.items():
            identity = [keys.col(c) for c in self.identities[n]]
            some = [(c.rows, c.refreshed != 0) for c in found if not c.empty]
            rows = merge.latest(some, self.identities[n]) if some else self.selected(n).limit(0).withColumn("_inserted", F.lit(True))
            deltas[n] = rows.select(*identity, "_inserted")
        return SubsetResult(self.plan, self.catalog, tables, deltas)


def independent(steps: Iterable[Step]) -> Iterator[list[Step]]:
    """Runs of steps of one kind none of which looks at another's table."""
    group: list[Step] = []
    for step in steps:
        seen = {s.table for s in group}
        looks_at = {r.parent if step.kind == "upstream" else r.child for r in step.relationships} | {step.table}
        if group and (group[0].kind != step.kind or seen & looks_at):
            yield group
            group = []
        group.append(step)
    if group:
        yield group


def select(spark: SparkSession, catalog: Catalog, config: Config, *, existing: dict[str, DataFrame] | None = None, keep: Keep | None = None, only: Iterable[str] | None = None) -> SubsetResult:
    """The subset as DataFrames, nothing published; with ``only``, just what those tables need.

    Without ``keep`` each table is a plan over the source, which is planned anew wherever it's used.
    """
    run = Run(spark, catalog, config, existing=existing, keep=keep)
    run.run(only)
    return run.result()


def apply_hooks(spark: SparkSession, tables: dict[str, DataFrame], statements: Iterable[str]) -> dict[str, DataFrame]:
    """Runs statements over temporary views of the tables, in order.

    ``<table> := SELECT ...`` replaces a table by a query's result; any other statement is run for
    its effect. Views are named as tables, with dots as underscores.
    """
    out = dict(tables)
    for statement in statements:
        for name, df in out.items():
            df.createOrReplaceTempView(name.replace(".", "_"))
        head, assign, query = statement.partition(":=")
        name = head.strip()
        if assign and name in out:
            out[name] = spark.sql(query)
        else:
            spark.sql(statement)
    return out


def open_catalog(spark: SparkSession, config: Config) -> Catalog:
    if config.source.path:
        return parquet.open_folder(spark, config.source.path)
    return jdbc.catalog(spark, jdbc.options(config.backend, config.source))


def run_subset(config: Config | str, spark: SparkSession, *, catalog: Catalog | None = None, no_constraints: bool = False, with_report: bool = True, verbose: bool = False) -> SubsetResult:
    """Computes a subset and publishes it as the destination's next version.

    Each step's rows are written once, as a segment of the table that they belong to; tables without new
    rows are carried over. Hooks and checks run before one manifest makes the version current, so a failed
    run leaves the current version as it was. In topup and grow its journal stays: the same configuration
    takes the run up after the steps that are done, another one is refused.

    If the destination is a database, its tables are the base of incremental runs, and the version of a
    folder that stages the run is loaded into it in one transaction for each table, parents first.
    """
    began = time.time()
    if isinstance(config, str):
        config = load(config)
    catalog = catalog or open_catalog(spark, config)
    database = None if config.destination.path else jdbc.Database(spark, jdbc.options(config.backend, config.destination))
    dest = Destination(spark, config.destination.path or f"{scratch_folder(spark)}/{database.folder}")
    dest.lock()
    log = (lambda line: print(f"-- {line}", flush=True)) if verbose else None
    try:
        journal = None
        if database:
            existing, stored = database.frames() if config.mode is not Mode.RECREATE else {}, {}
        else:
            stored = dest.stored() if config.mode is not Mode.RECREATE else {}
            existing = {n: dest.read(t) for n, t in stored.items()}

        def keep(name: str, df: DataFrame) -> DataFrame:
            if verbose:
                print(f"-- {name}\n{df._jdf.queryExecution().toString()}")
            return dest.write(name, df)

        if config.incremental:
            journal = incremental.Journal(dest)
        run = Run(spark, catalog, config, existing=existing, keep=keep, journal=journal, log=log)
        if journal:
            journal.begin(incremental.config_hash(config, run.identities), run.identities)
        run.run()
        out = run.result()
        every = {n: run.selected(n) for n in run.catalog.names()}  # tables without rows too
        final, tables = finished(run, dest, stored, every)
        hooked = apply_hooks(spark, final, config.pre_constraint_sql)
        replace_tables(dest, hooked, final, tables)

        usable = tuple(r for r in run.catalog.relationships if r.pair not in config.broken and r.child not in config.passthrough)
        replaced = {n for n in final if hooked[n] is not final[n]} | run.rewritten
        touched, moved = None, ()
        if run.incremental:
            touched = {n: rows for n in run.changes if not run.unchanged(n, inserted_only=False) and (rows := run.changed(n, inserted_only=False)) is not None}
            touched |= {n: hooked[n] for n in replaced}
            moved = {n for n, found in run.changes.items() if any(c.refreshed != 0 for c in found)} | replaced
        out.checks = checks.report(spark, run.catalog, hooked, usable, touched, moved)
        if not no_constraints:
            checks.enforce(out.checks)
        last = apply_hooks(spark, hooked, config.post_subset_sql)
        replace_tables(dest, last, hooked, tables)
        late = {n: last[n] for n in last if last[n] is not hooked[n]}
        if late and not no_constraints:
            checks.enforce(checks.report(spark, run.catalog, last, usable, late, set(late)))
        if database and config.mode is not Mode.RECREATE and (replaced or late):
            raise ConfigError(f"{', '.join(sorted(replaced | set(late)))}: hooks can't replace tables of a database that a run adds to")
        out.tables = last
        rows = [r.asDict() for r in out.sequences.collect()] if out.sequences is not None else []
        out.version = dest.publish(tables, sequences=rows, config_hash=incremental.config_hash(config, run.identities))
        if database:
            database.load(run, last, usable)
        if journal:
            journal.end()
        dest.vacuum(keep_versions=1 if database else None)
        out.elapsed = time.time() - began
        if with_report:
            print(report.tabulate(out.report, out.elapsed))
        return out
    finally:
        dest.unlock()


def finished(run: Run, dest: Destination, stored: dict[str, Stored], every: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, Stored]]:
    """The tables of a finished run and the segments that hold them; what no step changed is carried over."""
    frames, out = {}, dict(stored)
    for name, df in every.items():
        old, changed = stored.get(name), [c for c in run.changes.get(name, ()) if not c.empty]
        if name in run.rewritten or (run.incremental and old and old.worn):
            df = dest.write(f"whole:{name}", df)
            segments = [Segment(dest.folders[f"whole:{name}"])]
        elif run.incremental:
            segments = [*(old.segments if old else ()), *(Segment(dest.folders[c.name], c.refreshed) for c in changed)]
        else:
            segments = [*(old.segments if old else ()), *(Segment(dest.folders[n]) for n, _ in run.parts.get(name, ()))]
        frames[name], out[name] = df, Stored(df.schema.json(), segments, list(run.identities.get(name, old.identity if old else ())))
    return frames, out


def replace_tables(dest: Destination, new: dict[str, DataFrame], old: dict[str, DataFrame], tables: dict[str, Stored]) -> None:
    """Writes the tables that hooks have replaced."""
    for name, df in new.items():
        if df is not old[name]:
            new[name] = df = dest.write(f"hook:{name}", df)
            tables[name] = Stored(df.schema.json(), [Segment(dest.folders[f"hook:{name}"])], tables[name].identity)
