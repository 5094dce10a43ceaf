"""Published runs: hooks, failures, resumption, databases, streams."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from kinslice import checks, cli, config, engine, incremental, storage
from kinslice.catalog import Relationship, Table, UniqueKey, from_frames
from kinslice.operators import keys, merge, upstream
from kinslice.sources import jdbc, parquet
from kinslice.storage import Destination
from kinslice.streaming.grow import grow_on
from test_subset import catalog, closure, conf, data


def where(path):
    return {"destination_db_connection_info": {"path": str(path)}}


def run(spark, path, rows, **more):
    return engine.run_subset(conf(**where(path), **more), spark, catalog=catalog(spark, rows), with_report=False)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hooks_take_effect_in_order(spark, tmp_path):
    rows = data(5)
    rows["orgs"][0] = (0, True)
    out = run(spark, tmp_path, rows, pre_constraint_sql=["orgs := SELECT id, false AS keep FROM orgs"], post_subset_sql=["orgs := SELECT id, NOT keep AS keep FROM orgs WHERE id >= 0"])
    stored = Destination(spark, str(tmp_path)).tables()
    assert {r.keep for r in stored["orgs"].collect()} == {True} and rows_of(stored["orgs"]) == rows_of(out.tables["orgs"])
    # what a hook breaks isn't published
    with pytest.raises(checks.IntegrityError):
        run(spark, tmp_path, rows, post_subset_sql=["orgs := SELECT * FROM orgs WHERE false"])
    assert Destination(spark, str(tmp_path)).version == 1


@pytest.mark.parametrize("where_it_fails", ["write", "publish", "checks"])
def test_failed_runs_leave_the_version(spark, tmp_path, monkeypatch, where_it_fails):
    rows = data(5)
    rows["orgs"][0] = (0, True)
    run(spark, tmp_path, rows)
    before = {n: rows_of(df) for n, df in Destination(spark, str(tmp_path)).tables().items()}
    more = {t: list(v) for t, v in rows.items()}
    more["orgs"].append((50, True))
    more["projects"].append((101, 50))

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if where_it_fails == "write":
            plain, calls = Destination.write, []

            def write(self, name, df):
                calls.append(name)
                return fail() if len(calls) > 2 else plain(self, name, df)

            m.setattr(Destination, "write", write)
        elif where_it_fails == "publish":
            m.setattr(Destination, "publish", fail)
        else:
            m.setattr(checks, "enforce", fail)
        with pytest.raises(RuntimeError):
            run(spark, tmp_path, more, destination_mode="topup")
    dest = Destination(spark, str(tmp_path))
    assert dest.version == 1 and {n: rows_of(df) for n, df in dest.tables().items()} == before
    # another configuration is refused, the same one goes on with what was done
    with pytest.raises(config.ConfigError):
        run(spark, tmp_path, more, destination_mode="grow")
    names = []
    with monkeypatch.context() as m:
        plain = Destination.write
        m.setattr(Destination, "write", lambda self, name, df: names.append(name) or plain(self, name, df))
        out = run(spark, tmp_path, more, destination_mode="topup")
    assert "direct:orgs" not in names
    assert out.version == 2 and 101 in {r.id for r in out.tables["projects"].collect()}
    assert [r.id for r in out.deltas["orgs"].where("_inserted").collect()] == [50]
    assert not Destination(spark, str(tmp_path))._names("_journal")


def test_unchanged_tables_are_carried_over(spark, tmp_path):
    rows = data(5)
    rows["orgs"][0] = (0, True)
    run(spark, tmp_path, rows)
    dest = Destination(spark, str(tmp_path))
    first = dest.stored()
    more = {t: list(v) for t, v in rows.items()}
    more["orgs"].append((50, True))
    run(spark, tmp_path, more, destination_mode="topup")
    second = dest.stored()
    assert [s.path for s in second["links"].segments] == [s.path for s in first["links"].segments]
    assert len(second["orgs"].segments) == len(first["orgs"].segments) + 1
    # a refresh hides the earlier row, and old versions stay readable
    more["orgs"] = [(i, None if i == 50 else k) for i, k in more["orgs"]]
    out = engine.run_subset(conf(**where(tmp_path), destination_mode="grow", initial_targets=[{"table": "orgs", "where": "keep OR id = 50"}]), spark, catalog=catalog(spark, more), with_report=False)
    assert [(r.id, r._inserted) for r in out.deltas["orgs"].collect()] == [(50, False)]
    assert {r.id: r.keep for r in dest.tables()["orgs"].collect()}[50] is None
    assert {r.id: r.keep for r in dest.tables(2)["orgs"].collect()}[50] is True
    assert dest.versions() == [1, 2, 3]
    dest.truncate("projects")
    assert dest.tables()["projects"].isEmpty() and not dest.tables(3)["projects"].isEmpty()
    dest.vacuum(keep_versions=1)
    assert dest.versions() == [4] and len(dest.tables()["orgs"].collect()) > 0
    dest.teardown()
    assert dest.versions() == []


def test_plain_topup_adds_to_what_is_there(spark, tmp_path):
    rows = data(5)
    rows["orgs"][:2] = [(0, True), (1, False)]
    run(spark, tmp_path, rows)
    there = {r.id for r in Destination(spark, str(tmp_path)).tables()["orgs"].collect()}
    other = next(i for i, _ in rows["orgs"] if i not in there)
    breaks = [{"fk_table": t, "target_table": "orgs"} for t in ("users", "projects")]
    run(spark, tmp_path, rows, db_type="mysql", destination_mode="topup", initial_targets=[{"table": "orgs", "where": f"id = {other}"}], dependency_breaks=breaks)
    assert {r.id for r in Destination(spark, str(tmp_path)).tables()["orgs"].collect()} == there | {other}


def test_many_segments_are_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "MANY", 2)
    rows = data(5)
    rows["orgs"][0] = (0, True)
    run(spark, tmp_path, rows)
    for k in range(3):
        rows["orgs"].append((60 + k, True))
        run(spark, tmp_path, rows, destination_mode="topup")
    dest = Destination(spark, str(tmp_path))
    assert len(dest.stored()["orgs"].segments) <= 2
    assert {60, 61, 62} <= {r.id for r in dest.tables()["orgs"].collect()}


def test_workers_select_the_same(spark):
    rows = data(3)
    got = engine.select(spark, catalog(spark, rows), conf(parallel_read_workers=4), keep=storage.written(spark)).tables
    want = closure(rows)
    assert {t: rows_of(got[t]) for t in want} == {t: sorted(v, key=str) for t, v in want.items()}


def test_preflight_and_identities(spark, tmp_path):
    rows = data(1)
    cat = catalog(spark, rows)
    for bad in ("inherited", "partitioned", "temporal", "write_triggers"):
        table = cat.tables["orgs"]
        cat.tables["orgs"] = Table("orgs", table.read, table.keys, **{bad: True})
        with pytest.raises(config.ConfigError):
            engine.Run(spark, cat, conf(destination_mode="topup"))
        cat.tables["orgs"] = table
    always = Table("orgs", cat.tables["orgs"].read, cat.tables["orgs"].keys, always_identity=frozenset(["keep"]))
    with pytest.raises(config.ConfigError):
        incremental.identity(always)


def test_merge_of_null_identities_and_phases(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(None, "x"), (3, "c"), (4, None), (4, "z")], "id long, v string")
    got = {(r.id, r.v): r._action for r in merge.changes(old, new, ["id"]).collect()}
    assert got == {(None, "x"): "refresh", (4, "z"): "insert"}
    phases = [spark.createDataFrame([(1, "a", "insert"), (2, "b", "refresh")], "id long, v string, _action string"), spark.createDataFrame([(1, "c", "refresh"), (5, "d", "insert")], "id long, v string, _action string")]
    last = {(r.id, r.v): r._inserted for r in merge.latest([(p, True) for p in phases], ["id"]).collect()}
    assert last == {(1, "c"): True, (2, "b"): False, (5, "d"): True}


def test_conditions_and_odd_names(spark):
    from kinslice.catalog import TableRef

    ref = TableRef("app", "users")
    assert upstream.unqualified("app.users.id = 'app.users.id' AND `app.users.x` = app . users . y", ref) == "users.id = 'app.users.id' AND `app.users.x` = users.y"
    df = spark.createDataFrame([(1, "a"), (2, None)], "`we``ird.x` long, v string")
    have = spark.createDataFrame([("1",), ("no",)], "k string").select(keys.col("k").alias("_k0"))
    assert keys.semi(df, ["we`ird.x"], have).count() == 1 and keys.absent(df, ["we`ird.x"], have).count() == 1
    assert merge.dedup(df, ["we`ird.x"]).count() == 2


@pytest.fixture
def derby(spark):
    def make(*ddl):
        opts = {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        with jdbc.connected(spark, opts) as con:
            for line in ddl:
                made = con.createStatement()
                made.executeUpdate(line)
                made.close()
        return opts

    return make


TABLES = (
    'CREATE TABLE "ORGS" ("ID" BIGINT PRIMARY KEY, "NAME" VARCHAR(20))',
    'CREATE TABLE "USERS" ("ID" BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, "ORG" BIGINT REFERENCES "ORGS", "A" INT NOT NULL, "B" INT, "TWICE" INT GENERATED ALWAYS AS ("A" * 2), CONSTRAINT "AB" UNIQUE ("A"))',
    'CREATE TABLE "PAIRS" ("P" INT NOT NULL, "Q" INT NOT NULL, "U" BIGINT REFERENCES "USERS", PRIMARY KEY ("Q", "P"))',
    'CREATE TABLE "REFS" ("X" INT, "Y" INT, FOREIGN KEY ("X", "Y") REFERENCES "PAIRS" ("Q", "P"))',
)
ROWS = (
    "INSERT INTO ORGS VALUES (1, 'one'), (2, 'two'), (3, 'three')",
    "INSERT INTO USERS (ID, ORG, A, B) VALUES (1, 1, 10, 1), (2, 2, 11, NULL), (3, 1, 12, 5), (900, NULL, 13, 5)",
    "INSERT INTO PAIRS VALUES (1, 2, 1), (1, 3, 2), (2, 3, 3)",
    "INSERT INTO REFS VALUES (2, 1), (3, 1), (NULL, 1)",
)


def test_jdbc_catalog(spark, derby, monkeypatch):
    cat = jdbc.catalog(spark, derby(*TABLES, *ROWS, "CREATE VIEW V AS SELECT * FROM ORGS"))
    assert set(cat.names()) == {"APP.ORGS", "APP.USERS", "APP.PAIRS", "APP.REFS"} and cat.kinds()["APP.V"] == "v" and cat.schemas() == ["APP"]
    users = cat.tables["APP.USERS"]
    assert users.primary == ("ID",) and [k.columns for k in users.keys] == [("ID",), ("A",)] and users.keys[1].not_null
    assert users.native.columns["ID"].auto and users.generated == {"TWICE"} and users.sequences == ("ID",) and set(users.not_null) == {"ID", "A"}
    assert cat.tables["APP.PAIRS"].primary == ("Q", "P")
    assert Relationship("APP.REFS", ("X", "Y"), "APP.PAIRS", ("Q", "P")) in cat.relationships and len(cat.relationships) == 3
    assert ("TWICE", "int", True, False) in cat.datatypes("APP.USERS")
    monkeypatch.setattr(jdbc, "RANGE_ROWS", 1)
    ranged = jdbc.catalog(spark, derby(*TABLES, *ROWS)).frame("APP.USERS")
    assert ranged.rdd.getNumPartitions() == 4 and ranged.count() == 4


def test_jdbc_to_jdbc(spark, derby, tmp_path):
    source, target = derby(*TABLES, *ROWS), derby(*TABLES)
    raw = {"db_type": "jdbc", "initial_targets": [{"table": "APP.ORGS", "where": "ID = 1"}], "source_db_connection_info": source, "destination_db_connection_info": target}
    out = engine.run_subset(config.parse(raw), spark, with_report=False)
    there = lambda t: rows_of(jdbc.catalog(spark, target).frame(t))
    assert out.sequences is not None
    assert [r[0] for r in there("APP.USERS")] == [1, 3] and there("APP.ORGS") == [(1, "one")] and len(there("APP.PAIRS")) == 2 and there("APP.REFS") == [(2, 1)]
    # new and changed rows at the source
    with jdbc.connected(spark, source) as con:
        for line in ("UPDATE ORGS SET NAME = 'uno' WHERE ID = 1", "INSERT INTO ORGS VALUES (4, 'four')", "INSERT INTO USERS (ID, ORG, A) VALUES (901, 4, 20)"):
            made = con.createStatement()
            made.executeUpdate(line)
            made.close()
    raw |= {"initial_targets": [{"table": "APP.ORGS", "where": "ID IN (1, 4)"}], "destination_mode": "topup", "excluded_tables": ["APP.REFS"]}
    engine.run_subset(config.parse(raw), spark, with_report=False)
    assert there("APP.ORGS") == [(1, "uno"), (4, "four")] and [r[0] for r in there("APP.USERS")] == [1, 3, 901] and there("APP.REFS") == [(2, 1)]
    engine.run_subset(config.parse(raw | {"destination_mode": "recreate", "excluded_tables": []}), spark, with_report=False)
    assert [r[0] for r in there("APP.USERS")] == [1, 3, 901]
    names = {f.name for f in _facts(spark, target).values()}
    assert not any(n.startswith("KINSLICE") for n in names)
    db = jdbc.Database(spark, target)
    db.truncate("APP.REFS")
    assert there("APP.REFS") == []


def test_jdbc_creates_and_drops(spark, derby):
    source, target = derby(*TABLES, *ROWS), derby()
    raw = {"db_type": "jdbc", "initial_targets": [{"table": "APP.ORGS", "where": "ID < 3"}], "source_db_connection_info": source, "destination_db_connection_info": target}
    out = engine.run_subset(config.parse(raw), spark, with_report=False)
    db = jdbc.Database(spark, target)
    assert rows_of(db.catalog.frame("APP.USERS")) == rows_of(out.tables["APP.USERS"]) and "TWICE" not in db.catalog.columns("APP.USERS")
    assert db.catalog.tables["APP.PAIRS"].primary == ("Q", "P") and len(db.catalog.relationships) == 3
    assert [k.columns for k in db.catalog.tables["APP.USERS"].keys] == [("ID",), ("A",)]
    assert _facts(spark, target)["APP.ORGS"].columns["NAME"].definition == "VARCHAR(20)"
    db.teardown()
    assert db.catalog.names() == []
    # from Parquet, whose types are Spark's
    frames = {"items": spark.createDataFrame([(1, "a", 0.5)], "id long, name string, x double")}
    own = from_frames(frames, keys={"items": [UniqueKey(("id",), primary=True)]})
    engine.run_subset(config.parse(raw | {"db_type": "jdbc", "initial_targets": [{"table": "items", "where": "true"}]}), spark, catalog=own, with_report=False)
    assert any(n.endswith("items") for n in _facts(spark, target))


def _facts(spark, opts):
    with jdbc.connected(spark, opts) as con:
        return jdbc.facts(con)


def test_jdbc_options(monkeypatch):
    c = config.Connection(user_name="u", host="h", db_name="d", port=1, ssl_mode="require", password="p")
    assert jdbc.options(config.Backend.POSTGRES, c)["url"] == "jdbc:postgresql://h:1/d?sslmode=require"
    assert jdbc.options(config.Backend.MYSQL, c)["url"] == "jdbc:mysql://h:1/d?sslMode=require"
    monkeypatch.setattr(jdbc.getpass, "getpass", lambda _: "asked")
    assert jdbc.options(config.Backend.POSTGRES, config.Connection(user_name="u"))["password"] == "asked"
    with pytest.raises(config.ConfigError):
        jdbc.options(config.Backend.PARQUET, config.Connection())
    cat = jdbc.renamed(from_frames({"a.x": None, "a.y": None}, relationships=[Relationship("a.x", ("p",), "a.y", ("q",))]), "b")
    assert set(cat.tables) == {"b.x", "b.y"} and cat.relationships[0].parent == "b.y"


def test_folder_catalog(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(7).write.parquet(str(tmp_path / "two"))
    cat = parquet.open_folder(spark, str(tmp_path))
    assert set(cat.names()) == {"one", "two"} and cat.frame("two").count() == 7
    (tmp_path / "catalog.json").write_text(json.dumps({"tables": {"first": {"file": "one.parquet", "primary": ["id"], "kind": "r"}}}))
    cat = parquet.open_folder(spark, str(tmp_path))
    assert set(cat.names()) == {"first", "two"} and cat.tables["first"].primary == ("id",)
    assert parquet.size_bytes(spark, str(tmp_path / "two")) > 0


def test_stream_grows(spark, tmp_path):
    rows = data(5)
    rows["orgs"][0] = (0, True)
    run(spark, tmp_path / "out", rows)
    rows["orgs"].append((70, True))
    spark.createDataFrame([(70, True)], "id long, keep boolean").write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema("id long, keep boolean").parquet(str(tmp_path / "new"))
    query = grow_on(stream, conf(**where(tmp_path / "out")), lambda: catalog(spark, rows), checkpoint=str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    dest = Destination(spark, str(tmp_path / "out"))
    assert dest.version == 2 and 70 in {r.id for r in dest.tables()["orgs"].collect()}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["--config", str(tmp_path / "none.json")]) == 1
    assert cli.main(["--example-config"]) == 0 and config.parse(json.loads(capsys.readouterr().out))
    assert cli.main(["--help-config"]) == 0 and "incremental_keys" in capsys.readouterr().out
    source = tmp_path / "src"
    spark.range(9).withColumn("g", F.col("id") % 3).write.parquet(str(source / "items.parquet"))
    raw = {"db_type": "parquet", "initial_targets": [{"table": "items", "where": "g = 1"}], "source_db_connection_info": {"path": str(source)}, "destination_db_connection_info": {"path": str(tmp_path / "out")}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main(["--config", str(tmp_path / "c.json")]) == 1
    monkeypatch.setattr(type(spark.builder), "getOrCreate", lambda self: spark)
    assert cli.main(["--config", str(tmp_path / "c.json"), "-y", "-v"]) == 0
    assert "direct items" in capsys.readouterr().out
    assert Destination(spark, str(tmp_path / "out")).tables()["items"].count() == 3


def test_pre_filters_of_several_targets(spark):
    """Each target has its own; their types needn't be the column's."""
    from kinslice.operators import direct

    df = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, g long")
    spark.createDataFrame([("1",), ("4",), (None,), ("x",)], "k string").createOrReplaceTempView("pre_a")
    spark.createDataFrame([(5,)], "k int").createOrReplaceTempView("pre_b")
    c = conf(pre_filters=[{"name": n, "query": f"SELECT k FROM pre_{n}", "column": "id"} for n in "ab"], initial_targets=[{"table": "t", "where": "g = 1", "pre_filter": "a"}, {"table": "t", "where": "true", "pre_filter": "b"}, {"table": "t", "where": "id = 9"}])
    values = direct.load_pre_filters(spark, c)
    assert sorted(r.id for r in direct.select_target(df, list(c.targets), values, c).collect()) == [1, 4, 5, 9]
    assert sorted(r.id for r in direct.select_target(df, [c.targets[0]], values, c).collect()) == [1, 4]


def test_unique_keys_of_a_catalog():
    assert not UniqueKey(("a",), exclusion=True).eligible and not UniqueKey(("a",), predicate="x").eligible


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    here = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.scratch_folder(here)
    here.sparkContext.master = "local[4]"
    assert storage.scratch_folder(here)
