"""Runs against an independent closure in plain Python, and against the seed-like fixture."""

import random

import pytest

from kinslice import checks, config, engine
from kinslice.catalog import Catalog, Relationship, UniqueKey, from_frames
from kinslice.storage import Destination, Locked

RELS = [
    Relationship("users", ("org",), "orgs", ("id",)),
    Relationship("projects", ("org",), "orgs", ("id",)),
    Relationship("issues", ("project",), "projects", ("id",)),
    Relationship("issues", ("t", "u"), "users", ("t", "u")),
    Relationship("links", ("a",), "issues", ("id",)),
    Relationship("links", ("b",), "issues", ("id",)),
]
COLUMNS = {"orgs": "id long, keep boolean", "users": "t long, u long, org long", "projects": "id long, org long", "issues": "id long, project long, t long, u long", "links": "id long, a long, b long"}
KEYS = {"orgs": ["id"], "users": ["t", "u"], "projects": ["id"], "issues": ["id"], "links": ["id"]}


def data(seed):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.2 else v
    orgs = [(i, rng.random() < 0.5) for i in range(6)]
    users = [(i % 3, i, rng.randrange(6)) for i in range(9)]
    projects = [(i, maybe(rng.randrange(6))) for i in range(8)]
    issues = []
    for i in range(20):
        t, u, _ = rng.choice(users)
        issues.append((i, maybe(rng.randrange(8)), maybe(t), maybe(u)))
    links = [(i, maybe(rng.randrange(20)), maybe(rng.randrange(20))) for i in range(15)]
    return {"orgs": orgs, "users": users, "projects": projects, "issues": issues, "links": links}


def closure(rows):
    names = {t: [c.split()[0] for c in s.split(", ")] for t, s in COLUMNS.items()}
    get = lambda t, row, cols: tuple(row[names[t].index(c)] for c in cols)
    out = {"orgs": {x for x in rows["orgs"] if x[1]}}
    for table in ("users", "projects", "issues", "links"):
        out[table] = set()
        via = [r for r in RELS if r.child == table and r.parent in out]
        for row in rows[table]:
            fits = []
            for r in via:
                key = get(table, row, r.child_columns)
                fits.append(None if None in key else key in {get(r.parent, p, r.parent_columns) for p in out[r.parent]})
            if False not in fits and True in fits:
                out[table].add(row)
    for table in ("issues", "users", "projects", "orgs"):
        for r in (r for r in RELS if r.parent == table):
            need = {get(r.child, c, r.child_columns) for c in out[r.child]}
            out[table] |= {p for p in rows[table] if get(table, p, r.parent_columns) in need}
    return out


def catalog(spark, rows):
    frames = {t: spark.createDataFrame(rows[t], COLUMNS[t]) for t in rows}
    return from_frames(frames, keys={t: [UniqueKey(tuple(k), primary=True)] for t, k in KEYS.items()}, relationships=RELS)


def conf(**more):
    raw = {"db_type": "parquet", "initial_targets": [{"table": "orgs", "where": "keep"}], "source_db_connection_info": {}, "destination_db_connection_info": {}}
    return config.parse(raw | more)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graph(spark, seed):
    rows = data(seed)
    got = engine.select(spark, catalog(spark, rows), conf()).tables
    want = closure(rows)
    for table in COLUMNS:
        assert sorted(map(tuple, got[table].collect()), key=str) == sorted(want[table], key=str), table


def test_published_versions_and_modes(spark, tmp_path):
    rows = data(5)
    rows["orgs"][0] = (0, True)
    where = {"destination_db_connection_info": {"path": str(tmp_path / "out")}}
    first = engine.run_subset(conf(**where), spark, catalog=catalog(spark, rows), with_report=False)
    assert first.version == 1 and first.checks.where("violations > 0").isEmpty()
    want = closure(rows)
    assert {n: df.count() for n, df in Destination(spark, str(tmp_path / "out")).tables().items()} == {n: len(v) for n, v in want.items()}
    kept = next(o for o in rows["orgs"] if o[1])[0]
    more = {t: list(v) for t, v in rows.items()}
    more["projects"].append((100, kept))  # a new child of a resident row
    more["orgs"].append((50, True))
    more["projects"].append((101, 50))  # a child of a new row
    topup = engine.run_subset(conf(destination_mode="topup", **where), spark, catalog=catalog(spark, more), with_report=False)
    have = {r.id for r in topup.tables["projects"].collect()}
    assert 101 in have and 100 not in have
    grow = engine.run_subset(conf(destination_mode="grow", **where), spark, catalog=catalog(spark, more), with_report=False)
    assert {100, 101} <= {r.id for r in grow.tables["projects"].collect()}
    again = engine.run_subset(conf(destination_mode="grow", **where), spark, catalog=catalog(spark, more), with_report=False)
    assert all(d.isEmpty() for d in again.deltas.values())


def test_lock_and_failed_check(spark, tmp_path):
    dest = Destination(spark, str(tmp_path / "out"))
    where = {"destination_db_connection_info": {"path": str(tmp_path / "out")}}
    dest.lock()
    with pytest.raises(Locked):
        engine.run_subset(conf(**where), spark, catalog=catalog(spark, data(1)), with_report=False)
    dest.unlock()
    broken = data(1)
    broken["orgs"] += broken["orgs"]
    with pytest.raises(checks.IntegrityError):
        engine.run_subset(conf(**where), spark, catalog=catalog(spark, broken), with_report=False)
    assert dest.version == 0


def test_breaks_passthrough_and_disconnected(spark):
    rows = data(2)
    cat = catalog(spark, rows)
    extra = spark.createDataFrame([("x",)], "flag string")
    cat = Catalog(cat.tables | from_frames({"flags": extra}).tables, cat.relationships)
    got = engine.select(spark, cat, conf(keep_disconnected_tables=True, passthrough_tables=["links"], dependency_breaks=[{"fk_table": "users", "target_table": "orgs"}])).tables
    assert got["flags"].count() == 1 and got["links"].count() == len(rows["links"])
    assert got["users"].where("org IS NOT NULL").isEmpty()
