import json

import pytest

from kinslice import config, graph, incremental
from kinslice.catalog import Relationship, Table, TableRef, UniqueKey
from kinslice.cli import main

BASE = {"db_type": "postgres", "initial_targets": [{"table": "t", "where": "true"}], "source_db_connection_info": {}, "destination_db_connection_info": {}}


def r(child, parent):
    return Relationship(child, ("p",), parent, ("id",))


def test_defaults_and_modes():
    c = config.parse(BASE)
    assert c.mode is config.Mode.RECREATE and not c.incremental
    assert config.parse(BASE | {"skip_schema_setup": True}).mode is config.Mode.TOPUP
    assert config.parse(BASE | {"destination_mode": "grow"}).incremental
    assert not config.parse(BASE | {"db_type": "mysql", "destination_mode": "topup"}).incremental


@pytest.mark.parametrize(
    "more",
    [
        {"initial_targets": [{"table": "t"}]},
        {"initial_targets": [{"table": "t", "where": "a", "percent": 1}]},
        {"initial_targets": [{"table": "t", "where": "a", "pre_filter": "none"}]},
        {"upstream_filters": [{"condition": "x"}]},
        {"upstream_filters": [{"condition": "x", "table": "t", "column": "c"}]},
        {"parallel_read_workers": 0},
        {"db_type": "mysql", "destination_mode": "grow"},
        {"db_type": "mysql", "incremental_keys": [{"table": "t", "columns": ["a"]}]},
        {"db_type": "oracle"},
        {"destination_mode": "other"},
        {"incremental_keys": [{"table": "t", "columns": ["a"]}, {"table": "t", "columns": ["b"]}]},
        {"incremental_keys": [{"table": "t", "columns": ["a", "a"]}]},
        {"fk_augmentation": [{"fk_table": "a", "fk_columns": ["x"], "target_table": "b", "target_columns": []}]},
        {"fk_augmentation": [{"fk_table": "a", "fk_columns": ["x", "y"], "target_table": "b", "target_columns": ["z"]}]},
        {"pre_filters": [{"name": "", "query": "q", "column": "c"}]},
    ],
)
def test_rejected(more):
    with pytest.raises(config.ConfigError):
        config.parse(BASE | more)


def test_missing_key_and_environment(monkeypatch):
    with pytest.raises(config.ConfigError):
        config.parse({k: v for k, v in BASE.items() if k != "db_type"})
    monkeypatch.setenv("HIDDEN", "secret")
    c = config.parse(BASE | {"source_db_connection_info": {"password": "${HIDDEN}"}})
    assert c.source.password == "secret"
    with pytest.raises(config.ConfigError):
        config.parse(BASE | {"source_db_connection_info": {"password": "${NOT_SET_ANYWHERE}"}})


def test_legacy_schema_form_and_passthrough_order():
    c = config.parse(BASE | {"passthrough_tables": ["b", "a", "b"], "fk_augmentation": [{"fk_schema": "s", "fk_table": "a", "fk_columns": ["x"], "target_schema": "t", "target_table": "b", "target_columns": ["y"]}]})
    assert c.passthrough == ("b", "a")
    assert (c.logical_keys[0].child, c.logical_keys[0].parent) == ("s.a", "t.b")


def test_table_ref():
    assert TableRef.parse("a.b.c") == TableRef("a", "b.c")
    assert str(TableRef.parse("b")) == "b"


def test_strata():
    rels = [r("orders", "users"), r("events", "users"), r("users", "tenants")]
    assert graph.strata(rels, {"orders", "users", "tenants", "events"}) == [{"tenants"}, {"users"}, {"orders", "events"}]
    order = graph.strata(rels, {"orders", "users", "tenants", "events"})
    assert graph.upstream(order, ["users"]) == [{"orders", "events"}]
    assert graph.downstream(order, {"orders", "events"}) == [{"users"}, {"tenants"}]


def test_cycles():
    with pytest.raises(graph.CircularDependency):
        graph.strata([r("a", "b"), r("b", "a")], {"a", "b"})
    with pytest.raises(ValueError):
        graph.strata([r("a", "a")], {"a"})
    assert graph.strata(graph.unbroken([r("a", "b"), r("b", "a")], {("b", "a")}), {"a", "b"}) == [{"b"}, {"a"}]


def test_disconnected_counts_broken_edges():
    assert graph.disconnected(["a", "b", "c", "d"], [r("a", "b"), r("c", "d")], ["a"]) == ["c", "d"]


def test_identity_rules():
    table = lambda *k, **m: Table("t", lambda: None, k, **m)
    pk = UniqueKey(("id",), primary=True)
    assert incremental.identity(table(pk)) == ("id",)
    assert incremental.identity(table(UniqueKey(("a",)), UniqueKey(("b",), not_null=False))) == ("a",)
    for bad, chosen in ((table(pk), ("x",)), (table(UniqueKey(("a",), not_null=False)), None), (table(pk, always_identity=frozenset(["n"])), None)):
        with pytest.raises(config.ConfigError):
            incremental.identity(bad, chosen)
    for fact in ("inherited", "partitioned", "temporal", "write_triggers"):
        with pytest.raises(config.ConfigError):
            incremental.preflight(table(pk, **{fact: True}))


def test_cli_help(capsys):
    assert main(["--help-config"]) == 0
    assert "initial_targets" in capsys.readouterr().out
    assert main(["--example-config"]) == 0
    config.parse(json.loads(capsys.readouterr().out))
    assert main(["--config", "/nowhere.json"]) == 1
