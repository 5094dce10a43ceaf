"""Identities, preflight checks and the journal of topup and grow runs."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterable
from dataclasses import asdict

from .catalog import Catalog, Table
from .config import Config, ConfigError
from .storage import Destination


def identity(table: Table, configured: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The columns that name a table's rows across runs.

    The primary key, which can't be overridden; else the configured unique key; else the only
    eligible one.
    """
    eligible = {k.columns: k for k in table.keys if k.eligible}
    if table.primary:
        if configured and tuple(configured) != table.primary:
            raise ConfigError(f"{table.name}: the primary key can't be overridden")
        if table.primary not in eligible:
            raise ConfigError(f"{table.name}: the primary key is deferrable or not valid")
        found = table.primary
    elif configured:
        found = next((c for c in eligible if set(c) == set(configured)), None)
        if found is None:
            raise ConfigError(f"{table.name}: no eligible unique key on {', '.join(configured)}")
    elif len(eligible) == 1:
        (found,) = eligible
    elif eligible:
        raise ConfigError(f"{table.name}: several unique keys; name one in incremental_keys")
    else:
        raise ConfigError(f"{table.name}: no usable unique key; it can't be updated")
    for key in table.keys:
        if set(key.columns) == set(found) and not key.immediate:
            raise ConfigError(f"{table.name}: a deferrable unique key covers the identity")
    always = sorted(table.always_identity - set(found))
    if always:
        raise ConfigError(f"{table.name}: {', '.join(always)} is always generated and can't be refreshed")
    return found


def preflight(table: Table) -> None:
    """Rejects what a set-based merge can't keep in order."""
    for bad, what in ((table.inherited, "is inherited"), (table.partitioned, "is partitioned"), (table.temporal, "has temporal constraints"), (table.write_triggers, "has write triggers")):
        if bad:
            raise ConfigError(f"{table.name} {what}; topup and grow don't support that")


def identities(catalog: Catalog, config: Config, tables: Iterable[str]) -> dict[str, tuple[str, ...]]:
    chosen = dict(config.identities)
    out = {}
    for name in tables:
        preflight(catalog.tables[name])
        out[name] = identity(catalog.tables[name], chosen.get(name))
    return out


def config_hash(config: Config, names: dict[str, tuple[str, ...]]) -> str:
    """Equal for configurations that differ in passwords or in the order of unordered lists only."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in sorted(value.items()) if k != "password"}
        if isinstance(value, list | tuple):
            items = [plain(v) for v in value]
            return items if all(isinstance(v, str) for v in items) else sorted(items, key=lambda v: json.dumps(v, sort_keys=True))
        return value

    raw = plain(asdict(config))
    for key in ("excluded", "passthrough"):
        raw[key] = sorted(raw[key])
    body = json.dumps([raw, {k: list(v) for k, v in sorted(names.items())}], sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()


class Journal:
    """What a run that is under way has done, so that it can be taken up again by the same configuration.

    Each entry is a small file that is written whole: first the run's configuration, identities and base
    version, then one for each step with the segment of its changes. A run that is taken up reads those
    segments instead of selecting again.
    """

    def __init__(self, destination: Destination):
        self.destination = destination
        self.entries = 0
        #: Finished steps of the run that was taken up, by step.
        self.finished: dict[str, dict] = {}
        self._writing = threading.Lock()

    def _add(self, entry: dict) -> None:
        with self._writing:
            self.destination.create_text(json.dumps(entry), "_journal", f"{self.entries:06d}.json")
            self.entries += 1

    def begin(self, digest: str, names: dict[str, tuple[str, ...]]) -> bool:
        """True if a failed run of the same configuration is taken up again."""
        dest = self.destination
        files = sorted(n for n in dest._names("_journal") if n.endswith(".json") and not n.startswith("."))
        old = [json.loads(dest.read_text("_journal", n)) for n in files]
        state = {"config_hash": digest, "identities": {k: list(v) for k, v in names.items()}, "base": dest.version}
        if old:
            if old[0]["base"] != state["base"]:
                self.end()  # that run did publish
            elif old[0]["config_hash"] != digest:
                raise ConfigError("an unfinished run has another configuration; finish that or remove _journal")
            elif old[0]["identities"] != state["identities"]:
                raise ConfigError("an unfinished run has other identities")
            else:
                self.entries = len(files)
                self.finished = {e["step"]: e for e in old[1:]}
                return True
        self._add(state)
        return False

    def done(self, step: str, path: str, columns: list[str], inserted: int, refreshed: int) -> None:
        self._add({"step": step, "path": path, "columns": columns, "inserted": inserted, "refreshed": refreshed})

    def end(self) -> None:
        self.destination.remove("_journal")
        self.entries, self.finished = 0, {}
