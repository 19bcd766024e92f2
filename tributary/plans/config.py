"""Run configuration: typed keys, resolved by scope with provenance."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Key:
    name: str
    kind: type
    default: object
    minimum: float | None = None

    def parse(self, value: object) -> object:
        if self.kind is bool and isinstance(value, str):
            if value.lower() not in ("true", "false"):
                raise ValueError(f"{self.name}: {value!r} is neither true nor false")
            value = value.lower() == "true"
        out = self.kind(value)
        if self.minimum is not None and out < self.minimum:
            raise ValueError(f"{self.name} is at least {self.minimum}")
        return out


KEYS = {
    k.name: k
    for k in (
        Key("max_lineage_depth", int, 100, 1),
        Key("max_iterations", int, 30, 1),
        Key("csv_chunk_size", int, 1000, 1),
        Key("ingest_max_batch", int, 1000, 1),
        Key("allow_incomplete_archive", bool, False),
    )
}
#: From strongest to weakest.
SCOPES = ("cli", "env", "file", "flow", "default")


def resolve(cli: Mapping | None = None, file: Mapping | None = None, flow: Mapping | None = None, env: Mapping | None = None) -> dict[str, tuple[object, str]]:
    """Each key's value and the scope it came from. Unknown keys are refused."""
    env = os.environ if env is None else env
    from_env = {n: env[f"TRIBUTARY_{n.upper()}"] for n in KEYS if f"TRIBUTARY_{n.upper()}" in env}
    given = dict(zip(SCOPES, (cli or {}, from_env, file or {}, flow or {}, {n: k.default for n, k in KEYS.items()}), strict=True))
    for scope, values in given.items():
        unknown = set(values) - set(KEYS)
        if unknown:
            raise ValueError(f"{scope}: unknown keys {sorted(unknown)}")
    out = {}
    for name, key in KEYS.items():
        scope = next(s for s in SCOPES if name in given[s])
        out[name] = (key.parse(given[scope][name]), scope)
    return out
