"""All DuckDB twins."""

from importlib import import_module

_MODULES = ("telemetry", "scoring", "signals", "clusters", "files")


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(import_module(f"oracles.{m}").ORACLES)
    return out
