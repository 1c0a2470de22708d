"""tidemark: a PySpark-native engine for market analytics."""

from __future__ import annotations

from importlib import import_module

#: What the package exports and where it is. Modules are loaded when asked for, so Python workers load only what they run.
_WHERE = {
    "Config": "config", "DEFAULT": "config", "get_spark": "session", "PrecedentStore": "operators.serving",
    "QUERIES": "plans.registry", "ORACLES": "plans.registry", "FLAGSHIP": "plans.registry",
}
__all__ = ["Config", "DEFAULT", "FLAGSHIP", "ORACLES", "PrecedentStore", "QUERIES", "get_spark"]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
