"""Registered queries: the operators bound to the star-schema test tables, with SQL oracles."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("ownership", "graphs", "rules", "text", "sources", "prep", "streams")


def all_catalogs():
    return [import_module(f"catalog.{name}").C for name in _FAMILIES]
