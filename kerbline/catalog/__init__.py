"""Named queries: bindings from the given tables plus an operator each."""

from __future__ import annotations

import importlib

MODULES = ["demand", "supply", "versions", "realtime", "service", "observatory", "spatial", "city", "lake"]


def _load():
    from kerbline.catalog import registry

    for m in MODULES:
        importlib.import_module(f"kerbline.catalog.{m}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
