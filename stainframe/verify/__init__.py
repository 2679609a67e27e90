"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from stainframe.verify import registry

SECTIONS = ("scoring_queries", "cohort_queries", "tiling_queries", "pixel_queries", "instance_queries", "grid_queries", "source_queries")


def _load() -> None:
    for name in SECTIONS:
        importlib.import_module(f"stainframe.verify.{name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return dict(registry.ORACLE)
