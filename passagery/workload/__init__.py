"""Registered queries, grouped by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text", "retrieval", "fusion", "catalog", "chat", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"passagery.workload.{area}")
