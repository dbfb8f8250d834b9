"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tables", "summaries", "preparation", "statistics", "models"]


def load() -> None:
    for name in MODULES:
        import_module(f"proofs.catalog.{name}")
