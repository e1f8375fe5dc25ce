"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

NAMES = ("events", "text", "corpus", "pages", "records", "details", "scripts")


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"vellumspark.plans.{name}")
