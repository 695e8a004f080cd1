"""All registered queries; importing the package fills the registry."""

import importlib

from dqflow.catalog.base import ORACLES, QUERIES

MODULES = ["validators", "quality", "tables", "joins", "anomalies", "operations", "monitors", "storage", "feeds", "layout"]

for _m in MODULES:
    importlib.import_module(f"dqflow.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
