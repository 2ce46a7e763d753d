"""Every query of the conflict engine by name, with its SQL twin."""

from __future__ import annotations

from .plans import code, files, hunks, payloads, pipeline, resolutions, runs, tables, versions
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "files", "hunks", "payloads", "pipeline", "resolutions", "runs", "tables", "versions"]
