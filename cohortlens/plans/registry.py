"""All registered queries and their DuckDB oracles, gathered from the plans."""

from __future__ import annotations

import importlib

PLAN_MODULES = ["noshow", "sales", "scoring", "readmission", "intake"]


def _modules():
    return [importlib.import_module(f"cohortlens.plans.{m}") for m in PLAN_MODULES]


def queries():
    out = {}
    for m in _modules():
        for k, v in m.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query key {k}")
            out[k] = v
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
