"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("vote_queries", "text_queries", "segment_queries", "window_queries", "entity_queries", "rule_queries", "output_queries", "store_queries", "reader_queries")


def _modules():
    for m in MODULES:
        yield importlib.import_module(f"voxloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for m in _modules():
        names = {k: f for k, f in vars(m).items() if callable(f) and getattr(f, "__module__", "") == m.__name__ and k[:2] in PREFIXES}
        out |= names
    return out


PREFIXES = ("n_", "s_", "w_", "j_", "e_", "c_", "r_", "v_", "o_", "m_", "x_", "t_")


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
