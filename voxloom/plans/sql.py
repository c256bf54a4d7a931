"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from voxloom.functions.text import WS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


def clean(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), '')"


def ONCE(name: str, columns: str) -> str:  # noqa: N802
    """A table with every delivered row once."""
    return f"(SELECT DISTINCT {columns} FROM {name})"
