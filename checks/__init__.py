"""Queries over the given tables with their SQL counterparts."""

from __future__ import annotations


def _load() -> None:
    from checks import changes, flows, selection  # noqa: F401


def all_queries() -> dict:
    _load()
    from checks.registry import QUERIES

    return dict(QUERIES)


def all_statements() -> dict[str, str]:
    _load()
    from checks.registry import STATEMENTS

    return dict(STATEMENTS)
