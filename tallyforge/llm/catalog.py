"""The queries of this subpackage."""

from __future__ import annotations

from tallyforge.llm import queries as _q


def queries():
    return _q.QUERIES


def oracles():
    return _q.ORACLES
