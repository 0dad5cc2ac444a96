"""Collects the queries of the library and their DuckDB twins."""

from __future__ import annotations

from . import q_audit, q_dataset, q_decode, q_io, q_score, q_sharing, q_text


def _modules():
    return (q_text, q_audit, q_score, q_dataset, q_sharing, q_decode, q_io)


def queries() -> dict:
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in _modules():
        found |= module.ORACLES
    return found
