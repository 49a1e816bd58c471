"""All registered queries and their SQL."""

from __future__ import annotations

from twinloom.plans import q_attacks, q_compare, q_generate, q_runs, q_structure, q_tables

MODULES = [q_tables, q_generate, q_compare, q_structure, q_attacks, q_runs]


def queries():
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(m.SQL)
    return out
