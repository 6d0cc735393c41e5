"""All queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from gleaner.plans import analytics, extras, models, occupations, postings, relational, spaces, streams, studies, texts, units
from gleaner.plans.registry import Query

FLAGSHIP = "conditional_rates"

_MODULES = (relational, texts, analytics, postings, streams, models, units, spaces, occupations, extras, studies)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _MODULES:
        if both := out.keys() & m.query.queries.keys():
            raise ValueError(f"queries registered twice: {sorted(both)}")
        out |= m.query.queries
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.query.sql.items()}
