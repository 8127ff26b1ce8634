"""All registered queries by name, and the SQL that checks them."""

from __future__ import annotations

from soundtally.plans import annotations, base, folders, ingest, levels, live, matching, shapes, surveys

#: Modules that register queries when imported.
MODULES = (levels, matching, ingest, annotations, surveys, live, shapes, folders)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    # a text that goes on with further views begins with a comma
    return {k: v.replace(") , ", "), ") for k, v in base.SQL.items()}
