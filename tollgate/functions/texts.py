"""Render the fixed text templates of ``schema`` (``{name}`` placeholders)
as Spark columns or as SQL expressions, so that every engine writes the
same texts from one statement of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\{(\w+)\}")


def _split(template: str):
    pos = 0
    for m in _PART.finditer(template):
        if m.start() > pos:
            yield "lit", template[pos:m.start()]
        yield "var", m.group(1)
        pos = m.end()
    if pos < len(template):
        yield "lit", template[pos:]


def text_col(template: str, **values) -> Column:
    """The template as a string column; values are columns or column names."""
    parts = []
    for kind, v in _split(template):
        if kind == "lit":
            parts.append(F.lit(v))
        else:
            c = values[v]
            parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def text_sql(template: str, **values: str) -> str:
    """The template as a SQL string expression; values are SQL expressions."""
    parts = []
    for kind, v in _split(template):
        if kind == "lit":
            parts.append("'" + v.replace("'", "''") + "'")
        else:
            parts.append(f"CAST({values[v]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"
