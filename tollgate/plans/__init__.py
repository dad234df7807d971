"""Named queries (the Spark plans) and their DuckDB oracles."""

from tollgate.plans.registry import DOCS, ORACLES, QUERIES
from tollgate.plans import catalog_tables as _tables  # noqa: F401  (registers)
from tollgate.plans import catalog_stats as _stats  # noqa: F401
from tollgate.plans import catalog_charge as _charge  # noqa: F401
from tollgate.plans import catalog_stream as _stream  # noqa: F401
from tollgate.plans import catalog_kept as _kept  # noqa: F401

__all__ = ["QUERIES", "ORACLES", "DOCS"]
