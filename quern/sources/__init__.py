"""Table sources."""

from quern.sources.tables import table

__all__ = ["table"]
