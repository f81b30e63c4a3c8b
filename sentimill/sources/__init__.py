"""Readers of landed files."""

from sentimill.sources.tables import table

__all__ = ["table"]
