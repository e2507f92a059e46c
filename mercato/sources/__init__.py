"""Logical source tables: schemas, the test-data binding, readers and sinks."""

from mercato.sources.tables import SourceTables  # noqa: F401
