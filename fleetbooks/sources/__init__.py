"""Table schemas, readers and writers."""

from fleetbooks.sources import schemas, sinks, tables

__all__ = ["schemas", "sinks", "tables"]
