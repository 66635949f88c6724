"""Report and change operators, one module per part of the books."""

from fleetbooks.operators import changes, common, companies, employees, fleet, hired, ingest, quality

__all__ = [
    "changes",
    "common",
    "companies",
    "employees",
    "fleet",
    "hired",
    "ingest",
    "quality",
]
