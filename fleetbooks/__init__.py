"""Fleet bookkeeping reports as PySpark DataFrame functions.

Every public function takes DataFrames (and explicit dates) and returns a lazy
DataFrame built from Spark's own expressions. Nothing here collects rows,
reads the clock or registers a Python UDF.
"""

from fleetbooks import functions, operators, plans, sources

__all__ = ["functions", "operators", "plans", "sources"]
