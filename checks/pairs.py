"""A registered query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from checks.views import Books, with_views
from fleetbooks.functions.money import money_as_double


@dataclass(frozen=True)
class Pair:
    key: str
    build: Callable[[Books], DataFrame]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Money leaves as double, the last step on both sides."""
        return money_as_double(self.build(Books(spark, sf_dir)))

    def oracle(self) -> str:
        return with_views(self.sql)
