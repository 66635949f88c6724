"""Readers and plain listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from fleetbooks.operators.common import by_name, newest_first, newest_first_in_pieces
from fleetbooks.sources.schemas import LISTING_ORDER, SCHEMAS


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``<path>/<table>`` as Parquet with the declared schema, no inference.

    A month directory layout (``<month column>=YYYY-MM-DD``) is recognised, so
    month filters prune whole directories.
    """
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path.rstrip('/')}/{table}")


def load_jdbc(
    spark: SparkSession,
    table: str,
    options: Mapping[str, str],
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    pieces: int = 1,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A table of a PostgreSQL database, read in parallel pieces.

    ``options`` (url, user, password, ...) come from the caller; SSL is
    preferred unless the caller says otherwise. Give ``split_on`` with
    ``bounds`` and ``pieces`` to cut a numeric column into ranges, or
    ``predicates`` (for instance one per month) where the ids are uneven.
    """
    props = {"driver": "org.postgresql.Driver", "sslmode": "prefer", "fetchsize": "10000"}
    props.update(options)
    if predicates is not None:
        url = props.pop("url")
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=props)
    if split_on is not None:
        if bounds is None:
            raise ValueError("split_on needs bounds")
        props.update(
            partitionColumn=split_on,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(pieces),
        )
    return spark.read.format("jdbc").option("dbtable", table).options(**props).load()


def listing(df: DataFrame, table: str, ordered: bool = True, pieces: int | None = None) -> DataFrame:
    """All columns of a table in the order its page lists them.

    ``pieces`` says how many partitions a long list by date shall have, newest first;
    it is then put in order without a range partitioning, which would read all of it twice.
    """
    if not ordered:
        return df
    column, newest = LISTING_ORDER[table]
    if not newest:
        return by_name(df, column)
    return newest_first(df, column) if pieces is None else newest_first_in_pieces(df, column, pieces)


def choices(df: DataFrame, id: str, label: str) -> DataFrame:
    """Id and name for a pick list, by name."""
    return by_name(df.select(id, label), label)
