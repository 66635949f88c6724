"""Spark sessions: a local one for tests and benches, settings for a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators count on. Most are Spark's defaults, listed so that
# nobody turns them off: skewed joins are split at run time, small shuffle
# partitions are merged, and a side is broadcast only when its size, estimated
# or measured, is below the threshold. spark.checkpoint.dir is the cluster's and is
# not set here; the reports do not need it, the text operators write their tables there.
CLUSTER_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Key lists and vehicle lists of up to about a million rows; files are taken
    # to be three times as large in memory when their size is estimated.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.sources.fileCompressionFactor": "3.0",
    # Many initial partitions; the ones that turn out small are merged.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def local_session(cpus: int | str = "*", name: str = "fleetbooks", memory: str = "8g") -> SparkSession:
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
