"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A shuffle task is sized to hold about this much, so that it fits in executor
# memory without spilling; AQE merges smaller partitions up to it at run time.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(shuffle_bytes: int, cores: int) -> int:
    """Partitions for a shuffle of the given size: never fewer than the cores."""
    return max(cores, -(-shuffle_bytes // TARGET_PARTITION_BYTES))


def settings(cores: int, shuffle_bytes: int = 0) -> dict[str, str]:
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions(shuffle_bytes, cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        # A key holding a large share of the rows is split over several tasks,
        # even where that costs one more shuffle.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def build_session(
    app_name: str = "salesengine",
    master: str | None = None,
    cores: int = 8,
    shuffle_bytes: int = 0,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**settings(cores, shuffle_bytes), **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
