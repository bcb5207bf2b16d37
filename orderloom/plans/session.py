"""Session settings the jobs are designed for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings, each safe to change on a running session.
SETTINGS = {
    # Day arithmetic and timestamps read the same on every machine.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Items partitioned by order serve the joins on (order, item) and on
    # (order, requisition, item) without another shuffle of the wide side.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The JVM interprets methods above 8000 bytes instead of compiling them.  The
    # fused code of a 50-column row is larger, so let Spark use smaller pieces there.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables made inside lose their shuffle files as soon as they are computed, not when the driver forgets them.

    Only for tables that are computed once: a second run shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)
