"""Session builder with the settings the library is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins from measured sizes: it splits skewed join
# partitions, turns a join into a broadcast only when the measured side is small
# enough, and coalesces small shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The rule tables compile to thousands of column calls; recording the Python
    # line of each costs far more than the calls themselves.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "spendframe", master: str | None = None, **settings: str
) -> SparkSession:
    """Build (or reuse) a session. On a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
