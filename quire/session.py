"""Session settings the pipeline is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` wins over the defaults.

    Master, memory and shuffle width belong to the cluster (spark-submit), so
    they are only set when the caller passes them.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one row is a whole document, so Arrow batches are kept short
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call sites are captured for every Column built, which dominates planning
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
