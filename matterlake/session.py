"""Session settings the operators are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents may be long: few rows per Arrow batch bound a worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build(name: str = "matterlake", **extra: str) -> SparkSession:
    """A session with these settings; master and sizes come from the caller."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
