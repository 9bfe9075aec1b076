"""A Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarryfield", **conf: str) -> SparkSession:
    """Time zone UTC always; adaptive execution splits skewed joins and coalesces small partitions.

    Generated methods stay below 8,000 bytes of code, beyond which the JVM does not compile them:
    a wide split of payloads would be interpreted.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.codegen.hugeMethodLimit", "8000")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
