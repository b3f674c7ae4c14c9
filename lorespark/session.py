"""Sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lorespark", cores: int | str = "*", **settings: str) -> SparkSession:
    """A session with adaptive plans and UTC times; settings override, with dots written as double underscores."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    known = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (known | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
