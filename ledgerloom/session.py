"""Session builder with the settings the library is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with AQE on and a UTC time zone.

    ``master`` is left to spark-submit when it is None.  Keyword settings use
    ``_`` for ``.`` only when they hold no dot already.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k if "." in k else k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
