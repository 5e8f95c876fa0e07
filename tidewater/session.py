"""Session settings that the engine's operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Needed for equal results everywhere, whatever the session had before.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
#: Sensible where nothing was chosen. Small Arrow batches keep a batch of very long texts in memory.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A new session (or the running one) with the engine's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else made."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULTS["spark.sql.execution.arrow.maxRecordsPerBatch"])
    return spark
