"""Session settings that the library's jobs want: ANSI casts, UTC, adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Bytes of an Arrow batch of texts. A number of rows alone would not bound a worker's memory; one text may be longer.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session, unless it sets its own bound."""
    if int((spark.conf.get(_BATCH_CONF, None) or "-1").rstrip("kmgKMG")) <= 0:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def session(master: str | None = None, app: str = "galenic", **settings: str) -> SparkSession:
    """A session with SETTINGS and further ones. On a cluster leave master out and set spark.checkpoint.dir."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
