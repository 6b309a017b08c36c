"""Arrow batches between the JVM and Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH = 8 << 20  # bytes of an Arrow batch between the JVM and Python; a longer row is a batch of its own


def small_batches(df: DataFrame) -> None:
    """Batches of at most about BATCH bytes for Python functions over ``df``.

    The batches' size is a setting of the session that is read when the rows are, so it stays; a smaller one is left as it is.
    """
    if not 0 < df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
