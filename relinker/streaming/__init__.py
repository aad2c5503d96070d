"""The redirect job as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from relinker.operators.redirect import redirect


def start_redirect(
    spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str,
    *, url_col: str, old: str, new: str, host: str | None = None,
) -> StreamingQuery:
    """Redirect the Parquet files that arrive in ``source`` and append the rows to ``sink``.

    Stateless, so it needs no watermark. It takes what is there and ends
    (``availableNow``); started again with the same checkpoint folder it takes only
    what came since.
    """
    visits = spark.readStream.schema(schema).parquet(source)
    moved = redirect(visits, url_col, old, new, host)
    return (
        moved.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
