"""Incremental word postings: new document files become postings as they arrive, instead of a rebuild when stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import vocabulary as V

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def new_postings(docs: DataFrame) -> DataFrame:
    """Postings of a static or streaming table of documents."""
    return V.tokens(V.segments(docs)).select("word", "segment_id", "unit_id", "collection")


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append postings of files that appear in ``source`` to ``target``, all available ones, exactly once."""
    rows = new_postings(spark.readStream.schema(DOCUMENTS).parquet(source))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("collection").trigger(availableNow=True).start()
