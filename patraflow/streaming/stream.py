"""The engine over a stream of documents. Documents are independent, so a file source and micro-batches suffice; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import quality as Q
from ..operators.chunk import ChunkConfig, chunk_text
from ..operators.clean import PreprocessConfig, clean


def scored_stream(stream: DataFrame) -> DataFrame:
    """A stream of documents with their quality: row expressions only."""
    return stream.withColumn("quality", Q.score(stream["text"]))


def chunk_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, config: ChunkConfig = ChunkConfig(), cleaning: PreprocessConfig = PreprocessConfig()) -> StreamingQuery:
    """Cleans and chunks Parquet files as they arrive in a folder; a batch written again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        done = chunk_text(clean(df.select("doc_id", "text"), cleaning).select("doc_id", "text"), config)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
