"""Incremental enrichment: new chunk files are summarised as they arrive, each chunk once.

Each micro-batch drops chunks that the log has, summarises the others and appends them; the checkpoint keeps the place in the
stream, and the log makes a repeated batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..models import Summariser, first_sentence_summary
from ..operators import enrich
from ..sources import readers, sinks


def start(spark: SparkSession, chunks_path: str, log_path: str, checkpoint: str, summarise: Summariser = first_sentence_summary, files_per_batch: int = 100) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        log = readers.read_summary_log(df.sparkSession, log_path)
        new = enrich.summarise_pending(df.dropDuplicates(["chunk_id"]), enrich.last_records(log), summarise)
        sinks.append_summaries(new, log_path, readers.next_seq(log))

    stream = spark.readStream.schema(schemas.CHUNKS).option("maxFilesPerTrigger", files_per_batch).parquet(chunks_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
