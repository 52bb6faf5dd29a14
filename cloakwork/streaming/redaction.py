"""The pipeline on a stream: rows are independent, so it has no state; items are enqueued by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import ReviewQueue
from ..plans.pipeline import Pipeline


def redact_stream(docs: DataFrame, pipeline: Pipeline) -> DataFrame:
    return pipeline.transform(docs)


def run(docs: DataFrame, pipeline: Pipeline, queue: ReviewQueue, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Redacted documents to Parquet and items to the queue, whose ids make a repeated batch harmless."""

    def batch(rows: DataFrame, number: int) -> None:
        result = pipeline.transform(rows).persist()
        result.select("doc_id", "lang", "redacted_text").write.mode("overwrite").parquet(f"{out}/batch={number}")
        queue.enqueue(pipeline.review_items(result))
        result.unpersist()

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
