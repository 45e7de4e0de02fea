"""Embedding of units as they arrive: an extension, as the batch analysis needs no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import MOST_BYTES, Embedder, embed


def embed_stream(texts: DataFrame, embedder: Embedder, out: str, checkpoint: str, most: int = MOST_BYTES, once: bool = True) -> StreamingQuery:
    """Writes ``(ord, embedding)`` of a stream ``texts(ord, text)`` to ``out``, a folder for each micro-batch.

    A batch that is run again after a failure overwrites its own folder, so each row is there once.
    """

    def each(batch: DataFrame, n: int) -> None:
        embed(batch, embedder, None, most)[0].write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
