"""Incremental ingest of records into an index by Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarrydex.operators.engine import Index


def _query_id(corpus: DataFrame, checkpoint: str) -> str:
    """The stream's id, which stays the same when it is started again from its checkpoint."""
    sc = corpus.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def ingest(corpus: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Starts a stream that adds each micro-batch of records to ``index`` as a batch of its own.

    The index may hold rows and be written to by others. A replayed micro-batch adds nothing, as the
    store remembers the stream's newest epoch; index tables are unions (or keep the newest
    batch), so the stream keeps no state and late records need no rule.
    """
    return (
        corpus.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda rows, n: index.write(rows, f"stream-{_query_id(corpus, checkpoint)}", n))
        .start()
    )
