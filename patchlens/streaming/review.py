"""Reviews of a stream of patches. A patch is whole in its row, so each micro-batch is reviewed like a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from patchlens.operators.packet import review
from patchlens.operators.requests import review_requests
from patchlens.operators.rules import Options


def review_stream(patches: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), once: bool = False) -> StreamingQuery:
    """Start a query that hands each batch's redacted packets to sink(frame, batch number). With once, it ends when all that is there is done."""
    writer = patches.writeStream.trigger(availableNow=True) if once else patches.writeStream
    return writer.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(review(batch, options), n)).start()


def request_stream(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """As review_stream(), each patch by the options in its own columns (operators.requests.FIELDS)."""
    writer = requests.writeStream.trigger(availableNow=True) if once else requests.writeStream
    return writer.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(review_requests(batch), n)).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of JSON that may be repeated: a batch has a folder of its own."""
    return lambda frame, n: frame.write.mode("overwrite").json(f"{path}/batch={n}")
