"""Masking streams: the same projections, and a mapping kept once for each original."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.maskers import MaskSpec, masked
from maskwright.operators import mapping


def mask_stream(stream: DataFrame, specs: Sequence[MaskSpec]) -> DataFrame:
    """A masked stream.  Maskers keep no state, so no watermark is needed and any trigger gives the same values."""
    return masked(stream, specs)


def redaction_counts(stream: DataFrame, time: str, text: str, kinds: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings by window of event time and kind; events later than ``late`` are dropped by the watermark."""
    from maskwright.functions.patterns import found_kinds

    hits = stream.withWatermark(time, late).select(time, F.explode(found_kinds(F.col(text), kinds)).alias("kind"))
    return hits.groupBy(F.window(time, window).alias("window"), "kind").agg(F.count("*").alias("findings")).select("window.start", "window.end", "kind", "findings")


@dataclass
class Masking:
    """The two queries of a masked stream: its rows, and the mapping's entries."""

    rows: StreamingQuery
    entries: StreamingQuery

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        return all([q.awaitTermination(timeout) if timeout else q.awaitTermination() for q in (self.rows, self.entries)])

    def stop(self) -> None:
        self.rows.stop()
        self.entries.stop()


def start_masking(stream: DataFrame, table: str, specs: Sequence[MaskSpec], operation_id: str, key: str, out: str, store: str, checkpoint: str, **trigger) -> Masking:
    """Write the masked stream to ``out`` and new originals to the mapping ``store``.

    Each is a file sink of its own checkpoint, which writes every batch once.
    Which originals the mapping has is known by a state of their hashes, dealt by
    hash, so a batch costs what is new in it, however long the stream has run.
    """

    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    return Masking(start(masked(stream, specs), out, "rows"), start(mapping.build_mapping(stream, table, specs, operation_id, key), store, "entries"))
