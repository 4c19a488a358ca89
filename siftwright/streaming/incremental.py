"""Masks for files that arrive one batch after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import exact, near
from ..plans import pipeline


def flag_exact(stream: DataFrame, known: DataFrame, languages: dict[str, list[str]], name: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of a stream of files with its exact mask against a table of known hashes.

    A batch is written under its number, so that one repeated after a failure
    replaces itself: the target holds each row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        flagged = exact.exact_mask(exact.with_sha(batch, languages), known, name)
        flagged.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each_batch(stream, write, checkpoint)


def flag_near(stream: DataFrame, known: DataFrame, languages: dict[str, list[str]], name: str, target: str, checkpoint: str) -> StreamingQuery:
    """The same with the near mask against a table of known bands (``band, band_key``), such as ``tables.write_bands`` stores."""

    def write(batch: DataFrame, number: int) -> None:
        rows = pipeline.normal_corpus(batch, languages)
        flagged = near.near_mask(rows, near.near_keys(pipeline.band_index(rows), known), name).drop("normal")
        flagged.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each_batch(stream, write, checkpoint)


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(action).start()
