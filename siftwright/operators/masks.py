"""What consumers do with masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Fixed value: SHA-256 of the empty text.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Rows without a text share one hash; these many parts keep them out of one task.
PARTS = 64


def flagged(rows: DataFrame, key: str, flags: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of ``flags(key, column)``, 0 where there is none.

    ``flags`` has one row a key, so the number of rows stays.  The empty text's
    rows may be a third of all: their key is divided into PARTS by a hash of the
    row, and its one flag repeated.  Other hot keys are split by adaptive execution.
    """
    # a task that is tried again must come to the same parts
    row = F.xxhash64(*[f.name for f in rows.schema if not isinstance(f.dataType, MapType)])
    part = F.when(F.col(key) == EMPTY, F.pmod(row, F.lit(PARTS))).otherwise(F.lit(0))
    parts = F.when(F.col("_k") == EMPTY, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    there = flags.select(F.col(key).alias("_k"), column).select("_k", F.explode(parts).alias("_q"), column)
    joined = rows.withColumn("_p", part.cast("bigint")).join(there, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_q")), "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(0))).drop("_k", "_q", "_p")


def clean(masked: DataFrame, names: list[str]) -> DataFrame:
    """Rows that are neither exact nor near duplicates of any of the named corpora."""
    flags = [c for n in names for c in (f"exact_duplicates_{n}", f"near_duplicates_{n}") if c in masked.columns]
    return masked.where(~reduce(lambda a, b: a | b, [F.col(c) for c in flags], F.lit(False)))


def summary(masked: DataFrame) -> DataFrame:
    """Rows and flagged rows of each mask."""
    flags = [c for c in masked.columns if c.startswith(("exact_duplicates_", "near_duplicates_"))]
    return masked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in flags])
