"""Languages and file endings: lookups and the join of files with endings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a list of languages that the driver agrees to read.
MOST_LANGUAGES = 10_000


def read_languages(extensions: DataFrame) -> list[tuple[str, list[str]]]:
    """``(name, endings)`` in order; a list of languages is a parameter of a few hundred rows, so the driver reads it, and refuses more."""
    rows = extensions.select("ordinal", "name", "extensions").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return [(r[1], [e for e in (r[2] or []) if e]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0]))]


def endings_to_languages(extensions: DataFrame) -> dict[str, list[str]]:
    """Languages of each ending, in the list's order."""
    out: dict[str, list[str]] = {}
    for name, endings in read_languages(extensions):
        for e in endings:
            out.setdefault(e, []).append(name)
    return out


def with_languages(files: DataFrame, extensions: DataFrame, extension: str = "ext") -> DataFrame:
    """``files`` with ``langs``, the languages of its extension in order; empty if none.

    The endings are grouped first.  Spark broadcasts them where it measures them to be small.
    """
    pairs = extensions.select("ordinal", "name", F.explode("extensions").alias("_ending"))
    grouped = pairs.groupBy("_ending").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]).alias("langs"))
    joined = files.join(grouped, F.col(extension) == F.col("_ending"), "left").drop("_ending")
    return joined.withColumn("langs", F.coalesce("langs", F.array().cast("array<string>")))


def matching_endings(files: DataFrame, endings: list[str], name: str = "file_name", strict: bool = False) -> DataFrame:
    """One row for each ending that a file's name has, with the ending as ``matched``.

    By default an ending is a pattern found anywhere in the name, as file
    collectors do; ``strict`` wants it at the end.  The endings are constants, so
    each is one pattern, compiled once, and the join is an array within each row.
    """
    if not endings:
        return files.withColumn("matched", F.lit("")).where(F.lit(False))
    hit = (lambda e: F.endswith(F.col(name), F.lit(e))) if strict else (lambda e: F.col(name).rlike("(?d).*" + e))
    return files.withColumn("matched", F.explode(F.array_compact(F.array(*[F.when(hit(e), F.lit(e)) for e in endings]))))
