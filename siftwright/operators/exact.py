"""Exact duplicates: hashes of normalised texts, set operations on them, and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comments, literals, text
from . import masks

#: Columns that may hold a corpus' text or path; the first that is there counts.
CONTENT_FOR_HASH = ("text", "code", "code_text", "content")
CONTENT_FOR_INDEX = ("code", "text", "code_text", "content")
PATHS = ("path", "max_stars_repo_path", "meta", "file_name", "file_path")


def content_column(corpus: DataFrame, order: tuple[str, ...] = CONTENT_FOR_HASH) -> Column:
    """The corpus' text, by the columns it has; resolved once for a table, not by row."""
    return next((F.col(c) for c in order if c in corpus.columns), F.lit(None).cast("string"))


def path_column(corpus: DataFrame) -> Column:
    """The corpus' path; ``meta`` is a dictionary literal that holds one."""
    found = next((c for c in PATHS if c in corpus.columns), None)
    if found is None:
        return F.lit(None).cast("string")
    return literals.literal_value(F.col("meta"), "path") if found == "meta" else F.col(found)


def normal_text(content: Column, path: Column, languages: dict[str, list[str]], strict: bool = False, nested_last: bool = False) -> Column:
    """Text without the comments of its path's languages, white space and letter case; empty for a null text or path."""
    stripped = comments.strip_by_extension(content, text.path_extension(path), languages, strict, nested_last)
    return F.coalesce(F.when(path.isNotNull(), text.normalise(stripped)), F.lit(""))


def with_sha(corpus: DataFrame, languages: dict[str, list[str]], order: tuple[str, ...] = CONTENT_FOR_HASH, path: Column | None = None, strict: bool = False) -> DataFrame:
    """The corpus with ``sha``, the SHA-256 of its normal text; rows without text or path share that of the empty text."""
    return corpus.withColumn("sha", F.sha2(normal_text(content_column(corpus, order), path_column(corpus) if path is None else path, languages, strict), 256))


def distinct_hashes(hashed: DataFrame) -> DataFrame:
    return hashed.select("sha").distinct()


def common_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("sha").intersect(b.select("sha"))


def own_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hashes of ``a`` that ``b`` lacks."""
    return a.select("sha").subtract(b.select("sha"))


def exact_mask(hashed: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """``hashed`` with the boolean ``exact_duplicates_<name>``; no row is dropped.

    The other side is distinct, so the join keeps the number of rows; Spark
    broadcasts it if it is measured to be small, else both sides are shuffled.
    """
    marked = other.where(F.col("sha").isNotNull()).select("sha").distinct().withColumn("_there", F.lit(1))
    return masks.flagged(hashed, "sha", marked, "_there").withColumn(f"exact_duplicates_{name}", F.col("_there") > 0).drop("_there")


def keep_first(hashed: DataFrame, order: str) -> DataFrame:
    """The first row of each hash in the order of a unique column: an own corpus without exact copies.

    Only hash and order are shuffled to find the first, then rows are chosen by a semi-join on the order column.
    """
    first = hashed.groupBy("sha").agg(F.min(order).alias(order))
    return hashed.join(first.select(order), order, "left_semi")
