"""Whole comparisons: an own corpus against others, as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exact, extensions, masks, near
from ..session import checkpointed

#: Other corpora that one comparison can tell apart: bits of a mask.
MOST_CORPORA = 62


def normal_corpus(corpus: DataFrame, languages: dict[str, list[str]], order: tuple[str, ...] = exact.CONTENT_FOR_HASH) -> DataFrame:
    """The corpus with ``normal``, its normal text, and ``sha``; ``order`` says which of several text columns counts."""
    normal = exact.normal_text(exact.content_column(corpus, order), exact.path_column(corpus), languages)
    return corpus.withColumn("normal", normal).withColumn("sha", F.sha2("normal", 256))


def band_index(corpus: DataFrame) -> DataFrame:
    """Bands of the classes of a corpus with ``normal``."""
    return near.bands(near.classes(corpus))


def _one_column(corpus: DataFrame) -> bool:
    """Whether hashes and index are of one column; with both ``code`` and ``text`` the index takes the former."""
    first = [next((c for c in order if c in corpus.columns), None) for order in (exact.CONTENT_FOR_HASH, exact.CONTENT_FOR_INDEX)]
    return first[0] == first[1]


def for_index(corpus: DataFrame, languages: dict[str, list[str]]) -> DataFrame:
    """The corpus with ``near_normal`` and ``near_key``, text and class by the index' order of columns."""
    if _one_column(corpus):
        return corpus.withColumn("near_normal", F.col("normal")).withColumn("near_key", F.col("sha"))
    text = exact.normal_text(exact.content_column(corpus, exact.CONTENT_FOR_INDEX), exact.path_column(corpus), languages)
    return corpus.withColumn("near_normal", text).withColumn("near_key", F.sha2("near_normal", 256))


def masked(own: DataFrame, others: dict[str, DataFrame], languages: DataFrame) -> DataFrame:
    """``own`` with an exact and a near mask for each other corpus; no row is dropped.

    All other corpora are one table with a bit for each, so that the own corpus
    is hashed, signed and joined once, however many they are.
    """
    if len(others) > MOST_CORPORA:
        raise ValueError(f"more than {MOST_CORPORA} corpora")
    endings = extensions.endings_to_languages(languages)
    out = for_index(normal_corpus(own, endings), endings)
    if not others:
        return out.drop("normal", "near_normal", "near_key")
    texts = None
    for k, other in enumerate(others.values()):
        rows = for_index(normal_corpus(other, endings), endings).select(F.lit(1 << k).cast("bigint").alias("bit"), "sha", "near_key", "near_normal")
        texts = rows if texts is None else texts.unionByName(rows)
    hashes = texts.groupBy("sha").agg(F.bit_or("bit").alias("_exact"))
    # keys and signatures of all corpora, the own one as bit 0, are made once and then read for both sides of the join
    every = out.select(F.lit(0).cast("bigint").alias("bit"), "near_key", "near_normal").unionByName(texts.select("bit", "near_key", "near_normal"))
    signed = near.signatures(every.where(F.col("near_normal").isNotNull()).select("bit", F.col("near_key").alias("key"), F.col("near_normal").alias("text")))
    index = checkpointed(near.bands(signed.distinct()))
    there = index.where(F.col("bit") != 0).groupBy("band", "band_key").agg(F.bit_or("bit").alias("_near"))
    found = index.where(F.col("bit") == 0).join(there, ["band", "band_key"]).groupBy(F.col("key").alias("near_key")).agg(F.bit_or("_near").alias("_near"))
    out = masks.flagged(masks.flagged(out, "sha", hashes, "_exact"), "near_key", found, "_near")
    for k, name in enumerate(others):
        for kind in ("exact", "near"):
            out = out.withColumn(f"{kind}_duplicates_{name}", F.col(f"_{kind}").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0)
    return out.drop("normal", "near_normal", "near_key", "_exact", "_near")


def uncontaminated(own: DataFrame, others: dict[str, DataFrame], languages: DataFrame) -> DataFrame:
    """Rows of ``own`` that no other corpus has, exactly or nearly."""
    return masks.clean(masked(own, others, languages), list(others))
