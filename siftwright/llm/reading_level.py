"""Problem 10: reading level of English prose.

Words are ranked by their frequency in all prose (and the graded samples).  Of
each text the coverage rank is the smallest vocabulary, in order of frequency,
that covers a fixed share of its words; sentence complexity is its words a
sentence and letters a word.  The graded samples are measured in the same way,
and SQL calibrates the levels: each level gets mean and variance of each
measure, a text the level of the largest likelihood.

Code blocks, inline code, links, headings and markup are left out of the words.

Defined results: null texts, texts under ``least_words`` white-space separated
words and texts in other languages are no cases.  A text that has that many
words but no sentence outside code and markup is measured with all its words;
one without any letter has measures of 0 and the level that is nearest to them.
Equally frequent words enter the vocabulary together, so their rank is its size
with all of them.  Repeated texts get equal levels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Sources that hold prose, and English as ``lang`` spells it.
PROSE_SOURCES = ("readme", "tutorial", "guide", "issue", "review")
ENGLISH = r"^\s*(en|eng|english)([-_].*)?\s*$"
LEAST_WORDS = 20
#: Shares of a text's words that the ranked vocabulary must cover.
SHARES = (0.5, 0.8, 0.9)
MEASURES = ("cover_0", "cover_1", "cover_2", "sentence", "letters")
#: Levels that a scale may have.
MOST_LEVELS = 100
#: Least standard deviation of a measure, so that a level with equal samples still admits others.
FLOOR = 0.05


_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_CODE_LINE = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
_HEADING = re.compile(r"^\s{0,3}#{1,6}[^\n]*$", re.M)
_TAG = re.compile(r"<[^<>]{1,200}>")
_URL = re.compile(r"\bhttps?://\S+")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_INLINE = re.compile(r"`[^`\n]*`")
_WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n")


def prose(text: str) -> str:
    """The text without code, links, headings and markup."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _HEADING.sub("", _CODE_LINE.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _URL.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    return _INLINE.sub(" ", text)


def counted(text: str) -> tuple[Counter, float, float]:
    """Counts of a text's words, and the logarithms of words a sentence and letters a word."""
    body = prose(text)
    words = _WORD.findall(body.lower())
    if len(words) < 5:
        body, words = text, _WORD.findall(text.lower())
    sentences = sum(1 for s in _SENTENCE.split(body) if _WORD.search(s))
    n = max(1, len(words))
    return Counter(words), math.log(n / max(1, sentences)), math.log(max(1, sum(map(len, words))) / n)


def word_counts(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``kind, id, sentence, letters, word, n`` of ``texts(kind, id, text)``: one row for each different word of a text, so that no text and no repeated word is shuffled.

    A text without any has one row of a null word.  Texts under ``least_words`` white-space separated words are left out, but for graded samples (kind 1).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                kinds, ids, sentences, letters, words, ns = [], [], [], [], [], []
                for kind, i, text in zip(part["kind"], part["id"], part["text"]):
                    if not kind and len(text.split()) < least_words:
                        continue
                    counts, a, b = counted(text)
                    counts = counts or {None: 0}
                    m = len(counts)
                    kinds += [kind] * m
                    ids += [i] * m
                    sentences += [a] * m
                    letters += [b] * m
                    words += counts.keys()
                    ns += counts.values()
                yield pd.DataFrame({"kind": kinds, "id": ids, "sentence": sentences, "letters": letters, "word": pd.Series(words, dtype="object"), "n": ns})

    return texts.select("kind", "id", "text").mapInPandas(run, "kind int, id bigint, sentence double, letters double, word string, n bigint")


def word_ranks(counts: DataFrame) -> DataFrame:
    """``word, rank`` from ``counts(word, n)``: the size of the smallest vocabulary, in order of frequency, that has the word and all as frequent.

    The window runs over the histogram of frequencies, whose rows are at most
    the square root of twice the number of words in all texts, never over words.
    """
    totals = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    histogram = totals.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    size = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return totals.join(histogram.select("n", size.alias("rank")), "n").select("word", "rank")


def coverage(pairs: Column, shares: tuple[float, ...] = SHARES) -> tuple[Column, Column]:
    """A text's words in all, to be named ``_total``, and for each share the least rank up to which the words of ``pairs(rank, n)``, a text's own, make up that share of it; 0 for a text without words."""
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), *[F.lit(0).cast("bigint").alias(f"c{k}") for k in range(len(shares))])

    def add(acc: Column, x: Column) -> Column:
        # a share is reached by the first word at which the sum is no longer below it
        hits = [F.when(acc["sum"] < F.lit(s) * F.col("_total"), x["rank"]).otherwise(acc[f"c{k}"]).alias(f"c{k}") for k, s in enumerate(shares)]
        return F.struct((acc["sum"] + x["n"]).alias("sum"), *hits)

    return total, F.aggregate(F.sort_array(pairs), start, add)


def coverage_ranks(texts: DataFrame) -> DataFrame:
    """``id, cover_0, ...`` of ``texts(id, text)``: the coverage ranks by all runs of letters, markup and code included; texts without any have none.

    Words are cut and counted on the JVM; only counts are shuffled.
    """
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = checkpointed(words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")))
    own = counts.join(word_ranks(counts), "word").groupBy("id").agg(F.collect_list(F.struct("rank", "n")).alias("pairs"))
    total, covered = coverage(F.col("pairs"))
    return own.withColumn("_total", total).withColumn("c", covered).select("id", *[F.col(f"c.c{k}").alias(f"cover_{k}") for k in range(len(SHARES))])


def measures(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``kind, id`` and the five measures of each text of ``texts(kind, id, text)``; ranks are over all of them.

    A word that is in most texts is a hot key of the join with the ranks.  Spark
    broadcasts the ranks where it measures them to be small; else adaptive
    execution splits the hot partitions.  A text's different words come together
    as pairs of numbers, as they did in its own row.
    """
    # word counts feed the ranks and the texts' own measures, and those the calibration and the cases
    words = checkpointed(word_counts(texts, least_words))
    ranked = words.join(word_ranks(words), "word", "left")
    pair = F.struct(F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), "n")
    own = ranked.groupBy("kind", "id").agg(F.collect_list(pair).alias("pairs"), F.first("sentence").alias("sentence"), F.first("letters").alias("letters"))
    total, covered = coverage(F.col("pairs"))
    ranks = own.withColumn("_total", total).withColumn("c", covered)
    return ranks.select("kind", "id", *[F.log1p(F.col(f"c.c{i}").cast("double")).alias(f"cover_{i}") for i in range(len(SHARES))], "sentence", "letters")


def calibrate(graded: DataFrame) -> DataFrame:
    """Mean and deviation of each measure for each level of ``graded(level, measures)``: one row a level."""
    aggregates = [f(m).alias(f"{a}_{m}") for m in MEASURES for f, a in ((F.avg, "mean"), (F.stddev_pop, "dev"))]
    return graded.groupBy("level").agg(*aggregates)


def assign(measured: DataFrame, levels: DataFrame) -> DataFrame:
    """``id, level``: the level of the largest likelihood; of equals the first by name.

    ``levels`` has one row a level, of which there are ``MOST_LEVELS`` at most; they become one array, a scalar of the plan, so that no join and no shuffle of texts is needed.
    """
    rows = F.collect_list(F.struct("level", *[c for m in MEASURES for c in (f"mean_{m}", f"dev_{m}")]))
    every = levels.where(F.col("level").isNotNull()).agg(rows.alias("levels")).scalar()

    def scored(level: Column) -> Column:
        miss = F.lit(0.0)
        for m in MEASURES:
            dev = F.greatest(level[f"dev_{m}"], F.lit(FLOOR))
            miss = miss + F.pow((F.col(m) - level[f"mean_{m}"]) / dev, 2) + 2 * F.log(dev)
        return F.struct(miss.alias("miss"), level["level"].alias("level"))

    return measured.withColumn("_levels", every).select("id", F.array_min(F.transform("_levels", scored))["level"].alias("level"))


def reading_levels(documents: DataFrame, references: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, level`` of the English prose in ``documents(doc_id, text, lang, source)``."""
    cases = documents.where(F.col("source").isin(*PROSE_SOURCES) & F.lower("lang").rlike(ENGLISH) & F.col("text").isNotNull())
    graded = references.where(F.col("text").isNotNull() & F.col("level").isNotNull())
    texts = cases.select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(graded.select(F.lit(1).alias("kind"), F.col("ref_id").alias("id"), "text"))
    if graded.select("level").distinct().limit(MOST_LEVELS + 1).count() > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    measured = measures(texts, least_words)
    samples = measured.where(F.col("kind") == 1).join(graded.select(F.col("ref_id").alias("id"), "level"), "id")
    return assign(measured.where(F.col("kind") == 0), calibrate(samples)).select(F.col("id").alias("doc_id"), "level")
