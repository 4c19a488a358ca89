"""Queries of the problems, each over its whole tables; SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import canonical_ledger, credentials, encoding_repair, handwritten, leakage, licenses, packing, reading_level, syntax, tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, kind`` of files that are not hand-written source."""
    return handwritten.not_handwritten(_table(spark, sf_dir, "extract_files"))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what each row rests on."""
    return handwritten.with_evidence(_table(spark, sf_dir, "extract_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, item_id`` of files that hold a passage of an evaluation text."""
    return leakage.leaked_passages(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "eval_items")).select("id", "item_id")


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the stretches of the content to remove."""
    return leakage.leaked_passages(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "eval_items"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those files without the passages, and the spans that were removed."""
    return leakage.without_passages(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "eval_items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_id, id`` of each copy of an earlier record."""
    return canonical_ledger.copies(_table(spark, sf_dir, "extract_files"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record, with its number of copies; two batches merged one after the other."""
    return canonical_ledger.survivors(_table(spark, sf_dir, "extract_files"))


def p3_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies where the order of fields and settings counts, by a ledger of three batches."""
    return canonical_ledger.copies(_table(spark, sf_dir, "extract_files"), 3, ordered=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, secret`` of each credential that is written down."""
    return credentials.find_credentials(_table(spark, sf_dir, "extract_files"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of a credential with its score, and whether a pattern alone would have known it."""
    return credentials.scored_credentials(_table(spark, sf_dir, "extract_files"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with credentials, redacted."""
    return credentials.redacted_files(_table(spark, sf_dir, "extract_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scope, subject, spdx_id, verdict`` of files and repositories."""
    return licenses.license_verdicts(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "license_refs"))


def p5_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each licence a file states, with the exceptions to it."""
    return licenses.stated_licenses(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "license_refs")).select("id", "spdx_id", "exceptions", "full")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, restored_sha`` of files with wrongly decoded text."""
    return encoding_repair.garbled_files(_table(spark, sf_dir, "extract_files"))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with their restored contents."""
    return encoding_repair.restored_files(_table(spark, sf_dir, "extract_files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of files that are not valid in their language."""
    return syntax.invalid_files(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "langs_extension"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those files with the number of edits they need and the kind of fault."""
    return syntax.faulty_files(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "langs_extension"))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and their rate for each repository and language."""
    return syntax.fault_rates(_table(spark, sf_dir, "extract_files"), _table(spark, sf_dir, "langs_extension"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of each document."""
    return tokenizer.encode(_table(spark, sf_dir, "documents"))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each budget and the stretches of documents in them."""
    return packing.pack(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "token_budgets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, level`` of English prose."""
    return reading_level.reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_refs"))


def p10_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage ranks of all documents by all their words."""
    docs = _table(spark, sf_dir, "documents")
    return reading_level.coverage_ranks(docs.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


_P10_COVER = rf"""with w as (select doc_id, unnest(regexp_extract_all(lower("text"), '\p{{L}}+')) as word from documents),
c as (select doc_id, word, count(*) as n from w group by 1, 2), t as (select word, sum(n) as n from c group by 1),
r as (select word, count(*) over (order by n desc range between unbounded preceding and current row) as rank from t),
a as (select doc_id, rank, sum(n) over (partition by doc_id order by rank range between unbounded preceding and current row) as upto, sum(n) over (partition by doc_id) as total from c join r using (word))
select doc_id, {", ".join(f"min(rank) filter (where upto >= {s}::double * total) as cover_{k}" for k, s in enumerate(reading_level.SHARES))} from a group by 1"""


_P3_ORDERED = rf"""with k as (select id, regexp_replace(regexp_replace(lower(coalesce(extension, '')), '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g'), '^\.', '') as e, regexp_replace(lower(content), '[^\p{{L}}\p{{N}}]+', '', 'g') as t from extract_files),
f as (select id, min(id) over (partition by e, t) as first_id from k where t <> '')
select first_id, id from f where id <> first_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_evidence, p2_found, p2_spans, p2_clean, p3_found, p3_survivors, p3_ordered, p4_found, p4_scores, p4_redacted, p5_found, p5_statements, p6_found, p6_restored, p7_found, p7_faults, p7_rates, p8_ids, p9_pack, p10_found, p10_cover)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"p3_ordered": _P3_ORDERED, "p10_cover": _P10_COVER}
