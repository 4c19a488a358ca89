"""Problem 3: duplicates hidden by formatting differences.

An incremental ledger, a table stored by buckets of a canonical key, keeps how
many records had that key and which came first.  Each new batch is aggregated
(partially on the map side, so that a hot key costs one row a task) and joined
to the ledger's matching buckets by a full outer join on bucket and key; counts
are added and the earliest representative stays.  Only buckets that the batch
touches are read and written again.

The canonical key is a 128-bit digest of the extension and the content without
letter case and without anything but letters and digits.  For JSON, YAML and
INI-like files the order of fields, settings and sections is undone first, by
readers that need no valid syntax.

Defined results: records without a letter or digit (null, empty, blank) have a
null key and are left out; a null extension counts as an empty one; ties in
order are decided by id; extra columns are ignored; an empty batch leaves the
ledger as it is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import checkpointed, scratch

#: Extensions of the formats in which order does not count.
JSON_EXTENSIONS = ("json", "geojson")
YAML_EXTENSIONS = ("yml", "yaml")
INI_EXTENSIONS = ("ini", "properties")

#: Buckets of a stored ledger: folders of which a batch reads and writes those it touches.
BUCKETS = 64
#: A key with more than this share of all rows is hot; there are fewer such keys than its inverse, so that they can be broadcast.
HOT_SHARE = 1e-4

_DROP = re.compile(r"[\W_]+")
_STRIP = r"^[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"

LEDGER_SCHEMA = "bucket int, key binary, first_id bigint, copies bigint"


def plain(text: str) -> str:
    """Letters and digits only, without letter case."""
    return _DROP.sub("", text.lower())


_JSON_PIECE = re.compile(r'"(?:\\.|[^"\\])*"?|[{}\[\],]|[^"{}\[\],]+', re.S)


def canonical_json(text: str) -> str:
    """Fields of each object sorted, lists in their order; what is not closed ends with the text, so that any text has a form."""
    # each frame: whether an object, its fields or elements so far, and the parts of the one that is open
    stack: list[tuple[bool, list[str], list[str]]] = [(False, [], [])]

    def fold() -> None:
        is_object, done, now = stack.pop()
        done.append("".join(now))
        stack[-1][2].append("".join(sorted(done) if is_object else done))

    for m in _JSON_PIECE.finditer(text):
        s = m.group()
        if s in ("{", "["):
            stack.append((s == "{", [], []))
        elif s in ("}", "]"):
            if len(stack) > 1:
                fold()
        elif s == ",":
            _, done, now = stack[-1]
            done.append("".join(now))
            now.clear()
        else:
            stack[-1][2].append(plain(s))
    while len(stack) > 1:
        fold()
    return "".join([*stack[0][1], *stack[0][2]])


_INI_SECTION = re.compile(r"^\s*\[(.*)\]\s*$")


def canonical_ini(text: str) -> str:
    """Settings sorted within their section, sections sorted; a comment goes with what follows it in its section."""
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in text.splitlines():
        m = _INI_SECTION.match(line)
        if m:
            sections.append((plain(m[1]), []))
        elif p := plain(line):
            own = sections[-1][1]
            if line[:1].isspace() and own and "=" not in line and ":" not in line:
                own[-1] += p
            else:
                own.append(p)
    return "".join(sorted(name + "".join(sorted(own)) for name, own in sections))


def canonical_yaml(text: str) -> str:
    """Entries of equal indentation are siblings: fields are sorted, list items keep their order."""
    stack: list[tuple[int, list[list]]] = [(-1, [[False, ""]])]

    def add(indent: int, item: bool, body: str) -> None:
        while stack[-1][0] > indent:
            fold()
        if stack[-1][0] < indent:
            stack.append((indent, []))
        stack[-1][1].append([item, plain(body)])

    def fold() -> None:
        _, own = stack.pop()
        stack[-1][1][-1][1] += _siblings(own)

    for raw in text.splitlines():
        body = raw.strip()
        if body in ("", "---", "..."):
            continue
        indent = 2 * (len(raw) - len(raw.lstrip()))
        # an item lies half a step below a key of its column, and its fields where its first one begins
        while body.startswith("- ") or body == "-":
            add(indent + 1, True, "")
            rest = body[1:].lstrip()
            indent += 2 * (len(body) - len(rest))
            body = rest
        if body:
            add(indent, False, body)
    while len(stack) > 1:
        fold()
    return stack[0][1][0][1]


def _siblings(own: list) -> str:
    if any(item for item, _ in own):
        return "".join(t for _, t in own)
    return "".join(sorted(t for _, t in own))


def ordered_text(extension: pd.Series, content: pd.Series) -> pd.Series:
    """The canonical form of each structured text; null for the texts of other formats, which come as null."""
    out = []
    for e, c in zip(extension, content):
        out.append(None if c is None else canonical_json(c) if e in JSON_EXTENSIONS else canonical_yaml(c) if e in YAML_EXTENSIONS else canonical_ini(c))
    return pd.Series(out, dtype="object")


def clean_extension(extension: Column) -> Column:
    """Without letter case, outer white space and the leading dot; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), _STRIP, ""), r"^\.", "")


def with_key(files: DataFrame, ordered: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``id, bucket, key`` of each record of ``files(id, extension, content)`` that has a letter or digit: one scan.

    With ``ordered`` the order of fields and settings counts in all formats.
    """
    base = files.select("id", clean_extension(F.col("extension")).alias("e"), "content").where(F.col("content").rlike(r"[\p{L}\p{N}]"))
    bare = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", "")
    if not ordered:
        structured = F.col("e").isin(*JSON_EXTENSIONS, *YAML_EXTENSIONS, *INI_EXTENSIONS)
        # Python sees structured texts only: for others its argument is null
        bare = F.when(structured, F.pandas_udf(ordered_text, StringType())("e", F.when(structured, F.col("content")))).otherwise(bare)
    key = F.unhex(F.md5(F.concat_ws("\x00", "e", bare).cast("binary")))
    return base.select("id", key.alias("key")).select("id", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key")


def aggregate_batch(keyed: DataFrame) -> DataFrame:
    """Counts and earliest representative of each key of a batch; Spark aggregates partially before the shuffle."""
    return keyed.groupBy("bucket", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def merge_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch: full outer join of matching buckets, counts added, the earliest kept."""
    a, b = ledger.alias("a"), batch.alias("b")
    joined = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key")), "full_outer")
    return joined.select(
        F.coalesce("a.bucket", "b.bucket").alias("bucket"),
        F.coalesce("a.key", "b.key").alias("key"),
        F.least("a.first_id", "b.first_id").alias("first_id"),
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; a filter on ``bucket`` reads only those folders."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Stores the buckets that ``ledger`` holds, each as a folder, in place of what was there; other buckets stay."""
    ledger.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def matching_buckets(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the stored ledger in the buckets that a batch touches: numbers below ``BUCKETS``, which the driver reads."""
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]
    return ledger.where(F.col("bucket").isin(touched))


def add_batch(path: str, files: DataFrame, ordered: bool = False) -> None:
    """Adds a batch of records to the ledger stored at ``path``, an empty one at first."""
    _store(path, checkpointed(aggregate_batch(with_key(files, ordered))))


def _store(path: str, batch: DataFrame) -> None:
    spark = batch.sparkSession
    if not _exists(spark, path):
        write_ledger(batch, path)
        return
    # the rows to store are complete before the folders they come from are replaced
    write_ledger(checkpointed(merge_ledger(matching_buckets(read_ledger(spark, path), batch), batch)), path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def survivors(files: DataFrame, batches: int = 2, ordered: bool = False) -> DataFrame:
    """``first_id, copies``: one surviving row for each record with its number of copies, by a ledger that takes ``files`` in batches."""
    _, merged = _last_merge(files, batches, ordered)
    return merged.select("first_id", "copies")


def _last_merge(files: DataFrame, batches: int, ordered: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their keys, and the ledger after the last batch of them.

    Batches are ranges of the id, as files with larger ids arrived later.  All
    but the last are stored; the last is merged with what is stored.
    """
    keyed = checkpointed(with_key(files, ordered))
    low, high = keyed.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return keyed, aggregate_batch(keyed)
    number = F.least(F.floor((F.col("id") - low) / ((high - low + 1) / batches)).cast("int"), F.lit(batches - 1))
    numbered = keyed.withColumn("_b", number)
    path = scratch(files.sparkSession, "ledger")
    for k in range(batches - 1):
        _store(path, checkpointed(aggregate_batch(numbered.where(F.col("_b") == k))))
    last = aggregate_batch(numbered.where(F.col("_b") == batches - 1))
    return keyed, last if batches == 1 else merge_ledger(read_ledger(files.sparkSession, path), last)


def copies(files: DataFrame, batches: int = 2, ordered: bool = False) -> DataFrame:
    """``first_id, id`` of each record that is a copy of an earlier one.

    Only keys with several records go to the join with the rows.  Hot keys are
    fewer than ``1 / HOT_SHARE``, so they are broadcast and their rows stay
    where they are; each other key has a small share of the rows.
    """
    keyed, merged = _last_merge(files, batches, ordered)
    rows = keyed.select("id", "key")
    hot = keyed.count() * HOT_SHARE
    repeated = merged.where(F.col("copies") > 1)
    cold = rows.join(repeated.where(F.col("copies") <= hot).select("key", "first_id"), "key")
    warm = rows.join(F.broadcast(repeated.where(F.col("copies") > hot).select("key", "first_id")), "key")
    return cold.unionByName(warm).where(F.col("id") != F.col("first_id")).select("first_id", "id")
