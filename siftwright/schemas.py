"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

LICENSE = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "name", "spdx_id", "url", "node_id")])

#: A repository as its search returns it.
REPO = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("html_url", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in ("stargazers_count", "forks_count", "watchers_count", "open_issues_count")],
        *[T.StructField(n, T.StringType()) for n in ("language", "created_at", "pushed_at")],
        T.StructField("license", LICENSE),
        T.StructField("retrieval_date", T.StringType()),
    ]
)

#: A source file extracted from a repository, with statistics of its text.
FILE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("file_name", "file_path", "content")],
        T.StructField("size", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("language", "extension")],
        T.StructField("total_lines", T.LongType()),
        T.StructField("avg_line_length", T.DoubleType()),
        T.StructField("max_line_length", T.LongType()),
        T.StructField("alphanum_fraction", T.DoubleType()),
        T.StructField("repo_name", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in ("repo_stars", "repo_forks", "repo_open_issues")],
        *[T.StructField(n, T.StringType()) for n in ("repo_license", "repo_extraction_date")],
    ]
)

#: A list of languages with the endings of their files; the order matters.
EXTENSIONS = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("extensions", T.ArrayType(T.StringType()))])
