"""Queries that write tables, files, pages or streams and read them again; their SQL is over what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import exact, extract, near, repos
from ..session import checkpointed, scratch, spread
from ..sources import pages, tables, trees
from ..streaming import incremental
from . import pipeline, registry
from .registry import _ALL_BANDS, _CORPORA, _ORDER, _SQL_FIRST, _SQL_TIME, _crawl_order, _endings, _files, _foreign, _own, _query, _repos, _sql_bands, _sql_exact, _sql_near, _sql_normal, _table

_SQL_ORDER = f"{_SQL_TIME} nulls first, {', '.join(f'{c} nulls first' for c in _ORDER)}"
_HIT = "id, full_name, language, stargazers_count, license.key as license_key"


# ---------------------------------------------------------------- searches and repository lists
def _saved_pages(spark: SparkSession, sf_dir: str) -> str:
    """Pages of a search that found all repositories, by id."""
    path = scratch(spark, "pages")
    tables.write_repo_arrays(repos.numbered(_repos(spark, sf_dir), [F.col("id"), *_crawl_order()], "n"), path, "n", pages.PAGE_SIZE, '{"items":[', "]}")
    spark.dataSource.register(pages.RepositoryPages)
    return path


def _hits(found: DataFrame) -> DataFrame:
    return found.select("id", "full_name", "language", "stargazers_count", F.col("license.key").alias("license_key"))


@_query("repo_pages", f"select {_HIT} from repos")
def repo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all saved pages of a search."""
    return _hits(spark.read.format("repository_pages").load(_saved_pages(spark, sf_dir)))


@_query("repo_pages_limit", f"select {_HIT} from repos order by id, {_SQL_ORDER} limit 110")
def repo_pages_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search ended after a wanted number of hits, in the midst of a page."""
    return _hits(spark.read.format("repository_pages").option("limit", 110).load(_saved_pages(spark, sf_dir)))


@_query("search_pause", "select id, greatest(0.0, epoch(pushed_at::timestamptz) - epoch(created_at::timestamptz))::double + 7.5 as seconds from repos")
def search_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pause rule over two columns of instants."""
    instant = lambda c: F.unix_seconds(F.try_to_timestamp(F.col(c)))
    return _repos(spark, sf_dir).select("id", pages.pause_column(instant("pushed_at"), instant("created_at")).alias("seconds"))


_FIELDS = ("id", "full_name", "html_url", "stargazers_count", "forks_count", "watchers_count", "open_issues_count", "language", "created_at", "pushed_at", "license", "retrieval_date")


@_query("repo_json_lines", f"select id, coalesce(language, '') as lang, {' + '.join(f'({c} is not null)::bigint' for c in _FIELDS)} as fields from repos")
def repo_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository lists as JSON, where null fields are left out."""
    path = scratch(spark, "repos")
    tables.write_repos(_repos(spark, sf_dir), path)
    lines = spark.read.schema("value string, lang string").text(path)
    return lines.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.size(F.json_object_keys("value")).cast("bigint").alias("fields"))


@_query("repo_file_order", f"select id, full_name, language, stargazers_count from ({_SQL_FIRST}) where lower(language) = 'python'")
def repo_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as JSON arrays and cleaned in the order of their files."""
    path = scratch(spark, "lists")
    tables.write_repo_arrays(repos.numbered(_repos(spark, sf_dir), _crawl_order(), "n"), path, "n", 1000)
    listed = tables.read_repos(spark, path)
    return repos.clean(listed, "Python", [F.col("_file"), F.col("_pos")]).select("id", "full_name", "language", "stargazers_count")


@_query("repo_quota", f"select id, full_name, stargazers_count from ({_SQL_FIRST}) where html_url is not null order by stargazers_count desc nulls last, id limit 10")
def repo_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most starred repositories up to a quota."""
    first = repos.keep_first(_repos(spark, sf_dir), _crawl_order())
    return repos.quota(first, 0, 9, [F.desc_nulls_last("stargazers_count"), F.col("id")]).select("id", "full_name", "stargazers_count")


@_query(
    "full_buckets",
    f"""with m as (select unnest(generate_series(date '{repos.FIRST_MONTH}', date '{repos.LAST_MONTH}' - interval 1 month, interval 1 month))::date as d),
w as (select case when d = date '{repos.FIRST_MONTH}' then d else d + 1 end as low, (d + interval 1 month)::date as high from m),
r as (select case when s >= 900 then 900 when s >= 100 then s - s % 50 when s >= 10 then s - s % 10 when s >= 0 then s end as bucket, try_cast(substr(created_at, 1, 10) as date) as day from (select stargazers_count as s, created_at from repos)),
c as (select bucket, count(*) as n from r where bucket is not null group by bucket)
select bucket, null as last_day, n from c where n < 10 union all
select r.bucket, cast(high as varchar), count(*) from r join c on c.bucket = r.bucket and c.n >= 10 join w on day between low and high group by 1, 2""",
)
def full_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star buckets, those with 10 hits or more cut by date windows."""
    return repos.requeried(_repos(spark, sf_dir), 10).select("bucket", F.col("last_day").cast("string").alias("last_day"), "n")


# ---------------------------------------------------------------- corpora, hashes and indexes
@_query("corpus_partitions", "select id, language, md5(content) as digest from extract_files where contains(language, 'a')")
def corpus_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written by language, of which only some languages' folders are read."""
    path = scratch(spark, "corpus")
    tables.write_corpus(_files(spark, sf_dir), path)
    chosen = tables.languages_in(spark, path, "a")
    return tables.read_files(spark, path).where(F.col("language").isin(*chosen)).select("id", "language", F.md5("content").alias("digest"))


@_query("corpus_languages", "select language, row_number() over (order by language) - 1 as place from (select distinct language from extract_files where contains(language, 'a'))")
def corpus_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a corpus' parts that contain a text, in order."""
    path = scratch(spark, "corpus")
    tables.write_corpus(_files(spark, sf_dir), path)
    return spark.createDataFrame(list(zip(tables.languages_in(spark, path, "a"), range(10**6))), "language string, place bigint")


@_query("hash_text", f"with {_CORPORA} select sha256(normal) as sha, count(*) as n from own group by 1")
def hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes written one a line and read again."""
    path = scratch(spark, "hashes")
    tables.write_hashes(_own(spark, sf_dir), path)
    return tables.read_hashes(spark, path).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))


@_query("sorted_hashes", f"with {_CORPORA} select sha, row_number() over (order by sha) - 1 as place from (select distinct sha256(normal) as sha from own)")
def sorted_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes with their places in the whole order."""
    return repos.numbered(exact.distinct_hashes(_own(spark, sf_dir)), [F.col("sha")], "place").select("sha", F.col("place").cast("bigint").alias("place"))


@_query("band_table", f"with {_ALL_BANDS} select distinct key from own_ban join (select distinct band, band_key from (select * from a_ban union all select * from c_ban)) using (band, band_key)")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own classes that share a band with another corpus, from a stored table of bands."""
    path = scratch(spark, "bands")
    name, buckets = path.rsplit("/", 1)[1].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.write_bands(pipeline.band_index(_own(spark, sf_dir)), name, path, buckets)
    others = [pipeline.band_index(_foreign(spark, sf_dir, f"foreign_{c}")) for c in ("a", "c")]
    return near.near_keys(tables.open_bands(spark, name, path, buckets), others[0].unionByName(others[1]))


@_query("index_order", f"""select id, sha256({_sql_normal('language', 'file_name')}) as sha, sha256({_sql_normal('content', 'file_name')}) as near_key from extract_files""")
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus with both ``text`` and ``code``: hashes take the former, the index the latter."""
    both = _files(spark, sf_dir).select("id", F.col("language").alias("text"), F.col("content").alias("code"), F.col("file_name").alias("path"))
    endings = _endings(spark, sf_dir)
    return pipeline.for_index(pipeline.normal_corpus(both, endings), endings).select("id", "sha", "near_key")


# ---------------------------------------------------------------- files
_BARE = r"regexp_replace(content, '^\x{FEFF}', '')"


def _raw(content: Column, number: Column) -> Column:
    """Bytes of a text, by turns as UTF-8 with and without a mark, UTF-16 with a mark, and a legacy encoding where that can be told from UTF-8."""
    plain = F.encode(content, "UTF-8")
    latin = F.encode(F.regexp_replace(content, r"[^\x00-\x7f\xa0-\xff]", ""), "ISO-8859-1")
    legacy = ~content.rlike(r"[^\x00-\x7f\xa0-\xff]") & ~F.is_valid_utf8(latin.cast("string")) & ~F.startswith(latin, F.lit(b"\xff\xfe")) & ~F.startswith(latin, F.lit(b"\xfe\xff"))
    own_mark = F.startswith(content, F.lit("﻿"))
    return F.when(own_mark, plain).when(number % 4 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), plain)).when(number % 4 == 2, F.encode(content, "UTF-16")).when(legacy, latin).otherwise(plain)


@_query("decode_files", f"select id, md5({_BARE}) as digest from extract_files")
def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded in several ways and decoded again."""
    return _files(spark, sf_dir).select("id", F.md5(extract.decoded(_raw(F.col("content"), F.col("id")))).alias("digest"))


#: A file alone in its folder takes 8 kB of disk or more, so trees of over LOT_FILES files are made, read and removed in up to MOST_LOTS lots of repositories.
LOT_FILES, MOST_LOTS = 20_000, 6
_SAFE = "'f' || regexp_replace(coalesce(file_name, ''), '[^A-Za-z0-9._-]', '_', 'g')"


@_query(
    "extract_tree",
    f"""with f as (select id, repo_name, {_SAFE} as file_name, {_BARE} as content from extract_files where content is not null),
r as (select full_name, stargazers_count, license.spdx_id as spdx_id from ({_SQL_FIRST}) where license is not null and html_url is not null),
e as (select unnest(extensions) as extension from langs_extension where name = 'Python'),
l as (select id, unnest(string_split(content, chr(10))) as x from f),
s as (select id, count(*) as n, max(length(x)) as longest from l where {registry._LINE} group by id)
select f.id, f.file_name, e.extension, f.repo_name, r.stargazers_count as repo_stars, r.spdx_id as repo_license, md5(content) as digest, n as total_lines, longest as max_line_length
from f join r on r.full_name = f.repo_name join e on regexp_matches(f.file_name, '.*' || extension) join s on s.id = f.id
where len(regexp_extract_all(content, '[^{text.SPACE}]+')) >= 10""",
)
def extract_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as trees of repositories, read as bytes and extracted for one language, some repositories at a time."""
    files = _files(spark, sf_dir)
    lots = min(MOST_LOTS, max(1, -(-files.count() // LOT_FILES)))
    files = files.where(F.col("content").isNotNull()).withColumn("_lot", F.pmod(F.xxhash64("repo_name"), F.lit(lots)))
    first = checkpointed(repos.keep_first(_repos(spark, sf_dir), _crawl_order()))
    languages, out = _table(spark, sf_dir, "langs_extension"), scratch(spark, "extracted")
    for lot in range(lots):
        root = scratch(spark, "tree")
        plain_root = root.removeprefix("file:").replace("//", "/") if root.startswith("file:") else root
        extract.write_tree(_raw_files(spread(files.where(F.col("_lot") == lot))), plain_root)
        found = extract.extract(tables.walk_tree(spark, plain_root), first, languages, plain_root, "Python")
        number = F.element_at(F.split("file_path", "/"), 2).cast("bigint")
        found.select(number.alias("id"), "file_name", "extension", "repo_name", "repo_stars", "repo_license", F.md5("content").alias("digest"), "total_lines", "max_line_length").write.mode("append").parquet(out)
        extract.remove_tree(spark, plain_root)
    return spark.read.parquet(out)


def _raw_files(files: DataFrame) -> DataFrame:
    """Paths in a tree of repositories, with a folder for each file as names are not unique, and the bytes to write there."""
    safe = F.concat(F.lit("f"), F.regexp_replace(F.coalesce("file_name", F.lit("")), "[^A-Za-z0-9._-]", "_"))
    return files.select(F.concat_ws("/", text.repo_folder(F.col("repo_name")), F.col("id").cast("string"), safe).alias("file_path"), _raw(F.col("content"), F.col("id")).alias("raw"))


@_query("tree_list", f"select id, {_SAFE} as file_name from extract_files where content is not null")
def tree_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files below a folder, without their contents."""
    root = scratch(spark, "tree")
    safe = F.concat(F.lit("f"), F.regexp_replace(F.coalesce("file_name", F.lit("")), "[^A-Za-z0-9._-]", "_"))
    rows = _files(spark, sf_dir).where(F.col("content").isNotNull()).select(F.concat_ws("/", F.col("id").cast("string"), safe).alias("file_path"), F.encode("content", "UTF-8").alias("raw"))
    extract.write_tree(rows, root.removeprefix("file:"))
    parts = F.split("path", "/")
    return tables.list_tree(spark, root).select(F.element_at(parts, -2).cast("bigint").alias("id"), F.element_at(parts, -1).alias("file_name"))


@_query("tree_hidden", f"select id, '.' || {_SAFE} as file_name, strlen(content)::bigint as length, md5(content) as digest from extract_files where strlen(content) < 3000")
def tree_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with hidden files, those of 3,000 bytes and more left out unopened."""
    root = scratch(spark, "tree")
    safe = F.concat(F.lit(".f"), F.regexp_replace(F.coalesce("file_name", F.lit("")), "[^A-Za-z0-9._-]", "_"))
    rows = _files(spark, sf_dir).where(F.col("content").isNotNull()).select(F.concat_ws("/", text.repo_folder(F.col("repo_name")), F.col("id").cast("string"), safe).alias("file_path"), F.encode("content", "UTF-8").alias("raw"))
    extract.write_tree(rows, root.removeprefix("file:"))
    spark.dataSource.register(trees.RepositoryTrees)
    found, parts = spark.read.format("repository_trees").option("most_bytes", 3000).load(root), F.split("path", "/")
    return found.select(F.element_at(parts, -2).cast("bigint").alias("id"), F.element_at(parts, -1).alias("file_name"), "length", F.md5("content").alias("digest"))


# ---------------------------------------------------------------- streams
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stream reads what a pattern finds, or folders
    return spark.readStream.schema(_files(spark, sf_dir).schema).parquet(f"{sf_dir}/extract_files*.parquet").select("id", "content", "file_name")


@_query("stream_exact", f"with {_CORPORA} select id, {_sql_exact('a')} as exact_duplicates_a from own")
def stream_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact masks of a stream of files."""
    out = scratch(spark, "stream")
    known = exact.distinct_hashes(_foreign(spark, sf_dir, "foreign_a"))
    incremental.flag_exact(_stream(spark, sf_dir), known, _endings(spark, sf_dir), "a", f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "exact_duplicates_a")


@_query("stream_near", f"with {_CORPORA}, {_sql_bands('own')}, {_sql_bands('a')} select id, {_sql_near('a')} as near_duplicates_a from own")
def stream_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near masks of a stream of files against a stored table of bands."""
    out = scratch(spark, "stream")
    name, buckets = out.rsplit("/", 1)[1].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.write_bands(pipeline.band_index(_foreign(spark, sf_dir, "foreign_a")), name, f"{out}/bands", buckets)
    known = tables.open_bands(spark, name, f"{out}/bands", buckets)
    incremental.flag_near(_stream(spark, sf_dir), known, _endings(spark, sf_dir), "a", f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "near_duplicates_a")
