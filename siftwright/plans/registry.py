"""All queries of the engine over its tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import comments, text
from ..operators import exact, extensions, masks, near, repos
from ..session import checkpointed
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "extract_files")


def _endings(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return extensions.endings_to_languages(_table(spark, sf_dir, "langs_extension"))


# ---------------------------------------------------------------- SQL pieces
def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_strip(expression: str, patterns: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in patterns:
        expression = f"regexp_replace({expression}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return expression


_SPACES = f"[{text.SPACE}]+"


def _sql_normal(content: str, path: str) -> str:
    """Normal text under the languages of the tables: their families by ending, as the list of languages has them."""
    ending = rf"'.' || lower(regexp_replace({path}, '(?s)^.*\.', ''))"
    cases = " ".join(
        f"when {ending} in ({', '.join(map(_quoted, endings))}) then {_sql_strip(content, comments.PATTERNS[family])}"
        for family, endings in (("python", (".py", ".pyw")), ("c_like", (".js", ".jsx", ".java", ".jav", ".c", ".h", ".go")), ("ruby", (".rb", ".rake")), ("sql", (".sql", ".ddl")))
    )
    return f"coalesce(case when {path} is not null then regexp_replace(lower(case {cases} else {content} end), '{_SPACES}', '', 'g') end, '')"


_META_PATH = "regexp_extract(meta, '''path'': ''([^'']*)''', 1)"
_CORPORA = f"""own as materialized (select id, {_sql_normal('content', 'file_name')} as normal from extract_files),
a as materialized (select {_sql_normal('content', 'path')} as normal from foreign_a),
c as materialized (select {_sql_normal('"text"', f'case when meta is null then null else {_META_PATH} end')} as normal from foreign_c)"""


def _sql_bands(corpus: str) -> str:
    """CTEs of a corpus: classes, shingles, signature and bands."""
    family = near.permutations()
    mins = ", ".join(f"min(({a} * x + {b}) % {near.PRIME}) as h{k}" for k, (a, b) in enumerate(family))
    rest = ", ".join(f"coalesce(h{k}, {near.PRIME - 1}) as h{k}" for k in range(len(family)))
    bands, rows = near.band_shape()
    parts = " union all ".join(f"select key, {b} as band, md5(concat_ws(',', {', '.join(f'h{b * rows + r}' for r in range(rows))})) as band_key from {corpus}_sig" for b in range(bands))
    window = "(partition by key order by p)"
    chars = " || ".join(["ch", *[f"lead(ch, {k}) over {window}" for k in range(1, near.SHINGLE)]])
    return f"""{corpus}_cls as materialized (select distinct sha256(normal) as key, normal from {corpus}),
{corpus}_chr as (select key, unnest(string_split(normal, '')) as ch, generate_subscripts(string_split(normal, ''), 1) as p from {corpus}_cls),
{corpus}_shi as materialized (select distinct key, g from (select key, {chars} as g from {corpus}_chr) where g is not null),
{corpus}_min as (select key, {mins} from (select key, ('0x' || substr(sha256(g), 1, 8))::bigint as x from {corpus}_shi) group by key),
{corpus}_sig as materialized (select key, {rest} from {corpus}_cls left join {corpus}_min using (key)),
{corpus}_ban as materialized ({parts})"""


def _sql_near(corpus: str) -> str:
    return f"sha256(normal) in (select key from own_ban join (select distinct band, band_key from {corpus}_ban) using (band, band_key))"


def _sql_exact(corpus: str) -> str:
    return f"sha256(normal) in (select sha256(normal) from {corpus})"


# ---------------------------------------------------------------- corpora
def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.normal_corpus(_files(spark, sf_dir), _endings(spark, sf_dir))


def _foreign(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pipeline.normal_corpus(_table(spark, sf_dir, name), _endings(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near masks of all extracted files against both other corpora."""
    return combined_mask(spark, sf_dir)


@_query("norm_sha", f"with {_CORPORA} select id, sha256(normal) as sha from own")
def norm_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("id", "sha")


@_query("distinct_hashes", f"with {_CORPORA} select distinct sha256(normal) as sha from own")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.distinct_hashes(_own(spark, sf_dir))


@_query("hash_intersect", f"with {_CORPORA} select sha256(normal) as sha from own intersect select sha256(normal) from a")
def hash_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.common_hashes(_own(spark, sf_dir), _foreign(spark, sf_dir, "foreign_a"))


@_query("hash_except", f"with {_CORPORA} select sha256(normal) as sha from own except select sha256(normal) from a")
def hash_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.own_hashes(_own(spark, sf_dir), _foreign(spark, sf_dir, "foreign_a"))


@_query("hash_union", f"with {_CORPORA} select distinct sha256(normal) as sha from own union all select distinct sha256(normal) from a")
def hash_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.distinct_hashes(_own(spark, sf_dir)).unionByName(exact.distinct_hashes(_foreign(spark, sf_dir, "foreign_a")))


@_query("exact_mask", f"with {_CORPORA} select id, {_sql_exact('a')} as exact_duplicates_a, {_sql_exact('c')} as exact_duplicates_c from own")
def exact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _own(spark, sf_dir).select("id", "sha")
    for name in ("a", "c"):
        own = exact.exact_mask(own, _foreign(spark, sf_dir, f"foreign_{name}"), name)
    return own.drop("sha")


@_query("self_keep_first", f"with {_CORPORA} select min(id) as id, sha256(normal) as sha from own group by normal")
def self_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.keep_first(_own(spark, sf_dir).select("id", "sha"), "id")


# ---------------------------------------------------------------- near duplicates
@_query("shingles_distinct", f"with {_CORPORA}, {_sql_bands('a')} select key, count(g) as n from a_cls left join a_shi using (key) group by key")
def shingles_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near.keyed(_foreign(spark, sf_dir, "foreign_a"))
    return rows.select("key", F.size(near.shingles(F.col("text"))).cast("bigint").alias("n")).distinct()


_HASH_64 = " || ".join(f"substr(sha256(g), {k}, 2)" for k in range(15, 0, -2))


@_query("shingle_hash", f"with {_CORPORA}, {_sql_bands('a')} select key, min({_HASH_64}) as least, max({_HASH_64}) as most from a_shi group by key")
def shingle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the largest 64-bit hash of each text's shingles."""
    rows = near.keyed(_foreign(spark, sf_dir, "foreign_a"))
    hashes = rows.select("key", F.transform(near.shingles(F.col("text")), text.hash_64).alias("h")).where(F.size("h") > 0)
    return hashes.select("key", F.array_min("h").alias("least"), F.array_max("h").alias("most")).distinct()


@_query("minhash_sig", f"with {_CORPORA}, {_sql_bands('own')} select key, md5(concat_ws(',', {', '.join(f'h{k}' for k in range(near.PERMUTATIONS))})) as digest from own_sig")
def minhash_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = near.signatures(near.keyed(_own(spark, sf_dir)))
    return near.signed_alike(signed).select("key", F.col("alike").alias("digest")).distinct()


@_query("lsh_bands", f"with {_CORPORA}, {_sql_bands('a')} select band, band_key, key from a_ban")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.band_index(_foreign(spark, sf_dir, "foreign_a"))


@_query("lsh_candidates", f"with {_CORPORA}, {_sql_bands('own')}, {_sql_bands('a')} select distinct o.key, t.key as other_key from own_ban o join a_ban t on o.band = t.band and o.band_key = t.band_key")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = (checkpointed(near.classes(c)) for c in (_own(spark, sf_dir), _foreign(spark, sf_dir, "foreign_a")))
    return near.candidates(own, other)


@_query(
    "near_verified",
    f"""with {_CORPORA}, {_sql_bands('own')}, {_sql_bands('a')},
pairs as materialized (select distinct o.key, t.key as other_key from own_ban o join a_ban t on o.band = t.band and o.band_key = t.band_key),
own_n as (select key, count(*) as n from own_shi group by key), a_n as (select key, count(*) as n from a_shi group by key),
both_n as (select p.key, p.other_key, count(*) as n from pairs p join own_shi s on s.key = p.key join a_shi t on t.key = p.other_key and t.g = s.g group by all)
select b.key, b.other_key, round(b.n::double / (o.n + t.n - b.n), 9) as similarity
from both_n b join own_n o on o.key = b.key join a_n t on t.key = b.other_key where b.n::double / (o.n + t.n - b.n) >= {near.THRESHOLD}""",
)
def near_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = near.keyed(_own(spark, sf_dir)), near.keyed(_foreign(spark, sf_dir, "foreign_a"))
    signed = (checkpointed(near.signatures(rows).distinct()) for rows in (own, other))
    pairs = checkpointed(near.candidates(*signed))
    return near.verified(pairs, own, other).withColumn("similarity", F.round("similarity", 9))


@_query("near_mask", f"with {_CORPORA}, {_sql_bands('own')}, {_sql_bands('a')} select id, {_sql_near('a')} as near_duplicates_a from own")
def near_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _own(spark, sf_dir).select("id", "normal")
    keys = near.near_keys(pipeline.band_index(own), pipeline.band_index(_foreign(spark, sf_dir, "foreign_a")))
    return near.near_mask(own, keys, "a").select("id", "near_duplicates_a")


_FLAGS = ", ".join(f"{f(c)} as {kind}_duplicates_{c}" for c in ("a", "c") for kind, f in (("exact", _sql_exact), ("near", _sql_near)))
_ALL_BANDS = f"{_CORPORA}, {_sql_bands('own')}, {_sql_bands('a')}, {_sql_bands('c')}"


@_query("combined_mask", f"with {_ALL_BANDS} select id, {_FLAGS} from own")
def combined_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = {n: _table(spark, sf_dir, f"foreign_{n}") for n in ("a", "c")}
    own = _files(spark, sf_dir).select("id", "content", "file_name")
    return pipeline.masked(own, others, _table(spark, sf_dir, "langs_extension")).select("id", *[f"{kind}_duplicates_{c}" for c in ("a", "c") for kind in ("exact", "near")])


@_query("clean_filter", f"with {_ALL_BANDS} select id from own where not ({' or '.join(f(c) for c in ('a', 'c') for f in (_sql_exact, _sql_near))})")
def clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.clean(combined_mask(spark, sf_dir), ["a", "c"]).select("id")


# ---------------------------------------------------------------- comments
def _strip_query(family: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir).where(F.col("content").isNotNull())
        return files.select("id", F.md5(comments.strip_comments(F.col("content"), family)).alias("digest"))

    return run


def _sql_nested(opening: str, closing: str, rest: tuple[tuple[str, str], ...]) -> str:
    marks = "".join("\\" + c for c in dict.fromkeys(opening + closing[1]))
    o, c = ("".join("\\" + x for x in s) for s in (opening, closing))
    tokens = f"regexp_extract_all(content, {_quoted(f'{o}|{c}|[^{marks}]+|[{marks}]')})"
    return f"""with t as (select id, unnest({tokens}) as tok, generate_subscripts({tokens}, 1) as pos from extract_files where content is not null),
d as (select *, sum(case tok when {_quoted(opening)} then 1 when {_quoted(closing)} then -1 else 0 end) over (partition by id order by pos) as depth from t),
k as (select id, string_agg(tok, '' order by pos) filter (where depth <= 0 and tok <> {_quoted(closing)}) as kept from d group by id)
select f.id, md5({_sql_strip("coalesce(k.kept, '')", rest)}) as digest from extract_files f left join k on k.id = f.id where f.content is not null"""


for _family, _patterns in comments.PATTERNS.items():
    _query(f"strip_{_family}", f"select id, md5({_sql_strip('content', _patterns)}) as digest from extract_files where content is not null")(_strip_query(_family))
for _family, (_opening, _closing, _rest) in comments.NESTED.items():
    _query(f"strip_{_family}", _sql_nested(_opening, _closing, _rest))(_strip_query(_family))


# ---------------------------------------------------------------- texts, paths and endings
_LINE = f"regexp_matches(x, '[^{text.SPACE}]')"


@_query(
    "line_stats",
    f"""with l as (select id, unnest(string_split(content, chr(10))) as x from extract_files where content is not null),
s as (select id, count(*) as n, sum(length(regexp_replace(x, '^{_SPACES}|{_SPACES}$', '', 'g'))) as inner_, sum(length(x)) as whole, max(length(x)) as longest, sum(length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) as alnum from l where {_LINE} group by id)
select f.id, coalesce(n, 0) as total_lines, round(inner_::double / n, 9) as avg_line_length, coalesce(longest, 0) as max_line_length, round(alnum::double / whole, 9) as alphanum_fraction
from extract_files f left join s using (id) where content is not null""",
)
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = text.line_stats(F.col("content"))
    rounded = {n: F.round(c, 9) if n in ("avg_line_length", "alphanum_fraction") else c for n, c in stats.items()}
    return _files(spark, sf_dir).where(F.col("content").isNotNull()).select("id", *[c.alias(n) for n, c in rounded.items()])


@_query("min_words", f"select id from extract_files where len(regexp_extract_all(content, '[^{text.SPACE}]+')) >= 10")
def min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(text.word_count(F.col("content")) >= 10).select("id")


@_query("size_filter", "select id from extract_files where strlen(content) < 10000000")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(F.octet_length("content") < 10_000_000).select("id")


@_query("path_ext", r"""select id, '.' || lower(regexp_replace(file_path, '(?s)^.*\.', '')) as ext, regexp_replace(file_path, '(?s)^.*/', '') as base,
case when regexp_matches(regexp_replace(file_path, '(?s)^.*/', ''), '(?s)^.+\.[^.]*$') and not regexp_matches(regexp_replace(file_path, '(?s)^.*/', ''), '(?s)^\.+[^.]*$')
then regexp_replace(regexp_replace(file_path, '(?s)^.*/', ''), '(?s)\.[^.]*$', '') else regexp_replace(file_path, '(?s)^.*/', '') end as stem from extract_files""")
def path_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return _files(spark, sf_dir).select("id", text.path_extension(path).alias("ext"), text.base_name(path).alias("base"), text.base_stem(path).alias("stem"))


@_query("ext_theta", "select id, e as matched from extract_files, (select unnest(extensions) as e from langs_extension) where regexp_matches(file_name, '.*' || e)")
def ext_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.matching_endings(_files(spark, sf_dir).select("id", "file_name"), list(_endings(spark, sf_dir))).select("id", "matched")


@_query("ext_langs", r"""with p as (select ordinal, name, unnest(extensions) as e from langs_extension), g as (select e, string_agg(name, ',' order by ordinal) as langs from p group by e)
select id, coalesce(langs, '') as langs from (select id, '.' || lower(regexp_replace(file_name, '(?s)^.*\.', '')) as ext from extract_files) left join g on e = ext""")
def ext_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("id", text.path_extension(F.col("file_name")).alias("ext"))
    return extensions.with_languages(files, _table(spark, sf_dir, "langs_extension")).select("id", F.array_join("langs", ",").alias("langs"))


@_query("meta_path", f"""select md5(coalesce("text", '')) as digest, case when meta is null then null else {_META_PATH} end as path from foreign_c""")
def meta_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _table(spark, sf_dir, "foreign_c")
    return other.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), exact.path_column(other).alias("path"))


@_query("content_resolve", """select 'a' as corpus, md5(content) as digest from foreign_a union all select 'c', md5("text") from foreign_c""")
def content_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = _table(spark, sf_dir, "foreign_a"), _table(spark, sf_dir, "foreign_c")
    both = [t.select(F.lit(n).alias("corpus"), F.md5(exact.content_column(t, order)).alias("digest")) for n, t, order in (("a", a, exact.CONTENT_FOR_HASH), ("c", c, exact.CONTENT_FOR_INDEX))]
    return both[0].unionByName(both[1])


@_query("file_numbers", "select id, row_number() over (order by coalesce(repo_name, ''), id) - 1 as row_idx from extract_files")
def file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("id", "repo_name")
    return repos.numbered(files, [F.coalesce("repo_name", F.lit("")), F.col("id")], "row_idx").select("id", F.col("row_idx").cast("bigint").alias("row_idx"))


# ---------------------------------------------------------------- repositories
def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "repos")


_SQL_TIME = r"strptime(regexp_replace(retrieval_date, '\s*\([^)]*\)\s*$', ''), '%-m/%-d/%Y, %-I:%M:%S %p')"
_ORDER = ("stargazers_count", "forks_count", "watchers_count", "open_issues_count", "language", "html_url", "pushed_at", "full_name")


def _crawl_order() -> list[Column]:
    return [repos.retrieved_at(F.col("retrieval_date")), *map(F.col, _ORDER)]


_SQL_FIRST = f"select * from repos qualify row_number() over (partition by id order by {_SQL_TIME} nulls first, {', '.join(f'{c} nulls first' for c in _ORDER)}) = 1"


@_query("repo_dedup_lang", f"select id, full_name, language from ({_SQL_FIRST}) where lower(language) = 'javascript'")
def repo_dedup_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.clean(_repos(spark, sf_dir), "JavaScript", _crawl_order()).select("id", "full_name", "language")


@_query("repo_counts", "select lower(language) as lang, count(*) as n from repos group by 1")
def repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.counts_by(_repos(spark, sf_dir).withColumn("lang", F.lower("language")), "lang")


@_query("dup_ids", "select id, count(*) as n from repos group by id having count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.repeated_ids(_repos(spark, sf_dir))


@_query("repo_dates", f"select id, retrieval_date, strftime(timezone('UTC', timezone('Europe/Amsterdam', {_SQL_TIME})), '%Y-%m-%d %H:%M:%S') as retrieved_at from repos")
def repo_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repos(spark, sf_dir).select("id", "retrieval_date", F.date_format(repos.retrieved_at(F.col("retrieval_date")), "yyyy-MM-dd HH:mm:ss").alias("retrieved_at"))


@_query("star_buckets", "select case when s >= 900 then 900 when s >= 100 then s - s % 50 when s >= 10 then s - s % 10 when s >= 0 then s end as bucket, count(*) as n from (select stargazers_count as s from repos) group by 1")
def star_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.counts_by(_repos(spark, sf_dir).withColumn("bucket", repos.star_bucket(F.col("stargazers_count"))), "bucket")


@_query(
    "date_windows",
    f"""with m as (select unnest(generate_series(date '{repos.FIRST_MONTH}', date '{repos.LAST_MONTH}' - interval 1 month, interval 1 month))::date as d),
w as (select case when d = date '{repos.FIRST_MONTH}' then d else d + 1 end as low, (d + interval 1 month)::date as high from m),
r as (select substr(created_at, 1, 10)::date as day from repos where created_at is not null)
select cast(high as varchar) as last_day, count(*) as n from r join w on day between low and high group by 1""",
)
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.substring("created_at", 1, 10))
    windowed = _repos(spark, sf_dir).withColumn("last_day", repos.window_of(day).cast("string")).where(F.col("last_day").isNotNull())
    return repos.counts_by(windowed, "last_day")


@_query("license_filter", f"select id, license.key as license_key from repos where license.key in ({', '.join(map(_quoted, repos.COPYLEFT))})")
def license_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.copyleft(_repos(spark, sf_dir)).select("id", F.col("license.key").alias("license_key"))


@_query("url_filter", "select id, html_url from repos where html_url is not null")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repos(spark, sf_dir).where(F.col("html_url").isNotNull()).select("id", "html_url")


@_query("file_repos", f"select f.id, f.repo_name, r.stars, r.spdx_id from extract_files f left join (select full_name, stargazers_count as stars, license.spdx_id as spdx_id from ({_SQL_FIRST})) r on r.full_name = f.repo_name")
def file_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of repositories joined to their files; Spark broadcasts the smaller side only if it measures it to be small."""
    first = repos.keep_first(_repos(spark, sf_dir), _crawl_order()).select(F.col("full_name").alias("repo_name"), F.col("stargazers_count").alias("stars"), F.col("license.spdx_id").alias("spdx_id"))
    return _files(spark, sf_dir).select("id", "repo_name").join(first, "repo_name", "left").select("id", "repo_name", "stars", "spdx_id")


def queries() -> dict[str, Query]:
    from . import stored  # noqa: F401  registers its queries, which are built from those here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stored  # noqa: F401

    return dict(_SQL)
