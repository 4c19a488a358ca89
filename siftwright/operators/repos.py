"""Cleaning and slicing of repository metadata."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Keys of the copyleft licences that a search asks for.
COPYLEFT = ("gpl-2.0", "gpl-3.0", "agpl-3.0", "cecill-1.0", "cecill-1.1", "cecill-2.0", "cecill-2.1", "cecill-c", "epl-1.0", "epl-2.0", "lgpl-2.1", "lgpl-3.0", "ms-rl", "mpl-2.0", "eupl-1.1", "eupl-1.2", "osl-3.0")
FIRST_MONTH, LAST_MONTH = date(2008, 1, 1), date(2024, 8, 1)
ZONE = "Europe/Amsterdam"


def keep_first(repos: DataFrame, order: list[Column], key: str = "id") -> DataFrame:
    """The first row of each key in the given order.  Aggregates partially before its shuffle, so a repeated key costs one row a task."""
    columns = repos.columns
    first = repos.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("r"))
    return first.select("r.*")


def clean(repos: DataFrame, language: str, order: list[Column]) -> DataFrame:
    """Repeated ids removed, then other languages.

    The order of the two steps is kept: if an id's first row has another
    language, a later row with the right one goes as well.
    """
    return keep_first(repos, order).where(F.lower("language") == language.lower())


def repeated_ids(repos: DataFrame) -> DataFrame:
    return repos.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def counts_by(repos: DataFrame, *keys: str) -> DataFrame:
    return repos.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def retrieved_at(text: Column) -> Column:
    """The instant (UTC wall time) of a US-style wall time with the zone's name behind it; null if it is none."""
    bare = F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")
    return F.to_utc_timestamp(F.try_to_timestamp(bare, F.lit("M/d/yyyy, h:mm:ss a")), ZONE)


def format_retrieved(instant: Column) -> Column:
    """The wall time that ``retrieved_at`` reads."""
    return F.concat(F.date_format(F.from_utc_timestamp(instant, ZONE), "M/d/yyyy, h:mm:ss a"), F.lit(f" ({ZONE})"))


def star_bucket(stars: Column) -> Column:
    """Lower bound of the star bucket: 900 and more; steps of 50 from 100, of 10 from 10, of 1 below."""
    return F.when(stars >= 900, 900).when(stars >= 100, stars - stars % 50).when(stars >= 10, stars - stars % 10).when(stars >= 0, stars)


def star_buckets() -> list[tuple[int, int | None]]:
    """All buckets, ``(low, high)``, from the most stars down; the first is open."""
    return [(900, None), *[(s, s + 49) for s in range(850, 99, -50)], *[(s, s + 9) for s in range(90, 9, -10)], *[(s, s) for s in range(9, -1, -1)]]


def _months() -> list[date]:
    out, d = [], FIRST_MONTH
    while d <= LAST_MONTH:
        out.append(d)
        d = date(d.year + d.month // 12, d.month % 12 + 1, 1)
    return out


def date_windows() -> list[tuple[date, date]]:
    """Closed windows that cover the months without gap: the first begins on a 1st, the others on a 2nd, and each ends on the next 1st."""
    months = _months()
    return [(a if k == 0 else a.replace(day=2), b) for k, (a, b) in enumerate(zip(months, months[1:]))]


def window_of(day: Column) -> Column:
    """Last day of the window that holds a date, or null outside all; computed, so that no range join is needed."""
    first = F.trunc(day, "month")
    end = F.when(first == day, day).otherwise(F.add_months(first, 1).cast("date"))
    end = F.when(day == F.lit(FIRST_MONTH), F.add_months(F.lit(FIRST_MONTH), 1)).otherwise(end)
    return F.when((day >= F.lit(FIRST_MONTH)) & (day <= F.lit(LAST_MONTH)), end)


def oversized(counts: DataFrame, most: int = 1000) -> DataFrame:
    """Buckets with so many hits that a search has to be cut further, by date windows."""
    return counts.where(F.col("n") >= most)


def windows_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(date_windows(), "low date, high date")


def buckets_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(star_buckets(), "low int, high int")


def copyleft(repos: DataFrame) -> DataFrame:
    return repos.where(F.col("license.key").isin(*COPYLEFT))


def quota(repos: DataFrame, least: int, most: int, order: list[Column]) -> DataFrame:
    """At most ``most - least + 1`` repositories that can be fetched, in order: a report of a wanted size, not a cap on work."""
    return repos.where(F.col("html_url").isNotNull()).orderBy(*order).limit(max(0, most - least + 1))


def numbered(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Dense numbers from 0 in the given order, without gathering all rows in one task.

    Rows are range-partitioned and sorted once; what comes out is written, as
    the bounds of ranges are sampled anew by each job.  Each row's place in its
    partition and the partitions' sizes, one row each, then give the number.
    Ties get different numbers in no particular order.  Give narrow rows, and
    join wide ones to them by a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"_o{k}") for k in range(len(order))]
    ranged = rows.select("*", *[o.alias(f"_o{k}") for k, o in enumerate(order)]).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the number holds the partition above its low 33 bits and the place within it below
    placed = checkpointed(ranged.withColumn("_m", F.monotonically_increasing_id()).drop(*[f"_o{k}" for k in range(len(order))]))
    placed = placed.select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition, so a window over all of them and a broadcast are bounded by the number of partitions
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_m", "_p", "_k", "_before")


def requeried(repos: DataFrame, most: int = 1000) -> DataFrame:
    """``bucket, last_day, n``: hits of each star bucket, where one that reaches ``most`` is cut further by date windows; ``last_day`` is null for the others.

    Repositories outside all windows are lost from a full bucket, as a search by date would lose them.  Buckets are 36, so their counts are broadcast.
    """
    bucketed = repos.withColumn("bucket", star_bucket(F.col("stargazers_count"))).where(F.col("bucket").isNotNull())
    full = bucketed.groupBy("bucket").agg((F.count(F.lit(1)) >= most).alias("full"))
    day = window_of(F.to_date(F.substring("created_at", 1, 10)))
    cut = bucketed.join(F.broadcast(full), "bucket").withColumn("last_day", F.when(F.col("full"), day)).where(~F.col("full") | F.col("last_day").isNotNull())
    return cut.groupBy("bucket", "last_day").agg(F.count(F.lit(1)).alias("n"))
