"""Top-N per group and whole-table top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

NO_TIME_US = 4 * 10**18  # after every time there is
HOUR_US, SECOND_US = 3_600_000_000, 1_000_000


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of each group; ``order`` must be total so that ties are settled.

    Catalyst turns the row-number filter into a window group limit below the shuffle, so a group that
    holds a third of the rows is cut to ``n`` rows per input split first.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def oldest_instances(instances: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest instances of each region, ties by identifier."""
    order = [F.asc("creation_us"), F.asc("identifier"), F.asc("resource_id")]
    return top_n_per_group(instances, ["region"], order, n, "age_rank")


def _edge(sizes: DataFrame, within: Sequence[str], bucket: str) -> DataFrame:
    """The buckets, one per group of ``within``, in which the quota ``left`` runs out, with what is left of it there.

    Only counts are ordered; callers choose levels with a bounded number of buckets in a group.
    """
    ahead = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    reached = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    found = reached.filter((F.col("ahead") < F.col("left")) & (F.col("ahead") + F.col("n") >= F.col("left")))
    return found.select(*within, bucket, (F.col("left") - F.col("ahead")).alias("left"))


def earliest_k(df: DataFrame, time_us: str, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows with the smallest time, ties in the order of the md5 of the key; rows without a time come last.

    However large ``k`` is, its rows never meet in one task: counts per hour and second, then per microsecond and
    prefix of the md5 within the one second in which the quota runs out, give the exact cut, a single row. All rows
    before it are a filter. Only the rows of that prefix and microsecond, a 4,096th of those of one time, are ordered.
    The rows are read four times, so give a stored table. Fewer than ``k`` rows are all returned.
    """
    if k <= 0:
        return df.limit(0)
    tie = F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys]))
    time = F.coalesce(F.col(time_us), F.lit(NO_TIME_US))
    second = time - F.pmod(time, F.lit(SECOND_US))
    rows = df.withColumns({"_hour": second - F.pmod(second, F.lit(HOUR_US)), "_second": second, "_time": time, "_prefix": F.substring(tie, 1, 3)})

    seconds = rows.groupBy("_hour", "_second").agg(F.count(F.lit(1)).alias("n"))
    hours = seconds.groupBy("_hour").agg(F.sum("n").alias("n")).withColumn("left", F.lit(k).cast("bigint"))
    hour = _edge(hours, [], "_hour")
    at = _edge(seconds.join(hour, "_hour"), ["_hour"], "_second")
    cells = rows.join(at, ["_hour", "_second"]).groupBy("_time", "_prefix").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    times = cells.groupBy("_time").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    moment = _edge(times, [], "_time")
    cut = _edge(cells.drop("left").join(moment, "_time"), ["_time"], "_prefix")

    edge = cut.select(F.lit(1).alias("_one"), F.col("_time").alias("_cut_time"), F.col("_prefix").alias("_cut_prefix"), "left")
    marked = rows.withColumn("_one", F.lit(1)).join(F.broadcast(edge), "_one", "left")  # one row, or none
    same_time = F.col("_time") == F.col("_cut_time")
    before = F.col("_cut_time").isNull() | (F.col("_time") < F.col("_cut_time")) | (same_time & (F.col("_prefix") < F.col("_cut_prefix")))
    number = F.row_number().over(Window.partitionBy("_time", "_prefix").orderBy(tie))
    last = marked.filter(same_time & (F.col("_prefix") == F.col("_cut_prefix"))).withColumn("_number", number).filter("_number <= left")
    return marked.filter(before).select(*df.columns).unionByName(last.select(*df.columns))
