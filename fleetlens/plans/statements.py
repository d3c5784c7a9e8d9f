"""Statement statistics of both engine families, unified, ranked and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.engines import engine_short_name, statement_family
from fleetlens.functions.labels import truncate_label
from fleetlens.functions.statements import io_time_ms, lock_time_ms, query_digest, statement_text, wait_ms
from fleetlens.operators.keys import INSTANCE_KEY, present, shared
from fleetlens.operators.lookups import policy_for_clusters
from fleetlens.operators.predicates import mysql_digest_usable, pg_statement_usable, statement_source_usable
from fleetlens.operators.ranking import top_n_per_group
from fleetlens.plans.collection import PREFIX

# The six samples of a statement, their names, columns and help texts.
STATEMENT_SAMPLES = (
    ("query_calls_total", "calls", "Total number of times this query has been executed"),
    ("query_avg_duration_ms", "avg_duration_ms", "Average execution duration in milliseconds"),
    ("query_lock_time_ms", "sum_lock_time_ms", "Total lock time in milliseconds"),
    ("query_rows_examined_total", "rows_examined", "Total rows examined"),
    ("query_rows_sent_total", "rows_sent", "Total rows sent to client"),
    ("query_errors_total", "errors", "Total errors"),
)
STATS = ("digest", "digest_text", "calls", "avg_duration_ms", "sum_lock_time_ms", "rows_examined", "rows_sent", "errors")


def mysql_statement_stats(digests: DataFrame) -> DataFrame:
    c = F.col
    return digests.filter(mysql_digest_usable()).select(
        *present(digests, INSTANCE_KEY), F.lit("mysql").alias("family"),
        query_digest(c("digest")).alias("digest"), statement_text(c("digest_text")).alias("digest_text"),
        c("count_star").alias("calls"), wait_ms(c("avg_timer_wait")).alias("avg_duration_ms"),
        lock_time_ms(c("sum_lock_time")).alias("sum_lock_time_ms"), c("sum_rows_examined").alias("rows_examined"),
        c("sum_rows_sent").alias("rows_sent"), c("sum_errors").alias("errors"),
    )


def pg_statement_stats(statements: DataFrame) -> DataFrame:
    """I/O wait goes into the lock-time column; rows count as both examined and sent."""
    c = F.col
    return statements.filter(pg_statement_usable()).select(
        *present(statements, INSTANCE_KEY), F.lit("postgres").alias("family"),
        query_digest(c("queryid")).alias("digest"), statement_text(c("query")).alias("digest_text"),
        "calls", c("mean_exec_time").alias("avg_duration_ms"),
        io_time_ms(c("blk_read_time"), c("blk_write_time")).alias("sum_lock_time_ms"),
        c("rows").alias("rows_examined"), c("rows").alias("rows_sent"), F.lit(0).cast("bigint").alias("errors"),
    )


def statement_stats(digests: DataFrame, statements: DataFrame) -> DataFrame:
    return mysql_statement_stats(digests).unionByName(pg_statement_stats(statements))


def checked_top_n(n: Column) -> Column:
    """A policy's number of statements, as it is; below 1 it is an error."""
    return F.when(n >= 1, n).when(n.isNotNull(), F.raise_error(F.concat(F.lit("top_n must be at least 1, not "), n.cast("string"))))


def ranked_lists(stats: DataFrame, n: int) -> DataFrame:
    """Top ``n`` of each instance by mean duration (``source`` 0) and by calls (1), numbered in ``rank``.

    Each row enters both lists, so one row-number filter ranks them in one scan and is cut below the
    shuffle: a hot instance sends at most ``2 n`` rows per input split.
    """
    group = [*present(stats, INSTANCE_KEY), "family"]
    measure = F.when(F.col("source") == 0, F.col("avg_duration_ms")).otherwise(F.col("calls").cast("double"))
    lists = stats.withColumn("source", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_measure", measure)
    order = [F.desc("_measure"), F.asc("digest"), F.asc("digest_text")]
    return top_n_per_group(lists, [*group, "source"], order, n, "rank").drop("_measure")


def first_entries(lists: DataFrame) -> DataFrame:
    """Each digest once: the duration list goes before the calls list, a higher rank before a lower one."""
    keys = [*present(lists, INSTANCE_KEY), "family", "digest"]
    rest = [c for c in lists.columns if c not in (*keys, "source", "rank")]
    first = F.min(F.struct("source", "rank", *rest)).alias("first")
    return (
        lists.groupBy(*keys).agg(first).select(*keys, "first.*")
        .withColumn("rank_source", F.when(F.col("source") == 0, "duration").otherwise("calls")).drop("source")
    )


def top_per_instance(stats: DataFrame, n: int) -> DataFrame:
    return first_entries(ranked_lists(stats, n))


def publish_statements(rows: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Six samples per statement, without a time of their own."""
    short = engine_short_name(F.col("engine"))
    samples = [
        F.struct(
            F.concat(F.lit(prefix + "_"), short, F.lit("_" + suffix)).alias("name"), F.lit(text).alias("help"),
            F.col(column).cast("double").alias("value"),
        )
        for suffix, column, text in STATEMENT_SAMPLES
    ]
    labelled = rows.select(
        F.inline(F.array(*samples)), "identifier", "cluster_identifier", "region", "engine", "digest",
        truncate_label(F.col("digest_text")).alias("statement"),
    )
    return labelled.select(
        "name", "help", "identifier", "cluster_identifier", "region", "engine", "digest", "statement", "value",
        F.lit(None).cast("bigint").alias("ts_us"),
    )


def top_statements(
    digests: DataFrame, statements: DataFrame, instances: DataFrame, policy: DataFrame, prefix: str = PREFIX,
) -> DataFrame:
    """Instances with a usable endpoint and a policy row; the policy says how many statements to keep.

    Ranking comes before the join: what is joined is at most twice the policy's largest number per instance. That
    number is read when the plan is built; a policy is a small rule table.
    """
    most = policy.agg(F.max("top_n")).first()[0]
    sources = policy_for_clusters(instances.filter(statement_source_usable()), policy, ["top_n"])
    sources = (
        sources.filter(F.col("top_n").isNotNull())
        .withColumn("top_n", checked_top_n(F.col("top_n")))
        .withColumn("family", statement_family(F.col("engine")))
    )
    lists = ranked_lists(statement_stats(digests, statements), most or 0)
    keys = [*shared(lists, sources), "family"]
    labels = [n for n in ("region", "identifier", "cluster_identifier", "engine", "top_n") if n not in keys]
    wanted = lists.join(sources.select(*keys, *labels), keys).filter(F.col("rank") <= F.col("top_n"))
    return publish_statements(first_entries(wanted), prefix)
