"""Sinks: partitioned tables and the text exposition format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.text import exposition_number
from fleetlens.operators.keys import label_columns
from fleetlens.schemas import LABELS, UNDATED
from fleetlens.session import materialize, stored


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples as parquet, one folder per region and day.

    Rebalancing gathers a folder's rows for few, large files, and splits a folder too big for one task.
    """
    day = F.to_date(F.timestamp_micros("ts_us"))
    (
        samples.withColumn("ds", F.coalesce(day.cast("string"), F.lit(UNDATED)))
        .hint("rebalance", "region", "ds")
        .write.mode(mode).partitionBy("region", "ds").parquet(path)
    )


def _escaped(text: Column, quote: bool) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"')) if quote else text


def label_text(labels: Sequence[str] = LABELS) -> Column:
    """``{a="1",b="2"}`` in label order; absent labels are left out."""
    pairs = [
        F.when(F.col(n).isNotNull(), F.concat(F.lit(n + '="'), _escaped(F.col(n), quote=True), F.lit('"')))
        for n in sorted(labels)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """Rendered sample lines (name, help, kind 2, label text, value); samples without a name or a value have none."""
    stamp = F.when(
        F.col("ts_us").isNotNull(),
        F.concat(F.lit(" "), ((F.col("ts_us") - F.pmod("ts_us", F.lit(1000))) / 1000).cast("bigint").cast("string")),
    ).otherwise(F.lit(""))
    labels = label_text(label_columns(samples))
    return samples.filter("name IS NOT NULL AND value IS NOT NULL").select(
        "name", "help", F.lit(2).alias("kind"), labels.alias("labels"),
        F.concat("name", labels, F.lit(" "), exposition_number(F.col("value")), stamp).alias("value"),
    )


def in_exposition_order(lines: DataFrame) -> DataFrame:
    """Text lines in order, with the two head lines of each name; a name without help has an empty one.

    Ranges are cut by name and labels together: a name holding a third of the samples spans several partitions, and the
    files in their order still list each name once. The lines are read three times, for the heads (two columns), the
    ranges and the sort, so give a stored table.
    """
    keys = ["name", "kind", "labels"]
    heads = lines.groupBy("name").agg(F.coalesce(F.min("help"), F.lit("")).alias("help"))
    head = heads.select(
        "name",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.lit("").alias("labels"), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), _escaped(F.col("help"), quote=False)).alias("value")),
                F.struct(F.lit(1).alias("kind"), F.lit("").alias("labels"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" gauge")).alias("value")),
            )
        ),
    )
    return head.unionByName(lines.drop("help")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value")


def to_exposition_text(samples: DataFrame) -> DataFrame:
    """The text of samples, whose lines are rendered once and kept below the shared folder while they are ordered."""
    return in_exposition_order(materialize(sample_lines(samples), "exposition"))


def write_exposition_text(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The same into files; the rendered lines are removed afterwards."""
    with stored(sample_lines(samples), "exposition") as lines:
        in_exposition_order(lines).write.mode(mode).text(path)
