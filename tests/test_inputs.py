"""Input tables that are made of few rows: how they are dealt."""

from pyspark.sql import functions as F

from fleetlens.queries import inputs as I


def test_catalogue_entries_are_made_in_many_tasks(spark, tmp_path):
    spark.createDataFrame([(1, "EUROPE")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    spark.createDataFrame([(1, "FRANCE", 1)], I.SCHEMAS["nation"]).write.parquet(str(tmp_path / "nation.parquet"))
    keys = [*range(300), 7, 7, None]
    customers = spark.createDataFrame([(k, f"Customer#{k}", 1, 1.0, "AUTOMOBILE") for k in keys], I.SCHEMAS["customer"])
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = I.fx_catalogue(spark, str(tmp_path))
    parts = [r.n for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and len(parts) > 1 and max(parts) < 300 * 5
    # Every instance brings each entry, repeated ids and those without a key too.
    want = sorted((f"db-{k}" if k is not None else None, o) for k in keys for o, *_ in I.CATALOGUE if k is not None)
    got = sorted((r.resource_id, r.ordinal) for r in rows.where("resource_id is not null").collect())
    assert got == want and rows.where("resource_id is null").count() == 5
