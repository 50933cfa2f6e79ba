"""Saved run records: scans, the newest of each key, cache probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import written


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files with the file's name and time; fields that old files lack are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_at"))


def newest(records: DataFrame, key: str, at: str) -> DataFrame:
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), at).alias("r")).select(key, "r.*")


def history(records: DataFrame, at: str, tie: str, most: int = 40) -> DataFrame:
    """The newest ``most`` records (the limit is the feature)."""
    return records.orderBy(F.desc(at), tie).limit(most)


def cache_key(*parts: Column) -> Column:
    """16 hexadecimal digits of the hash of the stripped lower-case parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts])), 1, 16)


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    return wanted.join(cached.select(key), key, "left_anti")


def record_version(sections: Column, queries: Column, *, least_sections: int = 19, least_queries: int = 15) -> Column:
    return F.when((sections >= least_sections) & (queries >= least_queries), 2).otherwise(1)


def ordered(records: DataFrame, how: str, *, upload: str = "seq", name: str = "company", at: str = "at") -> DataFrame:
    """Records with their place in upload order, by name or by completion; ties by upload.

    The table is sorted by ranges, each range numbers its own rows, and the counts of the ranges before it,
    one number a partition, make the places: no task gets more than its range.
    """
    order = {"upload": [F.col(upload)], "name": [F.lower(name), F.col(upload)], "completed": [F.col(at).asc_nulls_last(), F.col(upload)]}[how]
    ranged = written(records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # the file order of a written range is not promised, so the range numbers its rows by the order itself
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.alias("p").join(counts.alias("q"), F.col("q._part") < F.col("p._part"), "left").groupBy(F.col("p._part").alias("_part")).agg(F.coalesce(F.sum("q._n"), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn("place", (F.col("_before") + F.col("_i")).cast("int")).drop("_part", "_i", "_before")
