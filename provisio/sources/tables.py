"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *, spread: bool = False) -> DataFrame:
    """The whole table. ``spread`` deals it out anew where its files give fewer tasks than there are cores.

    That is for tables whose rows are costly for their size; a large table has enough parts and
    is read where it lies.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
