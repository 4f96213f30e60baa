"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.checkpoints import cut, in_few_tasks, shared_folder

__all__ = ["cut", "id_text", "in_few_tasks", "md5_long", "shared_folder", "shuffle_partitions", "table", "text_or_empty", "whole_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def md5_long(col: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_text(name: str) -> Column:
    """The id as text; a null id is the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
