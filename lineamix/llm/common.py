"""What the operators of this package share: tables, written intermediate results, key columns."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.session import shared_folder

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder that does not exist yet, where driver and executors both see it.

    Files stay until the owner of ``spark.checkpoint.dir`` clears that folder.
    """
    return f"{shared_folder(spark)}/lineamix-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bounded(small: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast of a written table if it has at most so many rows, which are counted here.

    Beyond that Spark chooses the join by the sizes it measures.
    """
    return F.broadcast(small) if small.count() <= most_rows else small


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast path, where ``lower`` is the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
