"""Loading tables and cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables (a file or a directory of parts each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of spark.checkpoint.dir and read from there.

    A lost executor then costs no more than the task it ran. The folder is
    the session's own; only in a local session without one, as in tests, a
    temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lithograph-"))
    return df.checkpoint()


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct ``keys``; rows that repeat an earlier one count once.

    Among rows that share the keys but differ elsewhere the least row by value
    is kept, so that the result does not depend on the order of the input.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def same(a: Column, b: Column) -> Column:
    """Equality in which two nulls are equal."""
    return a.eqNullSafe(b)
