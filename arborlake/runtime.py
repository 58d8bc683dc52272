"""Session-level helpers shared by all operators: lineage cuts, key dedup, size-checked broadcast."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and holds no more rows than this.
MAX_BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where none is configured a local one is set for a local master, and others are refused."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="arborlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and replace its lineage by reliable checkpoint files, which survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Keep what ``df`` gives once something asks for it, for a plan that reads it more than once; nothing runs now.

    The lineage stays, so parts that are lost with an executor are made again.  ``spark.catalog.clearCache()`` frees what is kept.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` stay within ``bound``; otherwise leave the join to Catalyst."""
    return F.broadcast(df) if rows <= bound else df


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; rows with a null in a key are dropped.

    Copies of a key hold the same content, so any of them may stay; the pick is
    a map-side combined aggregate, so a key with many copies sends one row per
    map task.
    """
    return df.na.drop(how="any", subset=list(keys)).dropDuplicates(list(keys))


def clean(value: Column) -> Column:
    """A name without blanks and tabs at both ends, in lower case; null stays null."""
    return F.lower(F.btrim(value, F.lit(" \t")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
