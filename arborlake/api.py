"""Entry points: scan directories or a table of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from arborlake.functions.paths import derive
from arborlake.plans.aggregate import scan_results
from arborlake.sources.tree import read_tree


def scan(spark: SparkSession, *paths: str, detectors: Iterable[str] | None = None) -> DataFrame:
    """One nested row per directory: ``repo_id`` (the absolute path), ``scannedAt`` and the parts that were asked for."""
    return scan_results(read_tree(spark, *paths), detectors)


def scan_table(files: DataFrame, detectors: Iterable[str] | None = None) -> DataFrame:
    """The same for a table with ``repo_id, relative_path, content``, one row per file."""
    return scan_results(derive(files.select("repo_id", "relative_path", "content")), detectors)
