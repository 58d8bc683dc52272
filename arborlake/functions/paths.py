"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.plans.rules import SECONDARY_FOLDERS


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def dirname(path: Column) -> Column:
    """The folder of a file, '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def extension(name: Column) -> Column:
    """The last dot and what follows, in lower case; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def folder_segments(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def is_secondary(path: Column) -> Column:
    """Whether a folder on the way is one of tests, examples and the like."""
    return F.arrays_overlap(folder_segments(path), F.array(*map(F.lit, SECONDARY_FOLDERS)))


def ancestors(path: Column, with_top: bool = False) -> Column:
    """All proper ancestor folders of a path, outermost first; '.' for the top if asked for."""
    parts = segments(path)
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), inner) if with_top else inner


def derive(df: DataFrame) -> DataFrame:
    """Add ``name``, ``ext``, ``segments`` and ``is_secondary`` to rows with a ``relative_path``; backslashes become slashes."""
    path = F.translate("relative_path", "\\", "/")
    out = df.withColumn("relative_path", path).withColumn("name", basename(F.col("relative_path")))
    return out.withColumns({"ext": extension(F.col("name")), "segments": segments(F.col("relative_path")), "is_secondary": is_secondary(F.col("relative_path"))})
