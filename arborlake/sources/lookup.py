"""Lookups in a table of files, and INI texts as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import lines_of, trim


def with_name(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.col("name") == name)


def with_extension(files: DataFrame, ext: str) -> DataFrame:
    return files.filter(F.col("ext") == ext.lower())


def under(files: DataFrame, prefix: str) -> DataFrame:
    """Files below a folder, and the file of that very path."""
    return files.filter(F.startswith("relative_path", F.lit(prefix + "/")) | (F.col("relative_path") == prefix))


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """``*.ext`` by extension, anything else by name."""
    return with_extension(files, pattern[1:]) if pattern.startswith("*.") else with_name(files, pattern)


def matching_any(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    names = [p for p in patterns if not p.startswith("*.")]
    exts = [p[1:].lower() for p in patterns if p.startswith("*.")]
    return files.filter(F.col("name").isin(*names) | F.col("ext").isin(*exts))


def has_any(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """``repo_id`` of repositories with a file that matches, tests and examples included."""
    return matching_any(files, patterns).select("repo_id").distinct()


def is_test_file(name: Column, secondary: Column) -> Column:
    """Test files by name, and all below folders of tests and examples."""
    return secondary | name.rlike(r"\.test\.|\.spec\.|^test_|(?:_test\.(?:go|py|exs|rs))$")


def is_generated_file(name: Column, path: Column) -> Column:
    return name.rlike(r"\.gen\.|\.generated\.|\.Designer\.|(?:\.pb\.(?:go|ts)|\.g\.(?:cs|dart))$") | path.rlike(r"/[Mm]igrations/")


def ini_entries(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys, section, key, value`` of INI texts: names in lower case, ``#`` and ``;`` comments, the last value of a key counts."""
    lines = texts.select(*keys, F.posexplode(lines_of(F.col(text))).alias("line_no", "raw")).withColumn("line", trim(F.col("raw")))
    lines = lines.filter("line <> '' and not line rlike '^[#;]'")
    header = F.nullif(F.regexp_extract("line", r"^\[([^\]]+)\]$", 1), F.lit(""))
    # the lines of one text
    section = F.last(F.lower(trim(header)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    pairs = lines.withColumn("section", F.coalesce(section, F.lit(""))).filter(~F.col("line").rlike(r"^\[[^\]]+\]$") & (F.instr("line", "=") > 1))
    key = F.lower(trim(F.expr("substring(line, 1, instr(line, '=') - 1)")))
    value = trim(F.expr("substring(line, instr(line, '=') + 1)"))
    return pairs.groupBy(*keys, "section", key.alias("key")).agg(F.max_by(value, F.col("line_no")).alias("value"))
