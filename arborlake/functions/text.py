"""Texts as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.plans.rules import MAX_TEXT_BYTES


def trim(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def readable(content: Column, size: Column | None = None) -> Column:
    """The text where it is neither empty nor larger than the reading limit, else null."""
    bytes_ = F.octet_length(content) if size is None else F.coalesce(size, F.octet_length(content))
    return F.when((bytes_ <= MAX_TEXT_BYTES) & (content != ""), content)


def line_count(content: Column) -> Column:
    """Line ends, and one more for a last line without one; 0 for null and empty texts."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n")))
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, 0).otherwise(breaks + F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def drop_lines(content: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(lines_of(content), keep), "\n")


def _strict_json(content: Column) -> Column:
    """The text as VARIANT if it is one JSON value and nothing else; the parser alone would pass over what follows a value."""
    listed = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _without_trailing_commas(content: Column) -> Column:
    return F.regexp_replace(content, r",(\s*[}\]])", "$1")


def json_value(content: Column) -> Column:
    """The JSON text as VARIANT, read once more without trailing commas if it can't be read; null for anything else."""
    return F.coalesce(_strict_json(content), _strict_json(_without_trailing_commas(content)))


def json_source(content: Column) -> Column:
    """The text that ``json_value`` read."""
    return F.when(_strict_json(content).isNotNull(), content).otherwise(_without_trailing_commas(content))
