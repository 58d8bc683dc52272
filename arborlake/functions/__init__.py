"""Column functions: paths, text, JSON."""

from arborlake.functions.paths import ancestors, basename, derive, dirname, extension, is_secondary, segments
from arborlake.functions.text import drop_lines, json_source, json_value, line_count, lines_of, readable, trim

__all__ = ["ancestors", "basename", "derive", "dirname", "drop_lines", "extension", "is_secondary", "json_source", "json_value", "line_count", "lines_of", "readable", "segments", "trim"]
