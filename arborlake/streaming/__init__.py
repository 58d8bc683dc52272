"""Streams of file events."""

from arborlake.streaming.events import daily_language_lines, event_counts

__all__ = ["daily_language_lines", "event_counts"]
