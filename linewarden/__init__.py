"""Data-quality and OEE analytics for production lines, as Spark jobs."""

from linewarden.schema import RECORD_COLUMNS, RECORD_SCHEMA, StreamConfig

__all__ = ["RECORD_COLUMNS", "RECORD_SCHEMA", "StreamConfig"]
