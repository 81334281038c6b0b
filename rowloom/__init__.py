"""Delimited text as Spark tables: sniffing, layout, type inference, strict or lenient conversion, and writing."""

from .functions.convert import detect, detect_type, format_kind, parse_cell
from .sources.reader import iter_chunks, plan_delimited, read, read_delimited, read_many, read_rows
from .sources.writer import format_rows, iter_rows, write_delimited, write_row, writer

__all__ = ["detect", "detect_type", "format_kind", "format_rows", "iter_chunks", "iter_rows", "parse_cell", "plan_delimited", "read", "read_delimited", "read_many", "read_rows", "write_delimited", "write_row", "writer"]
