"""Options of reading and writing: aliases, defaults, validation."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

# fixed values: option names of older callers, default spellings of booleans
ALIASES = {"datarow": "skipto", "missingstrings": "missingstring", "dateformats": "dateformat", "type": "types", "ignoreemptylines": "ignoreemptyrows", "lazystrings": "stringtype", "threaded": "ntasks", "tasks": "ntasks", "lines_to_check": "rows_to_check"}
TRUE = ("true", "True", "TRUE", "T", "1")
FALSE = ("false", "False", "FALSE", "F", "0")
NOT_A_DELIMITER = ("\r", "\n", "\0")


def ascii_char(name: str, value: str | None) -> None:
    if value is not None and (len(value) != 1 or ord(value) > 127):
        raise ValueError(f"{name} must be one ASCII character, not {value!r}")


def check_delimiter(delim: str | None) -> None:
    if delim is not None and (delim == "" or any(c in delim for c in NOT_A_DELIMITER)):
        raise ValueError(f"{delim!r} can't be a delimiter")


@dataclass(frozen=True)
class ReadOptions:
    header: Any = 1  # a row number, False, names, or several row numbers
    normalizenames: bool = False
    skipto: int | None = None
    footerskip: int = 0
    transpose: bool = False
    comment: str | None = None
    ignoreemptyrows: bool = True
    select: Any = None
    drop: Any = None
    limit: int | None = None
    missingstring: Any = ""  # a string, several, or None
    delim: str | None = None
    ignorerepeated: bool = False
    quoted: bool = True
    quotechar: str = '"'
    openquotechar: str | None = None
    closequotechar: str | None = None
    escapechar: str = '"'
    dateformat: Any = None  # a pattern, or a dict by column
    decimal: str = "."
    groupmark: str | None = None
    truestrings: tuple[str, ...] = TRUE
    falsestrings: tuple[str, ...] = FALSE
    stripwhitespace: bool = False
    types: Any = None  # a type, a list, a dict by number, name or pattern, or a function
    typemap: dict = field(default_factory=dict)
    pool: Any = (0.2, 500)
    downcast: bool = False
    strict: bool = False
    silencewarnings: bool = False
    maxwarnings: int = 100
    validate: bool = True
    encoding: str = "UTF-8"
    multiline: bool | None = None  # records over several lines: looked for unless told
    # accepted, since Spark decides about them
    stringtype: Any = None
    ntasks: int | None = None
    rows_to_check: int | None = None
    buffer_in_memory: bool = False
    debug: bool = False
    parsingdebug: bool = False
    reusebuffer: bool = False

    @classmethod
    def of(cls, **given: Any) -> ReadOptions:
        for old, new in ALIASES.items():
            if old in given:
                warnings.warn(f"{old} is deprecated, use {new}", DeprecationWarning, stacklevel=3)
                given[new] = given.pop(old)
        o = cls(**given)
        check_delimiter(o.delim)
        for name in ("quotechar", "openquotechar", "closequotechar", "escapechar"):
            ascii_char(name, getattr(o, name))
        if (o.openquotechar is None) != (o.closequotechar is None):
            raise ValueError("openquotechar and closequotechar go together")
        if o.select is not None and o.drop is not None:
            raise ValueError("only one of select and drop")
        if o.ignorerepeated and o.delim is None:
            raise ValueError("ignorerepeated needs a delimiter")
        if o.transpose and (isinstance(o.header, (range, tuple)) or isinstance(o.header, list) and o.header and isinstance(o.header[0], int)):
            raise ValueError("transposed input has one header cell in each line")
        if o.skipto is not None and isinstance(o.header, int) and o.skipto < int(o.header):
            raise ValueError("skipto comes before the header")
        pool = o.pool if isinstance(o.pool, (int, float)) and not isinstance(o.pool, bool) else o.pool[0] if isinstance(o.pool, tuple) else 0
        if not 0 <= pool <= 1:
            raise ValueError("pool is a share between 0 and 1")
        return o

    @property
    def open(self) -> str:
        return self.openquotechar or self.quotechar

    @property
    def close(self) -> str:
        return self.closequotechar or self.quotechar

    @property
    def sentinels(self) -> tuple[str, ...]:
        return () if self.missingstring is None else (self.missingstring,) if isinstance(self.missingstring, str) else tuple(self.missingstring)

    def header_rows(self) -> list[int]:
        """Numbers of the rows that hold names; none for generated or given names."""
        h = self.header
        if isinstance(h, bool):
            return [1] if h else []
        if isinstance(h, int):
            return [h] if h > 0 else []
        h = list(h)
        return h if h and isinstance(h[0], int) else []

    def given_names(self) -> list[str] | None:
        h = self.header
        return list(h) if isinstance(h, (list, tuple)) and (not h or isinstance(h[0], str)) and h else None

    def first_row(self) -> int:
        rows = self.header_rows()
        if self.skipto is not None:
            return self.skipto
        return rows[-1] + 1 if rows else 1


@dataclass(frozen=True)
class WriteOptions:
    delim: str = ","
    quotechar: str = '"'
    openquotechar: str | None = None
    closequotechar: str | None = None
    escapechar: str = '"'
    newline: str = "\n"
    missingstring: str = ""
    decimal: str = "."
    dateformat: str | None = None
    quotestrings: bool = False
    header: Any = True  # or names
    append: bool = False
    bom: bool = False
    compress: bool = False
    partition: bool = False
    transform: Callable | None = None
    bufsize: int | None = None  # accepted

    @classmethod
    def of(cls, **given: Any) -> WriteOptions:
        if "writeheader" in given:
            warnings.warn("writeheader is deprecated, use header", DeprecationWarning, stacklevel=3)
            given["header"] = given.pop("writeheader")
        if given.get("append") and "header" not in given:
            given["header"] = False
        o = cls(**given)
        check_delimiter(o.delim)
        for name in ("quotechar", "openquotechar", "closequotechar", "escapechar", "decimal"):
            ascii_char(name, getattr(o, name))
        if (o.openquotechar is None) != (o.closequotechar is None):
            raise ValueError("openquotechar and closequotechar go together")
        return o

    @property
    def open(self) -> str:
        return self.openquotechar or self.quotechar

    @property
    def close(self) -> str:
        return self.closequotechar or self.quotechar
