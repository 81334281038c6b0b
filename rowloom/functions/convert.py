"""Kinds of cells and conversion of text columns, as column expressions."""

from __future__ import annotations

import re
from datetime import date, datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.options import FALSE, TRUE

INTEGER = r"^[ \t]*[+-]?\d+[ \t]*$"
FLOAT = r"^[ \t]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|nan|[Ii]nf(?:inity)?)[ \t]*$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
DATETIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?$"
TIME = r"^\d{1,2}:\d{2}:\d{2}(?:\.\d{1,9})?$"
#: Names of the kinds in the order in which they are tried.
KINDS = ("int", "float", "date", "datetime", "time", "bool", "string")
# fixed values: pattern letters of date formats and Java's
LETTERS = {"y": "y", "Y": "y", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "s": "S", "p": "a", "u": "MMM", "U": "MMMM", "e": "EEE", "E": "EEEE"}


def java_pattern(fmt: str) -> str:
    out = ""
    for run in re.finditer(r"([A-Za-z])\1*|[^A-Za-z]+", fmt):
        text = run[0]
        letter = LETTERS.get(text[0])
        if letter is None:
            out += text if not text[0].isalpha() else f"'{text}'"
        elif text[0] in "uUeE":
            out += letter
        elif text[0] == "s":
            out += "[SSSSSSSSS][SSSSSS][SSS][SS][S]" if len(text) == 1 else "S" * len(text)
        else:
            out += letter * len(text)
    return out


def format_kind(fmt: str) -> str:
    """date, time or datetime, by a format's letters."""
    day, clock = (any(c in fmt for c in letters) for letters in ("yYmdUu", "HIMSsp"))
    return "datetime" if day and clock else "time" if clock else "date"


class Cells:
    """How the text cells of one column are read: sentinels, radix, group marks, date format, spellings of booleans."""

    def __init__(self, o, dateformat: str | None = None):
        self.o, self.dateformat = o, dateformat

    def value(self, cell: Column) -> Column:
        """The cell, or null if it is missing. With no sentinels an empty cell is an empty text."""
        s = self.o.sentinels
        if "" not in s:
            cell = F.coalesce(cell, F.lit(""))
        others = [x for x in s if x]
        return F.when(~cell.isin(others), cell) if others else cell

    def present(self, cell: str | None) -> str | None:
        """The same of a text: the cell, or None if it is missing."""
        s = self.o.sentinels
        cell = "" if cell is None and "" not in s else cell
        return None if cell in s and cell != "" else cell

    def number(self, cell: Column) -> Column:
        if self.o.groupmark:
            cell = F.regexp_replace(cell, r"(?<=\d)\Q" + self.o.groupmark + r"\E(?=\d)", "")
        if self.o.decimal != ".":
            cell = F.when(cell.contains("."), cell).otherwise(F.translate(cell, self.o.decimal, "."))
        return cell

    def to(self, cell: Column, kind: str) -> Column:
        """The typed value; null where it isn't one. Null stays null."""
        o, x = self.o, cell
        if kind in ("tinyint", "smallint", "int32", "bigint", "int", "decimal(38,0)"):
            target = {"int": "bigint", "int32": "int"}.get(kind, kind)
            x = self.number(x)
            if kind == "decimal(38,0)":  # would be rounded
                return F.when(x.rlike(INTEGER), F.trim(F.translate(x, "\t", " ")).try_cast(target))
            return x.try_cast(target)  # blanks around digits are fine, fractions aren't
        if kind in ("float", "double", "float32"):
            plain, target = self.number(x), "float" if kind == "float32" else "double"
            x = F.trim(F.translate(plain, "\t", " "))
            inf = F.when(x.rlike("^[+]?[Ii]nf"), "Infinity").when(x.rlike("^-[Ii]nf"), "-Infinity").when(x.rlike("^[+-]?[Nn]a[Nn]$"), "NaN").otherwise(x)
            lettered = F.when(x.rlike(FLOAT), inf.try_cast(target))  # NaN, Inf; Java's 1d and 0x1p3 are no numbers here
            return F.when(plain.rlike("[A-DF-Za-df-z]"), lettered).otherwise(plain.try_cast(target))
        if kind == "bool":
            return F.when(x.isin(list(o.truestrings or ())), True).when(x.isin(list(o.falsestrings or ())), False)
        if kind in ("date", "datetime") and self.dateformat:
            pattern = java_pattern(self.dateformat)
            t = F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz")
            return t.cast("date") if kind == "date" else t
        if kind == "date":
            return F.when(x.rlike(DATE), x.try_cast("date"))
        if kind == "datetime":
            return F.when(x.rlike(DATETIME), x.try_cast("timestamp_ntz"))
        if kind == "time":
            if self.dateformat:
                t = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), x), F.lit("yyyy-MM-dd " + java_pattern(self.dateformat)))
                text = F.date_format(t, "HH:mm:ss.SSSSSS")
            else:
                ok = F.concat(F.lit("1970-01-01 "), x).try_cast("timestamp_ntz")
                text = F.when(x.rlike(TIME), F.date_format(ok, "HH:mm:ss.SSSSSS"))
            return F.regexp_replace(text, r"\.000000$|(?<=\.\d{1,5})0+$", "")
        return x

    def kind(self, cell: Column) -> Column:
        """The first kind of KINDS that a present cell has; with a date format, that format's kind replaces ISO dates."""
        timely = (format_kind(self.dateformat),) if self.dateformat else ("date", "datetime", "time")
        out = F.when(self.to(cell, "int").isNotNull(), "int").when(self.to(cell, "float").isNotNull(), "float")
        for k in timely:
            out = out.when(self.to(cell, k).isNotNull(), k)
        return out.when(self.to(cell, "bool").isNotNull(), "bool").otherwise("string")


class _Default:
    sentinels, groupmark, decimal, truestrings, falsestrings = ("",), None, ".", TRUE, FALSE


def detect_type(cell: Column) -> Column:
    """The name of the kind that a text column's cell has by itself; null for missing ones."""
    return F.when(cell.isNotNull() & (cell != ""), Cells(_Default).kind(cell))


def parse_cell(cell: Column, kind: str) -> Column:
    """Typed parse of a text column; null where it fails."""
    return Cells(_Default).to(cell, kind)


def detect(text: str):
    """The value that a text stands for, or the text itself."""
    if re.match(INTEGER, text):
        n = int(text)
        return n if -(2**63) <= n < 2**63 else float(n)
    if re.match(FLOAT, text):
        return float(text)
    for pattern, make in ((DATE, date.fromisoformat), (DATETIME, datetime.fromisoformat), (TIME, time.fromisoformat)):
        if re.match(pattern, text):
            try:
                return make(text)
            except ValueError:
                return text
    return True if text in TRUE else False if text in FALSE else text
