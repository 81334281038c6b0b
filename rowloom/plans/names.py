"""What is decided from the first lines: the delimiter, cells of a line, column names. Plain functions on small texts."""

from __future__ import annotations

import contextlib
import keyword
import re
import unicodedata
from collections import Counter

# fixed values: candidate delimiters in order of preference
CANDIDATES = (",", "\t", " ", "|", ";", ":")
FALLBACK = (",", "\t", "|", ";", ":")
SNIFFED = 10  # records


def split_line(line: str, delim: str, o) -> list[str | None]:
    """Cells of one record. Unquoted empty cells are None, quoted ones are ''; white space around quoted cells goes.

    An opening quote counts only at the start of a cell; after the closing one, anything up to the delimiter is kept.
    """
    if o.ignorerepeated:
        while line.startswith(delim):
            line = line[len(delim) :]
        while line.endswith(delim):
            line = line[: -len(delim)]
    out, at, n = [], 0, len(line)
    blank = [c for c in " \t" if c not in delim and c not in o.sentinels]
    while True:
        start = at
        while at < n and line[at] in blank and not line.startswith(delim, at):
            at += 1
        if o.quoted and at < n and line[at] == o.open:
            at += 1
            got = []
            while at < n:
                c = line[at]
                if c == o.escapechar and c != o.close and at + 1 < n:
                    got.append(line[at + 1])
                    at += 2
                elif c == o.close:
                    if o.escapechar == o.close and line.startswith(o.close, at + 1):
                        got.append(c)
                        at += 2
                    else:
                        break
                else:
                    got.append(c)
                    at += 1
            else:
                raise ValueError(f"a quoted cell isn't closed: {line[:80]!r}")
            at += 1
            end = line.find(delim, at)
            rest = line[at : end if end >= 0 else n]
            cell: str | None = "".join(got) + ("" if not rest.strip(" \t") else rest)
            at = end if end >= 0 else n
        else:
            end = line.find(delim, at)
            end = n if end < 0 else end
            cell = line[start:end]
            if o.stripwhitespace:
                cell = cell.strip(" \t")
            cell = cell or None
            at = end
        if o.stripwhitespace and cell:
            cell = cell.strip(" \t")
        out.append(cell)
        if at >= n:
            return out
        at += len(delim)
        if o.ignorerepeated:
            while line.startswith(delim, at):
                at += len(delim)


def outside_quotes(text: str, o) -> str:
    if not o.quoted:
        return text
    a, b = re.escape(o.open), re.escape(o.close)
    return re.sub(f"{a}[^{b}]*(?:{b}|\\Z)", "", text)


def skipped(value: str, o) -> bool:
    return o.comment is not None and value.startswith(o.comment) or o.ignoreemptyrows and value == ""


def record_end(lines: list[str], at: int, delim: str, o) -> int | None:
    """The place after the record that begins at a line; None if it isn't closed among the lines."""
    if not o.quoted or o.multiline is False or o.open not in lines[at] or o.comment is not None and lines[at].startswith(o.comment):
        return at + 1
    for end in range(at + 1, len(lines) + 1):
        if end == at + 1 or o.close in lines[end - 1]:
            with contextlib.suppress(ValueError):
                split_line("\n".join(lines[at:end]), delim, o)
                return end
    return None


def head_records(lines: list[str], delim: str, o) -> list[str]:
    """Lines put together to records; one that isn't closed among them stays as it is."""
    out, at = [], 0
    while at < len(lines):
        end = record_end(lines, at, delim, o) or at + 1
        out.append("\n".join(lines[at:end]))
        at = end
    return out


def counted_records(lines: list[str], delim: str, o) -> list[str]:
    """The first ten records that aren't skipped, up to one that isn't closed among the lines (of that, its first line if there are no others)."""
    out, at = [], 0
    while at < len(lines) and len(out) < SNIFFED:
        end = record_end(lines, at, delim, o)
        if end is None and out:
            break
        record = "\n".join(lines[at : end or at + 1])
        if record and not skipped(record, o):
            out.append(record)
        if end is None:
            break
        at = end
    return out


def sniff(lines: list[str], o, path: str = "") -> str:
    """The delimiter: by the file's extension, else a candidate that divides evenly over the first ten records (a quoted cell's line ends don't end one), else the header's most frequent."""
    lower = path.lower().removesuffix(".gz")
    if lower.endswith(".tsv"):
        return "\t"
    if lower.endswith(".wsv"):
        return " "
    for c in CANDIDATES:
        records = counted_records(lines, c, o)
        n = outside_quotes("\n".join(records), o).count(c)
        if n and n % len(records) == 0:
            return c
    lines = [x for x in lines if x and not skipped(x, o)][:SNIFFED]
    head = Counter(outside_quotes("\n".join(lines), o).split("\n")[0])
    best = max(FALLBACK, key=lambda c: (head[c], -FALLBACK.index(c)))
    return best if head[best] else ","


def normalized(name: str) -> str:
    """A valid identifier: NFC, other characters to _, runs of _ squeezed, _ before digits and reserved words."""
    s = re.sub(r"[^\w]", "_", unicodedata.normalize("NFC", name).strip())
    s = f"_{s}" if not s or not (s[0].isalpha() or s[0] == "_") or keyword.iskeyword(s) else s
    return re.sub(r"_+", "_", s)


def unique(names: list[str]) -> list[str]:
    """Repeated names get _1, _2 and so on, but never a name that is there already."""
    taken, seen, out, number = set(names), set(), [], Counter()
    for n in names:
        new = n
        if n in seen:
            while new in taken or new in seen:
                number[n] += 1
                new = f"{n}_{number[n]}"
        seen.add(new)
        out.append(new)
    return out


def header_names(rows: list[list[str | None]], width: int, o) -> list[str]:
    """Names from the header's rows (joined by _), completed by ColumnN up to ``width``."""
    given = o.given_names()
    if given is not None:
        names: list[str | None] = list(given)
    elif rows:
        n = max(map(len, rows))
        names = ["_".join(r[i] or "" for r in rows if i < len(r)) or None for i in range(n)]
    else:
        names = []
    names += [None] * (width - len(names))
    named = [n.strip(" \t") if n and o.stripwhitespace else n or f"Column{i}" for i, n in enumerate(names, 1)]
    return unique([normalized(n) for n in named] if o.normalizenames else named)


def by_column(given, i: int, name: str):
    """The value of a dict by number (from 1), name or compiled pattern; None if there is none."""
    if i in given:
        return given[i]
    if name in given:
        return given[name]
    return next((v for k, v in given.items() if isinstance(k, re.Pattern) and k.search(name)), None)


def check_keys(given, names: list[str], what: str) -> None:
    for k in given if isinstance(given, dict) else ():
        ok = 1 <= k <= len(names) if isinstance(k, int) else any(k.search(n) for n in names) if isinstance(k, re.Pattern) else k in names
        if not ok:
            raise ValueError(f"{what} names an unknown column: {k!r}")


def kept_columns(names: list[str], o) -> list[int]:
    """Places of the columns that select or drop leaves, in the file's order."""
    given = o.select if o.select is not None else o.drop
    if given is None:
        return list(range(len(names)))
    if callable(given):
        hit = [bool(given(i, n)) for i, n in enumerate(names, 1)]
    else:
        given = list(given)
        if given and all(isinstance(g, bool) for g in given):
            hit = [i < len(given) and given[i] for i in range(len(names))]
        elif all(isinstance(g, (int, str)) for g in given):
            hit = [i in given or n in given for i, n in enumerate(names, 1)]
        else:
            raise ValueError("select and drop take numbers, names, booleans or a function")
    return [i for i, h in enumerate(hit) if h == (o.select is not None)]
