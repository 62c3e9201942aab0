"""Paths, labels, glob patterns and sizes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part without its suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def sanitise_label(label: Column) -> Column:
    """For file names: other characters become one underscore, none at the ends."""
    cleaned = F.btrim(F.regexp_replace(label, "[^a-zA-Z0-9_-]+", "_"), F.lit("_"))
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def glob_pattern(pattern: str) -> str:
    """A regular expression for a shell pattern; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) > 0:
            body = pattern[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", r"\^", 1) if body.startswith("^") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def glob(name: Column, pattern: str) -> Column:
    return name.rlike(glob_pattern(pattern))


def human_size(n: Column) -> Column:
    """Bytes as ``x.xx UNIT``: powers of 1024, halves to the even hundredth; any bigint fits.

    Only what is left of the last unit, less than 2^40, is multiplied.
    """
    out = None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        scale = 1024**k
        units, rest = F.call_function("div", n, F.lit(scale).cast("bigint")), n % F.lit(scale).cast("bigint") * 100
        part = F.call_function("div", rest, F.lit(scale).cast("bigint"))
        half = (rest - part * scale) * 2
        hundredths = part + ((half > scale) | ((half == scale) & (part % 2 == 1))).cast("bigint")
        whole = units + F.call_function("div", hundredths, F.lit(100))
        text = F.concat(whole.cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = text if out is None else F.when(n < scale * 1024, text).otherwise(out)
    return out


def fixed(x: Column, digits: int) -> Column:
    """A number below 10^15 with so many decimals, exact ties to even; null stays null.

    ``format_number`` rounds the double's exact value; only its grouping marks are in the way.
    """
    x = x.cast("double")
    plain = F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(plain)
