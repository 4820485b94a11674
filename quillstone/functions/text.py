"""String forms with Python's semantics, in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes.
_BLANK = r"[\s\x1c-\x1f\x85   -     　]"


def strip(x: Column) -> Column:
    """Leading and trailing white space off, tabs and line breaks included."""
    return F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+$", "")


def slug(name: Column) -> Column:
    """Lower case, with each space and underscore a hyphen; runs are not collapsed."""
    return F.translate(F.lower(name), " _", "--")


def parse_list(x: Column) -> Column:
    """A comma-separated field: elements stripped, empty ones kept."""
    return F.transform(F.split(x, ",", -1), strip)


def parse_optional_list(x: Column) -> Column:
    """As ``parse_list``; a missing or empty field is an empty list."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parse_list(x))


def format_size(n: Column) -> Column:
    """Bytes with one decimal in B to TB, rounded half to even; the unit is chosen before rounding."""
    exact = n.cast("decimal(30,12)")
    out = None
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        text = F.concat(F.bround(exact / F.lit(1024**k).cast("decimal(20,0)"), 1).cast("decimal(30,1)").cast("string"), F.lit(f" {unit}"))
        out = text if out is None else F.when(n < 1024 ** (k + 1), text).otherwise(out)
    return out


def title(x: Column) -> Column:
    return F.initcap(F.translate(x, "_", " "))


def on_host(url: Column, host: str) -> Column:
    """Anchored test: the URL itself is on the host."""
    return F.coalesce(url.rlike("^https://" + host.replace(".", r"\.") + "/"), F.lit(False))


def mentions(url: Column, part: str) -> Column:
    """Substring test: the part may stand anywhere, in a parameter too."""
    return F.coalesce(F.contains(url, F.lit(part)), F.lit(False))


def first_found(x: Column, patterns: list[str], otherwise: Column | None = None) -> Column:
    """The first group of the first pattern that matches with something in it."""
    tries = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*tries, *([otherwise] if otherwise is not None else []))
