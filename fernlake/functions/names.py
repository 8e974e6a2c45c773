"""File names, ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_id(value: Column) -> Column:
    """Ids are compared as strings; a null id stays null and joins nothing."""
    return value.cast("string")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+(?=/*$)", 0)


def stem(name: Column) -> Column:
    """The base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(name), r"(?<=.)\.[^.]*$", "")


def group_label(index: Column) -> Column:
    """Six digits at least; longer numbers keep all of theirs."""
    return F.format_string("group_%06d", index)


def seeded_order(seed: int | Column, key: Column) -> Column:
    """A reproducible shuffle's sort key, the same in every engine; order by it and then by ``key``."""
    return F.md5(F.concat(seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.lit(":"), key))
