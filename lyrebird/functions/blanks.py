"""Blank values: what counts as "nothing said" when rows are merged, and when they are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, an empty string, zero or false: a merge takes it for no value."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def effective(df: DataFrame, proposed: str, current: str) -> Column:
    """The proposed value unless it is blank, else the current one."""
    return F.when(~is_blank(df, proposed), F.col(proposed)).otherwise(F.col(current))


def overlay(df: DataFrame, fields: dict[str, str], only_missing: bool = False) -> DataFrame:
    """Each field (key) overlaid by another column (value): non-blank values win, or only fill blanks."""
    keep = lambda own, other: effective(df, own, other) if only_missing else effective(df, other, own)
    return df.withColumns({own: keep(own, other) for own, other in fields.items()})


def pending(df: DataFrame, fields: dict[str, str]) -> Column:
    """Whether any field's (key) non-blank proposal (value) differs from it, as text; null and "" are alike."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = F.lit(False)
    for own, other in fields.items():
        out = out | (~is_blank(df, other) & (text(own) != text(other)))
    return out


def sort_blank(c: Column, text: bool = True) -> Column:
    """Null or an empty string; zero is a value here."""
    return c.isNull() | (c == "") if text else c.isNull()
