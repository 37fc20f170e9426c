"""Catalogue queries: search, filters, blanks-last sorting, pages, buckets and one-pass statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence from which a match is safe, and from which it needs a look.
HIGH, REVIEW = 92.0, 70.0
SEVERITIES = ("high", "medium", "low", "info")
PENALTY = {"high": 30, "medium": 15, "low": 6, "info": 0}
MAX_PAGE = 1000


def bucket(confidence: Column, matched: Column | None = None) -> Column:
    matched = confidence.isNotNull() if matched is None else matched
    return F.when(~matched, "unidentified").when(confidence >= HIGH, "high").when(confidence >= REVIEW, "review").otherwise("low")


def found(fields: list[Column], text: str) -> Column:
    """Whether the fields, joined by single spaces without blanks, hold the text in any case."""
    joined = F.concat_ws(" ", *(F.nullif(c.cast("string"), F.lit("")) for c in fields))
    return F.contains(F.lower(joined), F.lit(text.lower()))


def issue_filter(issues: Column, wanted: str) -> Column:
    """any: has issues. high, medium or low: has one of that severity. Anything else is no filter."""
    if wanted == "any":
        return F.coalesce(F.size(issues) > 0, F.lit(False)) & issues.isNotNull()
    if wanted in SEVERITIES[:3]:
        return F.coalesce(F.exists(issues, lambda i: i["severity"] == wanted), F.lit(False))
    return F.lit(True)


def blanks_last(df: DataFrame, key: str, descending: bool, tie: list[str], text: bool = True) -> DataFrame:
    """Sorted by key (strings without case), blanks last in either direction, ties by the tie columns ascending."""
    c = F.col(key)
    blank = (c.isNull() | (c == "")) if text else c.isNull()
    value = F.lower(c) if text else c
    value = F.when(~blank, value)
    return df.orderBy(blank.asc(), value.desc_nulls_last() if descending else value.asc_nulls_last(), *(F.col(t).asc_nulls_last() for t in tie))


@dataclass(frozen=True)
class Query:
    """text over search; equals: column to value; sort column, or an unknown one for the tie columns' order."""

    search: list[str] = field(default_factory=list)
    text: str = ""
    equals: dict[str, str] = field(default_factory=dict)
    sort: str = ""
    descending: bool = False
    tie: list[str] = field(default_factory=list)
    numeric: bool = False
    offset: int = 0
    limit: int = 100


def filtered(df: DataFrame, q: Query) -> DataFrame:
    if q.text:
        df = df.where(found([F.col(c) for c in q.search], q.text))
    for name, value in q.equals.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, q: Query) -> DataFrame:
    """One page; filtered(df, q).count() is the total before paging. Negative offsets are an error."""
    if q.offset < 0:
        raise ValueError("offset is negative")
    sort, descending = (q.sort[:-5], True) if q.sort.endswith("_desc") else (q.sort, q.descending)
    df = filtered(df, q)
    df = blanks_last(df, sort, descending, q.tie, not q.numeric) if sort in df.columns else df.orderBy(*q.tie)
    return df.offset(q.offset).limit(min(q.limit, MAX_PAGE))


def facet(df: DataFrame, key: str, blank: str = "?") -> DataFrame:
    """Rows by value; blank values together."""
    return df.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(blank)).alias(key)).agg(F.count("*").alias("n"))


def tally(df: DataFrame, what: Column, names: tuple[str, ...], as_: str = "outcome") -> DataFrame:
    """A row a name with the number of rows that have it, 0 included, from one pass."""
    counts = df.withColumn("__w", what).agg(*(F.count_if(F.col("__w") == x).alias(x) for x in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias(as_), F.col(x).alias("n")) for x in names))).alias("s")).select("s.*")


def stats(df: DataFrame, confidence: str, status: str, analysed: str, points: str, issues: str) -> DataFrame:
    """One row: total, a count a bucket, analysed, applied, errors, a count a severity, and the mean of the points.

    Only analysed rows' issues and points count; without one the mean is null.
    """
    done = F.coalesce(F.col(analysed), F.lit(False))
    one = lambda s: F.sum(F.when(done, F.size(F.filter(issues, lambda i: i["severity"] == s))).otherwise(0)).cast("long").alias(f"issues_{s}")
    b = bucket(F.col(confidence))
    return df.agg(
        F.count("*").alias("total"), *(F.count_if(b == x).alias(x if x != "high" else "high_bucket") for x in ("high", "review", "low", "unidentified")), F.count_if(done).alias("analysed"),
        F.count_if(F.col(status) == "applied").alias("applied"), F.count_if(F.col(status) == "error").alias("errors"), *(one(s) for s in SEVERITIES), F.bround(F.avg(F.when(done, F.col(points))), 1).alias("average"),
    )


def by_severity(issues: Column) -> Column:
    """The issues, the worst first, otherwise in their order."""

    def of(severity: str) -> Column:
        return F.filter(issues, lambda i: i["severity"] == severity)

    return F.concat(*map(of, SEVERITIES))


def score(penalties: Column) -> Column:
    """100 less the penalties, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalties))


def penalty(issues: Column) -> Column:
    """The sum of an array's severities' penalties."""
    one = lambda i: F.coalesce(F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv))[i["severity"]], F.lit(0))
    return F.aggregate(F.coalesce(issues, F.array()), F.lit(0), lambda s, i: s + one(i))


def worst(issues: Column) -> Column:
    """The worst severity of an array; info if it is empty."""
    out = F.lit("info")
    for s in reversed(SEVERITIES[:3]):
        out = F.when(F.coalesce(_has(issues, s), F.lit(False)), s).otherwise(out)
    return out


def _has(issues: Column, severity: str) -> Column:
    return F.exists(issues, lambda i: i["severity"] == severity)


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear between points, level beyond the ends."""
    points = sorted(points)
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(x.isNotNull(), F.lit(points[-1][1])))


def flagged(df: DataFrame, analysed: str, issues: str) -> DataFrame:
    """One row: how many are analysed, and how many of these have an issue."""
    done = F.coalesce(F.col(analysed), F.lit(False))
    return df.agg(F.count_if(done).alias("analysed"), F.count_if(done & (F.coalesce(F.array_size(issues), F.lit(0)) > 0)).alias("flagged"))


def sortable(df: DataFrame, tags: str) -> DataFrame:
    """kind (tag or file), name and place of each column that can be shown and sorted by: the fields of the struct `tags`
    in their order, then the other columns by name."""
    inner = df.schema[tags].dataType.names
    outer = sorted(c for c in df.columns if c != tags)
    rows = [("tag", c, i) for i, c in enumerate(inner)] + [("file", c, i) for i, c in enumerate(outer)]
    return df.sparkSession.createDataFrame(rows, "kind string, name string, place int")
