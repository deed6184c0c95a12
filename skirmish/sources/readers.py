"""Readers of records: explicit schemas, corrupt rows kept apart, several sources by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def json_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """One document a file (multi_line) or a line, with its file; what doesn't parse is in _corrupt_record."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line)
    return reader.json(path).withColumn("_file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line-delimited JSON; blank lines are skipped."""
    return json_documents(spark, path, schema, multi_line=False)


def rejected(rows: DataFrame) -> DataFrame:
    """How many rows didn't parse, by file. Spark doesn't scan files for the corrupt column alone, so the other columns are read too."""
    others = F.length(F.to_json(F.struct(*[c for c in rows.columns if c not in (CORRUPT, "_file")])))
    return rows.groupBy("_file").agg(F.count_if(F.col(CORRUPT).isNotNull() & (F.coalesce(others, F.lit(0)) >= 0)).alias("rejected")).filter("rejected > 0")


def by_precedence(sources: list[DataFrame], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row a key: that of the last source that has it, and of its rows the first in order."""
    both = None
    for rank, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(rank))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_rank"), *(order or [F.xxhash64(*keys)]))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")


def nest(rows: DataFrame, keys: list[str], fields: list[str], order: list[str], name: str, exactly: int | None = None) -> DataFrame:
    """Children collected under their keys in order; keys without the exact number of children are dropped."""
    child = F.struct(*order, *[f for f in fields if f not in order])
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(child)).alias(name))
    return got if exactly is None else got.filter(F.size(name) == exactly)


def payload(column: str, element: str, roots: tuple[str, ...] = ("data", "rows", "results", "positions")) -> Column:
    """The rows of a payload that is an array itself or holds it under one of several names."""
    inner = [F.from_json(F.col(column), f"{r} array<{element}>")[r] for r in roots]
    whole = F.when(F.ltrim(column).startswith("["), F.from_json(F.col(column), f"array<{element}>"))  # an object would be read as one row
    return F.coalesce(whole, *inner)


def timeline(dim: DataFrame, ts: str, since: int, until: int) -> DataFrame:
    """Entries inside [since, until) and the last one before, with the time the next takes over. A few rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(ts)
    rows = dim.withColumn("effective_end", F.lead(ts).over(w))
    return rows.filter((F.col(ts) < until) & (F.coalesce(F.col("effective_end"), F.lit(until)) > since))


def after_cursor(rows: DataFrame, key: str, cursor: int | None) -> DataFrame:
    """What an incremental load still has to take: rows below the key reached last."""
    return rows if cursor is None else rows.filter(F.col(key) < cursor)
