"""Distributions, table checks and the daily digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import stable_job_id
from rolecall.session import cut_lineage


def distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), F.col(column).asc())
    return counts.limit(limit) if limit else counts


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of several columns in one pass."""
    sets = [[F.col(c)] for c in columns]
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns])
    names = [F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]
    values = [F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns]
    return grouped.agg(
        F.coalesce(*names).alias("column"), F.coalesce(*values).alias("value"), F.count("*").alias("rows")
    ).select("column", "value", "rows")


def verify_tables(
    tables: dict[str, DataFrame | None], required: dict[str, list[str]] | None = None, keys: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per table: present, row count, missing columns, one sample row as JSON.

    The report is as long as the list of names; each table is read once, by one aggregate. The sample is the row
    of the least values of the columns in ``keys`` (all columns by default) and shows these.
    """
    rows = []
    spark = next(df for df in tables.values() if df is not None).sparkSession
    for name, df in tables.items():
        if df is None:
            row = spark.range(1).select(
                F.lit(name).alias("table"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("rows"),
                F.lit(f"table {name} is missing").alias("error"), F.lit(None).cast("string").alias("sample"),
            )
        else:
            lacking = [c for c in (required or {}).get(name, []) if c not in df.columns]
            error = F.lit(f"missing columns: {', '.join(lacking)}") if lacking else F.lit(None).cast("string")
            shown = F.struct(*[F.col(f"`{c}`") for c in (keys or {}).get(name, df.columns)])
            row = df.agg(F.count("*").alias("rows"), F.min(shown).alias("_least")).select(
                F.lit(name).alias("table"), F.lit(True).alias("present"), "rows", error.alias("error"),
                F.to_json("_least").alias("sample"),
            )
        rows.append(row)
    return reduce(DataFrame.unionByName, rows)


def unseen(jobs: DataFrame, seen: DataFrame, key: str = "job_id") -> DataFrame:
    """Postings not announced before."""
    return jobs.join(seen.select(key), key, "left_anti")


def remember(seen: DataFrame, jobs: DataFrame, as_of: Column, key: str = "job_id") -> DataFrame:
    """Seen store with the first time of each posting."""
    fresh = jobs.select(key, as_of.cast("timestamp").alias("first_seen"))
    return seen.select(key, "first_seen").unionByName(fresh).groupBy(key).agg(F.min("first_seen").alias("first_seen"))


def digest(ranked: DataFrame) -> DataFrame:
    """Lines of the daily digest: a count, then one block per posting of a bounded, ranked top-k."""
    text = lambda name: F.coalesce(F.col(name), F.lit("N/A"))
    block = F.concat(
        F.format_string("%d) [%s] %s — score %.2f\n", "rank", text("company_name"), text("title"), "similarity_score"),
        F.format_string("   Location: %s\n   URL: %s\n", text("location"), text("url")),
        F.format_string("   Highlights: %s", F.array_join("highlights", ", ")),
    )
    line = F.struct(F.col("rank").cast("long").alias("rank"), block.alias("value"))
    # written once, so that the ranking behind it runs once; nothing is gathered
    lines = cut_lineage(ranked.select(line.alias("line")).select("line.*"))
    title = F.concat(F.lit("Daily matched jobs ("), F.count("*").cast("string"), F.lit(")"))
    header = lines.agg(title.alias("value")).select(F.lit(0).cast("long").alias("rank"), "value")
    return header.unionByName(lines).orderBy("rank")


def export_rows(jobs: DataFrame) -> DataFrame:
    """Filtered-job export: the documented columns under their export names."""
    have = set(jobs.columns)
    given = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    return jobs.select(
        stable_job_id(F.col("company_name"), F.col("title"), F.col("url")).alias("job_id"),
        F.col("company_name").alias("company"), "title", "location", "department", "description",
        F.col("url").alias("apply_url"), given("tags", "array<string>").alias("tags"),
        F.coalesce(given("similarity_score", "double"), F.lit(0.0)).alias("score"),
    )

