"""Read access: filters, point lookups, counts, orders and limits.

An argument that is None, empty or zero means "no filter"; a limit of zero means "no limit".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import ascii_fold
from rolecall.operators.validate import known_columns


def equal_filters(df: DataFrame, **filters) -> DataFrame:
    """AND of equalities over the given arguments that are truthy."""
    for name, value in filters.items():
        if value:
            df = df.where(F.col(name) == F.lit(value))
    return df


def newest(df: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """Latest first; equal times in key order, so that a limit is repeatable."""
    ordered = df.orderBy(F.col(at).desc(), F.col(key).asc())
    return ordered.limit(limit) if limit else ordered


def jobs_by_filters(
    jobs: DataFrame,
    workplace_type: str | None = None,
    experience_level: str | None = None,
    employment_type: str | None = None,
    department_id: int | None = None,
    location_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    kept = equal_filters(
        jobs, workplace_type=workplace_type, experience_level=experience_level, employment_type=employment_type,
        department_id=department_id, location_id=location_id,
    )
    return newest(kept, "scraped_at", "url", limit)


def jobs_by_company(jobs: DataFrame, company_name: str, limit: int | None = None) -> DataFrame:
    return newest(jobs.where(F.col("company_name") == company_name), "scraped_at", "url", limit)


def companies(table: DataFrame, active_only: bool = True, limit: int | None = None) -> DataFrame:
    kept = table.where("is_active") if active_only else table
    return newest(kept, "discovered_at", "company_page_url", limit)


def companies_by_domain(table: DataFrame, domain: str, active_only: bool = True) -> DataFrame:
    return companies(table.where(F.col("domain") == domain), active_only)


def by_url(df: DataFrame, url: str, key: str = "url") -> DataFrame:
    """At most one row: the key is unique."""
    return df.where(F.col(key) == F.lit(url)).limit(1)


def like_pattern(column: Column, value: str) -> Column:
    """Substring LIKE that ignores ASCII case; % and _ in the value are wildcards."""
    folded = "".join(ch.lower() if ch.isascii() else ch for ch in value).replace("\\", "\\\\")
    return ascii_fold(column).like(f"%{folded}%")


def match_any(df: DataFrame, filters: dict[str, list], partial: tuple[str, ...] = ("location",)) -> DataFrame:
    """OR within a column, AND across columns; exact, but substring match for ``partial`` columns."""
    known_columns(df, list(filters))
    for name, values in filters.items():
        if not values:
            continue
        if name in partial:
            hit = like_pattern(F.col(name), values[0])
            for value in values[1:]:
                hit = hit | like_pattern(F.col(name), value)
        else:
            hit = F.col(name).isin(*values)
        df = df.where(hit)
    return df


def filter_records(jobs: DataFrame, filters: dict[str, list]) -> DataFrame:
    return newest(match_any(jobs, filters), "scraped_at", "url")


def stale(
    table: DataFrame, as_of: Column, max_age_hours: int, key: str = "company_page_url", at: str = "last_scraped"
) -> DataFrame:
    """Active rows never scraped, or scraped longer ago than the limit; never-scraped and oldest first."""
    limit = as_of - F.make_dt_interval(hours=F.lit(max_age_hours))
    due = table.where(F.col("is_active") & (F.col(at).isNull() | (F.col(at) < limit)))
    return due.orderBy(F.col(at).asc_nulls_first(), F.col(key).asc())


def embedding_backlog(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Postings with a description and no vector yet, newest first."""
    waiting = jobs.where(F.col("embedding").isNull() & (F.col("description") != ""))
    return newest(waiting, "scraped_at", "url", limit)


def processing_batches(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "processing")


def count_rows(df: DataFrame, name: str = "rows", **filters) -> DataFrame:
    return equal_filters(df, **filters).agg(F.count("*").alias(name))


def count_companies(table: DataFrame, domain: str | None = None, active_only: bool = True) -> DataFrame:
    kept = table.where("is_active") if active_only else table
    return count_rows(kept, "companies", domain=domain)


def count_jobs(
    jobs: DataFrame,
    workplace_type: str | None = None,
    experience_level: str | None = None,
    department_id: int | None = None,
    location_id: int | None = None,
) -> DataFrame:
    return count_rows(
        jobs, "jobs", workplace_type=workplace_type, experience_level=experience_level,
        department_id=department_id, location_id=location_id,
    )


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct filled values of a column in order."""
    known_columns(df, [column])
    kind = df.schema[column].dataType
    blank = "" if isinstance(kind, T.StringType) else False if isinstance(kind, T.BooleanType) else 0
    comparable = isinstance(kind, (T.StringType, T.BooleanType, T.NumericType))
    filled = F.col(column) != F.lit(blank) if comparable else F.col(column).isNotNull()
    return df.where(filled).select(column).distinct().orderBy(column)


def first_rows(df: DataFrame, position: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(position).asc()).limit(limit)


def sample_rows(df: DataFrame, key: str, size: int, seed: int | str = 0) -> DataFrame:
    """Repeatable random sample: the rows with the lowest seeded hash. A top-k, not a full sort."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, F.col(key)).limit(size)


def sample_newest(
    df: DataFrame, at: str, key: str, pool: int = 50, size: int = 50, seed: int | str = 0
) -> DataFrame:
    """Random sample out of the newest rows."""
    return sample_rows(newest(df, at, key, pool), key, size, seed)
