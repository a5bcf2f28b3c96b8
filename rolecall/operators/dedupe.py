"""Keep one row per key. The row limit per key runs before the shuffle, so hot keys stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[Column | str], order_by: list[Column]) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", ranked).where(F.col("_rank") == 1).drop("_rank")


def first_by_key(df: DataFrame, keys: list[Column | str], position: str) -> DataFrame:
    return keep_one(df, keys, [F.col(position).asc()])


def last_by_key(df: DataFrame, keys: list[Column | str], position: str) -> DataFrame:
    return keep_one(df, keys, [F.col(position).desc()])


def unique_companies(companies: DataFrame, position: str, url: str = "company_page_url") -> DataFrame:
    """First company per page URL; rows without a URL go."""
    return first_by_key(companies.where(F.coalesce(F.col(url), F.lit("")) != ""), [url], position)


def unique_jobs(jobs: DataFrame, position: str, title: str = "title", company: str = "company") -> DataFrame:
    """First posting per title and company; a missing part counts as empty."""
    part = lambda name: F.coalesce(F.col(name), F.lit(""))
    return first_by_key(jobs, [F.concat(part(title), F.lit("_"), part(company))], position)
