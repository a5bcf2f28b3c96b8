"""Keep or reject valid postings, with the reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import HEBREW, SCRIPT_SHARE_LIMIT, mostly_script, screening_text, strip

# The country token, the rejected department, and the reasons in order of checking.
COUNTRY = "ISRAEL"
GENERAL = "general"
NOT_IN_COUNTRY, HEBREW_TEXT, GENERAL_DEPARTMENT = "job_not_in_israel", "hebrew", "general_department"
REASONS = (HEBREW_TEXT, GENERAL_DEPARTMENT, NOT_IN_COUNTRY)


def in_country(location: Column, token: str = COUNTRY) -> Column:
    """Case-sensitive; a missing location is not in the country."""
    return F.coalesce(location.contains(token), F.lit(False))


def is_general(department: Column) -> Column:
    return F.coalesce(F.lower(strip(department)) == GENERAL, F.lit(False))


def reject_reason(
    block: tuple[str, str] = HEBREW, limit: float = SCRIPT_SHARE_LIMIT, token: str = COUNTRY
) -> Column:
    """First failing check of a posting, NULL when it passes all; the cheap check runs first."""
    text = screening_text(
        F.col("title"), F.col("description_map"), F.col("description_text"), F.col("location"), F.col("company_name")
    )
    return (
        F.when(~in_country(F.col("location"), token), F.lit(NOT_IN_COUNTRY))
        .when(mostly_script(text, block, limit), F.lit(HEBREW_TEXT))
        .when(is_general(F.col("department")), F.lit(GENERAL_DEPARTMENT))
    )


def screen(jobs: DataFrame, **options) -> DataFrame:
    return jobs.withColumn("reject_reason", reject_reason(**options))


def kept_jobs(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(screened: DataFrame) -> DataFrame:
    """One row with a count per reason, zeros included, and the kept rows."""
    return screened.agg(
        *[F.count_if(F.col("reject_reason") == reason).alias(reason) for reason in REASONS],
        F.count_if(F.col("reject_reason").isNull()).alias("valid"),
    )


def hard_filter(
    jobs: DataFrame,
    locations: list[str] | None = None,
    departments: list[str] | None = None,
    exclude_internships: bool = False,
    exclude_remote: bool = False,
) -> DataFrame:
    """Deterministic gate ahead of scoring: location match, department whitelist, exclusions."""
    checks = []
    if locations:
        hit = F.lit(False)
        for place in locations:
            hit = hit | F.coalesce(F.col("location").contains(place), F.lit(False))
        checks.append(hit)
    if departments:
        checks.append(F.coalesce(F.col("department").isin(*departments), F.lit(False)))
    if exclude_internships:
        checks.append(~F.coalesce(F.col("experience_level") == "Intern", F.lit(False)))
    if exclude_remote:
        checks.append(~F.coalesce(F.col("workplace_type") == "Remote", F.lit(False)))
    for check in checks:
        jobs = jobs.where(check)
    return jobs


def above_score(scored: DataFrame, min_score: float = 0.6, score: str = "similarity_score") -> DataFrame:
    return scored.where(F.col(score) >= F.lit(min_score))
