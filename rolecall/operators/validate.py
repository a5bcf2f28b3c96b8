"""Row validation: cleaned columns beside a list of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import blank_to_null, has_text, strip
from rolecall.functions.urls import normalise_url
from rolecall.schemas import RAW_JOB

# The states a batch may have.
BATCH_STATES = ("processing", "completed", "failed")

ERROR_TITLE_MISSING = "title: field required"
ERROR_TITLE_BLANK = "title cannot be empty or whitespace"
ERROR_URL_EMPTY = "url cannot be empty"
ERROR_URL_INVALID = "url: invalid http(s) URL"


def with_raw_fields(df: DataFrame) -> DataFrame:
    """Add the raw-job columns a source lacks as NULL; other columns are kept."""
    have = set(df.columns)
    return df.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_JOB.fields if f.name not in have]
    )


def check_jobs(raw: DataFrame) -> DataFrame:
    """Validate raw postings.

    Result: the declared columns under ``raw`` as they came, the cleaned ones under ``job``, and
    ``errors``. Columns that are not declared are kept beside them.
    """
    full = with_raw_fields(raw)
    declared = [f.name for f in RAW_JOB.fields]
    extra = [c for c in raw.columns if c not in set(declared)]
    url = normalise_url(F.col("raw.url"))
    staged = full.select(*extra, F.struct(*declared).alias("raw")).withColumn("_url", url)
    title = strip(F.col("raw.title"))
    wrong_type = F.transform(
        F.coalesce("raw.type_errors", F.array().cast("array<string>")),
        lambda name: F.concat(name, F.lit(": input should be a valid string")),
    )
    own = F.array(
        F.when(F.col("raw.title").isNull(), F.lit(ERROR_TITLE_MISSING)).when(title == "", F.lit(ERROR_TITLE_BLANK)),
        F.when(~has_text(F.col("raw.url")), F.lit(ERROR_URL_EMPTY)).when(
            F.col("_url").isNull(), F.lit(ERROR_URL_INVALID)
        ),
    )
    cleaned: dict[str, Column] = {"title": title, "url": F.col("_url")}
    for name in ("company_name", "department", "location"):
        cleaned[name] = blank_to_null(F.col(f"raw.{name}"))
    job = F.struct(
        *[cleaned.get(name, F.col(f"raw.{name}")).alias(name) for name in declared if name != "type_errors"]
    )
    return staged.select(*extra, "raw", job.alias("job"), F.concat(wrong_type, F.array_compact(own)).alias("errors"))


def valid_jobs(checked: DataFrame) -> DataFrame:
    extra = [c for c in checked.columns if c not in ("raw", "job", "errors")]
    return checked.where(F.size("errors") == 0).select(*extra, "job.*")


def invalid_jobs(checked: DataFrame) -> DataFrame:
    """The original posting and its error text."""
    extra = [c for c in checked.columns if c not in ("raw", "job", "errors")]
    return checked.where(F.size("errors") > 0).select(
        *extra, F.col("raw").alias("job"), F.array_join("errors", "; ").alias("error")
    )


def validation_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.size("errors") > 0).alias("invalid"), F.count("*").alias("total"))


def known_columns(df: DataFrame, names: list[str]) -> None:
    """Reject names that the table does not have."""
    unknown = [name for name in names if name not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; available: {df.columns}")


def with_text(df: DataFrame, text: str) -> DataFrame:
    """Guard before embedding: rows whose text is blank go."""
    return df.where(has_text(F.col(text)))


def valid_states(ledger: DataFrame, status: str = "status") -> DataFrame:
    """Rows that satisfy the state check; NULL satisfies it, as in a table constraint."""
    return ledger.where(F.col(status).isNull() | F.col(status).isin(*BATCH_STATES))
