"""Rank postings against one CV vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions.text import cut
from rolecall.functions.vectors import cosine
from rolecall.operators.numbering import number_rows

SCORE = "similarity_score"


def score_jobs(jobs: DataFrame, cv: DataFrame, embedding: str = "embedding", zero_is_error: bool = False) -> DataFrame:
    """Cosine score per posting. The CV is a one-row table and enters as a scalar subquery, so there is no join."""
    staged = jobs.withColumn("_cv", cv.select("embedding").scalar())
    return staged.withColumn(SCORE, cosine(F.col(embedding), F.col("_cv"), zero_is_error)).drop("_cv")


def _order(position: str) -> list[Column]:
    return [F.col(SCORE).desc_nulls_last(), F.col(position).asc()]


def top_matches(scored: DataFrame, position: str, limit: int = 10) -> DataFrame:
    """The best postings, ranked from 1; equal scores in input order. Only ``limit`` rows meet in one task."""
    best = scored.orderBy(*_order(position)).limit(limit)
    rank = F.row_number().over(Window.orderBy(*_order(position)))
    return best.withColumn("rank", rank.cast("long"))


def rank_all(scored: DataFrame, position: str) -> DataFrame:
    """Every posting with its rank, by a spread-out sort of scores and positions; ``position`` is unique."""
    ranks = number_rows(scored.select(position, SCORE), _order(position), "rank")
    others = [c for c in scored.columns if c not in (position, SCORE)]
    ranked = ranks.join(scored.select(position, *others), position) if others else ranks
    return ranked.select(*scored.columns, "rank")


def score_statistics(scored: DataFrame) -> DataFrame:
    """Count, mean, highest, lowest and population deviation, in percent."""
    percent = F.col(SCORE) * 100
    return scored.agg(
        F.count("*").alias("scored"),
        F.avg(percent).alias("mean_pct"),
        F.max(percent).alias("max_pct"),
        F.min(percent).alias("min_pct"),
        F.stddev_pop(percent).alias("stddev_pct"),
    )


def ranked_report(ranked: DataFrame, source_file: str, total: DataFrame) -> DataFrame:
    """Text lines of the ranking: a header, then three lines per posting.

    ``ranked`` is a bounded top-k; ``total`` is a one-row table with the number of scored rows.
    """
    header = total.select(
        F.lit(0).cast("long").alias("rank"),
        F.concat(
            F.lit(f"CV: {source_file}\nJobs analyzed: "), F.col(total.columns[0]).cast("string"),
            F.lit("\n" + "=" * 60 + "\n"),
        ).alias("value"),
    )
    entry = F.concat(
        F.format_string("#%d | Score: %.4f\n", F.col("rank"), F.col(SCORE)),
        F.format_string(
            "    %s @ %s\n", F.coalesce("title", F.lit("Unknown")), F.coalesce("company_name", F.lit("Unknown"))
        ),
        F.format_string("    %s...\n", cut(F.coalesce("description", F.lit("")), 200)),
    )
    return header.unionByName(ranked.select("rank", entry.alias("value"))).orderBy("rank")


def display_line(score: Column) -> Column:
    return F.format_string("%.2f%%", score * 100)


def for_export(scored: DataFrame) -> DataFrame:
    """Without the bulky columns."""
    return scored.drop("embedding", "full_text")


def model_mismatch(jobs: DataFrame, cv: DataFrame, model: str = "model_name") -> DataFrame:
    """Flag vectors that come from another model than the CV's."""
    return jobs.withColumn("model_mismatch", F.col(model) != cv.select(model).scalar())
