"""Reference tables: raw text to ids, synonyms, usage and roll-ups.

No join here carries a hint: the planner broadcasts a reference table while its known size is
below the broadcast threshold, and shuffles (with skew splitting) beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import ascii_fold, blank_to_null, location_head, strip


def lookup_table(dimension: DataFrame, synonyms: DataFrame, id_column: str) -> DataFrame:
    """Folded name to id. A synonym outranks a canonical name, an older row a newer one."""
    rows = synonyms.select(
        ascii_fold(F.col("synonym")).alias("_name"), F.lit(0).alias("_level"), "id", F.col(id_column).alias("_to")
    ).unionByName(
        dimension.select(
            ascii_fold(F.col("canonical_name")).alias("_name"), F.lit(1).alias("_level"), "id", F.col("id").alias("_to")
        )
    )
    return rows.groupBy("_name").agg(F.min(F.struct("_level", "id", "_to"))["_to"].alias("_to"))


def _normalise(df: DataFrame, name: Column, lookup: DataFrame, out: str) -> DataFrame:
    keyed = df.withColumn("_name", ascii_fold(name))
    return keyed.join(lookup, "_name", "left").withColumn(out, F.col("_to")).drop("_name", "_to")


def with_department_id(df: DataFrame, departments: DataFrame, synonyms: DataFrame, raw: str = "department") -> DataFrame:
    lookup = lookup_table(departments, synonyms, "department_id")
    return _normalise(df, blank_to_null(F.col(raw)), lookup, "department_id")


def with_location_id(df: DataFrame, locations: DataFrame, synonyms: DataFrame, raw: str = "location") -> DataFrame:
    """Matches the text ahead of the first comma."""
    lookup = lookup_table(locations, synonyms, "location_id")
    name = F.when(blank_to_null(F.col(raw)).isNotNull(), location_head(F.col(raw)))
    return _normalise(df, name, lookup, "location_id")


def unresolved(df: DataFrame, raw: str, id_column: str, head: bool = False) -> DataFrame:
    """Raw values that no reference row matches, with their number of rows."""
    name = location_head(F.col(raw)) if head else strip(F.col(raw))
    missing = df.where(F.col(id_column).isNull() & blank_to_null(F.col(raw)).isNotNull())
    return missing.groupBy(name.alias("value")).agg(F.count("*").alias("rows"))


def auto_create(dimension: DataFrame, unknown: DataFrame) -> DataFrame:
    """Dimension with one new row per unresolved value; names that exist already are skipped."""
    from rolecall.operators.tables import insert_dimension

    return insert_dimension(dimension, unknown.select(F.col("value").alias("canonical_name"))).snapshot


def with_synonyms(dimension: DataFrame, synonyms: DataFrame, id_column: str) -> DataFrame:
    """Each dimension row with its synonyms as one text; NULL when it has none.

    Synonyms are unique, so the list is the size of the curated table's own row.
    """
    joined = synonyms.groupBy(F.col(id_column).alias("id")).agg(
        F.expr("listagg(synonym, ', ') WITHIN GROUP (ORDER BY synonym)").alias("synonyms")
    )
    return dimension.join(joined, "id", "left").orderBy("canonical_name")


def synonyms_of(synonyms: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Synonyms of the wanted dimension rows, in alphabetical order."""
    return synonyms.join(ids.select(id_column), id_column, "left_semi").orderBy("synonym")


def usage(dimension: DataFrame, jobs: DataFrame, id_column: str) -> DataFrame:
    """Number of postings per dimension row, zero included."""
    counts = jobs.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("jobs"))
    return dimension.join(counts, "id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)).cast("long"))


def rolled_up(jobs: DataFrame, dimension: DataFrame, id_column: str, level: str) -> DataFrame:
    """Postings per category, country or region. Counts per id come first, so the join is tiny."""
    counts = jobs.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("_jobs"))
    return counts.join(dimension.select("id", level), "id").groupBy(level).agg(F.sum("_jobs").alias("jobs"))


def in_rollup(jobs: DataFrame, dimension: DataFrame, id_column: str, level: str, values: list[str]) -> DataFrame:
    """Postings whose dimension row has one of the level values."""
    wanted = dimension.where(F.col(level).isin(*values)).select(F.col("id").alias(id_column))
    return jobs.join(wanted, id_column, "left_semi")
