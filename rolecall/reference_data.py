"""Seed rows of the reference tables, loaded once and idempotently."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.operators.dedupe import first_by_key
from rolecall.schemas import DEPARTMENT, LOCATION

# Canonical departments with their category.
DEPARTMENTS = (
    ("Engineering", "R&D"),
    ("Software Development", "R&D"),
    ("Research & Development", "R&D"),
    ("Product Management", "Product"),
    ("Design", "Product"),
    ("Data Science", "R&D"),
    ("Quality Assurance", "R&D"),
    ("DevOps", "R&D"),
    ("Marketing", "Marketing"),
    ("Sales", "Sales"),
    ("Business Development", "Sales"),
    ("Customer Success", "Customer"),
    ("Customer Support", "Customer"),
    ("Operations", "Operations"),
    ("Finance", "Finance"),
    ("Human Resources", "HR"),
    ("Legal", "Legal"),
    ("Executive", "Executive"),
    ("Strategy", "Strategy"),
    ("Clinical", "Clinical"),
    ("Regulatory Affairs", "Regulatory"),
    ("Manufacturing", "Operations"),
    ("Supply Chain", "Operations"),
)

# Other spellings of a department.
DEPARTMENT_SYNONYMS = (
    ("R&D", "Research & Development"),
    ("Engineering", "Engineering"),
    ("Software Engineering", "Software Development"),
    ("SWE", "Software Development"),
    ("Product", "Product Management"),
    ("PM", "Product Management"),
    ("QA", "Quality Assurance"),
    ("Quality", "Quality Assurance"),
    ("Data", "Data Science"),
    ("Analytics", "Data Science"),
    ("BD", "Business Development"),
    ("BizDev", "Business Development"),
    ("CS", "Customer Success"),
    ("Support", "Customer Support"),
    ("HR", "Human Resources"),
    ("People", "Human Resources"),
    ("People Ops", "Human Resources"),
    ("Ops", "Operations"),
    ("CEO Office", "Executive"),
    ("Executive Office", "Executive"),
    ("Strategy and Corporate Affairs", "Strategy"),
    ("Corporate Affairs", "Strategy"),
)

# Canonical places with country and region.
LOCATIONS = (
    ("Tel Aviv", "Israel", "Center"),
    ("Jerusalem", "Israel", "Jerusalem"),
    ("Haifa", "Israel", "North"),
    ("Petah Tikva", "Israel", "Center"),
    ("Yokneam", "Israel", "North"),
    ("Rishon LeZion", "Israel", "Center"),
    ("Herzliya", "Israel", "Center"),
    ("Ramat Gan", "Israel", "Center"),
    ("Netanya", "Israel", "Center"),
    ("Beer Sheva", "Israel", "South"),
    ("Holon", "Israel", "Center"),
    ("Bnei Brak", "Israel", "Center"),
    ("Raanana", "Israel", "Center"),
)

# Other spellings of a place.
LOCATION_SYNONYMS = (
    ("TLV", "Tel Aviv"),
    ("Tel-Aviv", "Tel Aviv"),
    ("Tel Aviv-Yafo", "Tel Aviv"),
    ("Petah Tiqva", "Petah Tikva"),
    ("Petach Tikva", "Petah Tikva"),
    ("Yokne'am", "Yokneam"),
    ("Yokne'am Illit", "Yokneam"),
    ("Yokneam Illit", "Yokneam"),
    ("Ramat-Gan", "Ramat Gan"),
    ("Ra'anana", "Raanana"),
    ("Ra-anana", "Raanana"),
    ("Beersheba", "Beer Sheva"),
    ("Be'er Sheva", "Beer Sheva"),
)


_SEED_SYNONYM = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("synonym", T.StringType()),
     T.StructField("canonical_name", T.StringType())]
)


def _table(spark: SparkSession, rows: tuple, schema: T.StructType) -> DataFrame:
    """Rows numbered from 1 as a local relation, whose size the planner knows."""
    columns = list(zip(*[(i, *row) for i, row in enumerate(rows, 1)], strict=True))
    return spark.createDataFrame(pa.table(dict(zip(schema.names, columns, strict=True))), schema)


def departments(spark: SparkSession) -> DataFrame:
    return _table(spark, DEPARTMENTS, DEPARTMENT)


def locations(spark: SparkSession) -> DataFrame:
    return _table(spark, LOCATIONS, LOCATION)


def resolve_synonyms(seed: DataFrame, dimension: DataFrame, id_column: str) -> DataFrame:
    """Synonym rows (id, synonym, canonical_name) with the id of their dimension row."""
    unique = first_by_key(seed, ["synonym"], "id")
    ids = dimension.select("canonical_name", F.col("id").alias(id_column))
    return unique.join(ids, "canonical_name").select("id", "synonym", id_column)


def _seed_synonyms(spark: SparkSession, rows: tuple) -> DataFrame:
    return _table(spark, rows, _SEED_SYNONYM)


def department_synonyms(spark: SparkSession) -> DataFrame:
    return resolve_synonyms(_seed_synonyms(spark, DEPARTMENT_SYNONYMS), departments(spark), "department_id")


def location_synonyms(spark: SparkSession) -> DataFrame:
    return resolve_synonyms(_seed_synonyms(spark, LOCATION_SYNONYMS), locations(spark), "location_id")


def load_seed(existing: DataFrame, seed: DataFrame, key: str = "canonical_name") -> DataFrame:
    """Seed rows that the table lacks, appended; running it again changes nothing."""
    fresh = first_by_key(seed, [key], "id").join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
