"""Search results to companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import WHITESPACE, blank_to_null, empty_to_null, strip
from rolecall.functions.urls import clean_company_page_url
from rolecall.operators.tables import DEFAULT_SOURCE
from rolecall.schemas import SEARCH_RESULTS

# Title decorations of the hosting sites and the separators that may trail a name.
COMEET = "comeet.com"
TITLE_PREFIX, TITLE_SUFFIX = "Jobs at ", " - Comeet"
SEPARATORS = "-|:·"
LEGACY_PREFIXES = ("Jobs at ", "Careers at ", "Work at ")
LEGACY_STOPS = (" Jobs", " Careers", " - ", " | ")


def company_name(title: Column, domain: Column) -> Column:
    """Company in a page title. Trailing separators and white space are peeled together."""
    bare = F.replace(F.replace(title, F.lit(TITLE_PREFIX), F.lit("")), F.lit(TITLE_SUFFIX), F.lit(""))
    name = strip(F.when(domain == COMEET, bare).otherwise(title))
    return empty_to_null(F.rtrim(name, F.lit(SEPARATORS + WHITESPACE)))


def legacy_company_name(title: Column, domain: Column) -> Column:
    """Older rule: cut between a known prefix and the first known stop, else at the word Jobs, else at a separator."""
    clean = title
    for mark in (" - ", " | "):
        clean = F.replace(clean, F.concat(F.lit(mark), domain), F.lit(""))
    result = None
    for prefix in LEGACY_PREFIXES:
        name = strip(F.get(F.split(clean, f"\\Q{prefix}\\E"), F.lit(1)))
        for stop in LEGACY_STOPS:
            name = strip(F.substring_index(name, stop, 1))
        result = (
            F.when(clean.contains(prefix), name) if result is None else result.when(clean.contains(prefix), name)
        )
    lead = F.substring_index(F.substring_index(clean, " - ", 1), " | ", 1)
    return result.when(clean.contains("Jobs"), strip(F.substring_index(clean, "Jobs", 1))).otherwise(
        blank_to_null(lead)
    )


def search_hits(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per organic hit of a landed result page; pages without hits give none."""
    keep = [c for c in pages.columns if c != payload]
    first = F.get(F.from_json(payload, SEARCH_RESULTS), F.lit(0))
    hits = pages.select(*keep, F.posexplode(first["organic"]).alias("hit_pos", "_hit"))
    return hits.select(*keep, "hit_pos", "_hit.title", "_hit.link")


def hits_to_companies(hits: DataFrame, domain: str = "domain") -> DataFrame:
    """Companies named by search hits; hits without a name or link are dropped."""
    extra = [c for c in hits.columns if c not in ("title", "link", domain)]
    named = hits.withColumn("company_name", company_name(F.col("title"), F.col(domain)))
    usable = named.where(F.col("company_name").isNotNull() & (F.coalesce("link", F.lit("")) != ""))
    return usable.select(
        *extra,
        "company_name",
        F.col(domain).alias("domain"),
        clean_company_page_url(F.col("link")).alias("company_page_url"),
        "title",
        F.lit(DEFAULT_SOURCE).alias("source"),
    )


def discovery_counters(marked: DataFrame) -> DataFrame:
    """New companies and results per domain."""
    return marked.groupBy("domain").agg(F.count_if("is_new").alias("new_companies"), F.count("*").alias("results"))


def log_search(log: DataFrame, searches: DataFrame, as_of: Column) -> DataFrame:
    """Append searches to the search log."""
    return log.unionByName(searches.withColumn("searched_at", as_of).select(*log.columns))


def domains_due(log: DataFrame, domains: DataFrame, as_of: Column, max_age_hours: int) -> DataFrame:
    """Domains never searched, or last searched longer ago than the limit."""
    last = log.groupBy("domain").agg(F.max("searched_at").alias("last_searched"))
    limit = as_of - F.make_dt_interval(hours=F.lit(max_age_hours))
    joined = domains.join(last, "domain", "left")
    return joined.where(F.col("last_searched").isNull() | (F.col("last_searched") < limit))


def legacy_companies(legacy: DataFrame) -> DataFrame:
    """Old company records: renamed page URL, epoch seconds as timestamps."""
    return legacy.select(
        "company_name", "domain", F.col("job_page_url").alias("company_page_url"), "title",
        F.timestamp_seconds("discovered_at").alias("discovered_at"),
        F.timestamp_seconds("last_scraped").alias("last_scraped"),
    )
