"""Table maintenance: a change applied to a snapshot gives the next snapshot.

Plain Parquet tables take no MERGE, so each change is a function of DataFrames. The bulky jobs
table only ever grows by appended deltas; whole snapshots are rewritten for the small tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import blank_to_null, embedding_text, empty_to_null, has_text, storage_description
from rolecall.functions.urls import netloc, url_hash
from rolecall.operators.dedupe import first_by_key, keep_one
from rolecall.operators.dimensions import with_department_id, with_location_id
from rolecall.operators.joins import drop_known, small_side
from rolecall.operators.numbering import number_keys, number_rows
from rolecall.operators.validate import valid_states, with_raw_fields
from rolecall.schemas import COMPANY, JOB
from rolecall.session import cut_lineage

# Defaults of the stored columns.
DEFAULT_SOURCE = "google_serper"
DEFAULT_EMPLOYMENT = "Full-time"


class Change(NamedTuple):
    """The next snapshot, and the rows that the change touched or refused."""

    snapshot: DataFrame
    rows: DataFrame


def next_id(table: DataFrame) -> int:
    """One more than the highest id; a single aggregated value reaches the driver."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def mark_new(incoming: DataFrame, stored: DataFrame, key: str, position: str) -> DataFrame:
    """Incoming rows with ``is_new``: first of its key and not stored yet. Rows without a key are not new.

    Of rows that share key and position one is new: rows are worked out and told apart once, before they meet.
    """
    rows = cut_lineage(incoming.withColumn("_row", F.monotonically_increasing_id()))
    usable = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    winners = first_by_key(usable.select(key, F.struct(position, "_row").alias("_at")), [key], "_at")
    won = drop_known(winners, stored, key).select(F.col("_at._row").alias("_row"), F.lit(True).alias("is_new"))
    marked = rows.join(won, "_row", "left").select(*incoming.columns, "is_new")
    return marked.withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def insert_companies(
    companies: DataFrame, incoming: DataFrame, position: str, as_of: Column, new_is_small: bool = False, first_id: int | None = None
) -> Change:
    """Insert companies whose page URL is new; the first writer of a URL wins.

    Pass ``first_id`` where the highest id is known, from the last load; else the ids are scanned for it.
    """
    required = F.col("company_name").isNotNull() & F.col("domain").isNotNull()
    usable = incoming.where(required & (F.coalesce("company_page_url", F.lit("")) != ""))
    fresh = drop_known(
        first_by_key(usable, ["company_page_url"], position), companies, "company_page_url", new_is_small
    )
    numbered = number_keys(fresh, "company_page_url", [position], "id", next_id(companies) if first_id is None else first_id)
    have = set(incoming.columns)
    source = F.col("source") if "source" in have else F.lit(DEFAULT_SOURCE)
    values = {
        "discovered_at": as_of, "last_scraped": F.lit(None), "is_active": F.lit(True), "source": source,
        "title": F.col("title") if "title" in have else F.lit(None),
    }
    rows = numbered.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in COMPANY.fields]
    )
    return Change(companies.select(*COMPANY.names).unionByName(rows), rows)


def job_rows(
    incoming: DataFrame,
    departments: DataFrame,
    department_synonyms: DataFrame,
    locations: DataFrame,
    location_synonyms: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Stored form of validated postings: normalised ids, flat description, hash and host.

    Defaults fill in only where the source has no such column, not where its value is NULL.
    """
    have = set(incoming.columns)
    given = lambda name, default: F.col(name) if name in have else default
    full = with_raw_fields(incoming)
    full = with_department_id(full, departments, department_synonyms)
    full = with_location_id(full, locations, location_synonyms)
    values = {
        "employment_type": given("employment_type", F.lit(DEFAULT_EMPLOYMENT)),
        "scraped_at": as_of,
        "publish_date": F.coalesce(empty_to_null(F.col("last_updated")), given("publish_date", F.lit(None))),
        "description": storage_description(F.col("description_map"), F.col("description_text")),
        "embedding": given("embedding", F.lit(None)),
        "url_hash": url_hash(F.col("url")),
        "from_domain": netloc(F.col("url")),
        "is_ai_inferred": F.coalesce(given("is_ai_inferred", F.lit(False)), F.lit(False)),
    }
    values["id"] = given("id", F.lit(None))
    stored = [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in JOB.fields]
    text = embedding_text(F.col("title"), F.col("description_map"), F.col("description_text"))
    return full.select(*stored, text.alias("embed_text"))


def insert_jobs(
    stored: DataFrame,
    incoming: DataFrame,
    position: str,
    departments: DataFrame,
    department_synonyms: DataFrame,
    locations: DataFrame,
    location_synonyms: DataFrame,
    as_of: Column,
    first_id: int | None = None,
    new_is_small: bool = False,
) -> DataFrame:
    """The delta to append: postings whose URL is new, in stored form, with ids in insert order.

    The delta also carries ``embed_text``, the text to embed for each newly stored row. Known
    and repeated URLs leave before the bulky columns are built or the reference joins run. Pass
    ``first_id`` where the highest id is known, from the last load; else the ids are scanned for it.
    """
    usable = incoming.where(F.col("title").isNotNull() & (F.coalesce("url", F.lit("")) != ""))
    hashed = usable.withColumn("url_hash", url_hash(F.col("url")))
    fresh = drop_known(first_by_key(hashed, ["url_hash"], position), stored, "url_hash", new_is_small)
    start = next_id(stored) if first_id is None else first_id
    # only hashes and positions are sorted; the texts stay where the search for first copies has put them
    numbered = number_keys(fresh, "url_hash", [position], "id", start).drop("url_hash")
    rows = job_rows(numbered, departments, department_synonyms, locations, location_synonyms, as_of)
    return rows.select(*JOB.names, "embed_text")


def persist_jobs(stored: DataFrame, incoming: DataFrame, position: str, **parts) -> DataFrame:
    """As ``insert_jobs``, for postings that have a text to embed."""
    full = with_raw_fields(incoming)
    text = embedding_text(F.col("title"), F.col("description_map"), F.col("description_text"))
    return insert_jobs(stored, full.where(has_text(text)).select(*incoming.columns), position, **parts)


def _touch(table: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    keys = touched.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(small_side(keys), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def touch_companies(companies: DataFrame, scraped: DataFrame, as_of: Column) -> DataFrame:
    """Set the scrape time of the given page URLs."""
    hit = _touch(companies, "company_page_url", scraped)
    newer = F.when(F.col("_hit"), as_of).otherwise(F.col("last_scraped"))
    return hit.withColumn("last_scraped", newer).select(*companies.columns)


def deactivate_companies(companies: DataFrame, closed: DataFrame) -> DataFrame:
    hit = _touch(companies, "company_page_url", closed)
    return hit.withColumn("is_active", F.col("is_active") & ~F.col("_hit")).select(*companies.columns)


def delete_by_url(table: DataFrame, urls: DataFrame, key: str) -> Change:
    """Snapshot without the given URLs, and the rows that went. Blank URLs delete nothing."""
    doomed = small_side(urls.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct())
    return Change(table.join(doomed, key, "left_anti"), table.join(doomed, key, "left_semi"))


def insert_dimension(dimension: DataFrame, incoming: DataFrame) -> Change:
    """Add named rows; ``rows`` holds what was refused: blank names and names that exist."""
    optional = [c for c in dimension.columns if c not in ("id", "canonical_name")]
    have = set(incoming.columns)
    tidy = incoming.select(
        blank_to_null(F.col("canonical_name")).alias("canonical_name"),
        *[(blank_to_null(F.col(c)) if c in have else F.lit(None).cast("string")).alias(c) for c in optional],
    )
    named = tidy.where(F.col("canonical_name").isNotNull())
    order = [F.col(c).asc_nulls_first() for c in ("canonical_name", *optional)]
    unique = keep_one(named, ["canonical_name"], order)
    fresh = unique.join(dimension.select("canonical_name"), "canonical_name", "left_anti")
    numbered = number_rows(fresh, ["canonical_name"], "id", next_id(dimension)).select(*dimension.columns)
    known = tidy.join(dimension.select("canonical_name"), "canonical_name", "left_semi")
    blank = tidy.where(F.col("canonical_name").isNull())
    return Change(dimension.unionByName(numbered), known.unionByName(blank))


def update_dimension(dimension: DataFrame, changes: DataFrame) -> Change:
    """Replace rows by id. Refused: blank names, names that another row holds, and of several changes of one
    id or to one name all but the first in order of the new values and ids."""
    values = [c for c in dimension.columns if c != "id"]
    tidy = changes.select("id", *[blank_to_null(F.col(c)).alias(c) for c in values])
    holders = dimension.select("canonical_name", F.col("id").alias("_holder"))
    checked = tidy.join(holders, "canonical_name", "left").withColumn(
        "_ok", F.col("canonical_name").isNotNull() & F.coalesce(F.col("_holder") == F.col("id"), F.lit(True))
    )
    per_id = Window.partitionBy("id", "_ok").orderBy(*values)
    per_name = Window.partitionBy("canonical_name", "_ok").orderBy("id")
    checked = checked.withColumn("_ok", F.col("_ok") & (F.row_number().over(per_id) == 1))
    checked = checked.withColumn("_ok", F.col("_ok") & (F.row_number().over(per_name) == 1))
    accepted = checked.where("_ok").select("id", *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_hit"))
    merged = dimension.join(accepted, "id", "left")
    new = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return Change(merged.select("id", *new), checked.where(~F.col("_ok")).select(*tidy.columns))


def add_synonyms(synonyms: DataFrame, dimension: DataFrame, incoming: DataFrame, id_column: str) -> Change:
    """Add synonyms of existing rows. Refused: blank and known synonyms, unknown dimension rows."""
    tidy = incoming.select(blank_to_null(F.col("synonym")).alias("synonym"), id_column)
    linked = tidy.join(dimension.select(F.col("id").alias(id_column)), id_column, "left_semi")
    unique = keep_one(linked.where(F.col("synonym").isNotNull()), ["synonym"], [F.col(id_column).asc()])
    fresh = unique.join(synonyms.select("synonym"), "synonym", "left_anti")
    numbered = number_rows(fresh, ["synonym"], "id", next_id(synonyms)).select(*synonyms.columns)
    refused = tidy.join(fresh, ["synonym", id_column], "left_anti")
    return Change(synonyms.unionByName(numbered), refused)


class Cascade(NamedTuple):
    dimension: DataFrame
    synonyms: DataFrame
    jobs: DataFrame


def delete_dimension(
    dimension: DataFrame, synonyms: DataFrame, jobs: DataFrame, doomed: DataFrame, id_column: str
) -> Cascade:
    """Delete dimension rows by id; their synonyms go too and postings lose the id."""
    ids = small_side(doomed.select(F.col("id").alias(id_column)).distinct())
    hit = jobs.join(ids.withColumn("_hit", F.lit(True)), id_column, "left")
    cleared = F.when(F.col("_hit").isNull(), F.col(id_column))
    return Cascade(
        dimension.join(ids, dimension["id"] == ids[id_column], "left_anti"),
        synonyms.join(ids, id_column, "left_anti"),
        hit.withColumn(id_column, cleared).select(*jobs.columns),
    )


def delete_synonyms(synonyms: DataFrame, doomed: DataFrame) -> DataFrame:
    return synonyms.join(doomed.select("synonym"), "synonym", "left_anti")


def add_batches(ledger: DataFrame, batches: DataFrame, as_of: Column) -> DataFrame:
    """Register batches as processing; known ids stay as they are."""
    ids = batches.select("batch_id").where(F.col("batch_id").isNotNull()).distinct()
    fresh = ids.join(ledger.select("batch_id"), "batch_id", "left_anti")
    rows = fresh.select("batch_id", F.lit("processing").alias("status"), as_of.cast("timestamp").alias("created_at"))
    return ledger.select(*rows.columns).unionByName(rows)


# Remote states that mean the batch is still under way.
UNDER_WAY = ("validating", "in_progress", "finalizing")


def route_batches(ledger: DataFrame, remote: DataFrame) -> DataFrame:
    """Next state of each processing batch from its landed remote state.

    ``action`` says what to do: ingest the results, mark as failed, wait, or warn.
    """
    states = remote.select("batch_id", F.col("status").alias("remote_status"))
    open_batches = ledger.where(F.col("status") == "processing").join(states, "batch_id", "left")
    remote_status = F.col("remote_status")
    action = (
        F.when(remote_status == "completed", F.lit("ingest"))
        .when(remote_status == "failed", F.lit("fail"))
        .when(remote_status.isin(*UNDER_WAY), F.lit("wait"))
        .otherwise(F.lit("warn"))
    )
    return open_batches.withColumn("action", action).withColumn(
        "next_status",
        F.when(F.col("action") == "ingest", F.lit("completed"))
        .when(F.col("action") == "fail", F.lit("failed"))
        .otherwise(F.col("status")),
    )


def set_batch_status(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (batch_id, status) updates with a valid state; unknown ids change nothing."""
    wanted = valid_states(updates).select("batch_id", F.col("status").alias("_status"))
    joined = ledger.join(wanted, "batch_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).select(*ledger.columns)


def ensure_column(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    """Add a NULL column to tables written before it existed."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def latest_status(events: DataFrame, key: str = "job_id", at: str = "changed_at", state: str = "status") -> DataFrame:
    """Current state per posting from an append-only status log."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, state)).alias(state), F.max(at).alias(at))

