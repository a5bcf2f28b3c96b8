"""Landed pages to job rows: embedded JSON first, HTML listings second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.html import ANCHOR, CARD, html_listings, html_text_groups
from rolecall.functions.text import empty_to_null, strip
from rolecall.schemas import POSITION, RAW_JOB

# Where a page embeds its positions, and the words that classify a detail line.
EMBEDDED_NAME = "COMPANY_POSITIONS_DATA"
EMBEDDED_POSITIONS = rf"(?s){EMBEDDED_NAME}\s*=\s*(\[.*?\]);"
EMPLOYMENT_WORDS = "full-time|part-time|contract|temporary|freelance"
EXPERIENCE_WORDS = "senior|junior|mid-level|entry|lead|principal|intern"
LISTING_MARKS = ("positionItem", "job-card", "job-listing", "job-item", "position-card")
NO_LOCATION = "Not specified"

# posting column -> key of the embedded element
_EMBEDDED_TEXT = {
    "title": "name", "department": "department", "employment_type": "employment_type",
    "experience_level": "experience_level", "workplace_type": "workplace_type", "uid": "uid",
    "url": "url_comeet_hosted_page", "company_name": "company_name", "email": "email",
    "last_updated": "time_updated",
}


def location_text(location: Column) -> Column:
    """City, country and remote mark joined by a comma; the name when there is none of them."""
    country = empty_to_null(location["country"])
    joined = F.concat_ws(
        ", ",
        empty_to_null(location["city"]),
        F.when(country == "IL", F.lit("ISRAEL")).otherwise(country),
        F.when(location["is_remote"], F.lit("(Remote)")),
    )
    return F.when(joined != "", joined).otherwise(F.coalesce(location["name"], F.lit(NO_LOCATION)))


def original_url(main: Column, active: Column, detected: Column) -> Column:
    """The company's own page of the posting, when it differs from the hosted one."""
    other = F.coalesce(empty_to_null(active), empty_to_null(detected))
    return F.when(F.coalesce(other != main, other.isNotNull()), other)


def details_to_map(names: Column, values: Column) -> Column:
    """Lower-cased names to values; of equal names the last value stays."""
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def classify_details(items: Column) -> Column:
    """Fold detail lines, in order, into location, experience level and employment type.

    Each line is looked at once; the fold itself only compares flags.
    """
    name_type = ("location", "experience", "employment")
    empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in name_type])

    def flags(item: Column) -> Column:
        lowered = F.lower(item["text"])
        words = F.regexp_count(item["text"], F.lit(r"(?U)[^\s\x1c-\x1f]+"))
        kind = (
            F.when(F.coalesce(item["has_marker"], F.lit(False)), F.lit("location"))
            .when(lowered.rlike(EMPLOYMENT_WORDS), F.lit("employment"))
            .when(lowered.rlike(EXPERIENCE_WORDS), F.lit("experience"))
            .when(words <= 2, F.lit("guess"))
        )
        return F.struct(item["text"].alias("text"), kind.alias("kind"))

    def step(acc: Column, line: Column) -> Column:
        text, kind = line["text"], line["kind"]
        blank = lambda name: F.coalesce(acc[name], F.lit("")) == ""
        guess = kind == "guess"
        taken = {
            "location": kind == "location",
            "experience": (kind == "experience") | (guess & blank("experience")),
            "employment": (kind == "employment") | (guess & ~blank("experience") & blank("employment")),
        }
        return F.struct(*[F.when(taken[n], text).otherwise(acc[n]).alias(n) for n in name_type])

    return F.aggregate(F.transform(items, flags), empty, step)


def _raw_job(**fields: Column) -> Column:
    """A full raw-job struct; fields that are not given are NULL."""
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_JOB.fields]
    )


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _mistyped(variant: Column) -> Column:
    """Names of text fields whose JSON value is neither a text nor null."""
    checks = []
    for column, key in _EMBEDDED_TEXT.items():
        kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))
        checks.append(F.when(~F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID"), F.lit(column)))
    return F.array_compact(F.array(*checks))


def usable_details(position: Column) -> Column:
    """Details whose value is a filled text; values of other types go, a missing name is empty."""
    details = F.coalesce(position["custom_fields"]["details"], F.array().cast("array<struct<name:string,value:variant>>"))

    def text_of(detail: Column) -> Column:
        text = F.when(F.schema_of_variant(detail["value"]) == "STRING", F.try_variant_get(detail["value"], "$", "string"))
        return F.struct(F.coalesce(detail["name"], F.lit("")).alias("name"), text.alias("value"))

    return F.filter(F.transform(details, text_of), lambda d: F.coalesce(d["value"], F.lit("")) != "")


def position_to_job(position: Column, texts: Column, type_errors: Column) -> Column:
    """Project one embedded element; ``texts`` are its detail values freed of HTML."""
    names = F.transform(usable_details(position), lambda d: d["name"])
    return _raw_job(
        **{column: position[key] for column, key in _EMBEDDED_TEXT.items()},
        location=location_text(position["location"]),
        original_website_job_url=original_url(
            position["url_comeet_hosted_page"], position["url_active_page"], position["url_detected_page"]
        ),
        description_map=details_to_map(names, texts),
        type_errors=type_errors,
    )


def anchor_to_job(anchor: Column, kind: Column) -> Column:
    """Project one anchor; ``kind`` holds its classified details."""
    return _raw_job(
        title=anchor["title"], url=anchor["url"], location=kind["location"],
        experience_level=kind["experience"], employment_type=kind["employment"], type_errors=_no_errors(),
    )


def card_to_job(card: Column) -> Column:
    return _raw_job(**{name: card[name] for name in CARD.names}, type_errors=_no_errors())


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The page's other columns plus what was found, in one pass: ``_positions`` of the embedded array
    with their detail ``_texts`` and JSON ``_variants``, or the ``_listings`` of the HTML.

    Pages with embedded positions never reach the HTML parser, and of the others only those that
    contain a listing class do. Findings that a caller does not select are not computed.
    """
    keep = [c for c in pages.columns if c != html]
    page = F.col(html)
    # byte searches rule out most pages before any pattern runs
    embedded = F.when(page.contains(EMBEDDED_NAME), F.regexp_extract(page, EMBEDDED_POSITIONS, 1))
    listed = reduce(Column.__or__, [page.contains(mark) for mark in LISTING_MARKS])
    staged = (
        pages.withColumn("_json", empty_to_null(embedded))
        .withColumn("_positions", F.from_json("_json", T.ArrayType(POSITION), {"allowSingleQuotes": "false"}))
        .withColumn("_found", F.coalesce(F.size("_positions") > 0, F.lit(False)))
    )
    values = F.transform("_positions", lambda p: F.transform(usable_details(p), lambda d: d["value"]))
    marked_up = F.exists(F.flatten(values), lambda v: v.contains("<") | v.contains("&"))
    return staged.select(
        *keep,
        "_found",
        "_positions",
        F.try_variant_get(F.try_parse_json("_json"), "$", "array<variant>").alias("_variants"),
        html_listings(F.when(~F.col("_found") & listed, page)).alias("_listings"),
        F.coalesce(
            html_text_groups(F.when(F.col("_found") & marked_up, values)),
            F.transform(values, lambda row: F.transform(row, strip)),
        ).alias("_texts"),
    )


def _postings() -> Column:
    """One array over the three kinds of findings of a parsed page."""
    anchors, cards = F.col("_listings.anchors"), F.col("_listings.cards")

    def source(position: Column, texts: Column, anchor: Column, card: Column) -> Column:
        return F.struct(
            position.cast(POSITION).alias("position"), texts.cast("array<string>").alias("texts"),
            anchor.cast(ANCHOR).alias("anchor"), card.cast(CARD).alias("card"),
        )

    none = F.lit(None)
    return (
        F.when(F.col("_found"), F.transform("_positions", lambda p, i: source(p, F.get("_texts", i), none, none)))
        .when(F.size(anchors) > 0, F.transform(anchors, lambda a: source(none, none, a, none)))
        .otherwise(F.transform(cards, lambda c: source(none, none, none, c)))
    )


def extract_jobs(pages: DataFrame, html: str = "html", strict: bool = True) -> DataFrame:
    """One row per posting found: the page's other columns, ``job_pos`` and the raw-job columns.

    ``strict`` notes text fields that hold another JSON type in ``type_errors``. A page column
    named like a raw-job column would clash: rename it first.
    """
    keep = [c for c in pages.columns if c != html]
    carried = [*keep, "_variants"] if strict else keep
    rows = parse_pages(pages, html).select(*carried, F.posexplode(_postings()).alias("job_pos", "_from"))
    rows = rows.withColumn("_kind", classify_details(F.col("_from.anchor.items")))
    errors = _mistyped(F.get("_variants", F.col("job_pos"))) if strict else _no_errors()
    position, anchor = F.col("_from.position"), F.col("_from.anchor")
    job = (
        F.when(position.isNotNull(), position_to_job(position, F.col("_from.texts"), errors))
        .when(anchor.isNotNull(), anchor_to_job(anchor, F.col("_kind")))
        .otherwise(card_to_job(F.col("_from.card")))
    )
    return rows.select(*keep, "job_pos", job.alias("_job")).select(*keep, "job_pos", "_job.*")


def site_report(pages: DataFrame, html: str = "html") -> DataFrame:
    """Per page: success, number of postings, error. A page without HTML is an error."""
    keep = [c for c in pages.columns if c != html]
    missing = ~F.coalesce(F.length(html) > 0, F.lit(False))
    parsed = parse_pages(pages.withColumn("_missing", missing), html)
    sizes = [F.when(F.size(c) > 0, F.size(c)) for c in ("_positions", "_listings.anchors", "_listings.cards")]
    return parsed.select(
        *keep,
        (~F.col("_missing")).alias("success"),
        F.coalesce(*sizes, F.lit(0)).cast("long").alias("jobs"),
        F.when(F.col("_missing"), F.lit("No HTML")).alias("error"),
    )


def run_counters(report: DataFrame) -> DataFrame:
    """One row: pages processed, pages failed, total pages and postings."""
    return report.agg(
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count("*").alias("total"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"),
    )


def run_errors(report: DataFrame) -> DataFrame:
    return report.where(F.col("error").isNotNull())
