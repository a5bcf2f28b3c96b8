"""Fixed schemas of the landed documents and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, TS, BOOL, DBL = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType(), T.DoubleType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# one element of the array that a careers page embeds
POSITION = _struct(
    name=STR, department=STR, employment_type=STR, experience_level=STR, workplace_type=STR, uid=STR,
    url_comeet_hosted_page=STR, url_active_page=STR, url_detected_page=STR, company_name=STR, email=STR,
    time_updated=STR,
    location=_struct(name=STR, city=STR, country=STR, is_remote=BOOL),
    custom_fields=_struct(details=T.ArrayType(_struct(name=STR, value=T.VariantType()))),
)

# the text columns that a posting must carry as strings
POSTING_TEXT_FIELDS = (
    "title", "department", "location", "employment_type", "experience_level", "workplace_type", "uid", "url",
    "company_name", "email", "last_updated", "original_website_job_url",
)

# the description is a map or a text, never both
RAW_JOB = T.StructType(
    [T.StructField(name, STR) for name in POSTING_TEXT_FIELDS]
    + [
        T.StructField("description_map", T.MapType(STR, STR)),
        T.StructField("description_text", STR),
        T.StructField("type_errors", T.ArrayType(STR)),
    ]
)

COMPANY = _struct(
    id=LONG, company_name=STR, domain=STR, company_page_url=STR, title=STR, discovered_at=TS, last_scraped=TS,
    is_active=BOOL, source=STR,
)
COMPANY_MESSAGE = _struct(company_name=STR, domain=STR, company_page_url=STR)
LEGACY_COMPANY = _struct(
    company_name=STR, domain=STR, job_page_url=STR, title=STR, discovered_at=DBL, last_scraped=DBL
)

DEPARTMENT = _struct(id=LONG, canonical_name=STR, category=STR)
LOCATION = _struct(id=LONG, canonical_name=STR, country=STR, region=STR)
DEPARTMENT_SYNONYM = _struct(id=LONG, synonym=STR, department_id=LONG)
LOCATION_SYNONYM = _struct(id=LONG, synonym=STR, location_id=LONG)

JOB = _struct(
    id=LONG, title=STR, company_name=STR, department=STR, department_id=LONG, location=STR, location_id=LONG,
    workplace_type=STR, experience_level=STR, employment_type=STR, scraped_at=TS, publish_date=STR,
    description=STR, embedding=VECTOR, uid=STR, url=STR, url_hash=STR, from_domain=STR,
    original_website_job_url=STR, email=STR, is_ai_inferred=BOOL,
)

BATCH_LEDGER = _struct(batch_id=STR, status=STR, created_at=TS)
SEARCH_LOG = _struct(domain=STR, query=STR, source=STR, searched_at=TS, results_count=LONG)

SEARCH_RESULTS = T.ArrayType(_struct(organic=T.ArrayType(_struct(title=STR, link=STR))))

EMBEDDING_RESULT = _struct(
    custom_id=STR,
    response=_struct(body=_struct(data=T.ArrayType(_struct(embedding=T.ArrayType(DBL))))),
    error=_struct(message=STR),
)
REMOTE_BATCH = _struct(batch_id=STR, status=STR)
CV_VECTOR = _struct(embedding=VECTOR, model_name=STR, source_file=STR, text_length=LONG, timestamp=STR)
