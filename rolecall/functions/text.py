"""Text expressions: all native, all whole-text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space for a Unicode strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The Hebrew block, and the share of letters above which a text counts as Hebrew.
HEBREW = ("\u0590", "\u05ff")
SCRIPT_SHARE_LIMIT = 0.1


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only, so that matching ignores case for ASCII and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def location_head(location: Column) -> Column:
    return strip(F.substring_index(location, ",", 1))


def _filled_entries(mapping: Column) -> Column:
    return F.filter(F.map_entries(mapping), lambda e: F.coalesce(e["value"], F.lit("")) != "")


def _either(mapping: Column, from_map: Column, text: Column) -> Column:
    return F.when(mapping.isNotNull(), from_map).otherwise(text)


def storage_description(mapping: Column, text: Column) -> Column:
    """``key:`` line plus value per filled entry, blocks parted by a blank line."""
    blocks = F.transform(_filled_entries(mapping), lambda e: F.concat(e["key"], F.lit(":\n"), e["value"]))
    return _either(mapping, F.array_join(blocks, "\n\n"), text)


def embedding_text(title: Column, mapping: Column, text: Column) -> Column:
    """Title, a blank line, then ``key: value`` lines; the text that is sent out for a vector."""
    lines = F.transform(_filled_entries(mapping), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    body = F.coalesce(_either(mapping, F.array_join(lines, "\n"), text), F.lit(""))
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), body))


def matching_text(mapping: Column) -> Column:
    """The description and requirements entries, parted by a blank line."""
    part = lambda key: F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(""))
    return strip(F.concat(part("description"), F.lit("\n\n"), part("requirements")))


def screening_text(title: Column, mapping: Column, text: Column, location: Column, company: Column) -> Column:
    """All readable fields joined by one space; empty fields leave no gap."""
    values = F.array_join(F.transform(_filled_entries(mapping), lambda e: e["value"]), " ")
    body = _either(mapping, values, text)
    return F.concat_ws(" ", *[empty_to_null(c) for c in (title, body, location, company)])


def script_share(text: Column, block: tuple[str, str] = HEBREW) -> Column:
    """Characters of a script block over letters of any script; NULL when there is no letter."""
    low, high = block
    inside = F.length(F.regexp_replace(text, f"[^{low}-{high}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, inside.cast("double") / letters)


def mostly_script(text: Column, block: tuple[str, str] = HEBREW, limit: float = SCRIPT_SHARE_LIMIT) -> Column:
    """True above the share limit. One cheap probe spares the counting for texts without the script."""
    low, high = block
    share = F.coalesce(script_share(text, block) > F.lit(limit), F.lit(False))
    return F.when(text.rlike(f"[{low}-{high}]"), share).otherwise(F.lit(False))


def cut(text: Column, length: int) -> Column:
    """Display snippet of a report line."""
    return F.substring(text, 1, length)


def drop_blank_fields(fields: dict[str, Column]) -> Column:
    """JSON text of a record without NULL, empty text, empty list and empty map fields."""
    return F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]), {"ignoreNullFields": "true"})


def non_empty(column: Column, kind: str) -> Column:
    """NULL for an empty value of the given kind: text, list or map."""
    if kind == "text":
        return empty_to_null(column)
    if kind == "list":
        return F.when(F.size(column) > 0, column)
    kept = F.map_filter(column, lambda _k, v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def stable_job_id(company: Column, title: Column, apply_url: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (company, title, apply_url)]
    return F.md5(F.concat_ws("\u0001", *parts))
