"""URL expressions. Canonical URLs stay native; only odd ones visit a Python worker."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the parsers travel to the workers by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The longest accepted URL in bytes, and the default ports.
MAX_URL_BYTES = 2083
DEFAULT_PORTS = {"http": 80, "https": 443}

# already in canonical form: lower-case ASCII host that ends in a letter label, no port, no dot
# segment, nothing that would have to be encoded
_CANONICAL = (
    r"^https?://(?!.*/(?:\.|%2[eE]){1,2}(?:[/?#]|$))(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*\.?"
    r"/[!$%&()*+,\-./0-9:;=?@A-Z\[\]_a-z|~#]*$"
)
_EDGE = "".join(chr(code) for code in range(0x21))


def url_hash(url: Column) -> Column:
    """MD5 hex of the URL; the empty text for NULL and empty URLs."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.md5(url))


def netloc(url: Column) -> Column:
    """Authority part with user and port, empty when there is none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def clean_company_page_url(url: Column, fix_lever: bool = False, strip_query: bool = False) -> Column:
    """Cut a posting URL back to the careers page of its company."""
    parts = F.split(url, "/")
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    comeet = head(6)
    if strip_query:
        comeet = F.substring_index(comeet, "?", 1)
    cleaned = F.when(url.contains("comeet.com/jobs/") & (F.size(parts) >= 6), comeet).when(
        url.contains("lever.co/jobs/") & (F.size(parts) >= 3), head(3)
    )
    if fix_lever:
        cleaned = cleaned.when(url.contains("jobs.lever.co/") & (F.size(parts) >= 4), head(4))
    return cleaned.otherwise(url)


def normalise_url(url: Column) -> Column:
    """Canonical http(s) URL, or NULL when it is not a valid one."""
    trimmed = F.btrim(url, F.lit(_EDGE))
    canonical = trimmed.rlike(_CANONICAL)
    # NULL, and so no work for the worker, for canonical URLs and for anything but http(s)
    odd = F.when(~canonical & trimmed.rlike("^[hH][tT][tT][pP][sS]?:"), trimmed)
    normalised = F.when(canonical, trimmed).otherwise(_canonical_urls(odd))
    return F.when(F.octet_length(url) <= MAX_URL_BYTES, normalised)


@F.pandas_udf(T.StringType())
def _parsed_urls(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url, na_action="ignore")


# marked so that the planner neither repeats the call nor moves a filter on its result below it
_canonical_urls = _parsed_urls.asNondeterministic()


def _encode(text: str, also: str) -> str:
    """Percent-encode controls, non-ASCII and the given characters as UTF-8."""
    keep = lambda ch: 0x20 < ord(ch) < 0x7F and ch not in also
    return "".join(ch if keep(ch) else "".join(f"%{b:02X}" for b in ch.encode("utf-8", "replace")) for ch in text)


def _host(raw: str) -> str | None:
    raw = re.sub(r"(?:%[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), raw)
    if raw.startswith("["):
        return raw.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", raw) else None
    if not raw or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", raw):
        return None
    if raw.isascii():
        host = raw.lower()
    else:
        try:
            host = raw.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None
    labels = host.rstrip(".").split(".")
    if labels[-1].isdigit():
        if len(labels) != 4 or not all(label.isdigit() and int(label) < 256 for label in labels):
            return None
        return ".".join(str(int(label)) for label in labels)
    return host


def _path(raw: str) -> str:
    out: list[str] = []
    segments = raw.split("/")
    for index, segment in enumerate(segments):
        last = index == len(segments) - 1
        plain = segment.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(segment, ' "<>`#?{}'))
    return "/" + "/".join(out)


def canonical_url(url: str) -> str | None:
    """Browser-style canonical form of one http(s) URL; None when invalid."""
    match = re.match(r"(https?):[/\\]*(.*)$", re.sub(r"[\t\r\n]", "", url), re.I | re.S)
    if not match:
        return None
    scheme, rest = match[1].lower(), match[2]
    rest, hash_mark, fragment = rest.partition("#")
    rest, query_mark, query = rest.partition("?")
    authority, *tail = re.split(r"[/\\]", rest, maxsplit=1)
    user, at, hostport = authority.rpartition("@")
    number = re.search(r":([0-9]*)$", hostport)
    host = _host(hostport[: number.start()] if number else hostport)
    if host is None:
        return None
    port = ""
    if number and number[1]:
        if int(number[1]) > 65535:
            return None
        port = "" if int(number[1]) == DEFAULT_PORTS[scheme] else f":{int(number[1])}"
    login = ""
    if at and user not in ("", ":"):
        name, colon, secret = user.partition(":")
        hidden = ' "<>`#?{}/:;=@[\\]^|'
        login = _encode(name, hidden) + (":" + _encode(secret, hidden) if secret else "") + "@"
    path = _path(tail[0].replace("\\", "/")) if tail else "/"
    shown_query = query_mark + _encode(query, " \"#<>'")
    return f"{scheme}://{login}{host}{port}{path}{shown_query}{hash_mark}{_encode(fragment, ' \"<>`')}"
