"""Dates, hashes, URLs, numbers and checks as column expressions."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import arrow_udf, normalize_key


class InvalidInput(ValueError):
    """A value outside of what an operation takes."""


# --- dates ------------------------------------------------------------------------------------------



def rss_datetime(c: Column | str) -> Column:
    """RFC 822 to ISO 8601 with its own offset (none: UTC); what can't be read stays as it is."""
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    pattern = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})\s*(GMT|UTC|UT|Z|[+-]\d{4})?\s*$"
    local = F.try_to_timestamp(F.regexp_extract(raw, pattern, 1), F.lit("d MMM yyyy HH:mm:ss"))
    zone = F.regexp_extract(raw, pattern, 2)
    offset = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise("+00:00")
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return F.when(local.isNull() | (F.regexp_extract(raw, pattern, 1) == ""), raw).otherwise(text)


def published_time(c: Column | str) -> Column:
    """ISO 8601 as a timestamp, without an offset in UTC; null if it can't be read."""
    raw = F.col(c) if isinstance(c, str) else c
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"
    zone = F.regexp_extract(raw, pattern, 3)
    plain = F.concat(F.regexp_extract(raw, pattern, 1), F.lit(" "), F.when(F.regexp_extract(raw, pattern, 2) == "", "00:00:00").otherwise(F.regexp_extract(raw, pattern, 2)))
    zoned = F.concat(plain, F.when(zone.isin("", "Z"), "+00:00").when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone))
    return F.when(raw.rlike(pattern), zoned.try_cast("timestamp"))


def within_hours(left: Column, right: Column, hours: int = 48) -> Column:
    return F.abs(F.unix_micros(left) - F.unix_micros(right)) <= hours * 3_600_000_000


# --- hashes -----------------------------------------------------------------------------------------


def event_id(title: Column | str, entities: bool = True) -> Column:
    """16 hex digits of the title's key; null for a title without one (an error where ids are required)."""
    key = normalize_key(title, entities)
    return F.when(key != "", F.substring(F.sha2(key, 256), 1, 16))


def article_id(given: Column, link: Column, title: Column, source: Column, prefix: str = "article-") -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    named = F.when(blank(link), F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(source, F.lit("")))).otherwise(F.trim(link))
    return F.when(~blank(given), F.trim(given)).otherwise(F.concat(F.lit(prefix), F.substring(F.sha2(named, 256), 1, 16)))


# --- URLs -------------------------------------------------------------------------------------------

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(c, _PARTS, 3), r"\.+$", ""))


def search_url(keyword: Column | str, days: int = 7, base: str = "https://news.google.com/rss/search", language: str = "ko", country: str = "KR") -> Column:
    """A feed's address for a search in the last days."""
    term = F.concat(F.col(keyword) if isinstance(keyword, str) else keyword, F.lit(f" when:{days}d"))
    return F.concat(F.lit(f"{base}?q="), F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")), F.lit(f"&hl={language}&gl={country}&ceid={country}:{language}"))


def url_identity(c: Column | str) -> Column:
    """struct(host, path, query): which article an address names. Tracking parameters don't count."""
    u = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    pairs = F.filter(F.split(F.regexp_extract(u, _PARTS, 6), "&"), lambda p: p.contains("=") & ~p.rlike("^(?:utm_[^=]*|fbclid|gclid)=") & ~p.endswith("="))
    return F.struct(
        F.regexp_replace(url_host(u), r"^www\.", "").alias("host"), F.regexp_replace(F.regexp_extract(u, _PARTS, 5), "/+$", "").alias("path"), F.array_join(F.array_sort(pairs), "&").alias("query")
    )


def looks_public(c: Column | str) -> Column:
    """The part of is_public_url that needs no address arithmetic: scheme, port, credentials, names."""
    u = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    host = url_host(u)
    return (
        (F.length(u) <= 8192) & ~u.rlike(r"[\x00-\x20]") & F.lower(F.regexp_extract(u, _PARTS, 1)).isin("http", "https")
        & ~u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@") & F.regexp_extract(u, _PARTS, 4).isin("", "80", "443")
        & host.contains(".") & ~host.rlike(r"[%\\]") & ~host.rlike(r"(^|\.)(localhost|local|internal)$")
    )


def public_url(url: str | None) -> bool:
    """Whether an address may be fetched: http(s), default port, no credentials, no private host."""
    if not isinstance(url, str) or len(url) > 8192 or re.search(r"[\x00-\x20]", url):
        return False
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip(".").lower(), parts.port
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or "@" in parts.netloc or port not in (None, 80, 443):
        return False
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host and not re.search(r"[%\\]", host)


@arrow_udf("boolean")
def is_public_url(s: pd.Series) -> pd.Series:
    return s.map(public_url, na_action=None)


# Hosts whose addresses are no publisher's.
AGGREGATORS = ("news.google.com", "consent.google.com", "www.google.com", "google.com")


def publisher_url(c: Column, aggregators: tuple[str, ...] = AGGREGATORS) -> Column:
    return looks_public(c) & ~url_host(c).isin(*aggregators)


def fetch_status(failure: Column, http_status: Column) -> Column:
    """One code for how a fetch ended; failure is '' , 'timeout' or another kind of exception."""
    return (
        F.when(failure == "timeout", "TIMEOUT").when(failure != "", "REQUEST_FAILED").when(http_status.isin(401, 403, 429, 451), "BLOCKED_HTTP")
        .when(http_status >= 400, "HTTP_ERROR").otherwise("SUCCESS")
    )


# --- numbers ----------------------------------------------------------------------------------------


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0."""
    return F.when(d != 0, n.cast("double") / F.when(d != 0, d)).otherwise(F.lit(0.0))


def wilson(correct: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of Wilson's interval; 0 for no trials."""
    n = n.cast("double")
    p = correct / F.when(n > 0, n)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(F.lit(0.0))


def probability(c: Column | str) -> Column:
    """A number in [0, 1] from text; null for anything else."""
    x = F.trim(F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def score_text(scores: Column) -> Column:
    """Scores to four places joined by ', ', as Python prints them: at least one digit after the point."""
    one = lambda x: F.regexp_replace(F.round(x, 4).cast("decimal(9,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.array_join(F.transform(scores, one), ", ")


# --- checks -----------------------------------------------------------------------------------------


def require_non_blank(value: str, name: str = "value") -> str:
    value = value.strip() if isinstance(value, str) else ""
    if not value:
        raise InvalidInput(f"{name} must not be blank")
    return value


def validate_limit(limit: int, low: int = 1, high: int = 100) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not low <= limit <= high:
        raise InvalidInput(f"limit must be from {low} to {high}")
    return limit
