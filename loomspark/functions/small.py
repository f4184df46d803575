"""Small predicates and scalars: date ranges, paths, safe addresses, ids in URLs, reports, prompts, required fields."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import IMAGE, LINK
from .urls import path_segments


def in_range(published: Column, first: str | None, last: str | None) -> Column:
    """Whether a date text lies within inclusive days; ends may be open; what is no date is kept."""
    day = F.try_to_date(F.left(published, F.lit(10)), "yyyy-MM-dd")
    inside = F.lit(True)
    if first:
        inside = inside & (day >= F.lit(first).cast("date"))
    if last:
        inside = inside & (day <= F.lit(last).cast("date"))
    return F.coalesce(inside, F.lit(True))


def low_value_path(url: Column, segments=("tag", "tags", "category", "categories", "author", "search", "login", "signup", "cart", "account")) -> Column:
    """The root, or a path with one of the segments."""
    parts = F.transform(path_segments(url), F.lower)
    return (F.size(parts) == 0) | F.arrays_overlap(parts, F.array(*map(F.lit, segments)))


def unsafe_action_path(url: Column) -> Column:
    """A path that does something when it is fetched."""
    return low_value_path(url, ("logout", "signout", "delete", "remove", "unsubscribe", "checkout", "purchase")) & (F.size(path_segments(url)) > 0)


BLOCKED_HOSTS = ("localhost", "metadata.google.internal")


def fetch_allowed(url: str | None) -> bool:
    """http(s) to a public name or address: no local names, no private, loopback, link-local or reserved addresses."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host in BLOCKED_HOSTS or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return not re.fullmatch(r"(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+))*", host)
    mapped = getattr(address, "ipv4_mapped", None)
    return (mapped or address).is_global and not (mapped or address).is_multicast


@F.pandas_udf(T.BooleanType())
def is_fetch_allowed(urls: pd.Series) -> pd.Series:
    return urls.map(fetch_allowed).astype(bool)


def resolve(base: str | None, reference: str | None) -> str | None:
    """RFC 3986 resolution; what cannot be read stays as it is."""
    try:
        return urljoin(base or "", (reference or "").strip())
    except ValueError:
        return reference


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, r) for b, r in zip(base, reference, strict=True)])


def cap_utf8(text: str | None, most: int = 256) -> str | None:
    """The first bytes of a text, cut between characters."""
    return None if text is None else text.encode()[:most].decode("utf-8", "ignore")


def unlinked(report: Column) -> Column:
    """A report's text without links, images, tags, bare URLs, reference definitions and footnote marks."""
    out = report
    for pattern, new in ((IMAGE, ""), (LINK, "$1"), (r"(?m)^\[[^\]]+\]:\s.*$", ""), (r"\[\^[^\]]+\]", ""), (r"<[^>]+>", ""), (r"https?://\S+", "")):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def jaccard(a: Column, b: Column) -> Column:
    """Shared classes over all of them, lengths counted as they are; 0 for two empty lists."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def all_present(record: Column, required: list[str]) -> Column:
    """Every required field of a JSON record is there and not null."""
    out = F.lit(True)
    for name in required:
        out = out & F.get_json_object(record, f"$.{name}").isNotNull()
    return out


def needs_slow_path(fields: Column, document: Column) -> Column:
    """Whether a schema's field has no selector in the document (a map)."""
    return F.size(F.array_except(fields, F.map_keys(document))) > 0


def split_issue(message: Column) -> Column:
    """(issue, detail) of an error, split at the first colon and space."""
    at = F.instr(message, ": ")
    return F.struct(F.when(at > 0, F.left(message, at - 1)).otherwise(message).alias("issue"), F.when(at > 0, F.substr(message, at + 2)).otherwise(F.lit("")).alias("detail"))


ISSUES = ("login-required", "access-denied", "unavailable", "empty", "challenge", "robots")


def issue_bucket(message: Column) -> Column:
    """The kind of an unreadable page, or error."""
    out = None
    for issue in ISSUES:
        out = (F.when if out is None else out.when)(F.contains(F.lower(message), F.lit(issue)), issue)
    return out.otherwise("error")


def url_ids(url: Column) -> Column:
    """Ids that sites put into URLs: video, product, item and package."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    video = F.coalesce(found(r"youtube\.com/watch\?(?:.*&)?v=([\w-]+)"), found(r"youtu\.be/([\w-]+)"), found(r"youtube\.com/(?:shorts|embed|live)/([\w-]+)"))
    package = F.coalesce(found(r"pypi\.org/project/([^/?#]+)"), found(r"npmjs\.com/package/((?:@[^/?#]+/)?[^/?#]+)"))
    return F.struct(video.alias("video"), found(r"/(?:dp|gp/product)/([A-Z0-9]{10})").alias("asin"), found(r"/itm/(?:[^/?#]+/)?(\d{6,})").alias("item"), package.alias("package"))


def prompt(side: Column, markdown: Column, extra: Column) -> Column:
    """The sidecar first, then the page, then what is asked besides; empty parts go."""
    return F.array_join(F.filter(F.array(side, markdown, extra), lambda p: p.isNotNull() & (p != "")), "\n\n")
