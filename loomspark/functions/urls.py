"""URL columns: canonical form, hash, host, scope and asset predicates. Native expressions throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query keys that only track visitors; utm_* belongs to them too (fixed values).
TRACKING = ("gclid", "fbclid", "msclkid")
#: Extensions of files that are not pages (fixed values).
ASSETS = (
    "pdf", "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "avif", "mp4", "webm", "mp3", "avi", "mov",
    "zip", "gz", "tgz", "rar", "7z", "exe", "dmg", "msi", "woff", "woff2", "ttf", "eot", "otf",
)
#: A small subset of the public suffixes of more than one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx", "com.tr", "github.io", "blogspot.com")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def _form_encode(text: Column) -> Column:
    """As HTML forms encode: Spark differs from it in ~ and *."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_port(url: Column) -> Column:
    """Lower-case host, with its port if that is not the scheme's own; '' if there is none."""
    authority = F.lower(F.regexp_replace(_part(url, 2), r"^.*@", ""))
    own = F.when(scheme(url) == "http", F.regexp_replace(authority, r":80$", "")).when(scheme(url) == "https", F.regexp_replace(authority, r":443$", "")).otherwise(authority)
    return own


def host(url: Column) -> Column:
    return F.regexp_replace(host_port(url), r":\d+$", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def clean_query(url: Column) -> Column:
    """The query without tracking keys, sorted by key (values of a key keep their order), form-encoded."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    kept = F.filter(keyed, lambda s: ~(F.lower(s["k"]).isin(*TRACKING) | F.lower(s["k"]).startswith("utm_")))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(_form_encode(s["k"]), F.lit("="), _form_encode(s["v"]))), "&")


#: Signs that a path may have as they are, and those of them that stay when a path is written anew (fixed values).
_PATH_SIGNS = r"^[A-Za-z0-9\-._~!$&'()*+,;=:@\[\]%/]*$"
_PATH_KEPT, _USER_KEPT = "/$&+,:;=@~", "$&+,;=~"


def _decode(text: Column) -> Column:
    """Percent signs undone, null if one does not belong to two hex digits; a plus stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _percent_encode(text: Column, kept: str) -> Column:
    """UTF-8 in percent signs, but for letters, digits, - . _ and the signs in kept."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for sign in kept:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def escaped_path(url: Column) -> Column:
    """The path as it is if it has only signs that a path may have, else written anew; null if its percent signs are wrong."""
    own = path(url)
    return F.when(_decode(own).isNull(), F.lit(None)).when(own.rlike(_PATH_SIGNS), own).otherwise(_percent_encode(_decode(own), _PATH_KEPT))


def user_info(url: Column) -> Column:
    """What stands before the host, with its @; '' if there is nothing."""
    own = F.regexp_extract(_part(url, 2), r"^(.*)@", 1)
    name, word = F.substring_index(own, ":", 1), F.regexp_replace(own, r"^[^:]*:?", "")
    written = F.concat(_percent_encode(_decode(name), _USER_KEPT), F.when(F.instr(own, ":") > 0, F.concat(F.lit(":"), _percent_encode(_decode(word), _USER_KEPT))).otherwise(F.lit("")))
    return F.when(F.instr(_part(url, 2), "@") > 0, F.concat(written, F.lit("@"))).otherwise(F.lit(""))


def canonicalize(url: Column) -> Column:
    """Canonical URL; null if there is no host (file: URLs keep their path) or what is there is no URL.

    The path and the user stay as they are or are percent-encoded. Control signs, wrong percent signs, hosts with spaces and
    the like, and ports that are no number make no URL.
    """
    url = F.when(~F.trim(url).rlike(r"[\x00-\x1F\x7F]"), url)
    query = clean_query(url)
    target = F.when(path(url) == "", F.lit("/")).otherwise(escaped_path(url))
    odd_host = host_port(url).rlike(r"[ \\^`{|}%]") | host_port(url).rlike(r":[^\]]*[^0-9\]][^\]]*$")
    whole = F.concat(scheme(url), F.lit("://"), F.when(~odd_host, user_info(url)), host_port(url), target, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    file = F.when(scheme(url) == "file", F.concat(F.lit("file://"), escaped_path(url)))
    return F.when(host_port(url) != "", whole).otherwise(file)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def domain(url: Column) -> Column:
    """Lower-case host; file and invalid where there is none."""
    return F.when(host(url) != "", host(url)).when(scheme(url) == "file", F.lit("file")).otherwise(F.lit("invalid"))


def _without_dots(target: Column) -> Column:
    """A path without its . and .. segments."""
    segments = F.split(target, "/")
    last = F.element_at(segments, -1).isin(".", "..")
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(target.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), whole).otherwise(target)


def resolve(base: Column, reference: Column) -> Column:
    """A reference against an absolute base, without its fragment (RFC 3986, section 5.2); native."""
    ref = F.regexp_replace(F.trim(reference), r"(?s)#.*$", "")
    query = F.regexp_extract(ref, r"(?s)(\?.*)$", 1)
    bare = F.regexp_replace(ref, r"(?s)\?.*$", "")
    site = F.concat(scheme(base), F.lit("://"), F.regexp_replace(_part(base, 2), r"^.*@", ""))
    own = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_replace(own, r"[^/]*$", "")
    asked = F.when(F.trim(base).rlike(r"^[^#]*\?"), F.concat(F.lit("?"), _part(base, 4))).otherwise(F.lit(""))
    absolute = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    whole = F.when(absolute, ref).otherwise(F.concat(scheme(base), F.lit(":"), ref))
    elsewhere = F.when(whole.rlike(_PARTS), F.concat(scheme(whole), F.lit("://"), _part(whole, 2), _without_dots(path(whole)), query)).otherwise(whole)
    return (
        F.when(absolute | ref.startswith("//"), elsewhere)
        .when(ref == "", F.concat(site, own, asked))
        .when(bare == "", F.concat(site, own, query))
        .when(bare.startswith("/"), F.concat(site, _without_dots(bare), query))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, bare)), query))
    )


def registrable_domain(host_name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix and one label; IP addresses and bare hosts are themselves."""
    labels = F.split(host_name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    return F.when(host_name.rlike(r"^\d+\.\d+\.\d+\.\d+$") | (F.size(labels) < 2), host_name).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path(url), r"([^/]*)$", 1), r"\.([^.]*)$", 1))


def is_asset(url: Column) -> Column:
    return extension(url).isin(*ASSETS)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def policy_match(host_name: Column, domains: list[str]) -> Column:
    """host is one of the domains or below one; www. does not count."""
    bare = F.regexp_replace(host_name, r"^www\.", "")
    out = F.lit(False)
    for d in domains:
        out = out | (bare == d) | bare.endswith("." + d)
    return out


def normalize_domain(text: str) -> str:
    """What a user types -> a bare domain; ValueError without a dot."""
    bare = re.sub(r"^[a-z][a-z0-9+.-]*://", "", text.strip().lower())
    bare = re.sub(r"[/?#].*$", "", bare)
    bare = re.sub(r":\d+$", "", bare)
    bare = re.sub(r"^(\*\.)?(www\.)?", "", bare).rstrip(".")
    if "." not in bare:
        raise ValueError(f"not a domain: {text!r}")
    return bare


def compile_glob(glob: str) -> str:
    """** any signs, * any but /, ? one but /; anchored. ValueError if too long or too wild."""
    if len(glob) > 1024 or glob.count("**") > 4:
        raise ValueError(f"glob out of bounds: {glob[:40]!r}")
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", glob, re.S)) + r"\z"


@dataclass
class Scope:
    """Which URLs a crawl takes. Globs are compiled when it is made, before any data is read."""

    seed_host: str = ""
    allow_subdomains: bool = False
    path_prefix: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._include = [compile_glob(g) for g in self.include]
        self._exclude = [compile_glob(g) for g in self.exclude]

    def allows(self, url: Column) -> Column:
        ok = F.lit(True)
        if self.seed_host:
            own, seed = F.regexp_replace(host(url), r"\.$", ""), self.seed_host.rstrip(".").lower()
            ok = (own == seed) | own.endswith("." + seed) if self.allow_subdomains else own == seed
        if self.path_prefix:
            ok = ok & path(url).startswith(self.path_prefix)
        if self._include:
            ok = ok & _any(url, self._include)
        return ok & ~_any(url, self._exclude) if self._exclude else ok


def _any(url: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path(url).rlike(p)
    return out
