"""Site extractors as data: for each site a URL rule and fields, read from JSON, JSON-LD, XML or the page's tree.

A field is a name and a reader; a reader takes the source and returns a value or None, and what is empty is left out.
Dispatch is a native when-chain over URL rules in registry order; the extractors that would take any page are
opt-in and only run by name. Records come out as JSON text, one row for each body.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .clean import sidecar
from .dom import Node, first, first_text, meta, parse, select


def get(value, path: str):
    """a.b.0.c in nested JSON; None where it leads nowhere."""
    for step in path.split("."):
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value


def number(v) -> float | None:
    """Numbers and texts of numbers; zero and others are None."""
    try:
        n = float(str(v).strip()) if not isinstance(v, bool) else 0.0
    except ValueError:
        return None
    return (int(n) if n == int(n) else n) or None


def first_number(text: str | None) -> float | None:
    found = re.search(r"\d[\d.]*", (text or "").replace(",", ""))
    return number(found[0].rstrip(".")) if found else None


def price(text: str | None) -> dict | None:
    amount = first_number(text)
    signs = {"$": "USD", "€": "EUR", "£": "GBP"}
    unit = next((code for sign, code in signs.items() if sign in (text or "")), None)
    return {k: v for k, v in (("amount", amount), ("currency", unit)) if v} if amount else None


def count(text: str | None) -> int | None:
    found = re.search(r"(\d+(?:\.\d+)?)\s*([km]?)", (text or "").lower().replace(",", ""))
    return int(float(found[1]) * {"": 1, "k": 1000, "m": 1_000_000}[found[2]]) or None if found else None


def short(v) -> str | None:
    return re.sub(r"^https?://schema\.org/", "", v) if isinstance(v, str) and v else None


def names(v) -> list[str] | None:
    """Names of one or several people or things, given as texts or objects."""
    items = v if isinstance(v, list) else [v]
    out = [n for x in items if (n := x if isinstance(x, str) else get(x, "name"))]
    return out or None


def image(v) -> str | None:
    v = v[0] if isinstance(v, list) and v else v
    return v if isinstance(v, str) else get(v, "url") or get(v, "contentUrl") if isinstance(v, dict) else None


def strip_html(text: str | None) -> str | None:
    return parse(re.sub(r"</?(?:p|div|br|li|ul|ol|h[1-6]|pre|blockquote)\b[^>]*>", " ", text)).text() or None if text else None


class Source:
    """A body, read once in each form that a reader asks for."""

    def __init__(self, body: str, url: str):
        self.body, self.url = body, url
        self.parts = urlsplit(url)
        self.path = [s for s in self.parts.path.split("/") if s]
        self._tree = self._json = self._blocks = None

    @property
    def tree(self) -> Node:
        if self._tree is None:
            self._tree = parse(self.body)
        return self._tree

    @property
    def json(self):
        if self._json is None:
            try:
                self._json = json.loads(self.body)
            except ValueError:
                self._json = {}
        return self._json

    @property
    def blocks(self) -> list[dict]:
        """All objects in the page's JSON-LD, graphs opened."""
        if self._blocks is None:
            side = sidecar(self.tree, self.body)
            self._blocks = []
            stack = list(reversed(side if isinstance(side, list) else [side]))
            while stack:
                v = stack.pop()
                if isinstance(v, list):
                    stack.extend(reversed(v))
                elif isinstance(v, dict):
                    self._blocks.append(v)
                    stack.extend(reversed(v["@graph"] if isinstance(v.get("@graph"), list) else []))
        return self._blocks

    def typed(self, *types: str) -> dict | None:
        """The first object whose @type has one of the texts in it."""
        for b in self.blocks:
            kinds = b.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(isinstance(k, str) and t in k for k in kinds for t in types):
                return b
        return None

    def segment(self, after: str) -> str | None:
        return next((b for a, b in zip(self.path, self.path[1:], strict=False) if a == after), None)


Reader = Callable[[Source], object]


def js(path: str, then: Callable = lambda v: v) -> Reader:
    return lambda s: then(get(s.json, path))


def css(selector: str, then: Callable = lambda v: v) -> Reader:
    return lambda s: then(first_text(s.tree, selector))


def every(selector: str) -> Reader:
    return lambda s: [t for n in select(s.tree, selector) if (t := n.text())] or None


def head(*keys: str) -> Reader:
    return lambda s: meta(s.tree, *keys)


def ld(types: tuple[str, ...], path: str, then: Callable = lambda v: v) -> Reader:
    return lambda s: then(get(s.typed(*types), path))


def either(*readers: Reader) -> Reader:
    return lambda s: next((v for r in readers if (v := r(s)) not in (None, "", [], {})), None)


def constant(v) -> Reader:
    return lambda s: v


def page_url(s: Source) -> str:
    return s.url


@dataclass
class Site:
    name: str
    rule: str
    """A pattern over host/path, without scheme and query; '' takes any http(s) page."""
    fields: dict[str, Reader]
    opt_in: bool = False
    needs: tuple[str, ...] = ()
    """Fields of which one must be there, or the body is no such page; () means any but those of the URL."""
    query: str = ""
    label: str = field(default="")


def _offer(product: dict | None) -> dict:
    offers = get(product, "offers")
    offers = offers[0] if isinstance(offers, list) and offers else offers
    return offers if isinstance(offers, dict) else {}


def offer(types: tuple[str, ...], key: str, then: Callable = lambda v: v) -> Reader:
    return lambda s: then(get(_offer(s.typed(*types)), key))


def offer_price(types: tuple[str, ...]) -> Reader:
    def read(s: Source):
        o = _offer(s.typed(*types))
        amount = number(o.get("price") or o.get("lowPrice"))
        return {k: v for k, v in (("amount", amount), ("currency", o.get("priceCurrency"))) if v} if amount else None

    return read


def _address(v) -> str | dict | None:
    if isinstance(v, dict):
        return {k: v[k] for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry") if isinstance(v.get(k), str) and v[k]} or None
    return v if isinstance(v, str) and v else None


def _place(v) -> dict | None:
    v = v[0] if isinstance(v, list) and v else v
    if not isinstance(v, dict):
        return {"name": v} if isinstance(v, str) and v else None
    return {k: x for k, x in (("name", v.get("name")), ("address", _address(v.get("address"))), ("url", v.get("url"))) if x} or None


def _online(s: Source) -> bool:
    e = s.typed("Event") or {}
    place = e.get("location")
    kinds = [get(p, "@type") for p in (place if isinstance(place, list) else [place])]
    return "Online" in str(e.get("eventAttendanceMode", "")) or "VirtualLocation" in kinds


def _salary(v) -> dict | None:
    value = get(v, "value")
    inner = value if isinstance(value, dict) else {"value": value}
    parts = {"currency": get(v, "currency"), "min": number(inner.get("minValue")), "max": number(inner.get("maxValue")), "value": number(inner.get("value")), "unit": inner.get("unitText")}
    return {k: x for k, x in parts.items() if x} or None


def _offers(v) -> list | None:
    items = v if isinstance(v, list) else [v]
    out = [{k: x for k, x in (("name", o.get("name")), ("price", number(o.get("price"))), ("currency", o.get("priceCurrency")), ("url", o.get("url"))) if x} for o in items if isinstance(o, dict)]
    return [o for o in out if o] or None


def _reviews(s: Source) -> list | None:
    """Review objects anywhere in the page's blocks, in order."""
    out: list[dict] = []

    def visit(v) -> None:
        if isinstance(v, list):
            for x in v:
                visit(x)
        elif isinstance(v, dict):
            if v.get("@type") == "Review":
                row = {"author": (names(v.get("author")) or [None])[0], "rating": number(get(v, "reviewRating.ratingValue")), "date": v.get("datePublished"), "text": v.get("reviewBody")}
                out.append({k: x for k, x in row.items() if x})
            for k in sorted(v):
                visit(v[k])

    visit(s.blocks)
    return out or None


def _comments(listing, depth: int, left: list[int]) -> list[dict]:
    """A comment tree of at most ten levels and two hundred comments; other kinds of children are passed over."""
    out = []
    for child in get(listing, "data.children") or []:
        data = get(child, "data") if get(child, "kind") == "t1" else None
        if data and left[0]:
            left[0] -= 1
            replies = _comments(data.get("replies"), depth + 1, left) if depth + 1 < 10 and isinstance(data.get("replies"), dict) else []
            out.append({"author": data.get("author", ""), "score": data.get("score", 0), "body": data.get("body", ""), "created": data.get("created_utc", 0), "replies": replies})
    return out


def _reddit(key: str) -> Reader:
    def read(s: Source):
        post = get(s.json, "0.data.children.0.data")
        if post:
            return {"kind": "post", "comments": _comments(get(s.json, "1"), 0, [200]), "title": post.get("title"), "author": post.get("author"), "score": number(post.get("score")), "selftext": post.get("selftext")}.get(key)
        if len(s.path) > 2:
            title = first_text(s.tree, "a.title") or meta(s.tree, "og:title") or first_text(s.tree, "title")
            return {"kind": "post", "title": title, "author": first_text(s.tree, "a.author"), "score": count(first_text(s.tree, ".score")), "selftext": first_text(s.tree, ".usertext-body")}.get(key)
        about = first_text(s.tree, ".usertext-body") or meta(s.tree, "description")
        return {"kind": "subreddit", "title": s.segment("r"), "subscribers": count(first_text(s.tree, ".subscribers")), "description": about}.get(key)

    return read


def _hn_comments(v, depth: int = 0) -> list[dict]:
    return [{"author": c.get("author"), "text": strip_html(c.get("text")), "children": _hn_comments(c, depth + 1) if depth < 9 else []} for c in get(v, "children") or [] if isinstance(c, dict)]


def balanced(text: str, at: int) -> str | None:
    """The object that begins at the first brace from `at` on; strings and escapes are minded."""
    at = text.find("{", at)
    depth, quoted, i = 0, False, at
    while 0 <= at and i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : i + 1]
        i += 1
    return None


def _player(key: str, then: Callable = lambda v: v) -> Reader:
    def read(s: Source):
        at = s.body.find("ytInitialPlayerResponse")
        text = balanced(s.body, at) if at >= 0 else None
        try:
            details = get(json.loads(text), "videoDetails") if text else None
        except ValueError:
            details = None
        return then(get(details, key)) if details else None

    return read


def video_id(url: str) -> str | None:
    parts = urlsplit(url)
    host, path = (parts.hostname or "").removeprefix("www.").removeprefix("m."), [s for s in parts.path.split("/") if s]
    if host == "youtu.be":
        return path[0] if path else None
    if host == "youtube.com":
        if path[:1] == ["watch"]:
            return (parse_qs(parts.query).get("v") or [None])[0]
        return path[1] if len(path) > 1 and path[0] in ("shorts", "embed", "live") else None
    return None


def find_object(value, marks: tuple[str, ...], preferred: tuple[str, ...], depth: int = 0):
    """The first object within eight levels that has one of the keys; preferred keys first, then sorted."""
    if depth > 8:
        return None
    if isinstance(value, dict):
        if any(m in value for m in marks):
            return value
        order = [k for k in preferred if k in value] + sorted(set(value) - set(preferred))
        return next((f for k in order if (f := find_object(value[k], marks, preferred, depth + 1)) is not None), None)
    if isinstance(value, list):
        return next((f for v in value if (f := find_object(v, marks, preferred, depth + 1)) is not None), None)
    return None


def _job(key: str, then: Callable = lambda v: v, fallback: Reader = constant(None)) -> Reader:
    def read(s: Source):
        state = first(s.tree, "script#__NEXT_DATA__")
        try:
            job = find_object(json.loads(state.raw_text()), ("ciphertext",), ("props", "pageProps", "job")) if state else None
        except ValueError:
            job = None
        return (then(get(job, key)) if job else None) or fallback(s)

    return read


def _xml(body: str) -> ElementTree.Element | None:
    if re.search(r"<!(?:DOCTYPE|ENTITY)", body, re.I):  # no entities: they can grow without end
        return None
    try:
        root = ElementTree.fromstring(body.strip())
    except ElementTree.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def _x(e, path: str) -> str | None:
    found = e.find(path) if e is not None else None
    return " ".join("".join(found.itertext()).split()) or None if found is not None else None


def _atom_link(e) -> str | None:
    links = e.findall("link")
    best = next((x for x in links if x.get("rel", "alternate") == "alternate" and x.get("href")), links[0] if links else None)
    return None if best is None else best.get("href") or (best.text or "").strip() or None


FEED_ITEMS = 50


def feed(body: str) -> dict | None:
    """title, link, description and the first items of an RSS 2.0 or Atom feed."""
    root = _xml(body)
    if root is None or root.tag not in ("rss", "feed"):
        return None
    top = root.find("channel") if root.tag == "rss" else root
    if top is None:
        return None
    summary = ("description", "summary", "content")
    items = []
    for e in list(top.findall("item") or top.findall("entry"))[:FEED_ITEMS]:
        row = {"title": _x(e, "title"), "link": _atom_link(e), "published": _x(e, "pubDate") or _x(e, "published") or _x(e, "updated"), "summary": strip_html(next((t for k in summary if (t := _x(e, k))), None))}
        items.append({k: v for k, v in row.items() if v})
    out = {"title": _x(top, "title"), "link": _atom_link(top), "description": _x(top, "description") or _x(top, "subtitle"), "items": items}
    return {k: v for k, v in out.items() if v}


def _feed(key: str) -> Reader:
    return lambda s: get(feed(s.body), key)


def _arxiv(key: str) -> Reader:
    def read(s: Source):
        root = _xml(s.body)
        entry = root.find("entry") if root is not None else None
        if entry is None:
            return None
        if key == "authors":
            return [n for a in entry.findall("author") if (n := _x(a, "name"))] or None
        return _x(entry, key)

    return read


def _og(prefix: str) -> Reader:
    def read(s: Source):
        out = {}
        for n in s.tree.walk():
            if n.tag == "meta":
                key = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
                if key.startswith(prefix + ":") and n.attrs.get("content"):
                    out.setdefault(key.replace(":", "_"), n.attrs["content"].strip())
        return out or None

    return read


def _canonical(s: Source) -> str | None:
    n = first(s.tree, "link[rel=canonical]")
    return n.attrs.get("href") or None if n else None


def _github(key: str) -> Reader:
    kinds = {"issues": "issue", "pull": "pr", "releases": "release"}

    def read(s: Source):
        kind = kinds.get(s.path[2], "") if len(s.path) > 2 else "repo"
        data = get(s.json, "0") if kind == "release" and isinstance(s.json, list) else s.json
        if key == "kind":
            return kind if data else None
        paths = {
            "repo": {"full_name": "full_name", "description": "description", "stars": "stargazers_count", "forks": "forks_count", "language": "language", "license": "license.name", "open_issues": "open_issues_count"},
            "issue": {"title": "title", "author": "user.login", "state": "state", "comments": "comments", "body": "body"},
            "release": {"tag": "tag_name", "name": "name", "published": "published_at", "body": "body"},
        }
        path = paths.get("issue" if kind == "pr" else kind, {}).get(key)
        v = get(data, path) if path else None
        return v.lower() if key == "license" and isinstance(v, str) else v

    return read


def _answers(s: Source) -> list | None:
    rows = [a for a in get(s.json, "items") or [] if isinstance(a, dict) and "answer_id" in a]
    return [{"score": a.get("score", 0), "accepted": bool(a.get("is_accepted")), "body": strip_html(a.get("body"))} for a in rows] or None


_PRODUCT, _ARTICLE = ("Product",), ("Article", "BlogPosting")
_BUSINESS = ("LocalBusiness", "Restaurant", "Store", "Hotel", "Dentist", "Organization")
_GITHUB = ("kind", "full_name", "description", "stars", "forks", "language", "license", "open_issues", "title", "author", "state", "comments", "body", "tag", "name", "published")

REGISTRY: list[Site] = [
    Site("og", "", {"og": _og("og"), "twitter": _og("twitter"), "title": css("title"), "description": head("description"), "canonical": _canonical, "h1": css("h1"), "url": page_url}, opt_in=True),
    Site("article", "", {"headline": ld(_ARTICLE, "headline"), "authors": ld(_ARTICLE, "author", names), "datePublished": ld(_ARTICLE, "datePublished"), "dateModified": ld(_ARTICLE, "dateModified"), "publisher": ld(_ARTICLE, "publisher.name"), "image": ld(_ARTICLE, "image", image), "url": page_url}, opt_in=True),
    Site("local_business", "", {**{k: ld(_BUSINESS, k) for k in ("name", "telephone", "email", "priceRange")}, "address": ld(_BUSINESS, "address", _address), "geo": ld(_BUSINESS, "geo", lambda g: {"lat": number(get(g, "latitude")), "lng": number(get(g, "longitude"))} if g else None), "openingHours": ld(_BUSINESS, "openingHours", lambda v: v if isinstance(v, list) else [v] if v else None), "sameAs": ld(_BUSINESS, "sameAs", names), "url": page_url}, opt_in=True),
    Site("event", "", {**{k: ld(("Event",), k) for k in ("name", "startDate", "endDate")}, "isOnline": _online, "location": ld(("Event",), "location", _place), "offers": ld(("Event",), "offers", _offers), "performers": ld(("Event",), "performer", names), "organizer": ld(("Event",), "organizer", lambda v: (names(v) or [None])[0]), "url": page_url}, opt_in=True, needs=("name",)),
    Site("job_posting", "", {"title": ld(("JobPosting",), "title"), "organization": ld(("JobPosting",), "hiringOrganization", lambda v: (names(v) or [None])[0]), "remote": lambda s: get(s.typed("JobPosting"), "jobLocationType") == "TELECOMMUTE", "locations": ld(("JobPosting",), "jobLocation", lambda v: [p for x in (v if isinstance(v, list) else [v]) if (p := _place(x))] or None), **{k: ld(("JobPosting",), k) for k in ("datePosted", "validThrough", "employmentType")}, "salary": ld(("JobPosting",), "baseSalary", _salary), "description": ld(("JobPosting",), "description", strip_html), "url": page_url}, opt_in=True, needs=("title",)),
    Site("ecommerce_product", "", {"name": ld(_PRODUCT, "name"), "brand": ld(_PRODUCT, "brand", lambda v: (names(v) or [None])[0]), "price": offer_price(_PRODUCT), "availability": offer(_PRODUCT, "availability", short), "url": page_url}, opt_in=True),
    Site("shopify_product", ".*/products/.+", {"title": js("title"), "vendor": js("vendor"), "price": js("price", lambda v: number(v) / 100 if number(v) else None), "type": js("product_type"), "images": js("images", lambda v: [i["src"] for i in v or [] if get(i, "src")] or None), "url": page_url}, opt_in=True),
    Site("woocommerce_product", ".*/product/.+", {"title": either(ld(_PRODUCT, "name"), css("h1.product_title")), "price": either(offer_price(_PRODUCT), css("p.price ins", price), css("p.price", price)), "sku": either(ld(_PRODUCT, "sku"), css(".sku")), "brand": ld(_PRODUCT, "brand", lambda v: (names(v) or [None])[0]), "stock_status": either(offer(_PRODUCT, "availability", short), css("p.stock")), "rating": ld(_PRODUCT, "aggregateRating.ratingValue", number), "reviews": ld(_PRODUCT, "aggregateRating.reviewCount", number), "images": ld(_PRODUCT, "image", lambda v: v if isinstance(v, list) else [v] if v else None), "url": page_url}, opt_in=True),
    Site("rss", "", {"title": _feed("title"), "link": _feed("link"), "description": _feed("description"), "items": _feed("items")}, opt_in=True),
    Site("amazon_product", r"(?:www\.)?amazon\.com/(?:.*/)?(?:dp|gp/product)/[A-Z0-9]{10}.*", {"asin": lambda s: next(iter(re.findall(r"/(?:dp|gp/product)/([A-Z0-9]{10})", s.parts.path)), None), "title": css("#productTitle"), "price": lambda s: price(next((n.text() for n in select(s.tree, ".a-price .a-offscreen") if not any("basisPrice" in a.classes for a in n.ancestors())), None)), "list_price": css(".basisPrice .a-offscreen", price), "rating": css('span[data-hook="rating-out-of-text"]', first_number), "reviews": css("#acrCustomerReviewText", first_number), "availability": css("#availability span"), "features": every("#feature-bullets li span.a-list-item"), "url": page_url}),
    Site("ebay_item", r"(?:www\.)?ebay\.com/itm/.+", {"item_id": lambda s: next(iter(re.findall(r"(\d{6,})", s.parts.path)), None), "title": either(ld(_PRODUCT, "name"), css("#itemTitle")), "price": either(offer_price(_PRODUCT), css(".x-price-primary", price)), "condition": either(offer(_PRODUCT, "itemCondition", short), css(".x-item-details", lambda v: v and v.removeprefix("Condition:").strip())), "seller": either(offer(_PRODUCT, "seller.name"), css(".x-sellercard-atf__info__about-seller")), "availability": offer(_PRODUCT, "availability", short), "url": page_url}),
    Site("etsy_listing", r"(?:www\.)?etsy\.com/listing/\d+.*", {"listing_id": lambda s: s.segment("listing"), "title": either(ld(_PRODUCT, "name"), css("h1"), head("og:title")), "price": either(offer_price(_PRODUCT), lambda s: (lambda a: {"amount": a, "currency": meta(s.tree, "og:price:currency")} if a else None)(number(meta(s.tree, "og:price:amount")))), "seller": either(ld(_PRODUCT, "brand", lambda v: (names(v) or [None])[0]), offer(_PRODUCT, "seller.name")), "availability": offer(_PRODUCT, "availability", short), "rating": ld(_PRODUCT, "aggregateRating.ratingValue", number), "reviews": ld(_PRODUCT, "aggregateRating.reviewCount", number), "url": page_url}),
    Site("dev_to_article", r"dev\.to/[^/]+/[^/]+", {"title": either(css("h1"), head("og:title")), "author": either(css(".crayons-article__header strong"), css("a.crayons-link")), "published": lambda s: (lambda n: n.attrs["datetime"] if n else None)(first(s.tree, "time[datetime]")), "tags": lambda s: [t.lstrip("#").strip() for n in select(s.tree, "a.crayons-tag") if (t := n.text())] or None, "reactions": css(".crayons-reaction__count", count), "comments": either(css(".js-comments-count", count), css("#comments h2", count)), "description": either(head("description", "og:description"), css(".crayons-article__body p")), "url": page_url}),
    Site("substack_post", r"[a-z0-9-]+\.substack\.com/p/[^/]+", {"title": js("title"), "subtitle": js("subtitle"), "author": js("publishedBylines.0.name"), "published": js("post_date"), "likes": js("reaction_count", number), "comments": js("comment_count", number), "cover_image": js("cover_image"), "text": js("body_html", strip_html), "url": page_url}),
    Site("stackoverflow", r"(?:www\.)?stackoverflow\.com/questions/\d+.*", {"kind": lambda s: "answers" if _answers(s) else "question", "title": js("items.0.title"), "score": js("items.0.score", number), "tags": js("items.0.tags"), "body": js("items.0.body", strip_html), "owner": js("items.0.owner.display_name"), "answers": _answers, "url": page_url}),
    Site("trustpilot", r"(?:www\.)?trustpilot\.com/review/.+", {"name": ld(("Organization", "LocalBusiness"), "name"), "rating_value": ld(("Organization", "LocalBusiness"), "aggregateRating.ratingValue", number), "review_count": ld(("Organization", "LocalBusiness"), "aggregateRating.reviewCount", number), "reviews": _reviews, "url": page_url}),
    Site("upwork_job", r"(?:www\.)?upwork\.com/(?:jobs|freelance-jobs)/.+", {"source": lambda s: "state" if first(s.tree, "script#__NEXT_DATA__") else "meta", "title": _job("title", fallback=head("og:title")), "description": _job("description", fallback=head("og:description")), "budget": _job("budget"), "category": _job("category"), "postedAt": _job("postedAt"), "skills": _job("skills", names), "id": _job("ciphertext"), "url": page_url}),
    Site("github_repo", r"(?:www\.)?github\.com/[^/]+/[^/]+(?:/(?:issues|pull|releases)(?:/.*)?)?", {**{k: _github(k) for k in _GITHUB}, "url": page_url}),
    Site("pypi", r"(?:www\.)?pypi\.org/project/[^/]+", {**{k: js(f"info.{k}") for k in ("name", "version", "summary", "author", "requires_python")}, "url": page_url}),
    Site("npm", r"(?:www\.)?npmjs\.com/package/.+", {"name": js("name"), "version": js("dist-tags.latest"), "latest": js("dist-tags.latest"), "description": lambda s: ((get(s.json, "versions") or {}).get(get(s.json, "dist-tags.latest"), {}) or {}).get("description") or get(s.json, "description"), "url": page_url}),
    Site("crates_io", r"(?:www\.)?crates\.io/crates/[^/]+", {"name": js("crate.name"), "newest_version": js("crate.newest_version"), "description": js("crate.description"), "downloads": js("crate.downloads", number), "url": page_url}),
    Site("dockerhub", r"hub\.docker\.com/(?:r/[^/]+|_)/[^/]+", {"name": js("name"), "description": js("description"), "star_count": js("star_count", number), "pull_count": js("pull_count", number), "last_updated": js("last_updated"), "url": page_url}),
    Site("huggingface", r"huggingface\.co/(?:datasets/)?[^/]+/[^/]+", {"kind": lambda s: "dataset" if s.path[:1] == ["datasets"] else "model", "id": js("id"), "likes": js("likes", number), "downloads": js("downloads", number), "tags": js("tags"), "pipeline_tag": js("pipeline_tag"), "url": page_url}),
    Site("reddit", r"(?:www\.|old\.|np\.)?reddit\.com/r/[^/]+.*", {**{k: _reddit(k) for k in ("kind", "title", "author", "score", "selftext", "comments", "subscribers", "description")}, "url": page_url}),
    Site("hackernews", r"news\.ycombinator\.com/item", {"kind": lambda s: ("comment" if get(s.json, "parent_id") else "story") if s.json else None, "title": js("title"), "url": either(js("url"), page_url), "points": js("points", number), "author": js("author"), "comments": lambda s: _hn_comments(s.json) or None, "text": js("text", strip_html), "parent_id": js("parent_id")}, query="id="),
    Site("youtube", r"(?:(?:www\.|m\.)?youtube\.com/(?:watch|shorts/.+|embed/.+|live/.+)|youtu\.be/.+)", {"title": either(_player("title"), js("title")), "author": either(_player("author"), js("author_name")), "description": _player("shortDescription"), "views": _player("viewCount", number), "duration_s": _player("lengthSeconds", number), "url": page_url}),
    Site("arxiv", r"(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/.+", {"title": _arxiv("title"), "authors": _arxiv("authors"), "summary": _arxiv("summary"), "published": _arxiv("published"), "url": page_url}),
]


def register(site: Site) -> None:
    """Add an extractor of one's own; a name can be taken once."""
    if not site.name or not site.fields:
        raise ValueError("an extractor needs a name and fields")
    if any(s.name == site.name for s in REGISTRY):
        raise ValueError(f"extractor {site.name!r} is registered already")
    REGISTRY.append(site)


def lookup(name: str) -> Site:
    return next((s for s in REGISTRY if s.name == name), None) or _missing(name)


def _missing(name: str):
    raise KeyError(f"no extractor {name!r}")


def dispatch(url: Column) -> Column:
    """The first extractor, in registry order, whose rule takes the URL; null if none does. Opt-in ones never do."""
    address = F.regexp_replace(F.regexp_replace(url, r"^[Hh][Tt][Tt][Pp][Ss]?://", ""), r"[?#].*$", "")
    address = F.regexp_replace(F.regexp_replace(address, r"/+$", ""), r"^([^/]*):\d+", "$1")
    web = url.rlike(r"^(?i)https?://[^/?#]+")
    out = F.when(~web, F.lit(None).cast("string"))
    for s in REGISTRY:
        if not s.opt_in:
            takes = address.rlike(rf"^(?:{s.rule})\z")
            out = out.when(takes & F.contains(url, F.lit(s.query)) if s.query else takes, s.name)
    return out


_FROM_URL = ("url", "asin", "item_id", "listing_id", "kind", "isOnline", "remote", "source", "og", "twitter")


def extract_record(name: str, body: str, url: str) -> dict | None:
    """The record of one body by the extractor of that name."""
    return record_of(lookup(name), body, url)


def record_of(site: Site, body: str, url: str) -> dict | None:
    """The record of one body, without what is empty; None if the body is no such page."""
    source = Source(body or "", url or "")
    record = {k: v for k, read in site.fields.items() if (v := read(source)) not in (None, "", [], {})}
    needs = site.needs or tuple(k for k in site.fields if k not in _FROM_URL or k in ("og", "twitter"))
    return record if any(k in record for k in needs) else None


def extract(bodies: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """key, extractor, record (JSON) and error for each body (key, url, body), by name or by URL."""
    chosen = F.lit(name) if name else dispatch(F.col("url"))
    if name:
        lookup(name)
    kind = bodies.schema[key].dataType.simpleString()
    # Sites that have been registered here are not known to the workers' own registry.
    known = {s.name: s for s in REGISTRY if name in (None, s.name)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records, errors = [], []
            for extractor, body, url in zip(pdf["extractor"], pdf["body"], pdf["url"], strict=True):
                record = record_of(known[extractor], body, url) if extractor else None
                records.append(json.dumps(record, sort_keys=True, ensure_ascii=False) if record else None)
                errors.append(None if record else "no data" if extractor else "no extractor")
            yield pd.DataFrame({key: pdf[key], "extractor": pdf["extractor"], "record": records, "error": errors})

    rows = spread(bodies.select(key, "url", "body", chosen.alias("extractor")))
    return rows.mapInPandas(run, f"{key} {kind}, extractor string, record string, error string")
