"""Queries over pages: URLs, scope, hosts, page heads, links, the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text, urls
from ..operators import frontier, suffixes
from ..sources.tables import table
from .registry import query

def _escaped(path: str) -> str:
    """A path as SQL: as it is if it may be, else its text written anew, with the signs that stay."""
    written = f"url_encode(url_decode({path}))"
    for sign in "/$&+,:;=@":
        written = f"replace({written}, '%{ord(sign):02X}', '{sign}')"
    return rf"CASE WHEN regexp_full_match({path}, '[A-Za-z0-9\-._~!$&''()*+,;=:@\[\]%/]*') THEN {path} ELSE {written} END"


# The canonical form, as SQL over a column url.
_CANON = r"""
parts AS (
  SELECT *, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'a', 'p', 'q']) AS u
  FROM pages),
canon AS (
  SELECT * EXCLUDE (u), lower(u.s) AS scheme,
         CASE lower(u.s) WHEN 'http' THEN regexp_replace(lower(u.a), ':80$', '') WHEN 'https' THEN regexp_replace(lower(u.a), ':443$', '') ELSE lower(u.a) END AS host,
         u.p AS path, @ESCAPED AS escaped,
         array_to_string(list_sort(list_filter(string_split(u.q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|(gclid|fbclid|msclkid)(=|$))'))), '&') AS query
  FROM parts),
canonical AS (
  SELECT *, CASE WHEN host <> '' THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE escaped END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical
  FROM canon)""".replace("@ESCAPED", _escaped("u.p"))


@query(f"WITH {_CANON} SELECT page_id, url, canonical FROM canonical")
def url_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonicalize(F.col("url")).alias("canonical"))


@query(
    r"""SELECT p_partkey, CASE CAST(p_size % 8 AS INTEGER)
      WHEN 0 THEN 'http://U:p%40@h.com/' || url_encode(p_name) || '/%C3%A9%28' || p_size || '%29' WHEN 1 THEN 'http://h.com:8080/(' || p_size || ')!*%20?b=1&c=' || p_size
      WHEN 3 THEN 'https://h.com/a%20b/%C3%A9//' || p_size || '?q=' || replace(url_encode(p_name), '%20', '+') WHEN 5 THEN 'http://h.com/a+b' || p_size || '~' END AS canonical FROM part"""
)
def url_canonicalize_odd(spark, sf_dir):
    """Spaces, letters outside ASCII, users, ports, and what is no URL, around parts' names and sizes."""
    size = F.col("p_size").cast("string")
    odd = [
        ("HTTP://U:p%40@H.com:80/", F.col("p_name"), "/é(", size, ")#f"), ("http://h.com:8080/(", size, ")!*%20?c=", size, "&utm_a=1&b=1"), ("http://h.com/%zz", size), ("https://H.COM:443/a%20b/é/%2F", size, "?q=", F.col("p_name")),
        ("http://h .com/", size), (" http://h.com/a+b", size, "~ "), ("http://h.com/\t", size), ("http://h.com:8a/", size),
    ]
    made = [F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)) for parts in odd]
    url = F.element_at(F.array(*made), (F.col("p_size") % len(odd) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.canonicalize(url).alias("canonical"))


@query(f"WITH {_CANON} SELECT canonical, sha256(canonical) AS url_hash, COUNT(*) AS n, MIN(page_id) AS first_page FROM canonical GROUP BY canonical")
def url_hash_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))
    grouped = pages.groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return grouped.select("canonical", urls.url_hash(F.col("canonical")).alias("url_hash"), "n", "first_page")


@query(
    f"""WITH {_CANON} SELECT page_id, url FROM canonical
    WHERE (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/')"""
)
def url_scope_filter(spark, sf_dir):
    scope = urls.Scope(seed_host="example.org", allow_subdomains=True, path_prefix="/en/")
    return table(spark, sf_dir, "pages").select("page_id", "url").where(scope.allows(F.col("url")))


@query(
    f"""WITH {_CANON} SELECT page_id, url FROM canonical
    WHERE (regexp_matches(path, '^/en/[^/]*$') OR regexp_matches(path, '^/fr/.*$')) AND NOT regexp_matches(path, '^/.*[.]html$')"""
)
def url_glob_filter(spark, sf_dir):
    scope = urls.Scope(include=["/en/*", "/fr/**"], exclude=["/**.html"])
    return table(spark, sf_dir, "pages").select("page_id", "url").where(scope.allows(F.col("url")))


@query(
    f"""WITH {_CANON}, e AS (SELECT page_id, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[.]([^.]*)$', 1)) AS extension FROM canonical)
    SELECT page_id, extension, extension IN ({", ".join(f"'{a}'" for a in urls.ASSETS)}) AS asset FROM e"""
)
def url_asset_skip(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.extension(u).alias("extension"), urls.is_asset(u).alias("asset"))


@query(f"WITH {_CANON} SELECT CASE WHEN host <> '' THEN regexp_replace(host, ':[0-9]+$', '') ELSE 'invalid' END AS domain, COUNT(*) AS pages, CAST(SUM(length(html)) AS BIGINT) AS chars FROM canonical GROUP BY 1")
def domain_rollup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("domain", urls.domain(F.col("url")))
    return pages.groupBy("domain").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query(
    f"""WITH {_CANON}, l AS (SELECT page_id, host, string_split(host, '.') AS x FROM canonical)
    SELECT page_id, host, CASE WHEN len(x) < 2 THEN host WHEN array_to_string(x[-2:], '.') IN ({", ".join(f"'{s}'" for s in urls.SUFFIXES)}) THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS registrable FROM l"""
)
def registrable_domain(spark, sf_dir):
    host = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.registrable_domain(host).alias("registrable"))


@query(f"WITH {_CANON}, s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM canonical) SELECT page_id, len(segments) AS n_segments, segments[-1] AS last_segment FROM s")
def path_segments(spark, sf_dir):
    segments = urls.path_segments(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(segments).cast("long").alias("n_segments"), F.try_element_at(segments, F.lit(-1)).alias("last_segment"))


_BARE = "regexp_replace(host, '^www[.]', '')"


@query(
    f"""WITH {_CANON}, h AS (SELECT page_id, regexp_replace({_BARE}, ':[0-9]+$', '') AS h, canonical FROM canonical)
    SELECT page_id, canonical, CASE WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'prefer' ELSE 'allow' END AS policy
    FROM h WHERE NOT (h IN ('casino-win.example.org', 'adult-x.example.net') OR ends_with(h, '.casino-win.example.org') OR ends_with(h, '.adult-x.example.net'))"""
)
def policy_filter(spark, sf_dir):
    u = F.col("url")
    kept = table(spark, sf_dir, "pages").where(~urls.policy_match(urls.host(u), ["casino-win.example.org", "adult-x.example.net"]))
    policy = F.when(urls.policy_match(urls.host(u), ["example.net"]), "prefer").otherwise("allow")
    return kept.select("page_id", urls.canonicalize(u).alias("canonical"), policy.alias("policy"))


_UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("SELECT page_id, NULLIF(trim(" + _UNESCAPE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.title(F.col("html")).alias("title"))


@query("""SELECT NULLIF(regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1), '') AS lang, COUNT(*) AS pages FROM pages GROUP BY 1""")
def html_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.html_lang(F.col("html")).alias("lang")).agg(F.count("*").alias("pages"))


@query("SELECT page_id, sha256(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS stripped_hash, CAST(length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS INTEGER) AS n FROM pages")
def html_comment_strip(spark, sf_dir):
    stripped = text.strip_comments(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(stripped, 256).alias("stripped_hash"), F.length(stripped).alias("n"))


_LINKS = f"""{_CANON},
written AS (
  SELECT page_id, scheme || '://' || host AS site, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) AS target FROM canonical),
links AS (
  SELECT page_id, site || {_escaped("target")} AS link FROM written)"""


# Anchors in many forms, with {h}, {H}, {s} and {n} for a page's host, upper-case host, scheme and number, and what each must come to, by its making.
_FORMS = (
    ("""<A class="x" HREF='{s}://{H}/Abs/{n}?b=2&amp;a=1&utm_source=z#top'>""", "'/Abs/' || page_id || '?a=1&b=2'"),
    ("<a href=rel{n}>", "regexp_replace(path, '[^/]*$', '') || 'rel' || page_id"),
    ("""<a data-href="/no" title="> href=/not"\n href = "../../../up/./{n}/x/../y?q={n}">""", "'/up/' || page_id || '/y?q=' || page_id"),
    ("""<a href="//{h}/slashes/{n}" href="/second">""", "'/slashes/' || page_id"),
    ("""<a rel='nofollow' href="?only={n}">""", "path || '?only=' || page_id"),
    # No links: in comments and scripts, elsewhere, of other schemes, to files, and on other elements.
    ("""<!-- <a href="/comment{n}"> --><script>var a = '<a href="/script">';</script>""", None),
    ("""<a href="https://elsewhere.example/{n}">""", None),
    ("""<a href="mailto:x{n}@example.com"><a href="javascript:void(0)">""", None),
    ("""<a href="/file{n}.PDF?x=1">""", None),
    ("""<abbr href="/abbr"><area href="/area"><a name="/name">""", None),
)
_MADE = ", ".join(f"scheme || '://' || host || {link}" for _, link in _FORMS if link)


@query(f"WITH {_LINKS} SELECT DISTINCT page_id, link FROM links UNION SELECT page_id, unnest([{_MADE}]) FROM canonical")
def html_links(spark, sf_dir):
    u = F.col("url")
    written = F.lit("".join(form for form, _ in _FORMS))
    for sign, value in (("{s}", urls.scheme(u)), ("{h}", urls.host_port(u)), ("{H}", F.upper(urls.host_port(u))), ("{n}", F.col("page_id").cast("string"))):
        written = F.replace(written, F.lit(sign), value)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", written).alias("html"))
    return frontier.page_links(pages).select("page_id", "link")


@query(f"WITH {_LINKS} SELECT link, COUNT(DISTINCT page_id) AS pages FROM links WHERE link NOT IN (SELECT canonical FROM canonical) GROUP BY link")
def frontier_antijoin(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    seen = pages.select(urls.canonicalize(F.col("url")).alias("link"))
    return frontier.page_links(pages).join(seen, "link", "left_anti").groupBy("link").agg(F.count_distinct("page_id").alias("pages"))


# A small web over the pages' numbers: page n links to 2n + 1, 2n + 2 and n // 3.
_WEB = """web AS (SELECT page_id AS src, unnest([2 * page_id + 1, 2 * page_id + 2, page_id // 3]) AS dst FROM pages),
edges AS (SELECT DISTINCT src, dst FROM web WHERE dst IN (SELECT page_id FROM pages) AND src <> dst)"""


@query(
    f"""WITH RECURSIVE {_WEB}, reach(page_id, depth) AS (
      SELECT CAST(5 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.page_id WHERE r.depth < 4)
    SELECT page_id, MIN(depth) AS depth FROM reach GROUP BY page_id"""
)
def frontier_bfs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    link = F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2, F.floor(F.col("page_id") / 3)))
    edges = pages.select(F.col("page_id").alias("src"), link.alias("dst"))
    edges = edges.join(pages.withColumnRenamed("page_id", "dst"), "dst", "left_semi").where("src <> dst").distinct()
    seeds = spark.range(5, 6).select(F.col("id").alias("node"))
    return frontier.reach(seeds, edges, max_depth=4).select(F.col("node").alias("page_id"), "depth")


_COLORS = r"""SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(css, '(#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3}))\b', 1), lambda x: lower(x)))) AS colors
FROM (SELECT page_id, 'a{color:#' || substr(md5(url), 1, 6) || ';background:#FFF} b{border:1px solid #' || upper(substr(md5(url), 7, 3)) || '} ' || html AS css FROM pages)"""


@query(_COLORS)
def brand_colors(spark, sf_dir):
    digest = F.md5("url")
    css = F.concat(F.lit("a{color:#"), F.substring(digest, 1, 6), F.lit(";background:#FFF} b{border:1px solid #"), F.upper(F.substring(digest, 7, 3)), F.lit("} "), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.hex_colors(css).alias("colors"))


_PAIRS = f"""WITH {_LINKS}, mine AS (SELECT page_id, list_sort(list_distinct(list(regexp_replace(link, '^[a-z]+://[^/]*', '')))) AS l FROM links GROUP BY page_id)
SELECT a.page_id, list_sort(list_filter(b.l, lambda x: NOT list_contains(a.l, x))) AS added, list_sort(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS removed
FROM mine a JOIN mine b ON b.page_id = a.page_id + 1"""


@query(_PAIRS)
def link_delta(spark, sf_dir):
    links = frontier.page_links(table(spark, sf_dir, "pages"))
    mine = links.groupBy("page_id").agg(F.array_sort(F.collect_set(F.regexp_replace("link", "^[a-z]+://[^/]*", ""))).alias("l"))
    after = mine.select((F.col("page_id") - 1).alias("page_id"), F.col("l").alias("m"))
    return mine.join(after, "page_id").select("page_id", F.array_sort(F.array_except("m", "l")).alias("added"), F.array_sort(F.array_except("l", "m")).alias("removed"))


def _statuses(pages):
    """Page statuses by page number, for rules that need them."""
    return pages.withColumn("status", F.element_at(F.array(*map(F.lit, (200, 200, 403, 401, 503, 404, 429, 200))), (F.col("page_id") % 8 + 1).cast("int")))


_STATUS = "[200, 200, 403, 401, 503, 404, 429, 200][CAST(page_id % 8 AS INTEGER) + 1]"
_ANY = lambda marks: "(" + " OR ".join(f"contains(lower, '{m}')" for m in marks) + ")"


@query(
    rf"""WITH s AS (SELECT page_id, {_STATUS} AS status, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, array_to_string(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), ' ') AS md FROM pages),
    w AS (SELECT *, lower(html || chr(10) || md || chr(10) || title) AS lower,
      len(list_filter(regexp_split_to_array(regexp_replace(md, '[#*_`>~|()!\[\]-]+', ' ', 'g'), '\s+'), lambda x: x <> '')) AS words,
      len(list_filter(regexp_split_to_array(regexp_replace(lower(html), '(?s)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS body FROM s)
    SELECT page_id, status, CASE
      WHEN status IN (401, 407) AND {_ANY(("sign in", "log in", "login required", "log in to continue"))} THEN 'login-required'
      WHEN status = 401 AND words < 200 AND {_ANY(("unauthorized", "login", "sign in"))} THEN 'login-required'
      WHEN status = 403 AND words < 200 AND {_ANY((*classify.MARKERS, "blocked"))} THEN 'access-denied'
      WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'unavailable'
      WHEN words < 200 AND body > words AND (body - words > 50 OR (words < 20 AND body > 2 * words)) THEN 'empty'
      WHEN words < 200 AND {_ANY(classify.MARKERS)} AND {_ANY(("<title>just a moment", "checking your browser", "enable javascript and cookies"))} THEN 'access-denied'
      WHEN words < 200 AND {_ANY(classify.MARKERS)} AND words < 30 THEN 'empty'
      WHEN status = 404 AND words < 200 THEN 'empty' ELSE '' END AS issue FROM w"""
)
def quality_classify(spark, sf_dir):
    pages = _statuses(table(spark, sf_dir, "pages"))
    heading = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<h1>(.*?)</h1>"), F.lit(1)), " ")
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", "status", classify.quality(heading, title, F.col("status"), F.col("html")).alias("issue"))


# Pages with one vendor's signs put in, by page number.
_SIGNS = ("_cf_chl_opt", "challenges.cloudflare.com/turnstile", "datadome captcha", "awswaf", "h-captcha verify", "nothing", "DataDome geo", "/h/g/orchestrate/")


def _signed(pages):
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (F.col("page_id") % len(_SIGNS) + 1).cast("int"))
    return pages.withColumn("body", F.concat(F.col("html"), F.lit(" "), sign))


# The whole page and the sign at its end; small and thin are the detectors' gates.
_BODY = rf"""b AS (SELECT page_id, html || ' ' || [{", ".join(f"'{s}'" for s in _SIGNS)}][CAST(page_id % {len(_SIGNS)} AS INTEGER) + 1] AS body FROM pages),
l AS (SELECT page_id, {_STATUS} AS status, lower(body) AS lower, strlen(body) < {classify.SMALL_PAGE} AS small,
  len(list_filter(regexp_split_to_array(regexp_replace(body, '[#*_`>~|()!\[\]-]+', ' ', 'g'), '\s+'), lambda x: x <> '')) < {classify.THIN_WORDS} AS thin FROM b)"""


@query(
    f"""WITH {_BODY} SELECT page_id, CASE
    {" ".join("WHEN small AND thin AND " + " AND ".join(f"contains(lower, '{m}')" for m in marks) + f" THEN '{vendor}'" for vendor, marks in classify.VENDORS)} ELSE '' END AS vendor FROM l"""
)
def challenge_vendor(spark, sf_dir):
    return _signed(table(spark, sf_dir, "pages")).select("page_id", classify.challenge_vendor(F.col("body")).alias("vendor"))


@query(f"WITH {_BODY} SELECT page_id, {_ANY(classify.MARKERS)} AS marked FROM l")
def marker_scan(spark, sf_dir):
    return _signed(table(spark, sf_dir, "pages")).select("page_id", classify.has_any(F.lower("body"), classify.MARKERS).alias("marked"))


@query(f"WITH {_BODY} SELECT page_id, status, small AND thin AND (status IN ({', '.join(map(str, classify.CHALLENGE_STATUSES))}) OR {_ANY(classify.MARKERS)}) AS challenge FROM l")
def challenge_page(spark, sf_dir):
    pages = _statuses(_signed(table(spark, sf_dir, "pages")))
    return pages.select("page_id", "status", classify.is_challenge(F.col("body"), F.col("status")).alias("challenge"))


@query(
    """WITH t AS (SELECT n_nationkey AS k, lower(replace(n_name, ' ', '-')) AS tld FROM nation),
    h AS (SELECT s_suppkey % 4 AS form, k % 3 AS kind, tld, 's' || s_suppkey AS own, s_suppkey FROM supplier JOIN t ON s_nationkey = k)
    SELECT 'www.' || own || '.' || CASE form WHEN 0 THEN 'co.' WHEN 1 THEN 'city.' WHEN 2 THEN 'a.b.' ELSE '' END || upper(tld) AS host,
      CASE kind WHEN 0 THEN CASE form WHEN 0 THEN own || '.co.' || tld WHEN 1 THEN 'city.' || tld WHEN 2 THEN 'a.b.' || tld ELSE 'www.' || own || '.' || tld END
        WHEN 1 THEN CASE form WHEN 0 THEN own || '.co.' || tld WHEN 1 THEN 'city.' || tld WHEN 2 THEN 'b.' || tld ELSE own || '.' || tld END
        ELSE CASE form WHEN 0 THEN 'co.' || tld WHEN 1 THEN 'city.' || tld WHEN 2 THEN 'b.' || tld ELSE own || '.' || tld END END AS domain,
      CASE kind WHEN 0 THEN CASE form WHEN 0 THEN 'co.' || tld WHEN 1 THEN tld WHEN 2 THEN 'b.' || tld ELSE own || '.' || tld END WHEN 1 THEN CASE form WHEN 0 THEN 'co.' || tld ELSE tld END ELSE tld END AS suffix FROM h"""
)
def suffix_domains(spark, sf_dir):
    """Suppliers' hosts under their nations, of which a third have a wildcard with an exception, a third a rule of two labels, and a third one."""
    tld = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), tld.alias("tld"))
    kind = F.col("s_nationkey") % 3
    made = F.when(kind == 0, F.array(F.concat(F.lit("*."), "tld"), F.concat(F.lit("!city."), "tld"))).when(kind == 1, F.array("tld", F.concat(F.lit("co."), "tld"))).otherwise(F.array("tld"))
    rules = suffixes.rules_of(nations.select(F.explode(made).alias("rule")))
    form = F.col("s_suppkey") % 4
    middle = F.when(form == 0, "co.").when(form == 1, "city.").when(form == 2, "a.b.").otherwise("")
    host = F.concat(F.lit("www.s"), F.col("s_suppkey").cast("string"), F.lit("."), middle, F.upper("tld"))
    return suffixes.registrable(table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(host.alias("host")), rules)
