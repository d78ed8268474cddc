"""Page operators: text, state, metadata, links, directories, assets, cookies.

Pages are tables with ``url`` and ``html`` columns plus any key columns.  Rows
of HTML are large, so every operator here is narrow: nothing shuffles HTML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.text import brand_from_title, clean_text, html_unescape, pin
from ..functions.urls import (
    has_skipped_extension, is_scrapeable, netloc_of, path_of, registrable_domain, scheme_of,
    with_normalised_url)


def visible_text(html: Column) -> Column:
    """Page text: script-like blocks and tags become blanks, entities are decoded."""
    without = F.regexp_replace(F.regexp_replace(html, rules.SCRIPT_STYLE, " "), rules.TAG, " ")
    return html_unescape(without)


def embedded_state(html: Column) -> Column:
    """Text inside single-page-application state blobs, unescaped; '' when none."""
    blobs = F.concat(F.regexp_extract_all(html, F.lit(rules.STATE_BLOB), F.lit(1)),
                     F.regexp_extract_all(html, F.lit(rules.JSON_SCRIPT), F.lit(1)))
    text = F.array_join(F.filter(
        blobs, lambda b: (b != "") & (F.length(b) < rules.MAX_STATE_CHARS)), " ")
    text = F.regexp_replace(F.regexp_replace(text, rules.ESCAPED_AT, "@"), rules.ESCAPED_DOT, ".")
    for old, new in (("\\/", "/"), ('\\"', '"'), ("\\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return html_unescape(text)


def _first(html: Column, pattern: str) -> Column:
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def title_of(html: Column) -> Column:
    return clean_text(F.regexp_replace(_first(html, rules.TITLE), rules.TAG, ""), 200)


def meta_description(html: Column) -> Column:
    return clean_text(_first(html, rules.META_DESCRIPTION), 400)


def site_name(html: Column) -> Column:
    return clean_text(_first(html, rules.META_SITE), 120)


def with_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add title, description, name and the schema.org facts, structured data first."""
    from .structured import with_jsonld

    h = F.col(html)
    keep = list(pages.columns)
    df = with_jsonld(pages, html, "__ld").withColumns({
        "__title": title_of(h), "__desc": meta_description(h), "__site": site_name(h)})
    ld = F.col("__ld")

    def first_set(structured: str, tag: str) -> Column:
        # A node that was accepted but lacks the field still hides nothing: null is dropped.
        return F.coalesce(F.nullif(ld[structured], F.lit("")), F.nullif(F.col(tag), F.lit("")))

    name = F.coalesce(first_set("name", "__site"),
                      brand_from_title(F.col("__title"), registrable_domain(F.col(url))))
    return df.select(
        *keep, F.col("__title").alias("title"), first_set("description", "__desc").alias("description"),
        name.alias("name"), F.nullif(ld["address"], F.lit("")).alias("address"),
        F.nullif(ld["telephone"], F.lit("")).alias("telephone"),
        F.nullif(ld["email"], F.lit("")).alias("structured_email"),
        *[F.nullif(ld[k], F.lit(0.0)).alias(k) for k in ("latitude", "longitude", "rating")],
        F.nullif(ld["reviews"], F.lit(0)).alias("reviews"))


def raw_hrefs(pages: DataFrame, keys: Sequence[str], html: str = "html",
              url: str = "url") -> DataFrame:
    """One row per anchor: keys, ``page_url``, ``pos``, ``href``."""
    return pages.select(
        *keys, F.col(url).alias("page_url"),
        F.posexplode(F.regexp_extract_all(html, F.lit(rules.HREF), F.lit(1))).alias("pos", "href"))


def links(pages: DataFrame, keys: Sequence[str], html: str = "html", url: str = "url",
          internal_only: bool = True, skip_extensions: bool = True) -> DataFrame:
    """Edge table: keys, ``page_url``, ``link``, ``pos`` of the link's first occurrence."""
    found = with_normalised_url(raw_hrefs(pages, keys, html, url), "href", "link", "page_url")
    edges = found.where("link is not null")
    if skip_extensions:
        edges = edges.where(~has_skipped_extension(F.col("link")))
    if internal_only:
        edges = internal_links(edges)
    # a link's first place in its page: partial aggregation, no sort by page
    return edges.groupBy(*keys, "page_url", "link").agg(F.min("pos").alias("pos"))


def internal_links(edges: DataFrame) -> DataFrame:
    """Of the edges those that stay on their page's organisation."""
    return edges.where(registrable_domain(F.col("link")) == registrable_domain(F.col("page_url")))


def contact_link_score(path: Column) -> Column:
    """Likelihood that a lower-case path leads to contact data; null when it shows no hint."""
    position = None
    for i, hint in enumerate(rules.CONTACT_HINTS):
        position = (F if position is None else position).when(path.contains(hint), i)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return 100 - position - slashes * 3 + F.when(F.length(path) < 30, 5).otherwise(0)


def contact_links(pages: DataFrame, keys: Sequence[str], limit: int = 8, edges: DataFrame | None = None,
                  **kw) -> DataFrame:
    """The ``limit`` internal links per page most likely to hold contact data.

    ``edges`` may pass the pages' internal links if at hand.
    """
    edges = pin(links(pages, keys, **kw) if edges is None else edges, "__path", F.lower(path_of(F.col("link"))))
    scored = pin(edges, "score", contact_link_score(F.col("__path"))).drop("__path").where("score is not null")
    order = [F.desc("score"), F.length("link"), F.col("pos")]
    return (scored.withColumn("rank", F.row_number().over(
        W.partitionBy(*keys, "page_url").orderBy(*order))).where(F.col("rank") <= limit))


def outbound_orgs(pages: DataFrame, keys: Sequence[str], limit: int = rules.MAX_OUTBOUND_ORGS,
                  skip_domains: Sequence[str] = rules.SKIP_DOMAINS, edges: DataFrame | None = None, **kw) -> DataFrame:
    """First external link per organisation and page as a homepage, in link order.

    ``edges`` may pass the pages' links of all organisations if at hand.
    """
    domain = registrable_domain(F.col("link"))
    edges = pin(links(pages, keys, internal_only=False, **kw) if edges is None else edges, "domain", domain)
    external = (
        edges.withColumn("__src", registrable_domain(F.col("page_url")))
        .where((F.col("domain") != "") & (F.col("domain") != F.col("__src"))
               & is_scrapeable(F.col("link"), skip_domains)
               & ~F.col("domain").isin(*rules.INFRA_DOMAINS)
               & ~F.col("domain").rlike(r"\.gov$|\.gov\.sa$")))
    home = F.concat(scheme_of(F.col("link")), F.lit("://"), netloc_of(F.col("link")), F.lit("/"))
    firsts = (external.withColumn("homepage", home).groupBy(*keys, "page_url", "domain")
              .agg(F.min(F.struct("pos", "homepage")).alias("__f"))
              .select(*keys, "page_url", "domain", "__f.homepage", "__f.pos"))
    return firsts.withColumn("rank", F.row_number().over(
        W.partitionBy(*keys, "page_url").orderBy("pos"))).where(F.col("rank") <= limit)


def directory_pages(pages: DataFrame, keys: Sequence[str], contacts_found: DataFrame | None = None,
                    html: str = "html", url: str = "url", orgs: DataFrame | None = None,
                    headline: str = rules.HEADLINE, **kw) -> DataFrame:
    """Per page: number of outbound organisations and whether it lists other organisations.

    ``contacts_found`` has the keys and ``n_contacts``; pages it lacks count as
    zero.  ``orgs`` may pass the pages' outbound organisations if at hand.
    ``headline`` is the pattern of titles that announce a list.
    """
    if orgs is None:
        orgs = outbound_orgs(pages, keys, html=html, url=url, **kw)
    orgs = (orgs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orgs")))
    heads = pages.select(*keys, F.col(url).alias("page_url"),
                         F.coalesce(_first(F.col(html), rules.TITLE), F.lit("")).alias("__title"))
    df = heads.join(orgs, list(keys), "left").withColumn("n_orgs", F.coalesce("n_orgs", F.lit(0)))
    if contacts_found is not None:
        df = df.join(contacts_found.select(*keys, "n_contacts"), list(keys), "left")
    else:
        df = df.withColumn("n_contacts", F.lit(0))
    n = F.col("n_orgs")
    listing = F.col("page_url").rlike(rules.DIRECTORY_URL)
    headed = F.col("__title").rlike(headline) & (F.coalesce("n_contacts", F.lit(0)) == 0)
    return df.select(*keys, "page_url", "n_orgs",
                     ((n >= 5) | ((n >= 3) & (listing | headed))).alias("is_directory"))


def all_links(pages: DataFrame, keys: Sequence[str], html: str = "html",
              url: str = "url") -> DataFrame:
    """Every anchor target of a page, internal and external, first occurrence first."""
    found = resolved(raw_hrefs(pages, keys, html, url), "href", "link")
    return (found.where("link is not null").groupBy(*keys, "page_url", "link")
            .agg(F.min("pos").alias("pos")))


def resolved(df: DataFrame, href: str, out: str) -> DataFrame:
    """Canonical form of a reference, or the reference itself when it is no web link."""
    keep = list(df.columns)
    df = with_normalised_url(df, href, "__r", "page_url")
    plain = html_unescape(F.col(href))
    inert = (plain == "") | plain.rlike(r"^(?:javascript:|#|data:)")
    return df.select(*keep, F.when(~inert, F.coalesce("__r", plain)).alias(out))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag; '' when it is absent."""
    pattern = r"(?isU)\s" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def declared_assets(pages: DataFrame, keys: Sequence[str], html: str = "html",
                    url: str = "url") -> DataFrame:
    """Stylesheets, fonts, scripts, images and frames a page declares, first occurrence first."""
    tags = pages.select(
        *keys, F.col(url).alias("page_url"),
        F.posexplode(F.regexp_extract_all(
            html, F.lit(r"(?isU)<((?:link|script|img|source|iframe)\b[^>]*)>"), F.lit(1)),
        ).alias("pos", "tag"))
    tag = F.col("tag")
    rel = F.split(F.lower(attribute(tag, "rel")), r"\s+")
    name = F.lower(F.regexp_extract(tag, r"^(\w+)", 1))
    src, href = attribute(tag, "src"), attribute(tag, "href")
    sheet, font = F.array_contains(rel, "stylesheet"), (
        F.array_contains(rel, "preload") & (attribute(tag, "as") == "font"))
    srcset = F.regexp_extract(F.substring_index(attribute(tag, "srcset"), ",", 1), r"^\s*(\S+)", 1)
    found = tags.select(
        *keys, "page_url", "pos",
        F.when((name == "link") & sheet, "stylesheet").when((name == "link") & font, "font")
        .when(name == "script", "script").when(name.isin("img", "source"), "image")
        .when(name == "iframe", "iframe").alias("kind"),
        F.when(name == "link", href).when(name == "source", srcset).otherwise(src).alias("ref"))
    found = resolved(found.where("kind is not null and ref <> ''"), "ref", "asset")
    return (found.where("asset is not null").groupBy(*keys, "kind", "asset")
            .agg(F.min("pos").alias("pos")))


#: Names that are attributes of the cookie before them, and those that need no value.
COOKIE_ATTRIBUTES = ("expires", "path", "comment", "domain", "max-age", "secure", "httponly", "version", "samesite",
                     "partitioned")
COOKIE_FLAGS = ("secure", "httponly", "partitioned")


def cookies(responses: DataFrame, keys: Sequence[str], headers: str = "headers") -> DataFrame:
    """One row per cookie of a ``set-cookie`` header: name, value and the attributes up to the next cookie.

    A header with an attribute before its first cookie, or with a bare word
    that is no flag, is invalid and gives no rows.  Of a name given twice the
    last cookie counts.
    """
    header = F.element_at(F.col(headers), F.lit("set-cookie"))
    pieces = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("name"),
        F.when(p.contains("="), F.trim(F.regexp_replace(
            F.regexp_replace(p, r"^[^=]*=", ""), '^\\s*"(.*)"\\s*$', "$1"))).alias("v")))
    known = F.transform(parts, lambda p: F.struct(
        p["name"].alias("name"), p["v"].alias("v"), F.lower(p["name"]).alias("k"),
        F.lower(p["name"]).isin(*COOKIE_ATTRIBUTES).alias("attribute")))
    bare = F.exists("parts", lambda p: p["v"].isNull() & ~p["k"].isin(*COOKIE_FLAGS))
    starts = (responses.select(*keys, known.alias("parts"))
              .where(~bare & ~F.get("parts", F.lit(0))["attribute"])
              .select(*keys, "parts", F.posexplode("parts").alias("i", "c")).where("not c.attribute"))
    later = F.slice("parts", F.col("i") + 2, F.size("parts"))
    again = F.exists(later, lambda p: ~p["attribute"] & (p["name"] == F.col("c.name")))
    # attributes after this cookie and before the next one
    n_next = F.array_position(F.transform(later, lambda p: ~p["attribute"]), True)
    attrs = F.when(n_next > 0, F.slice(later, F.lit(1), n_next - 1)).otherwise(later)

    def value(name: str) -> Column:
        found = F.filter("attrs", lambda a: a["k"] == name)
        return F.nullif(F.get(found, F.size(found) - 1)["v"], F.lit(""))

    def flag(name: str) -> Column:
        return F.exists("attrs", lambda a: a["k"] == name)

    return (starts.where(~again).withColumn("attrs", attrs).select(
        *keys, F.col("c.name").alias("name"), F.col("c.v").alias("value"),
        value("domain").alias("domain"), value("path").alias("path"),
        flag("secure").alias("secure"), flag("httponly").alias("httponly"),
        value("expires").alias("expires"), value("samesite").alias("samesite")))


def admission_error(body: Column, content_type: Column, limit: int = rules.MAX_BODY_BYTES) -> Column:
    """Why a response body is not parsed; null when it is."""
    textual = F.lit(False)
    for kind in rules.TEXTUAL_TYPES:
        textual = textual | content_type.contains(kind)
    return (F.when(F.octet_length(body) > limit, "body-too-large")
            .when((F.coalesce(content_type, F.lit("")) != "") & ~textual,
                  F.concat(F.lit("content-type:"), F.substring_index(content_type, ";", 1))))


def is_ok_response(status: Column, text: Column, error: Column) -> Column:
    return error.isNull() & (status >= 200) & (status < 300) & (F.coalesce(text, F.lit("")) != "")


def looks_blocked(html: Column) -> Column:
    return F.lower(html).rlike("|".join(rules.BLOCK_MARKERS))
