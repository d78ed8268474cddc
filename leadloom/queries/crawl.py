"""Crawls over a corpus derived from the given pages.

Every page stands for one site ``siteN.net`` with a home page, a contact page
and an about page; every tenth site is a listing of five other sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.corpus import StoredCorpus
from ..plans.crawl import CrawlOptions, crawl, expand, leads_from_seeds
from ..sources.tables import robots_rules
from .base import register, table
from .payloads import key, text


def _corpus(spark, sf) -> StoredCorpus:
    p = table(spark, sf, "pages").select("page_id", "html")
    site = text("https://www.site", key(), ".net")
    listing = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: text(
        '<a href="https://www.listed', key(), "x", j, '.org/about">o</a>')), "")
    home = F.concat(
        F.regexp_replace("html", "<nav>.*?</nav>", ""),
        F.when(key() % 3 == 0, text('<a href="/contact">c</a><a href="/impressum.html">i</a>')).otherwise('<a href="/shop">s</a>'),
        F.when(key() % 4 == 0, text('<a href="mailto:hello@site', key(), '.net">m</a>')).otherwise(""),
        F.when(key() % 10 == 0, listing).otherwise(""))
    pages = F.array(
        F.struct(F.concat(site, F.lit("/")).alias("url"), home.alias("html")),
        F.struct(F.concat(site, F.lit("/contact")).alias("url"), text("<p>write to box", key(), "@site", key(), '.net</p><a href="/team">t</a>').alias("html")),
        F.struct(F.concat(site, F.lit("/shop")).alias("url"), text("<p>shop", key(), '@mail.com</p><a href="/cart">c</a>').alias("html")))
    listed = F.when(key() % 10 == 0, F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.struct(
        text("https://www.listed", key(), "x", j, ".org/").alias("url"),
        text("<title>Listed</title><p>office", key(), "x", j, "@listed", key(), "x", j, ".org</p>").alias("html")))).otherwise(
        F.array().cast("array<struct<url:string,html:string>>"))
    rows = p.select(F.explode(F.concat(pages, listed)).alias("r")).select("r.url", "r.html")
    return StoredCorpus.store(rows, buckets=16)


def _seeds(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(
        text("site", key(), ".net").alias("domain"), text("https://www.site", key(), ".net/").alias("url"), F.lit(0).alias("seq"))


_SITE = "'https://www.site' || page_id || '.net"
_SEED_VISITS = f"""SELECT 'site' || page_id || '.net' AS domain, {_SITE}/' AS url, 0 AS depth, TRUE AS fetched FROM pages
    UNION ALL SELECT 'site' || page_id || '.net', {_SITE}/contact', 1, TRUE FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT 'site' || page_id || '.net', {_SITE}/impressum.html', 1, FALSE FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 0
    UNION ALL SELECT 'site' || page_id || '.net', {_SITE}/shop', 1, TRUE FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 0
      AND NOT regexp_matches(html, '[A-Za-z0-9]@mail[0-9]*[.]example[.]')"""


@register("itr1_frontier_expansion", _SEED_VISITS)
def _(spark, sf):
    r = expand(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    return r.visited.select("domain", "url", "depth", "fetched")


@register("itr2_early_exit", f"SELECT domain, count(*) AS n_tried FROM ({_SEED_VISITS}) WHERE depth = 1 GROUP BY 1")
def _(spark, sf):
    r = expand(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    return r.visited.where("depth = 1").groupBy("domain").agg(F.count(F.lit(1)).alias("n_tried"))


@register("itr3_directory_wave", """SELECT domain, value FROM (SELECT 'site' || page_id || '.net' AS domain, 'hello@site' || page_id || '.net' AS value FROM pages WHERE page_id % 4 = 0
    UNION ALL SELECT 'site' || page_id || '.net', 'box' || page_id || '@site' || page_id || '.net' FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT 'listed' || page_id || 'x' || j || '.org', 'office' || page_id || 'x' || j || '@listed' || page_id || 'x' || j || '.org' FROM (SELECT page_id, unnest([1, 2, 3, 4, 5]) AS j FROM pages WHERE page_id % 10 = 0))""")
def _(spark, sf):
    r = crawl(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    mails = r.contacts.where("kind = 'email' AND value LIKE concat('%@', domain)")
    return mails.select("domain", "value").distinct()


@register("itr3_directories", "SELECT 'site' || page_id || '.net' AS domain, 5::BIGINT AS listed_orgs FROM pages WHERE page_id % 10 = 0")
def _(spark, sf):
    r = expand(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    return r.directories.select("domain", "listed_orgs")


@register("jn4_directory_finds", """SELECT domain, url FROM (SELECT 'listed' || page_id || 'x' || j || '.org' AS domain, 'https://www.listed' || page_id || 'x' || j || '.org/' AS url
    FROM (SELECT page_id, unnest([1, 2, 3, 4, 5]) AS j FROM pages WHERE page_id % 10 = 0))""")
def _(spark, sf):
    r = expand(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    return r.found.select("domain", "url")


@register("itr1_robots_gate", f"""SELECT domain, url, depth, fetched AND NOT closed AS fetched, closed AS blocked FROM (
    SELECT *, url LIKE '%/contact' AND replace(replace(domain, 'site', ''), '.net', '')::INT % 2 = 0 AS closed FROM ({_SEED_VISITS}))""")
def _(spark, sf):
    robots = table(spark, sf, "pages").select(
        text("https://www.site", key(), ".net").alias("origin"), F.lit(True).alias("ok"),
        F.when(key() % 2 == 0, "User-agent: *\nDisallow: /contact").otherwise("User-agent: other\nDisallow: /").alias("body"))
    r = expand(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()), robots_rules(robots))
    return r.visited.select("domain", "url", "depth", "fetched", "blocked")


@register("itr1_first_seeds", f"""SELECT 'site' || page_id || '.net' AS domain, unnest(list_concat(
    CASE WHEN page_id % 2 = 0 THEN [{_SITE}/legal'] ELSE [] END, [{_SITE}/', {_SITE}/shop', {_SITE}/a'])) AS url FROM pages""")
def _(spark, sf):
    """Three seeds a site, after the contact pages that its sitemap lists."""
    p = table(spark, sf, "pages").select(text("site", key(), ".net").alias("domain"), text("https://www.site", key(), ".net").alias("home"), "page_id")
    seeds = p.select("domain", F.posexplode(F.array(*map(F.lit, ("/", "/shop", "/", "/a", "/contact", "/b")))).alias("seq", "path"), "home") \
        .select("domain", F.concat("home", "path").alias("url"), "seq")
    listed = p.where("page_id % 2 = 0").select("domain", F.explode(F.array(*map(F.lit, ("/legal", "/prices.pdf")))).alias("path"), "home") \
        .select("domain", F.concat("home", "path").alias("url"), F.lit(0).alias("seq"))
    r = expand(seeds, _corpus(spark, sf), CrawlOptions(blocklist=()), listed=listed)
    return r.visited.where("depth = 0").select("domain", "url")


@register("itr_seeds_to_leads", f"""SELECT domain, count(*) AS pages_crawled, min(url) AS url FROM ({_SEED_VISITS}) WHERE fetched GROUP BY 1
    UNION ALL SELECT 'listed' || page_id || 'x' || j || '.org', 1, 'https://www.listed' || page_id || 'x' || j || '.org/'
    FROM (SELECT page_id, unnest([1, 2, 3, 4, 5]) AS j FROM pages WHERE page_id % 10 = 0)""")
def _(spark, sf):
    leads = leads_from_seeds(_seeds(spark, sf), _corpus(spark, sf), CrawlOptions(blocklist=()))
    return leads.select("domain", "pages_crawled", "url")
