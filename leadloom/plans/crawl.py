"""Bounded crawl over a stored page corpus.

Every round looks its frontier up in the corpus.  State between rounds
(visited URLs, contacts found) goes to reliable storage, so a lost executor
costs one round's partitions and plans do not grow with the depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.urls import is_scrapeable
from ..operators.contacts import contacts_of
from ..operators.leads import at_least, best_contacts, build_leads, cap_emails, contact_stats, first_metadata
from ..operators.pages import (
    contact_links, directory_pages, internal_links, links, outbound_orgs, with_metadata)
from ..session import cut
from ..sources.tables import with_robots_gate
from .corpus import StoredCorpus, pages_at
from .discovery import first_seeds


@dataclass(frozen=True)
class CrawlOptions:
    depth: int = 1
    max_pages: int = rules.MAX_PAGES_PER_SITE
    seeds_per_site: int = 3
    agent: str = "leadloom"
    metadata: bool = False                  # collect page facts as well
    blocklist: Sequence[str] = field(default=rules.EMAIL_BLOCKLIST)
    skip_domains: Sequence[str] = field(default=rules.SKIP_DOMAINS)
    directory_waves: int = 1
    max_directory_links: int = rules.MAX_DIRECTORY_LINKS


@dataclass
class CrawlResult:
    visited: DataFrame      # domain, url, depth, page_rank, fetched, blocked
    contacts: DataFrame     # domain, kind, value, source_url, confidence, meta, depth, page_rank, place
    directories: DataFrame  # domain, page_url, listed_orgs
    found: DataFrame        # domain, url, seq: organisations to crawl next
    facts: DataFrame | None = None  # domain, url, depth, page_rank and page metadata, if asked for


def expand(seeds: DataFrame, corpus: StoredCorpus | DataFrame, options: CrawlOptions = CrawlOptions(),
           robots: DataFrame | None = None, listed: DataFrame | None = None) -> CrawlResult:
    """One crawl wave: seeds (domain, url, seq) outwards to ``max(depth, 1)`` links.

    Per domain the first ``seeds_per_site`` seeds are taken, after the
    scrapeable contact pages that sitemaps and archives have ``listed``
    (domain, url, seq); at most ``max_pages`` URLs are tried.  URLs that
    ``robots`` (parsed rules per origin) closes to ``agent`` use up the budget
    but are not fetched.  A page's contact links follow; pages of a domain
    without e-mail so far fall back to plain links.  Once a domain has a
    mailbox of its own at confidence 0.9 or more, one more page is tried at
    most.  Order inside a round is (rank of the referring page, rank of the link).
    """
    deepest = max(options.depth, 1)
    frontier = _first_urls(seeds, listed, options)
    visited, contacts, facts, directories, found = None, None, None, None, None
    for depth in range(deepest + 1):
        tried = _within_budget(frontier, visited, contacts, options, depth)
        tried = tried.withColumn("allowed", F.lit(True)) if robots is None else with_robots_gate(
            tried, robots, "url", options.agent)
        tried = cut(tried)
        # the only join that meets HTML: its result is stored once and read by every later step
        pages = cut(pages_at(corpus, tried.where("allowed").drop("allowed")).where("html is not null"))
        got = pages.select("domain", "url", F.lit(True).alias("fetched"))
        now = cut(tried.join(got, ["domain", "url"], "left").select(
            "domain", "url", "depth", "page_rank", F.coalesce("fetched", F.lit(False)).alias("fetched"),
            (~F.col("allowed")).alias("blocked")))
        pages = pages.withColumn("__org", F.col("domain"))
        # the organisation is part of a page's key: two sites may show the same address
        new = cut(contacts_of(pages, ["__org", "depth", "page_rank"], blocklist=options.blocklist, org_key="__org").drop("__org"))
        visited = now if visited is None else visited.unionByName(now)
        contacts = new if contacts is None else contacts.unionByName(new)
        if options.metadata:
            about = cut(with_metadata(pages).drop("html", "__org"))
            facts = about if facts is None else facts.unionByName(about)
        if depth < deepest:
            # links are taken from the HTML and brought to their normal form once, for all that follow them
            edges = cut(links(pages, ["domain", "page_rank"], internal_only=False))
            if depth == 0:
                directories, found = _directories(pages, edges, new, seeds, options)
            frontier = _next_links(edges, contacts, visited, options)
    return CrawlResult(visited, contacts, directories, found, facts)


def _first_urls(seeds: DataFrame, listed: DataFrame | None, options: CrawlOptions) -> DataFrame:
    """First frontier: domain, url and prio, the listed contact pages before the seeds."""
    own = first_seeds(seeds.groupBy("domain", "url").agg(F.min(F.col("seq").cast("bigint")).alias("seq")),
                      ["seq", "url"], options.seeds_per_site).drop("rank")
    queue = own.select("domain", "url", _prio(F.lit(1), F.col("seq")))
    if listed is not None:
        usable = listed.where(F.coalesce(is_scrapeable(F.col("url"), options.skip_domains), F.lit(False)))
        queue = queue.unionByName(usable.join(own.select("domain").distinct(), "domain", "left_semi")
                                  .select("domain", "url", _prio(F.lit(0), F.col("seq"))))
    return queue.groupBy("domain", "url").agg(F.min("prio").alias("prio"))


def _prio(page: Column, link: Column) -> Column:
    return F.struct(page.cast("bigint").alias("page"), link.cast("bigint").alias("link")).alias("prio")


def _within_budget(frontier: DataFrame, visited: DataFrame | None, contacts: DataFrame | None,
                   options: CrawlOptions, depth: int) -> DataFrame:
    budget = options.max_pages
    # the constant bound applies before the shuffle, so a domain with many links stays cheap
    r = F.row_number().over(W.partitionBy("domain").orderBy("prio", "url"))
    first = frontier.withColumn("page_rank", r).where(F.col("page_rank") <= budget)
    if visited is None:
        return first.select("domain", "url", F.lit(depth).alias("depth"), "page_rank")
    used = visited.groupBy("domain").agg(F.count(F.lit(1)).alias("__used"))
    settled = (contacts.where((F.col("kind") == "email") & (F.col("confidence") >= 0.9)
                              & F.endswith(F.col("value"), F.concat(F.lit("@"), F.col("domain"))))
               .select("domain").distinct().withColumn("__one", F.lit(1)))
    left = F.least(F.lit(budget) - F.coalesce("__used", F.lit(0)), F.coalesce("__one", F.lit(budget)))
    return (first.join(used, "domain", "left").join(settled, "domain", "left")
            .where(F.col("page_rank") <= left)
            .select("domain", "url", F.lit(depth).alias("depth"), "page_rank"))


def _next_links(edges: DataFrame, contacts: DataFrame, visited: DataFrame,
                options: CrawlOptions) -> DataFrame:
    inner = internal_links(edges)
    ranked = contact_links(inner, ["domain", "page_rank"], options.max_pages, inner).select(
        "domain", "page_rank", F.col("rank").alias("link_rank"), "page_url", "link", "pos")
    nxt = ranked.select("domain", F.col("link").alias("url"),
                        _prio(F.col("page_rank"), F.col("link_rank")))
    if options.depth > 0:
        with_mail = contacts.where("kind = 'email'").select("domain").distinct()
        plain = (inner.join(with_mail, "domain", "left_anti")
                 .join(ranked.select("domain", "page_url").distinct(), ["domain", "page_url"], "left_anti"))
        w = W.partitionBy("domain", "page_url").orderBy("pos")
        plain = plain.withColumn("link_rank", F.row_number().over(w)).where(F.col("link_rank") <= options.max_pages)
        nxt = nxt.unionByName(plain.select(
            "domain", F.col("link").alias("url"), _prio(F.col("page_rank"), F.col("link_rank"))))
    return (nxt.join(visited.select("url").distinct(), "url", "left_anti")
            .groupBy("domain", "url").agg(F.min("prio").alias("prio")))


def _directories(pages: DataFrame, edges: DataFrame, contacts: DataFrame, seeds: DataFrame,
                 options: CrawlOptions) -> tuple[DataFrame, DataFrame]:
    keys = ["site", "page_rank"]
    sites = pages.withColumnRenamed("domain", "site")
    n = contacts.groupBy(F.col("domain").alias("site"), "page_rank").agg(F.count(F.lit(1)).alias("n_contacts"))
    # the classifier counts the same organisations
    all_orgs = cut(outbound_orgs(sites, keys, rules.MAX_OUTBOUND_ORGS, options.skip_domains,
                                 edges.withColumnRenamed("domain", "site")))
    listing = directory_pages(sites, keys, n, orgs=all_orgs).where("is_directory")
    orgs = (all_orgs.where(F.col("rank") <= options.max_directory_links)
            .select("site", "page_url", F.col("domain").alias("org"), "homepage", "pos")
            .join(listing.select("site", "page_url"), ["site", "page_url"]))
    listed = orgs.groupBy("site", "page_url").agg(F.count(F.lit(1)).alias("listed_orgs"))
    known = seeds.select(F.col("domain").alias("org")).distinct()
    fresh = orgs.join(known, "org", "left_anti")
    with_fresh = listed.join(fresh.select("site", "page_url").distinct(), ["site", "page_url"])
    found = (fresh.groupBy("org", F.col("homepage").alias("url")).agg(F.min(F.struct("page_url", "pos")).alias("o")))
    seq = F.row_number().over(W.partitionBy("org").orderBy("o", "url"))
    found = found.withColumn("seq", seq).where("seq <= 3").select(F.col("org").alias("domain"), "url", "seq")
    return (cut(with_fresh.select(F.col("site").alias("domain"), "page_url", "listed_orgs")), cut(found))


def crawl(seeds: DataFrame, corpus: StoredCorpus | DataFrame, options: CrawlOptions = CrawlOptions(),
          robots: DataFrame | None = None, listed: DataFrame | None = None) -> CrawlResult:
    """Crawl waves: the seeds, then the organisations their directory pages list."""
    result = expand(seeds, corpus, options, robots, listed)
    done = seeds.select("domain").distinct()
    for _ in range(options.directory_waves):
        nxt = cut(result.found.join(done, "domain", "left_anti"))
        if nxt.isEmpty():
            break
        wave = expand(nxt, corpus, options, robots, listed)
        done = cut(done.unionByName(nxt.select("domain").distinct()))
        result = CrawlResult(
            result.visited.unionByName(wave.visited), result.contacts.unionByName(wave.contacts),
            result.directories.unionByName(wave.directories), wave.found,
            result.facts.unionByName(wave.facts) if options.metadata else None)
    return result


def leads_from_seeds(seeds: DataFrame, corpus: StoredCorpus | DataFrame, options: CrawlOptions = CrawlOptions(),
                     robots: DataFrame | None = None, listed: DataFrame | None = None, min_confidence: float = 0.0,
                     email_cap: int = rules.MAX_EMAILS_PER_LEAD) -> DataFrame:
    """Seeds to scored leads in one call: crawl, merge and cap contacts, first metadata, score.

    A domain becomes a lead when one of its pages was fetched; ``url`` is its
    first fetched page.
    """
    result = crawl(seeds, corpus, replace(options, metadata=True), robots, listed)
    order = ["depth", "page_rank"]
    contacts = cap_emails(best_contacts(at_least(result.contacts, min_confidence), [*order, "place"]), email_cap)
    first = result.visited.where("fetched").groupBy("domain").agg(
        F.min_by("url", F.struct(*order)).alias("url"), F.count(F.lit(1)).alias("pages_crawled"))
    return build_leads(contact_stats(contacts), first_metadata(result.facts, order), first)
