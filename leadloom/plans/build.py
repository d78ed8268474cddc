"""From captured pages to scored leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.urls import host_of, registrable_domain
from ..operators.contacts import FAMILIES, contacts_of
from ..operators.leads import (
    at_least, best_contacts, build_leads, cap_emails, contact_stats, first_metadata, merge_contacts)
from ..operators.pages import title_of, with_metadata


def scored_leads(pages: DataFrame, order: Sequence[str] = ("page_id",), org_key: str | None = None,
                 want: Sequence[str] = FAMILIES, blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST,
                 min_confidence: float = 0.0, email_cap: int = rules.MAX_EMAILS_PER_LEAD,
                 full_metadata: bool = False, html: str = "html", url: str = "url", own_borders: bool = False) -> DataFrame:
    """Lead table of a page table.

    HTML is read twice at most (contacts, metadata) and never shuffled; only
    contact candidates and short metadata rows move.
    """
    contacts = merged_contacts(pages, order, org_key, want, blocklist, min_confidence, email_cap,
                               html, url, own_borders=own_borders)
    host = host_of(F.col(url)) if org_key == "host" else registrable_domain(F.col(url))
    keyed = pages.withColumn("domain", host if org_key in (None, "host") else F.col(org_key))
    if full_metadata:
        meta = with_metadata(keyed, html, url)
    else:
        meta = keyed.withColumn("title", title_of(F.col(html))).withColumns({
            c: F.lit(None).cast(t) for c, t in (
                ("name", "string"), ("description", "string"), ("address", "string"), ("latitude", "double"),
                ("longitude", "double"), ("rating", "double"), ("reviews", "int"))})
    facts = first_metadata(meta, order)
    first_url = keyed.groupBy("domain").agg(
        F.min_by(F.col(url), F.struct(*order)).alias("url"), F.count(F.lit(1)).alias("pages_crawled"))
    return build_leads(contact_stats(contacts), facts, first_url)


def merged_contacts(pages: DataFrame, order: Sequence[str] = ("page_id",), org_key: str | None = None,
                    want: Sequence[str] = FAMILIES, blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST,
                    min_confidence: float = 0.0, email_cap: int = rules.MAX_EMAILS_PER_LEAD,
                    html: str = "html", url: str = "url", with_meta: bool = False, own_borders: bool = False) -> DataFrame:
    """Extract, filter, merge and cap the contacts of a page table."""
    found = at_least(contacts_of(pages, order, want, html, url, blocklist, org_key=org_key, dedup=False,
                                 own_borders=own_borders), min_confidence)
    merge = merge_contacts if with_meta else best_contacts
    return cap_emails(merge(found, [*order, "place"]), email_cap)
