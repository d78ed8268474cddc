"""Contact and lead analytics over captured web pages, as Spark jobs."""

from .operators.contacts import contacts_of
from .plans.build import merged_contacts, scored_leads
from .plans.crawl import CrawlOptions, crawl
from .session import build_session, configure

__all__ = ["CrawlOptions", "build_session", "configure", "contacts_of", "crawl", "merged_contacts",
           "scored_leads"]
