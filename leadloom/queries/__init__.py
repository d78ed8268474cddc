"""Registered queries: each operator over the given tables, with SQL that states its result.

Many operators read inputs the given tables do not hold as such (search
payloads, robots files, contact markup).  Those inputs are derived from the
tables by Spark, row by row, so the work grows with the tables.
"""

from . import contacts, crawl, leads, logs, pages, payloads, sinks, streams, urls
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contacts", "crawl", "leads", "logs", "pages", "payloads", "sinks",
           "streams", "urls"]
