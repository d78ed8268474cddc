"""Registry and the tables the queries derive from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..session import checkpoint_dir, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` states the same result for another engine."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for a query that writes and reads back."""
    return f"{checkpoint_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


# ---- SQL fragments shared by result statements -------------------------------------------------
def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"


def sql_domain(h: str) -> str:
    """Registrable domain of a host expression."""
    from .. import rules
    p = f"string_split(regexp_replace({h}, '^www\\.', ''), '.')"
    return (f"(CASE WHEN regexp_matches({h}, '^[0-9.]*$') THEN {h} "
            f"WHEN len({p}) <= 2 THEN array_to_string({p}, '.') "
            f"WHEN {p}[-2] IN {sql_list(rules.SECOND_LEVEL_LABELS)} AND length({p}[-1]) <= 3 "
            f"THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END)")


def sql_normal(u: str) -> str:
    """Canonical form of an absolute http(s) URL without entities or dot segments."""
    from .. import rules
    path = f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), lambda q: q <> '' AND NOT "
            f"regexp_matches(string_split(q, '=')[1], '(?i)^({'|'.join(rules.TRACKING_PREFIXES)})')), '&')")
    netloc = f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1))"
    scheme = f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1))"
    port = (f"(CASE {scheme} WHEN 'http' THEN regexp_replace({netloc}, ':80$', '') "
            f"ELSE regexp_replace({netloc}, ':443$', '') END)")
    p1 = f"regexp_replace('/' || {path}, '/{{2,}}', '/', 'g')"
    p2 = f"(CASE WHEN length({p1}) > 1 THEN regexp_replace({p1}, '/$', '') ELSE {p1} END)"
    return f"({scheme} || '://' || {port} || {p2} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


def sql_score(e="n_emails", b="best_email", p="n_phones", s="n_networks", named="FALSE", addressed="FALSE") -> str:
    return (f"round(least(CASE WHEN {e} > 0 THEN 40 + least({e} - 1, 4) * 3 + {b} * 10 ELSE 0.0 END"
            f" + CASE WHEN {p} > 0 THEN 15 ELSE 0 END + least({s} * 5, 20)"
            f" + CASE WHEN {named} THEN 5 ELSE 0 END + CASE WHEN {addressed} THEN 5 ELSE 0 END, 100.0), 1)::DOUBLE")


# ---- derived tables, one expression text for both engines -----------------------------------
#: Contact finds derived from orders: a third of all rows belong to one organisation.
FINDS_COLUMNS = {
    "domain": "CASE WHEN o_orderkey % 3 = 0 THEN 'hub.example.net' ELSE concat('org', o_custkey % 300, "
              "CASE o_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.io' WHEN 2 THEN '.co.uk' ELSE '.org' END) END",
    "kind": "CASE o_orderkey % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'email' WHEN 2 THEN 'phone' WHEN 3 THEN 'email' "
            "WHEN 4 THEN 'linkedin' WHEN 5 THEN 'twitter' WHEN 6 THEN 'github' ELSE 'facebook' END",
    "local": "CASE o_custkey % 9 WHEN 0 THEN 'info' WHEN 1 THEN 'Sales' ELSE concat(CASE WHEN o_orderkey % 2 = 0 "
             "THEN 'Box' ELSE 'box' END, o_custkey % 700) END",
    "seq": "o_orderkey",
    "confidence": "round((1 + o_orderkey % 19) * 0.05, 2)",
    "source_url": "concat('https://pages.example.net/', o_orderkey % 977)",
    "page_no": "o_custkey % 50",
    "spent": "o_totalprice",
}
_VALUE = ("CASE kind WHEN 'email' THEN concat(local, '@', CASE seq % 11 WHEN 0 THEN 'gmail.com' ELSE domain END) "
          "WHEN 'phone' THEN concat('+1555', 1000000 + seq % 5000) "
          "ELSE concat('https://', kind, '.com/', lower(local)) END")

FINDS_SQL = ("(SELECT domain, kind, " + _VALUE + " AS value, source_url, confidence, seq, page_no, spent FROM (SELECT "
             + ", ".join(f"{e} AS {n}" for n, e in FINDS_COLUMNS.items()) + " FROM orders))")


def finds(spark: SparkSession, sf: str) -> DataFrame:
    """Contact finds (domain, kind, value, source_url, confidence, seq, meta) derived from orders."""
    base = table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in FINDS_COLUMNS.items()])
    base = base.withColumn("confidence", F.col("confidence").cast("double"))
    return base.selectExpr("domain", "kind", f"{_VALUE} AS value", "source_url", "confidence", "seq", "page_no",
                           "spent").withColumn("meta", F.create_map(F.lit("page"), F.col("page_no").cast("string")))


#: Finds merged per (domain, kind, value ignoring case).
MERGED_SQL = (f"(SELECT domain, kind, first(value ORDER BY seq) AS value, max(confidence)::DOUBLE AS confidence, "
              f"first(source_url ORDER BY confidence DESC, seq) AS source_url FROM {FINDS_SQL} "
              f"GROUP BY domain, kind, lower(value))")

CAPPED_SQL = (f"(SELECT domain, kind, value, confidence, source_url FROM (SELECT *, row_number() OVER "
              f"(PARTITION BY domain, kind = 'email' ORDER BY confidence DESC, "
              f"lower(split_part(value, '@', 1)) IN {sql_list(rules.ROLE_LOCALS)} DESC, value) AS rn FROM {MERGED_SQL}) "
              f"WHERE kind <> 'email' OR rn <= 25)")

STATS_SQL = ("(SELECT domain, count(*) AS n_contacts, count(*) FILTER (kind = 'email') AS n_emails, "
             "max(confidence) FILTER (kind = 'email') AS best_email, count(*) FILTER (kind = 'phone') AS n_phones, "
             "count(DISTINCT kind) FILTER (kind NOT IN ('email', 'phone')) AS n_networks FROM "
             f"{CAPPED_SQL} GROUP BY domain)")

#: Lead facts per organisation, from the finds' pages.
FACTS_SQL = (f"(SELECT domain, first(name ORDER BY seq) FILTER (name <> '') AS name, "
             f"first(address ORDER BY seq) FILTER (address <> '') AS address, count(*) AS pages_crawled FROM (SELECT *, "
             f"CASE WHEN seq % 40 = 7 THEN concat('Name ', seq) ELSE '' END AS name, "
             f"CASE WHEN seq % 50 = 9 THEN concat(seq, ' High Street') END AS address FROM {FINDS_SQL}) GROUP BY domain)")

LEADS_SQL = (f"(SELECT *, {sql_score(named='name IS NOT NULL', addressed='address IS NOT NULL')} AS score, "
             f"'crawl' AS source FROM {FACTS_SQL} JOIN {STATS_SQL} USING (domain))")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Page metadata (domain, seq, name, title, address, ...) that goes with the finds."""
    f = finds(spark, sf)
    return f.selectExpr(
        "domain", "seq", "CASE WHEN seq % 40 = 7 THEN concat('Name ', seq) ELSE '' END AS name",
        "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS description",
        "CASE WHEN seq % 50 = 9 THEN concat(seq, ' High Street') END AS address",
        "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude",
        "CAST(NULL AS DOUBLE) AS rating", "CAST(NULL AS INT) AS reviews")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.leads import best_contacts
    return best_contacts(finds(spark, sf), ["seq"])


def capped(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.leads import cap_emails
    return cap_emails(merged(spark, sf))


def lead_table(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.leads import build_leads, contact_stats, first_metadata
    f = facts(spark, sf)
    pages = f.groupBy("domain").agg(F.count(F.lit(1)).alias("pages_crawled"))
    return build_leads(contact_stats(capped(spark, sf)), first_metadata(f, ["seq"]), pages)


# ---- pages with contact markup -----------------------------------------------------------------
def captured(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with contact markup appended: page_id, url, host, html.

    Which markup a page carries follows from its number.
    """
    from ..functions.urls import host_of
    from ..sources.tables import spread
    p = spread(table(spark, sf, "pages")).withColumn("host", host_of(F.col("url")))
    k = F.col("page_id")

    def every(n: int, *parts) -> F.Column:
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
        return F.when(k % n == 0, text).otherwise(F.lit(""))

    address = F.concat(F.lit("cf"), k.cast("string"), F.lit("@shielded.io"))
    key = (k % 200 + 1).cast("int")
    token = F.concat(F.lpad(F.lower(F.hex(key)), 2, "0"), F.array_join(F.transform(
        F.filter(F.split(address, ""), lambda c: c != ""),
        lambda c: F.lpad(F.lower(F.hex(F.ascii(c).bitwiseXOR(key))), 2, "0")), ""))
    partners = F.array_join(F.transform(F.sequence(F.lit(0), k % 8), lambda j: F.concat(
        F.lit('<a href="https://www.partner'), ((k * 3 + j) % 60).cast("string"), F.lit('.net/about?ref=x">p</a>'))), "")
    markup = F.concat(
        every(2, '<a class="m" href="mailto:desk', k % 40, '@', F.col("host"), '?subject=Hi">write</a>'),
        every(3, ' <a href="tel:+1-555-01', k % 9000 + 1000, '-77">call</a>'),
        every(5, ' <p>team', k, ' (at) firm', k % 50, ' (dot) com</p>'),
        every(7, " <script>var m='js", k, "'+'@'+'widgets.io';</script>"),
        every(6, ' <script id="__NEXT_DATA__" type="application/json">{"mail":"spa', k, '\\u0040state.io"}</script>'),
        every(4, ' <span data-cfemail="', token, '">[protected]</span>'),
        every(3, ' <a href="https://www.linkedin.com/company/org-', k % 90, '">in</a>'
              '<a href="https://twitter.com/share?u=1">s</a>'),
        every(4, ' <a href="https://x.com/org_', k % 90, '">x</a> <a href="https://github.com/org', k % 90, '/site">g</a>'),
        every(9, '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList"},'
              '{"@type":["LocalBusiness","Thing"],"name":"Org &amp; Co ', k, '","telephone":"+44 20 7946 ', k % 9000 + 1000,
              '","email":"mailto:ld', k, '@org.io","address":{"streetAddress":"', k, ' High St","addressLocality":"Leeds",},'
              '"geo":{"latitude":', k % 80 + 1, '.5,"longitude":"-1.25"},"aggregateRating":{"ratingValue":"4.5","reviewCount":"',
              k % 300 + 1, '"}}]}</script>'),
        every(2, '<link rel="stylesheet" href="/css/', k % 5, '.css"><script src="https://cdn', k % 4, '.net/app.js"></script>'
              '<img alt="a" src="/img/', k % 11, '.png"><source srcset="/img/s.webp 1x, /img/t.webp 2x"><iframe src="https://maps', k % 3, '.net/e"></iframe>'),
        partners)
    return p.select("page_id", "url", "host", F.concat(
        F.substring_index("html", "</body>", 1), markup, F.lit("</body></html>")).alias("html"))
