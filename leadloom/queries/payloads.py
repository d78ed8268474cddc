"""Payload sources and enrichment joins over payload texts derived row by row from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.urls import host_of
from ..operators import analytics as A
from ..operators import enrich as E
from ..operators import leads as L
from ..plans import discovery as D
from ..sources import payloads as P
from ..sources import tables as S
from .base import CAPPED_SQL, LEADS_SQL, capped, lead_table, register, sql_host, sql_normal, table

HOST, NORMAL = sql_host("url"), sql_normal("url")


def key() -> Column:
    """The number a page's payloads follow from (a function: a Column needs a session)."""
    return F.col("page_id")


def _s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", host_of(F.col("url")).alias("host"))


# ------------------------------------------------------------------ search results
@register("src2_url_lines", "SELECT url FROM pages WHERE page_id % 5 <> 1")
def _(spark, sf):
    from .base import scratch
    path = scratch(spark, "lines")
    line = F.when(key() % 5 == 0, text("  ", F.col("url"), "\t")).when(key() % 5 == 1, text("#", F.col("url"))).otherwise(F.col("url"))
    lines = _pages(spark, sf).select(line.alias("v")).unionByName(_pages(spark, sf).select(F.lit("   ").alias("v")))
    lines.write.text(path)
    return S.read_url_list(spark, path)


@register("src4_serp_json", f"""SELECT page_id, seq::INT AS seq, url FROM (SELECT page_id, 0 AS seq, {NORMAL} AS url FROM pages UNION ALL
    SELECT page_id, 1, 'https://cached.example.net/' || page_id FROM pages UNION ALL SELECT page_id, 2, 'https://' || {HOST} || '/home' FROM pages WHERE page_id % 3 <> 0)""")
def _(spark, sf):
    payload = text('{"search_metadata":{"status":"Success"},"organic_results":[{"position":1,"link":"', F.col("url"),
                   '"},{"link":"","cached_page_link":"https://cached.example.net/', key(), '"},{"title":"none"}],"local_results":',
                   F.when(key() % 3 == 0, F.lit("[]")).otherwise(text('{"places":[{"title":"x"},{"website":"HTTPS://', F.col("host"), '//home/"}]}')), "}")
    return P.serp_urls(_pages(spark, sf).select("page_id", payload.alias("payload")), ["page_id"])


@register("src5_duckduckgo", f"SELECT page_id, 0 AS seq, {NORMAL} AS url FROM pages UNION ALL SELECT page_id, 1, 'https://second.example.net/' || page_id FROM pages WHERE page_id % 2 = 0")
def _(spark, sf):
    redirect = text("//duckduckgo.com/l/?uddg=", F.url_encode("url"), "&amp;rut=9")
    marked = text('<a rel="nofollow" class="result__a" href="', redirect, '">a</a><a class="x result__a b" href="https://second.example.net/', key(),
                  '">b</a><a href="/l/?uddg=https%3A%2F%2Fignored.net">c</a>')
    plain = text('<a class="other" href="/l/?uddg=', F.url_encode("url"), '">a</a>')
    html = F.when(key() % 2 == 0, marked).otherwise(plain)
    return P.duckduckgo_urls(_pages(spark, sf).select("page_id", html.alias("html")), ["page_id"])


@register("src6_bing", f"SELECT page_id, 0 AS seq, {NORMAL} AS url FROM pages UNION ALL SELECT page_id, 2, 'https://direct.example.net/' || page_id FROM pages")
def _(spark, sf):
    html = text('<h2 class="t"><a h="1" href="https://www.bing.com/ck/a?!&amp;&amp;p=9&amp;u=a1', F.regexp_replace(F.base64(F.col("url").cast("binary")), "=+$", ""),
                '&amp;ntb=1">x</a></h2><h2><a href="https://www.bing.com/images">i</a></h2><h2>\n<a href="https://direct.example.net/', key(), '/">d</a></h2>')
    return P.bing_urls(_pages(spark, sf).select("page_id", html.alias("html")), ["page_id"])


@register("win9_pagination_stop", """SELECT user_id, page, n_hits FROM (SELECT *, min(CASE WHEN n_hits < 5 THEN page END) OVER (PARTITION BY user_id) AS stop FROM
    (SELECT user_id, event_id // 1500 AS page, count(*) AS n_hits FROM events GROUP BY 1, 2)) WHERE stop IS NULL OR page <= stop""")
def _(spark, sf):
    pages = table(spark, sf, "events").groupBy("user_id", F.floor(F.col("event_id") / 1500).alias("page")).agg(F.count(F.lit(1)).alias("n_hits"))
    return P.until_short_page(pages, ["user_id"])


# ------------------------------------------------------------------ places
def _place_payload() -> Column:
    return text('{"status":"OK","results":[{"place_id":"p', key(), '","name":"Shop  &amp; Co ', key(), '","formatted_address":"', key(),
                ' High Street","geometry":{"location":{"lat":', (key() % 90).cast("double"), ',"lng":', (key() % 180).cast("double"),
                '}},"rating":4.5,"user_ratings_total":', key() % 500, ',"types":["dentist","health","point","extra"],"business_status":"OPERATIONAL"}]}')


@register("src7_places", """SELECT page_id, 'p' || page_id AS place_id, 'Shop & Co ' || page_id AS name, page_id || ' High Street' AS address, (page_id % 90)::DOUBLE AS latitude,
    (page_id % 180)::DOUBLE AS longitude, 4.5::DOUBLE AS rating, (page_id % 500)::INT AS reviews, 'dentist, health, point' AS category FROM pages""")
def _(spark, sf):
    rows = P.place_rows(_pages(spark, sf).select("page_id", _place_payload().alias("payload")), ["page_id"])
    return rows.drop("seq", "business_status")


@register("jn15_place_details", f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'shop' || page_id || '.co.uk' ELSE '' END AS domain, CASE WHEN page_id % 3 = 0 THEN 'https://www.shop' || page_id || '.co.uk/' ELSE '' END AS url,
    CASE WHEN page_id % 3 = 2 THEN NULL WHEN page_id % 2 = 0 THEN '+44207946' || (1000 + page_id % 9000) ELSE '02079461' || (100 + page_id % 900) END AS phone FROM pages""")
def _(spark, sf):
    pages = _pages(spark, sf)
    places = P.place_rows(pages.select("page_id", _place_payload().alias("payload")), ["page_id"])
    details = pages.where("page_id % 3 <> 2").select(
        text("p", key()).alias("place_id"), F.when(key() % 3 == 0, text("https://WWW.shop", key(), ".co.uk/?utm_source=maps")).alias("website"),
        text("(020) 7946 1", 100 + key() % 900).alias("formatted_phone_number"),
        F.when(key() % 2 == 0, text("+44 20 7946 ", 1000 + key() % 9000)).otherwise("").alias("international_phone_number"))
    return P.place_leads(places, details, ["page_id"]).select("page_id", "domain", "url", "phone")


def _map_payload() -> Column:
    return text('{"type":"node","id":', key(), ',"lat":', F.when(key() % 2 == 0, text((key() % 80).cast("double"))).otherwise("null"), ',"center":{"lat":1.5,"lon":2.5},"tags":{',
                F.when(key() % 4 != 3, text('"name":"Cafe ', key(), '",')).otherwise(""), F.when(key() % 3 == 0, text('"contact:website":"cafe', key(), '.com/",')).otherwise(""),
                '"addr:street":"Road","addr:housenumber":"', key(), '","shop":"bakery","phone":"+44 20 7946 ', 1000 + key() % 9000, ';020 7946 ', 1000 + key() % 9000, '","email":"Info@cafe', key(), '.com,bad"}}')


@register("src8_map_leads", """SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN 'Cafe ' || page_id END AS name, CASE WHEN page_id % 3 = 0 THEN 'cafe' || page_id || '.com' ELSE '' END AS domain,
    page_id || ', Road' AS address, CASE WHEN page_id % 2 = 0 THEN (page_id % 80)::DOUBLE ELSE 1.5 END AS latitude, 2.5::DOUBLE AS longitude, 'bakery' AS category FROM pages WHERE page_id % 4 <> 3 OR page_id % 3 = 0""")
def _(spark, sf):
    leads = P.map_leads(_pages(spark, sf).select("page_id", _map_payload().alias("payload")), ["page_id"])
    return leads.select("page_id", "name", "domain", "address", "latitude", "longitude", "category")


@register("src8_map_contacts", """SELECT page_id, kind, value, confidence FROM (SELECT page_id, unnest(['phone', 'phone', 'email']) AS kind, unnest(['+44207946' || (1000 + page_id % 9000),
    '0207946' || (1000 + page_id % 9000), 'info@cafe' || page_id || '.com']) AS value, unnest([0.9, 0.9, 0.85])::DOUBLE AS confidence FROM pages WHERE page_id % 4 <> 3 OR page_id % 3 = 0)""")
def _(spark, sf):
    leads = P.map_leads(_pages(spark, sf).select("page_id", _map_payload().alias("payload")), ["page_id"])
    return P.map_contacts(leads, ["page_id"]).select("page_id", "kind", "value", "confidence")


@register("jn13_selector_match", """SELECT page_id FROM pages WHERE page_id % 4 <> 3 OR page_id % 3 = 0""")
def _(spark, sf):
    leads = P.map_leads(_pages(spark, sf).select("page_id", _map_payload().alias("payload")), ["page_id"])
    return leads.where(P.matches_selectors(F.col("tags"), ["amenity=cafe", "shop=yes"])).select("page_id")


@register("src17_geocode", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 80)::DOUBLE END AS s, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 170)::DOUBLE END AS w,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 80 + 0.5::DOUBLE END AS n FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    box = text('[{"boundingbox":["', k % 80, '.0","', k % 80, '.5","', k % 170, '.0","', k % 170, '.9"]},{"boundingbox":[]}]')
    payload = F.when(k % 8 == 0, "[]").when(k % 4 == 0, '[{"boundingbox":["a","b","c","d"]}]').otherwise(box)
    df = table(spark, sf, "customer").select("c_custkey", P.geocoded_box(payload).alias("b"))
    return df.select("c_custkey", "b.s", "b.w", "b.n")


# ------------------------------------------------------------------ contact provider
def _provider_payload() -> Column:
    k = F.col("c_custkey")
    return text('{"data":{"domain":"firm', k, '.com","organization":"Firm  ', k, '","country":"', F.when(k % 2 == 0, "GB").otherwise(""), '","industry":"Retail","twitter":"firm_', k,
                '","linkedin":"https://www.linkedin.com/company/f', k, '","facebook":null,"emails":[{"value":"Ann', k, '@Firm', k, '.com","confidence":', k % 101,
                ',"first_name":"Ann","last_name":null,"position":"CEO","verification":{"status":"valid"}},{"value":""}]}}')


def _provider(spark, sf):
    return table(spark, sf, "customer").select(text("firm", F.col("c_custkey"), ".com").alias("domain"), "c_custkey", _provider_payload().alias("payload"))


@register("src9_provider_contacts", """SELECT c_custkey, kind, value, confidence, name FROM (SELECT c_custkey, unnest(['email', 'twitter', 'linkedin']) AS kind,
    unnest(['ann' || c_custkey || '@firm' || c_custkey || '.com', 'https://twitter.com/firm_' || c_custkey, 'https://www.linkedin.com/company/f' || c_custkey]) AS value,
    unnest([((least(9900, 5000 + 50 * CASE WHEN c_custkey % 101 = 0 THEN 50 ELSE c_custkey % 101 END) + 50) // 100) / 100.0::DOUBLE, 0.85, 0.85])::DOUBLE AS confidence, unnest(['Ann', NULL, NULL]) AS name FROM customer)""")
def _(spark, sf):
    c = P.provider_contacts(_provider(spark, sf), ["c_custkey"])
    return c.select("c_custkey", "kind", "value", "confidence", F.col("meta")["name"].alias("name"))


@register("src9_provider_profiles", "SELECT 'firm' || c_custkey || '.com' AS domain, 'Firm ' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'GB' END AS country, 'Retail' AS industry FROM customer")
def _(spark, sf):
    return P.provider_profiles(_provider(spark, sf)).select("domain", "name", "country", "industry")


@register("jn6_provider_enrichment", f"""SELECT l.domain, CASE WHEN n_emails = 0 THEN coalesce(nullif(name, ''), 'Found ' || l.domain) ELSE name END AS name, n_emails = 0 AS enriched FROM
    (SELECT domain, name, CASE WHEN n_contacts % 2 = 0 THEN 0 ELSE n_emails END AS n_emails FROM {LEADS_SQL}) l""")
def _(spark, sf):
    leads = lead_table(spark, sf).select("domain", "name", F.expr("CASE WHEN n_contacts % 2 = 0 THEN 0L ELSE n_emails END").alias("n_emails"))
    contacts = capped(spark, sf).select("domain", "kind", "value", "confidence")
    profiles = leads.select("domain", text("Found ", F.col("domain")).alias("name"), F.lit("x").alias("industry"))
    found = leads.select("domain", F.lit("email").alias("kind"), text("mail@", F.col("domain")).alias("value"), F.lit(0.9).alias("confidence"))
    filled, both = E.attach_provider(leads, contacts, found, profiles)
    got = both.where("value = concat('mail@', domain)").select("domain").distinct().withColumn("enriched", F.lit(True))
    return filled.join(got, "domain", "left").select("domain", "name", F.coalesce("enriched", F.lit(False)).alias("enriched"))


# ------------------------------------------------------------------ mail servers, phones, companies
def _mx_answers(spark, sf):
    hosts = lead_table(spark, sf).select("domain", "n_contacts")
    n = F.col("n_contacts")
    empty, refused = F.lit('{"Status":0,"Answer":[]}'), F.lit("not json")
    full = text('{"Status":0,"Answer":[{"data":"10 ', F.when(n % 4 == 1, "aspmx.l.google.com.").when(n % 4 == 2, "mx.zoho.eu.").otherwise("mail.own.net."),
                '"},{"data":"  20 alt', n % 9, '.mx.net. "},{"data":""}]}')
    first = hosts.select("domain", F.lit(1).alias("endpoint_rank"), F.when(n % 5 == 0, refused).when(n % 3 == 0, empty).otherwise(full).alias("payload"))
    second = hosts.select("domain", F.lit(2).alias("endpoint_rank"), text('{"Status":0,"Answer":[{"data":"5 mx.outlook.com."}]}').alias("payload"))
    return first.unionByName(second)


_MX_SQL = f"""(SELECT *, CASE WHEN n_contacts % 5 = 0 THEN 'mx.outlook.com' WHEN n_contacts % 3 = 0 THEN '' ELSE
    CASE n_contacts % 4 WHEN 1 THEN 'aspmx.l.google.com' WHEN 2 THEN 'mx.zoho.eu' ELSE 'mail.own.net' END || ' alt' || (n_contacts % 9) || '.mx.net' END AS mx FROM {LEADS_SQL})"""


@register("src10_mx_hosts", f"SELECT domain, mx FROM {_MX_SQL}")
def _(spark, sf):
    return P.mx_hosts(_mx_answers(spark, sf)).select("domain", F.array_join("mx_records", " ").alias("mx"))


def _mailed(spark, sf):
    return E.with_deliverability(lead_table(spark, sf), P.mx_hosts(_mx_answers(spark, sf)))


_PLATFORM_SQL = "CASE WHEN mx LIKE '%google%' THEN 'Google Workspace' WHEN mx LIKE '%outlook%' THEN 'Microsoft 365' WHEN mx LIKE '%zoho%' THEN 'Zoho Mail' END"


@register("jn7_deliverability", f"SELECT domain, mx <> '' AS deliverable, mx AS mx_records FROM {_MX_SQL}")
def _(spark, sf):
    return _mailed(spark, sf).select("domain", "deliverable", F.array_join("mx_records", " ").alias("mx_records"))


@register("jn7_discounted_emails", f"""SELECT c.domain, value, CASE WHEN mx = '' AND kind = 'email' AND value LIKE '%@' || c.domain THEN round(greatest(0.05, confidence - 0.35), 2) ELSE confidence END::DOUBLE AS confidence,
    mx = '' AND kind = 'email' AND value LIKE '%@' || c.domain AS undeliverable FROM {CAPPED_SQL} c JOIN {_MX_SQL} l USING (domain)""")
def _(spark, sf):
    return E.discount_undeliverable(capped(spark, sf), _mailed(spark, sf)).select("domain", "value", "confidence", "undeliverable")


@register("jn14_mail_platform", f"SELECT domain, {_PLATFORM_SQL} AS mail_platform FROM {_MX_SQL}")
def _(spark, sf):
    return _mailed(spark, sf).select("domain", "mail_platform")


@register("agg12_mail_platforms", f"SELECT mail_platform, count(*) AS n FROM (SELECT {_PLATFORM_SQL} AS mail_platform FROM {_MX_SQL}) WHERE mail_platform IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6")
def _(spark, sf):
    return A.mail_platforms(_mailed(spark, sf))


def _phone_payloads(spark, sf):
    k = F.col("o_orderkey")
    numbers = table(spark, sf, "orders").groupBy(text("1555", 1000000 + k % 5000).alias("digits")).agg(F.min(k % 5000).alias("n"))
    n = F.col("n")
    payload = (F.when(n % 10 == 0, text('{"success":false,"error":{"info":"limit ', n % 3, '"}}'))
               .when(n % 3 == 0, text('{"valid":false,"country_name":""}'))
               .otherwise(text('{"valid":true,"country_name":"","country_code":"US","carrier":"Tel ', n % 7, '","line_type":"mobile","international_format":"+1 555 ', 1000000 + n, '"}')))
    return numbers.select("digits", "n", payload.alias("payload"))


@register("src11_phone_facts", """SELECT digits, n % 3 <> 0 AS valid, CASE WHEN n % 3 <> 0 THEN 'US' END AS country, CASE WHEN n % 3 <> 0 THEN 'Tel ' || (n % 7) END AS carrier FROM
    (SELECT DISTINCT '1555' || (1000000 + o_orderkey % 5000) AS digits, o_orderkey % 5000 AS n FROM orders) WHERE n % 10 <> 0""")
def _(spark, sf):
    return P.phone_facts(_phone_payloads(spark, sf), ["digits"]).select("digits", "valid", "country", "carrier")


@register("src11_phone_errors", "SELECT DISTINCT 'NumVerify: limit ' || ((o_orderkey % 5000) % 3) AS message FROM orders WHERE (o_orderkey % 5000) % 10 = 0")
def _(spark, sf):
    return P.phone_errors(_phone_payloads(spark, sf))


_VALIDATED_SQL = f"""(SELECT domain, rank::INT AS rank, CASE WHEN n % 10 <> 0 AND n % 3 <> 0 THEN '+1555' || (1000000 + n) ELSE value END AS value, n % 10 <> 0 AS checked, n % 10 <> 0 AND n % 3 <> 0 AS valid,
    CASE WHEN n % 10 = 0 THEN confidence WHEN n % 3 <> 0 THEN round(least(1.0, confidence + 0.15), 2) ELSE round(greatest(0.05, confidence - 0.30), 2) END::DOUBLE AS confidence FROM (SELECT *, substr(value, 6)::INT - 1000000 AS n,
    row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, value) AS rank FROM {CAPPED_SQL} WHERE kind = 'phone') WHERE rank <= 2)"""


@register("jn8_phone_validation", f"SELECT domain, rank, value, confidence, checked FROM {_VALIDATED_SQL}")
def _(spark, sf):
    facts = P.phone_facts(_phone_payloads(spark, sf), ["digits"])
    return E.validated_phones(capped(spark, sf), facts).select("domain", "rank", "value", "confidence", "checked")


def _company_payloads(spark, sf):
    k = F.col("c_custkey")
    about = F.when(k % 4 == 0, "family name").when(k % 4 == 1, text("Software company ", k)).when(k % 4 == 2, "a colour").otherwise("private UNIVERSITY in town")
    payload = F.when(k % 6 == 5, '{"search":[]}').otherwise(text('{"search":[{"id":"Q', k, '","label":"L', k, '","description":"', about, '"},{"id":"x","description":"bank"}]}'))
    return table(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey", payload.alias("payload"))


_COMPANY_SQL = """(SELECT c_custkey, c_name AS name, 'Q' || c_custkey AS wikidata_id, CASE WHEN c_custkey % 4 = 1 THEN 'Software company ' || c_custkey ELSE 'private UNIVERSITY in town' END AS industry_hint
    FROM customer WHERE c_custkey % 6 <> 5 AND c_custkey % 4 IN (1, 3))"""


@register("src12_company_profiles", f"SELECT name, wikidata_id, industry_hint FROM {_COMPANY_SQL}")
def _(spark, sf):
    return P.company_profiles(_company_payloads(spark, sf)).select("name", "wikidata_id", "industry_hint")


@register("jn9_company_join", f"SELECT c.c_custkey, p.wikidata_id FROM customer c LEFT JOIN {_COMPANY_SQL} p ON c.c_name = p.name")
def _(spark, sf):
    leads = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return E.with_company(leads, P.company_profiles(_company_payloads(spark, sf))).select("c_custkey", "wikidata_id")


@register("agg15_enrichment_counters", f"""SELECT (SELECT count(*) FROM {_MX_SQL}) AS mx_checked, (SELECT count(*) FROM {_MX_SQL} WHERE mx <> '') AS deliverable_domains, (SELECT count(*) FROM {_MX_SQL} WHERE mx = '') AS undeliverable_domains,
    (SELECT count(*) FROM {_VALIDATED_SQL} WHERE checked) AS phones_checked, (SELECT count(*) FROM {_VALIDATED_SQL} WHERE valid) AS phones_valid, (SELECT count(*) FROM {_COMPANY_SQL}) AS company_profiles""")
def _(spark, sf):
    facts = P.phone_facts(_phone_payloads(spark, sf), ["digits"])
    companies = E.with_company(table(spark, sf, "customer").select(F.col("c_name").alias("name")), P.company_profiles(_company_payloads(spark, sf)))
    return A.enrichment_counters(_mailed(spark, sf), E.validated_phones(capped(spark, sf), facts), companies)


@register("src18_api_errors", """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Invalid key ' || user_id WHEN 1 THEN 'quota ' || user_id WHEN 2 THEN 'detail ' || user_id WHEN 3 THEN 'plain' WHEN 4 THEN 'msg' WHEN 5 THEN 'REQUEST_DENIED' END AS error FROM events""")
def _(spark, sf):
    u = F.col("user_id")
    payload = (F.when(F.col("event_id") % 10 == 0, text('{"error":"Invalid key ', u, '"}')).when(F.col("event_id") % 10 == 1, text('{"error":{"code":1,"message":"quota ', u, '"}}'))
               .when(F.col("event_id") % 10 == 2, text('{"errors":[{"id":"x","details":"detail ', u, '"}]}')).when(F.col("event_id") % 10 == 3, '{"errors":["plain"]}')
               .when(F.col("event_id") % 10 == 4, '{"status":"REQUEST_DENIED","error_message":"msg"}').when(F.col("event_id") % 10 == 5, '{"status":"REQUEST_DENIED"}')
               .when(F.col("event_id") % 10 == 6, '{"status":"OK","error":""}').when(F.col("event_id") % 10 == 7, '["error"]').when(F.col("event_id") % 10 == 8, "broken").otherwise('{"status":"ZERO_RESULTS"}'))
    return table(spark, sf, "events").select("event_id", P.api_error(payload).alias("error"))


# ------------------------------------------------------------------ robots, sitemaps, archives
def _domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", text("site", key(), ".net").alias("domain"), "url")


@register("src13_listed_sitemaps", """SELECT 'site' || page_id || '.net' AS domain, sitemap, rank::INT AS rank FROM (SELECT page_id, unnest(['https://site' || page_id || '.net/a.xml', 'https://cdn.net/b.xml']) AS sitemap, unnest([1, 2]) AS rank FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 'https://site' || page_id || '.net/sitemap.xml', 1 FROM pages WHERE page_id % 3 <> 0)""")
def _(spark, sf):
    body = F.when(key() % 3 == 0, text("User-agent: *\nSitemap: https://", F.col("domain"), "/a.xml\nSITEMAP:https://cdn.net/b.xml\nsitemap: https://", F.col("domain"), "/a.xml\n")).otherwise("User-agent: *\nDisallow:")
    return S.listed_sitemaps(_domain(spark, sf).select("domain", (key() % 3 != 2).alias("ok"), body.alias("body")))


@register("src14_sitemap_pages", """SELECT 'site' || page_id || '.net' AS domain, n::INT AS n, page FROM (SELECT page_id, unnest([1, 2, 3]) AS n, unnest(['https://site' || page_id || '.net/deep?a=1&b=2', 'https://site' || page_id || '.net/contact', 'https://site' || page_id || '.net/blog']) AS page FROM pages WHERE page_id % 5 <> 4)""")
def _(spark, sf):
    d = F.col("domain")
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = _domain(spark, sf).select("page_id", "domain", F.explode(F.array(
        F.struct(text("https://", d, "/i.xml").alias("url"), text(f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> https://", d, "/j.xml </loc></sitemap><sitemap><loc>https://", d,
                 "/p.xml</loc></sitemap></sitemapindex>", F.when(key() % 5 == 4, "<broken").otherwise("")).alias("body")),
        F.struct(text("https://", d, "/j.xml").alias("url"), text(f"<sitemapindex {ns}><sitemap><loc>https://", d, "/q.xml</loc></sitemap></sitemapindex>").alias("body")),
        F.struct(text("https://", d, "/p.xml").alias("url"), text(f"<urlset {ns}><url><loc>https://", d, "/contact</loc><lastmod>x</lastmod></url><url><loc>https://", d, "/blog</loc></url></urlset>").alias("body")),
        F.struct(text("https://", d, "/q.xml").alias("url"), text(f"<urlset {ns}><url><loc>https://", d, "/deep?a=1&amp;b=2</loc></url></urlset>").alias("body")))).alias("x"))
    start = _domain(spark, sf).select("domain", text("https://", d, "/i.xml").alias("sitemap"), F.lit(1).alias("rank"))
    captured = docs.select("x.url", F.lit(200).alias("status"), "x.body")
    # a second, larger capture of each leaf, and one that failed: neither counts
    later = captured.where("url like '%/p.xml' or url like '%/q.xml'").withColumn("body", F.replace("body", F.lit("<urlset"), F.lit("<urlset x='1'")))
    failed = captured.withColumns({"status": F.lit(503), "body": F.lit("<a/>")})
    return S.sitemap_pages(start, captured.unionByName(later).unionByName(failed)).select("domain", "n", "page")


@register("src15_cdx", """SELECT 'site' || page_id || '.net' AS domain, url, rank::INT AS rank FROM (SELECT page_id, unnest(['http://site' || page_id || '.net/Contact', 'https://site' || page_id || '.net/about']) AS url, unnest([1, 2]) AS rank FROM pages)""")
def _(spark, sf):
    d = F.col("domain")
    payload = text('[["original"],["http://', d, '/Contact"],["https://', d, '/shop"],["ftp://', d, '/team"],[],["https://', d, '/about"]]')
    return S.cdx_contact_urls(_domain(spark, sf).select("domain", payload.alias("payload")))


_ROBOTS_BODY = ["# note\nUser-agent: *\nDisallow: /private # x\nAllow: /\n\nUser-agent: leadloom\nUser-agent: other\nAllow: /team\nDisallow: /t\nDisallow: /%7Ejoe/\n",
                "User-agent: googlebot\nDisallow: /\n", "Disallow: /orphan\nUser-agent: *\nDisallow:\n"]


@register("src16_robots_rules", """SELECT 'https://site' || page_id || '.net' AS origin, CASE page_id % 3 WHEN 0 THEN '*|false|/private;*|true|/;leadloom,other|true|/team;leadloom,other|false|/t;leadloom,other|false|/~joe/'
    WHEN 1 THEN 'googlebot|false|/' ELSE '*|true|' END AS rules FROM pages WHERE page_id % 7 <> 0""")
def _(spark, sf):
    body = F.when(key() % 3 == 0, _ROBOTS_BODY[0]).when(key() % 3 == 1, _ROBOTS_BODY[1]).otherwise(_ROBOTS_BODY[2])
    parsed = S.robots_rules(_domain(spark, sf).select(text("https://", F.col("domain")).alias("origin"), (key() % 7 != 0).alias("ok"), body.alias("body")))
    flat = F.transform("rules", lambda r: F.concat_ws("|", F.array_join(r["agents"], ","), r["allow"].cast("string"), r["path"]))
    return parsed.select("origin", F.array_join(flat, ";").alias("rules"))


@register("jn10_robots_gate", """SELECT page_id, path, CASE WHEN page_id % 7 = 0 OR page_id % 3 <> 0 THEN TRUE ELSE path = '/team/x' OR path = '/private/y' END AS allowed FROM (SELECT page_id, unnest(['/team/x', '/tools', '/private/y', '/~joe/z']) AS path FROM pages)""")
def _(spark, sf):
    body = F.when(key() % 3 == 0, _ROBOTS_BODY[0]).when(key() % 3 == 1, _ROBOTS_BODY[1]).otherwise(_ROBOTS_BODY[2])
    d = _domain(spark, sf)
    parsed = S.robots_rules(d.select(text("https://", F.col("domain")).alias("origin"), (key() % 7 != 0).alias("ok"), body.alias("body")))
    urls = d.select("page_id", F.explode(F.array(*map(F.lit, ["/team/x", "/tools", "/private/y", "/~joe/z"]))).alias("path"), "domain")
    urls = urls.withColumn("u", text("https://", F.col("domain"), F.col("path")))
    return S.with_robots_gate(urls, parsed, "u", "Leadloom/1.0").select("page_id", "path", "allowed")


#: Files where a delay or a rate ends the agent list and keeps a group alive, and one whose first group has no rule.
_ROBOTS_GROUPS = ["User-agent: leadloom\nCrawl-delay: 5\nUser-agent: other\nDisallow: /\n",
                  "User-agent: leadloom\nRequest-rate: 1/5\n\nUser-agent: *\nDisallow: /\n",
                  "User-agent: leadloom\n\nUser-agent: *\nDisallow: /x\n"]


@register("jn10_robots_groups", """SELECT page_id, agent, path, CASE WHEN page_id % 3 = 2 THEN path <> '/x/1' WHEN agent = 'leadloom' THEN TRUE ELSE page_id % 3 = 0 AND agent = 'third' END AS allowed
    FROM (SELECT page_id, unnest(['/x/1', '/y']) AS path FROM pages), (SELECT unnest(['leadloom', 'other', 'third']) AS agent)""")
def _(spark, sf):
    body = F.when(key() % 3 == 0, _ROBOTS_GROUPS[0]).when(key() % 3 == 1, _ROBOTS_GROUPS[1]).otherwise(_ROBOTS_GROUPS[2])
    d = _domain(spark, sf)
    parsed = S.robots_rules(d.select(text("https://", F.col("domain")).alias("origin"), F.lit(True).alias("ok"), body.alias("body")))
    urls = d.select("page_id", F.explode(F.array(F.lit("/x/1"), F.lit("/y"))).alias("path"), "domain")
    urls = urls.withColumn("u", text("https://", F.col("domain"), F.col("path")))
    out = [S.with_robots_gate(urls, parsed, "u", agent).select("page_id", F.lit(agent).alias("agent"), "path", "allowed")
           for agent in ("leadloom", "other", "third")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("set2_site_queue", """SELECT domain, url, source::INT AS source FROM (SELECT 'site' || page_id || '.net' AS domain, unnest(['https://site' || page_id || '.net/contact', 'https://site' || page_id || '.net/about', 'https://site' || page_id || '.net/']) AS url,
    unnest([0, 1, 2]) AS source FROM pages) WHERE NOT (source = 2 AND replace(replace(domain, 'site', ''), '.net', '')::INT % 4 = 0)""")
def _(spark, sf):
    d = _domain(spark, sf)

    def made(path: str, seq: int) -> DataFrame:
        return d.select("domain", text("https://", F.col("domain"), path).alias("url"), F.lit(seq).alias("seq"))

    seen = d.where("page_id % 4 = 0").select(text("https://", F.col("domain"), "/").alias("url"))
    queue = D.site_queue([made("/contact", 0).unionByName(made("/brochure.pdf", 1)), made("/about", 0).unionByName(made("/contact", 5))], made("/", 0), seen)
    return queue.select("domain", "url", "source")
