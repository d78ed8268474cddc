"""URL columns, predicates, safety, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import urls as U
from ..plans import discovery as D
from .base import register, sql_domain, sql_host, sql_list, sql_normal, table

H = sql_host("url")
DOM = sql_domain(f"({H})")
NORMAL = sql_normal("url")


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


@register("url1_host", f"SELECT page_id, {H} AS host FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", U.host_of(F.col("url")).alias("host"))


_HOSTS = ("CASE page_id % 6 WHEN 0 THEN concat('www.shop', page_id, '.co.uk') WHEN 1 THEN concat('a.b', page_id, '.com') "
          "WHEN 2 THEN concat('x', page_id, '.com.pk') WHEN 3 THEN concat('10.0.', page_id % 250, '.9') "
          "WHEN 4 THEN concat('host', page_id) ELSE concat('mail.dept', page_id % 90, '.ac.info') END")


@register("url2_registrable_domain",
          f"SELECT page_id, {DOM} AS url_domain, {sql_domain('h')} AS host_domain FROM (SELECT *, {_HOSTS} AS h FROM pages)")
def _(spark, sf):
    return _pages(spark, sf).withColumn("h", F.expr(_HOSTS)).select(
        "page_id", U.registrable_domain(F.col("url")).alias("url_domain"),
        U.registrable_domain(F.col("h")).alias("host_domain"))


_MESSY = ("CASE page_id % 5 WHEN 0 THEN concat('  ', url) WHEN 1 THEN replace(url, 'example', 'EXAMPLE') "
          "WHEN 2 THEN concat(split_part(url, '#', 1), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_source=a&k=1&&source=b') "
          "WHEN 3 THEN concat('mailto:', url) ELSE concat(split_part(split_part(url, '?', 1), '#', 1), '//x/?b=2#z') END")


@register("url3_normalise", f"SELECT page_id, CASE WHEN page_id % 5 = 3 THEN NULL ELSE {sql_normal('trim(m)')} END AS normal "
          f"FROM (SELECT page_id, {_MESSY} AS m FROM pages)")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("m", F.expr(_MESSY))
    return U.with_normalised_url(df, "m", "normal").select("page_id", "normal")


@register("url4_same_site", f"SELECT page_id, {DOM} = {sql_domain(sql_host('other'))} AS same FROM (SELECT *, "
          "CASE WHEN page_id % 2 = 0 THEN 'https://shop.example.com/x' ELSE 'https://example.org' END AS other FROM pages)")
def _(spark, sf):
    other = F.when(F.col("page_id") % 2 == 0, "https://shop.example.com/x").otherwise("https://example.org")
    return _pages(spark, sf).select("page_id", U.same_site(F.col("url"), other).alias("same"))


_TARGET = ("CASE page_id % 7 WHEN 0 THEN concat('https://www.facebook.com/p', page_id) WHEN 1 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '/File.PDF') "
           "WHEN 2 THEN concat('http://x.medium.com/', page_id) WHEN 3 THEN 'not a url//' ELSE url END")


@register("url5_scrapeable", f"""SELECT page_id, d <> '' AND d NOT IN {sql_list(rules.SKIP_DOMAINS)} AND NOT regexp_matches(
    lower(regexp_extract(t, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '({'|'.join(x.replace('.', '[.]') for x in rules.SKIP_EXTENSIONS)})$') AS ok
    FROM (SELECT page_id, t, {sql_domain(sql_host('t'))} AS d FROM (SELECT page_id, {_TARGET} AS t FROM pages))""")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("t", F.expr(_TARGET))
    return df.select("page_id", U.is_scrapeable(F.col("t")).alias("ok"))


_HINTED = "CASE page_id % 3 WHEN 0 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '/Contact') WHEN 1 THEN concat('https://privacy.', page_id, '.net') ELSE url END"


@register("url6_contact_url", f"""SELECT page_id, len(list_filter({list(rules.CONTACT_HINTS[:20])}, lambda h: contains(lower(u), h))) > 0 AS hinted
    FROM (SELECT page_id, {_HINTED} AS u FROM pages)""")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("u", F.expr(_HINTED))
    return df.select("page_id", U.is_contact_url(F.col("u")).alias("hinted"))


_RISKY = ("CASE page_id % 14 WHEN 0 THEN concat('http://10.', page_id % 256, '.0.1/') WHEN 1 THEN concat('http://h', page_id, ':22/') "
          "WHEN 2 THEN 'http://localhost/x' WHEN 3 THEN concat('ftp://f', page_id, '.com') WHEN 4 THEN 'http://169.254.169.254/meta' "
          "WHEN 5 THEN concat('http://box', page_id, '.local/') WHEN 6 THEN 'http:///nohost' WHEN 7 THEN concat('http://172.', 10 + page_id % 30, '.1.1/') "
          "WHEN 8 THEN concat('http://100.', page_id % 256, '.1.1/') WHEN 9 THEN concat('http://p', page_id, ':99999/') "
          "WHEN 10 THEN 'http://[::ffff:192.168.0.1]/' WHEN 11 THEN concat('http://[2606:4700::', page_id % 9000, ']/') "
          "WHEN 12 THEN concat('http://', 1 + page_id % 200, '.8.8.8:8080/') ELSE url END")
_REASON_SQL = """CASE page_id % 14 WHEN 0 THEN 'private address' WHEN 1 THEN 'blocked port' WHEN 2 THEN 'local name' WHEN 3 THEN 'scheme'
    WHEN 4 THEN 'metadata host' WHEN 5 THEN 'local name' WHEN 6 THEN 'no host'
    WHEN 7 THEN CASE WHEN page_id % 30 BETWEEN 6 AND 21 THEN 'private address' END
    WHEN 8 THEN CASE WHEN page_id % 256 BETWEEN 64 AND 127 THEN 'private address' END
    WHEN 9 THEN 'invalid port' WHEN 10 THEN 'private address' WHEN 11 THEN NULL
    WHEN 12 THEN CASE WHEN 1 + page_id % 200 IN (10, 127) THEN 'private address' END ELSE NULL END"""


@register("url7_block_reason", f"SELECT page_id, {_REASON_SQL} AS block_reason FROM pages")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("u", F.expr(_RISKY))
    return U.with_block_reason(df, "u").select("page_id", "block_reason")


@register("url8_dns_rebinding", f"SELECT page_id, page_id % 50 < 40 AND page_id % 3 = 0 AS rebinds FROM pages")
def _(spark, sf):
    from ..operators.enrich import rebinding_hosts
    urls = _pages(spark, sf).select("page_id", F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("host"))
    dns = urls.where("page_id % 50 < 40").select("host", F.explode(F.array(
        F.concat(F.lit("93.184."), (F.col("page_id") % 200).cast("string"), F.lit(".7")),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("192.168.1."), (F.col("page_id") % 250).cast("string")))
        .otherwise(F.lit("2606:2800:220:1::1")))).alias("address"))
    return rebinding_hosts(urls, dns).select("page_id", "rebinds")


@register("url9_safe_filter", f"""SELECT count(*) AS blocked, first(u ORDER BY page_id) AS first_blocked FROM
    (SELECT page_id, {_RISKY} AS u, {_REASON_SQL} AS r FROM pages) WHERE r IS NOT NULL""")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("u", F.expr(_RISKY))
    return D.blocked_summary(df, "u", "page_id")


@register("url9_safe_urls", f"SELECT page_id, u FROM (SELECT page_id, {_RISKY} AS u, {_REASON_SQL} AS r FROM pages) WHERE r IS NULL")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("u", F.expr(_RISKY))
    return D.safe_urls(df, "u").select("page_id", "u")


@register("url10_public_domain", f"""SELECT page_id, h AS bare, CASE page_id % 6 WHEN 3 THEN FALSE WHEN 4 THEN FALSE ELSE TRUE END AS public
    FROM (SELECT page_id, {_HOSTS} AS h FROM pages)""")
def _(spark, sf):
    df = _pages(spark, sf).withColumn("h", F.expr(_HOSTS))
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://"), "h", F.lit("/x?y"))).otherwise(F.col("h"))
    return df.select("page_id", U.bare_domain(text).alias("bare"), U.is_public_domain(text).alias("public"))


@register("url11_sitemap_contacts", f"""WITH p AS (SELECT DISTINCT {H} AS domain FROM pages),
    listed AS (SELECT DISTINCT {H} AS domain, 'https://' || {H} || '/team/' || (page_id % 9) AS url FROM pages WHERE page_id % 2 = 0)
    SELECT domain, url, max(guessed)::INT AS guessed FROM (SELECT domain, url, 0 AS guessed FROM listed UNION ALL
    SELECT domain, 'https://' || domain || '/' || g, 1 FROM p, (SELECT unnest(['contact', 'contact-us', 'about', 'about-us']) AS g))
    GROUP BY domain, url""")
def _(spark, sf):
    from ..sources.tables import contact_pages
    p = _pages(spark, sf).withColumn("domain", U.host_of(F.col("url")))
    k = F.col("page_id")
    listed = p.select("domain", F.lit(1).alias("rank"), k.cast("int").alias("n"), F.concat(
        F.lit("https://"), "domain", F.when(k % 2 == 0, F.lit("/team/")).otherwise(F.lit("/blog/")),
        (k % 9).cast("string")).alias("page"))
    return contact_pages(p.select("domain"), listed).select("domain", "url", "guessed")


@register("url12_duckduckgo_unwrap", f"SELECT page_id, {NORMAL} AS target FROM pages")
def _(spark, sf):
    href = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1"))
    df = _pages(spark, sf).withColumn("href", F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(href))
    return U.with_unwrapped_redirect(df, "href", "target", "duckduckgo").select("page_id", "target")


@register("url13_bing_decode", f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE {NORMAL} END AS target FROM pages")
def _(spark, sf):
    token = F.regexp_replace(F.base64(F.col("url").cast("binary")), "=+$", "")
    href = F.when(F.col("page_id") % 4 == 0, F.lit("https://www.bing.com/images?q=1")).when(
        F.col("page_id") % 4 == 1, F.col("url")).otherwise(
        F.concat(F.lit("https://www.bing.com/ck/a?!&amp;p=1&amp;u=a1"), token, F.lit("&amp;ntb=1")))
    df = _pages(spark, sf).withColumn("href", href)
    return U.with_unwrapped_redirect(df, "href", "target", "bing").select("page_id", "target")


@register("url14_cache_key", "SELECT page_id, md5(url) AS url_key FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", U.cache_key(F.col("url")).alias("url_key"))


@register("url15_clean_text", r"""SELECT doc_id, nullif(left(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')), 300), '') AS cleaned
    FROM documents WHERE text NOT LIKE '%&%' AND regexp_matches(text, '^[\x00-\x7FÀ-ÿ]*$') AND NOT regexp_matches(text, '[¨ª¯²³´µ¸¹º¼½¾\x{A0}]')""")
def _(spark, sf):
    from ..functions.text import clean_text
    plain = ~F.col("text").contains("&") & F.col("text").rlike("^[\\x00-\\x7FÀ-ÿ]*$") & ~F.col("text").rlike("[¨ª¯²³´µ¸¹º¼½¾\\u00A0]")
    return table(spark, sf, "documents").where(plain).select("doc_id", clean_text(F.col("text"), 300).alias("cleaned"))


@register("url15_clean_text_all")
def _(spark, sf):
    """Every document cleaned; entity decoding and NFKC have no counterpart in the other engine."""
    from ..functions.text import clean_text
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@register("set1_seed_union", f"""WITH s AS (SELECT {NORMAL} AS url, page_id % 3 AS source, page_id AS seq, {DOM} AS d FROM pages)
    SELECT url, min(source)::INT AS source, first(seq ORDER BY source, seq) AS seq FROM s GROUP BY url""")
def _(spark, sf):
    p = U.with_normalised_url(_pages(spark, sf), "url", "n").select(F.col("n").alias("url"), F.col("page_id").alias("seq"))
    return D.seed_union([p.where(f"seq % 3 = {i}") for i in range(3)])


@register("set3_fallback", """SELECT page_id % 40 AS query, page_id AS hit, (page_id % 2)::INT AS choice FROM pages
    WHERE page_id % 2 = 1 OR page_id % 40 < 20""")
def _(spark, sf):
    p = _pages(spark, sf).selectExpr("page_id % 40 AS query", "page_id AS hit")
    return D.first_available([p.where("query < 20 AND hit % 2 = 0"), p.where("hit % 2 = 1")], "query")


@register("agg17_seed_groups", f"""SELECT url, domain, page_id FROM (SELECT {NORMAL} AS url, {H} AS domain, min(page_id) AS page_id
    FROM pages GROUP BY 1, 2) WHERE NOT regexp_matches(url, '[.]js$')""")
def _(spark, sf):
    p = U.with_normalised_url(_pages(spark, sf), "url", "n").select(F.col("n").alias("url"), "page_id")
    s = D.seeds_by_domain(p, ["page_id"])
    return s.select("url", U.host_of(F.col("url")).alias("domain"), "page_id")


@register("win3_first_seeds", f"""SELECT url, domain, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rank
    FROM (SELECT {NORMAL} AS url, {DOM} AS domain, min(page_id) AS page_id FROM pages GROUP BY 1, 2)) WHERE rank <= 3""")
def _(spark, sf):
    p = U.with_normalised_url(_pages(spark, sf), "url", "n").select(F.col("n").alias("url"), "page_id")
    return D.first_seeds(D.seeds_by_domain(p, ["page_id"]), ["page_id"]).select("url", "domain", "rank")


@register("jn2_resume", f"SELECT page_id, {H} AS domain FROM pages WHERE {H} NOT IN (SELECT {H} FROM pages WHERE page_id % 7 = 0)")
def _(spark, sf):
    p = _pages(spark, sf).withColumn("domain", U.host_of(F.col("url")))
    return D.unfinished(p, p.where("page_id % 7 = 0")).select("page_id", "domain")


@register("src3_split_targets", """SELECT page_id, seq::INT AS seq, target FROM (SELECT page_id, unnest([0, 1, 3]) AS seq,
    unnest([url, concat('b', page_id, '.com'), concat('c', page_id, '.com')]) AS target FROM pages)""")
def _(spark, sf):
    from ..sources.tables import split_targets
    text = F.concat("url", F.lit(" ,b"), F.col("page_id").cast("string"), F.lit(".com\n \n c"),
                    F.col("page_id").cast("string"), F.lit(".com,"))
    return split_targets(_pages(spark, sf).select("page_id", text.alias("t")), "t")
