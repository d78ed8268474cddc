"""Page snapshots, URL lists and robots/sitemap documents."""

from __future__ import annotations

import uuid
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import rules
from ..functions.text import percent_decode, strip
from ..functions.urls import bare_domain, is_public_domain, is_sitemap_contact, origin_of, path_of, query_of
from ..operators.pages import is_ok_response
from ..session import cut


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots that carry text; fetch columns are honoured where present."""
    return ok_pages(spark.read.parquet(path))


def spread(table: DataFrame) -> DataFrame:
    """A plain scan dealt out to all cores where its files make fewer partitions than there are cores.

    Pages take far more work than their bytes suggest.  Large tables have
    partitions enough and are left as they are, so the shuffle is at most one
    small table's.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def ok_pages(pages: DataFrame) -> DataFrame:
    have = set(pages.columns)
    text = "text" if "text" in have else "html"
    if {"status", "error"} <= have:
        return pages.where(is_ok_response(F.col("status"), F.col(text), F.col("error")))
    return pages.where(F.coalesce(F.col(text), F.lit("")) != "")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of URLs, one per line; blank and ``#`` lines are dropped."""
    return url_lines(spark.read.text(path).select(F.col("value").alias("line")))


def url_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    kept = strip(F.col(line))
    return lines.where((kept != "") & ~F.col(line).startswith("#")).select(
        *[c for c in lines.columns if c != line], kept.alias("url"))


def split_targets(df: DataFrame, text: str, out: str = "target", commas: bool = True) -> DataFrame:
    """Entries of a text column separated by new lines and, for URLs, commas."""
    keep = [c for c in df.columns if c != text]
    pieces = F.split(text, r"[,\n\r]" if commas else r"[\n\r]")
    return (df.select(*keep, F.posexplode(pieces).alias("seq", "__t"))
            .select(*keep, "seq", strip(F.col("__t")).alias(out)).where(F.col(out) != ""))


SITEMAP_SPACE = "http://www.sitemaps.org/schemas/"


def listed_sitemaps(robots: DataFrame, limit: int = rules.MAX_SITEMAPS) -> DataFrame:
    """Sitemaps per domain from robots.txt (domain, ok, body), else the usual place."""
    lines = robots.where("ok").select("domain", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("seq", "line"))
    named = (lines.where(F.lower("line").startswith("sitemap:"))
             .select("domain", "seq", strip(F.regexp_replace("line", "^[^:]*:", "")).alias("sitemap"))
             .groupBy("domain", "sitemap").agg(F.min("seq").alias("seq")))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy("seq")))
    listed = ranked.where(F.col("rank") <= limit).select("domain", "sitemap", "rank")
    usual = (robots.select("domain").distinct().join(listed, "domain", "left_anti")
             .select("domain", F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("sitemap"),
                     F.lit(1).alias("rank")))
    return listed.unionByName(usual)


#: As objects, so that the module can be imported before a session exists.
_ENTRIES = T.ArrayType(T.StructType([T.StructField("is_index", T.BooleanType()), T.StructField("loc", T.StringType())]))


@F.pandas_udf(_ENTRIES)
def _sitemap_entries(bodies: pd.Series) -> pd.Series:
    """``loc`` texts of a sitemap or sitemap index; null for malformed XML."""
    def entries(body):
        try:
            root = ElementTree.fromstring(body)
        except (ElementTree.ParseError, ValueError):
            return None
        spaces = [SITEMAP_SPACE + kind for kind in ("sitemap/0.9", "sitemap-index/0.9")]
        return [{"is_index": tag == "sitemap", "loc": (loc.text or "").strip()}
                for tag in ("sitemap", "url") for ns in spaces
                for loc in root.iterfind(f"{{{ns}}}{tag}/{{{ns}}}loc")]
    return bodies.map(entries, na_action="ignore")


def sitemap_edges(documents: DataFrame) -> DataFrame:
    """What each sitemap document lists, parsed once: url, i (place), is_index, loc.

    ``documents``: url, status, body.  Of several captures of a url the one
    with the smallest text counts; only the bodies of such urls are shuffled.
    Malformed, empty and oversized documents list nothing.
    """
    xml = documents.where(F.col("url").isNotNull() & F.col("status").between(200, 299)
                          & F.length("body").between(1, rules.MAX_SITEMAP_CHARS)).select("url", "body")
    again = xml.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url")
    once = xml.join(again, "url", "left_anti").unionByName(
        xml.join(again, "url", "left_semi").groupBy("url").agg(F.min("body").alias("body")))
    return (once.select("url", _sitemap_entries("body").alias("entries"))
            .select("url", F.posexplode("entries").alias("i", "e")).where("e.loc <> ''")
            .select("url", "i", "e.is_index", "e.loc"))


def sitemap_pages(start: DataFrame, documents: DataFrame, max_depth: int = rules.MAX_SITEMAP_DEPTH,
                  max_urls: int = rules.MAX_SITEMAP_URLS) -> DataFrame:
    """Page URLs reachable from each start sitemap through sitemap indexes.

    ``start``: domain, sitemap, rank.  Indexes are followed up to ``max_depth``
    deep by a recursive query over the edges; no document's body takes part in
    it.  Of one start's pages the first ``max_urls`` in document order are
    kept, entries of a child sitemap before the pages behind it.
    """
    spark = start.sparkSession
    edges, roots = f"sitemap_edges_{uuid.uuid4().hex}", f"sitemap_roots_{uuid.uuid4().hex}"
    cut(sitemap_edges(documents)).createOrReplaceTempView(edges)
    start.select("domain", "sitemap", "rank").createOrReplaceTempView(roots)
    found = spark.sql(f"""
        WITH RECURSIVE reached(domain, root, rank, url, depth, path) AS (
            SELECT domain, sitemap, rank, sitemap, 0, CAST(array() AS ARRAY<INT>) FROM {roots}
            UNION ALL
            SELECT r.domain, r.root, r.rank, e.loc, r.depth + 1, concat(r.path, array(e.i))
            FROM reached r JOIN {edges} e ON e.url = r.url WHERE e.is_index AND r.depth < {int(max_depth)})
        SELECT r.domain, r.root, r.rank, concat(r.path, array(e.i)) AS path, e.loc AS page
        FROM reached r JOIN {edges} e ON e.url = r.url WHERE NOT e.is_index""")
    n = F.row_number().over(W.partitionBy("domain", "root").orderBy("path"))
    return (found.withColumn("n", n).where(F.col("n") <= max_urls)
            .select("domain", "root", "rank", "n", "page"))


def contact_pages(domains: DataFrame, pages: DataFrame) -> DataFrame:
    """Contact-like sitemap pages of each public domain plus the guessed paths, first occurrence first.

    ``pages``: domain, rank, n, page.
    """
    public = domains.select(bare_domain(F.col("domain")).alias("domain")).where(
        is_public_domain(F.col("domain"))).distinct()
    listed = pages.where(is_sitemap_contact(F.col("page"))).select(
        "domain", F.col("page").alias("url"), F.struct(F.lit(0).alias("g"), "rank", "n").alias("o"))
    guesses = public.select("domain", F.posexplode(F.array(*map(F.lit, rules.SITEMAP_GUESS_PATHS))).alias("n", "p"))
    guesses = guesses.select(
        "domain", F.concat(F.lit("https://"), "domain", F.lit("/"), "p").alias("url"),
        F.struct(F.lit(1).alias("g"), F.lit(0).cast(dict(pages.dtypes)["rank"]).alias("rank"),
                 F.col("n").cast(dict(pages.dtypes)["n"]).alias("n")).alias("o"))
    return (listed.join(public, "domain", "left_semi").unionByName(guesses)
            .groupBy("domain", "url").agg(F.min("o").alias("o"))
            .select("domain", "url", F.col("o.g").alias("guessed"), F.col("o.rank").alias("rank"), F.col("o.n").alias("n")))


def cdx_contact_urls(payloads: DataFrame, limit: int = rules.CDX_LIMIT) -> DataFrame:
    """Contact-like archived URLs per domain from a CDX listing (domain, payload)."""
    rows = payloads.select("domain", F.posexplode(F.from_json("payload", "array<array<string>>")).alias("seq", "row"))
    urls = rows.where("seq > 0").select("domain", "seq", strip(F.coalesce(F.get("row", F.lit(0)), F.lit(""))).alias("url"))
    kept = urls.where(F.col("url").startswith("http") & is_sitemap_contact(F.col("url")))
    return (kept.withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy("seq")))
            .where(F.col("rank") <= limit).select("domain", "url", "rank"))


def robots_rules(robots: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Parsed rules, one row per origin (origin, ok, body).

    Each entry: agents of its group, allow flag, path, group number, in file
    order.  A crawl-delay or request-rate line ends the list of agents and
    keeps its group alive like a rule does, so it gives an entry without a
    path, which matches no URL.  Origins whose file is missing or has more than
    ``max_chars`` characters are absent, which lets everything pass; of several
    files of an origin the smallest text counts.
    """
    usable = robots.where("ok")
    if max_chars is not None:
        usable = usable.where(F.length("body") <= max_chars)
    usable = usable.groupBy("origin").agg(F.min("body").alias("body")).where("body is not null")
    lines = F.transform(F.split("body", r"\r\n|\n|\r"), lambda l: F.struct(
        l.alias("raw"), strip(F.regexp_replace(l, "#.*$", "")).alias("text")))
    field = F.transform(lines, lambda l: F.struct(
        F.when(l["raw"] == "", "blank").otherwise(F.lower(strip(F.substring_index(l["text"], ":", 1)))).alias("k"),
        percent_decode(strip(F.regexp_replace(l["text"], "^[^:]*:", ""))).alias("v"),
        l["text"].contains(":").alias("pair")))
    known = F.filter(field, lambda x: (x["k"] == "blank") | (
        x["pair"] & x["k"].isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate")))
    zero = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(0).alias("state"), F.lit(0).alias("grp"),
        F.array().cast("array<struct<agents:array<string>,allow:boolean,path:string,grp:int>>").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        # state 0: outside a group, 1: reading agents, 2: reading rules
        opening = x["k"] == "user-agent"
        fresh = opening & (acc["state"] != 1)
        agents = (F.when(fresh, F.array(F.lower(x["v"])))
                  .when(opening, F.concat(acc["agents"], F.array(F.lower(x["v"]))))
                  .when((x["k"] == "blank") & (acc["state"] == 2), F.array().cast("array<string>"))
                  .otherwise(acc["agents"]))
        ruling = x["k"].isin("allow", "disallow")
        inside = ~opening & (x["k"] != "blank") & (acc["state"] != 0)
        state = (F.when(opening, 1).when(x["k"] == "blank", 0).when(inside, 2)
                 .otherwise(acc["state"]))
        added = F.struct(acc["agents"].alias("agents"),
                         (~ruling | (x["k"] == "allow") | (x["v"] == "")).alias("allow"),
                         F.when(ruling, x["v"]).alias("path"), acc["grp"].alias("grp"))
        return F.struct(agents.alias("agents"), state.alias("state"),
                        F.when(fresh, acc["grp"] + 1).otherwise(acc["grp"]).alias("grp"),
                        F.when(inside, F.concat(acc["rules"], F.array(added))).otherwise(acc["rules"]).alias("rules"))

    folded = F.aggregate(known, zero, step)
    return usable.select("origin", folded["rules"].alias("rules"))


def with_robots_gate(urls: DataFrame, parsed: DataFrame, url: str, agent: str = "leadloom",
                     out: str = "allowed") -> DataFrame:
    """Add whether robots rules let ``agent`` fetch a URL; true where no rules are known.

    Rules are reduced to the agent's group before the join, and one row of them
    per origin is joined to each URL, so no URL/rule pairs arise.
    """
    token = agent.split("/")[0].lower()
    keep = list(urls.columns)
    df = urls.withColumns({"origin": origin_of(F.col(url)), "__path": F.concat(
        F.when(path_of(F.col(url)) == "", F.lit("/")).otherwise(path_of(F.col(url))),
        F.when(query_of(F.col(url)) != "", F.concat(F.lit("?"), query_of(F.col(url)))).otherwise(F.lit("")))}).withColumn("__path", percent_decode(F.col("__path")))
    r, path = F.col("rules"), F.col("__path")
    named = F.filter(r, lambda x: ~F.array_contains(x["agents"], "*")
                     & F.exists(x["agents"], lambda a: F.contains(F.lit(token), a)))
    group = F.get(named, F.lit(0))["grp"]
    star = F.filter(r, lambda x: F.array_contains(x["agents"], "*"))
    first_star = F.get(star, F.lit(0))["grp"]
    chosen = F.when(F.size(named) > 0, F.filter(named, lambda x: x["grp"] == group)).otherwise(
        F.filter(star, lambda x: x["grp"] == first_star))
    df = df.join(parsed.select("origin", chosen.alias("__rules")), "origin", "left")
    match = F.get(F.filter("__rules", lambda x: (x["path"] == "*") | (x["path"] == "")
                           | F.startswith(path, x["path"])), F.lit(0))
    return df.select(*keep, F.coalesce(match["allow"], F.lit(True)).alias(out))
