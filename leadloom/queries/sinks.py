"""Sinks: lead results written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks as S
from ..keyed import KeyedTable
from ..operators import leads as L
from .base import CAPPED_SQL, LEADS_SQL, capped, lead_table, register, scratch

def _first(kind: str) -> str:
    return f"coalesce(array_to_string((list(value ORDER BY confidence DESC, value) FILTER (kind = '{kind}'))[:25], '; '), '')"


def _all_of(kind: str) -> str:
    return f"coalesce(string_agg(value, '; ' ORDER BY confidence DESC, value) FILTER (kind = '{kind}'), '')"


#: The first 25 contacts of a kind.
_FLAT_SQL = f"""(SELECT l.domain, coalesce(l.name, '') AS name, l.score, {_first('email')} AS emails, {_first('phone')} AS phones,
    coalesce(l.address, '') AS address, {_first('github')} AS github, l.source, l.pages_crawled
    FROM {LEADS_SQL} l JOIN {CAPPED_SQL} c USING (domain) GROUP BY ALL)"""

#: A flat row lists every contact of a kind.
_WHOLE_SQL = f"""(SELECT l.domain, coalesce(l.name, '') AS name, l.score, {_all_of('email')} AS emails, {_all_of('phone')} AS phones,
    coalesce(l.address, '') AS address, {_all_of('github')} AS github, l.source, l.pages_crawled
    FROM {LEADS_SQL} l JOIN {CAPPED_SQL} c USING (domain) GROUP BY ALL)"""


def _leads(spark, sf):
    return lead_table(spark, sf).withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/")))


def _flat(spark, sf):
    return L.export_rows(_leads(spark, sf), L.lead_documents(capped(spark, sf)))


def _documents(spark, sf):
    return _leads(spark, sf).join(L.lead_documents(capped(spark, sf)), "domain")


@register("snk1_flat_rows", f"SELECT *, 'https://' || domain || '/' AS website FROM {_WHOLE_SQL}")
def _(spark, sf):
    return _flat(spark, sf).select("domain", "name", "score", "emails", "phones", "address", "github", "source", "pages_crawled", "website")


@register("snk2_csv", f"SELECT domain, name, score, emails, CASE WHEN phones LIKE '+%' THEN '''' || phones ELSE phones END AS phones FROM {_WHOLE_SQL}")
def _(spark, sf):
    path = scratch(spark, "csv")
    S.write_csv(_flat(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("domain", F.coalesce("name", F.lit("")).alias("name"), F.col("score").cast("double").alias("score"),
                       F.coalesce("emails", F.lit("")).alias("emails"), F.coalesce("phones", F.lit("")).alias("phones"))


@register("snk3_json", f"SELECT domain, score, (SELECT count(*) FROM {LEADS_SQL}) AS declared, 1 AS depth, (SELECT max(score) FROM {LEADS_SQL}) AS best FROM {LEADS_SQL}")
def _(spark, sf):
    path = scratch(spark, "json")
    leads = _leads(spark, sf)
    S.write_json(_documents(spark, sf), path, {"depth": 1, "kinds": ["email"]}, leads.agg(F.max("score").alias("best")))
    manifest = spark.read.schema("count bigint, settings struct<depth:int,kinds:array<string>>, stats struct<best:double>") \
        .json(f"{path}/manifest").head()
    back = spark.read.schema("domain string, score double").json(f"{path}/leads")
    return back.select("domain", "score", F.lit(manifest["count"]).alias("declared"), F.lit(manifest.settings.depth).alias("depth"),
                       F.lit(manifest.stats.best).alias("best"))


@register("snk4_jsonl", f"SELECT domain, emails FROM {_FLAT_SQL}")
def _(spark, sf):
    path = scratch(spark, "jsonl")
    S.write_jsonl(_documents(spark, sf), path)
    back = spark.read.schema("domain string, emails array<string>").json(path)
    return back.select("domain", F.array_join("emails", "; ").alias("emails"))


@register("snk5_report_rows", f"""SELECT rank, '| ' || rank || ' | [' || domain || '](https://' || domain || '/) | ' || left(name, 40) || ' | ' || score || ' | ' ||
    coalesce(nullif(array_to_string(e[:4], '<br>'), ''), '—') || ' | ' || coalesce(nullif(array_to_string(p[:2], '<br>'), ''), '—') || ' |' AS line FROM
    (SELECT *, row_number() OVER (ORDER BY score DESC, domain) AS rank FROM (SELECT domain, name, score, string_split(emails, '; ') AS e, string_split(phones, '; ') AS p FROM {_FLAT_SQL}))""")
def _(spark, sf):
    path = scratch(spark, "md")
    S.write_markdown(_documents(spark, sf), path)
    lines = spark.read.text(f"{path}/rows").select(F.col("value").alias("line"))
    return lines.select(F.regexp_extract("line", r"^\| (\d+) ", 1).cast("bigint").alias("rank"), "line")


@register("snk6_tables", f"SELECT l.domain, l.score, c.kind, c.value, '{{}}' AS meta FROM {LEADS_SQL} l JOIN {CAPPED_SQL} c USING (domain)")
def _(spark, sf):
    path = scratch(spark, "tables")
    contacts = capped(spark, sf).withColumn("meta", F.lit(None).cast("map<string,string>"))
    S.write_tables(_leads(spark, sf), contacts, path, buckets=8)
    leads, back = (KeyedTable.open(spark, f"{path}/{t}").rows() for t in ("leads", "contacts"))
    return leads.select("domain", "score").join(back.select("domain", "kind", "value", "meta"), "domain")


@register("snk6_upsert", f"SELECT domain, CASE WHEN n_contacts % 2 = 0 THEN 0.0 ELSE score END::DOUBLE AS score FROM {LEADS_SQL}")
def _(spark, sf):
    path = scratch(spark, "upsert")
    S.upsert_or_create(S.normalised_leads(_leads(spark, sf)), path, ["domain"], buckets=8)
    again = _leads(spark, sf).where("n_contacts % 2 = 0").withColumn("score", F.lit(0.0))
    return S.upsert_or_create(S.normalised_leads(again), path, ["domain"]).rows().select("domain", "score")


@register("snk7_fan_out", f"""SELECT format, status, CASE WHEN status = 'written' THEN (SELECT count(*) FROM {LEADS_SQL}) ELSE 0 END AS n_rows
    FROM (SELECT unnest(['csv', 'jsonl', 'docx']) AS format, unnest(['written', 'written', 'unknown']) AS status)""")
def _(spark, sf):
    path = scratch(spark, "all")
    rows, flat = _documents(spark, sf).persist(), _flat(spark, sf)
    results = S.write_all(rows, flat, _leads(spark, sf), capped(spark, sf), path, ["csv", "jsonl", "docx"])
    rows.unpersist()
    made = spark.createDataFrame(results, "format string, status string")
    counts = (spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv").select(F.lit("csv").alias("format"))
              .unionByName(spark.read.schema("domain string").json(f"{path}/jsonl").select(F.lit("jsonl").alias("format"))))
    n = counts.groupBy("format").agg(F.count(F.lit(1)).alias("n_rows"))
    return made.join(n, "format", "left").select("format", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
