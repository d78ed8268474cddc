"""Enrichment joins.

Dimension tables are reduced to one row per key before each join; join
strategies are left to the optimiser, which broadcasts a side only below its
size threshold and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from .leads import first_phones


def mail_platform(hosts: Column) -> Column:
    """Platform behind a list of MX hosts: the first rule that matches any of them."""
    joined = F.lower(F.array_join(hosts, " "))
    out = None
    for pattern, label in rules.MX_PLATFORMS:
        out = (F if out is None else out).when(joined.rlike(pattern), label)
    return out


def with_deliverability(leads: DataFrame, mx: DataFrame, org: str = "domain") -> DataFrame:
    """Add mx_records (first four), deliverable and mail_platform from (domain, mx_records)."""
    m = mx.select(F.col("domain").alias(org), F.col("mx_records").alias("__mx"))
    hosts = F.coalesce("__mx", F.array().cast("array<string>"))
    return (leads.join(m, org, "left")
            .withColumns({"mx_records": F.slice(hosts, 1, 4), "deliverable": F.size(hosts) > 0,
                          "mail_platform": mail_platform(hosts)}).drop("__mx"))


def discount_undeliverable(contacts: DataFrame, leads: DataFrame, org: str = "domain") -> DataFrame:
    """Lower confidence of own-domain e-mails of domains without mail servers; add ``undeliverable``."""
    dead = leads.where("not deliverable").select(org).distinct().withColumn("__dead", F.lit(True))
    hit = (F.coalesce("__dead", F.lit(False)) & (F.col("kind") == "email")
           & F.endswith(F.col("value"), F.concat(F.lit("@"), F.col(org))))
    return (contacts.join(dead, org, "left").withColumns({
        "confidence": F.when(hit, F.round(F.greatest(F.lit(0.05), F.col("confidence") - 0.35), 2))
        .otherwise(F.col("confidence")), "undeliverable": hit}).drop("__dead"))


def validated_phones(contacts: DataFrame, facts: DataFrame, limit: int = 2,
                     org: str = "domain") -> DataFrame:
    """First phones per lead with validation facts (digits, valid, international, ...) applied."""
    phones = first_phones(contacts, limit, org).withColumn("digits", F.ltrim(F.col("value"), F.lit("+")))
    df = phones.join(facts.dropDuplicates(["digits"]), "digits", "left")
    checked = F.col("valid").isNotNull()
    conf = (F.when(F.col("valid"), F.round(F.least(F.lit(1.0), F.col("confidence") + 0.15), 2))
            .when(checked, F.round(F.greatest(F.lit(0.05), F.col("confidence") - 0.30), 2))
            .otherwise(F.col("confidence")))
    value = F.when(F.col("valid") & (F.coalesce("international", F.lit("")) != ""),
                   F.replace(F.col("international"), F.lit(" "), F.lit(""))).otherwise(F.col("value"))
    return df.withColumns({"checked": checked, "confidence": conf, "value": value,
                           "invalid_number": checked & ~F.coalesce("valid", F.lit(False))})


def with_company(leads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add company profile columns by lead name (first 80 characters)."""
    p = profiles.withColumnRenamed("name", "__n").dropDuplicates(["__n"])
    return leads.join(p, F.substring("name", 1, 80) == F.col("__n"), "left").drop("__n")


def leads_without_email(leads: DataFrame) -> DataFrame:
    return leads.where("domain <> '' and n_emails = 0")


def attach_provider(leads: DataFrame, contacts: DataFrame, found: DataFrame,
                    profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider data for leads without e-mail: (leads with filled names, all contacts to merge).

    Leads get the provider's name where they have none and its other fields;
    ``contacts`` and ``found`` share the contact columns.
    """
    needy = leads_without_email(leads).select("domain")
    extra = found.join(needy, "domain", "left_semi")
    shared = [c for c in contacts.columns if c in extra.columns]
    p = (profiles.join(needy, "domain", "left_semi").dropDuplicates(["domain"])
         .withColumnRenamed("name", "__name"))
    filled = (leads.join(p, "domain", "left")
              .withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "__name")).drop("__name"))
    return filled, contacts.select(*shared).unionByName(extra.select(*shared))


def rebinding_hosts(urls: DataFrame, dns: DataFrame, host: str = "host") -> DataFrame:
    """Add ``rebinds``: any captured address of the URL's host is internal (dns: host, address)."""
    from ..functions.urls import with_private_flag

    flagged = with_private_flag(dns, "address", "__private")
    bad = F.col("__private") | F.col("address").isin(*rules.METADATA_HOSTS)
    hosts = flagged.groupBy("host").agg(F.bool_or(bad).alias("rebinds"))
    return (urls.join(hosts.withColumnRenamed("host", host), host, "left")
            .withColumn("rebinds", F.coalesce("rebinds", F.lit(False))))
