"""Reports over finished leads and their contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.emails import is_freemail, is_role


def _pct(part, total):
    return F.coalesce(F.round(part * 100.0 / F.nullif(total, F.lit(0)), 1), F.lit(0.0))


def lead_figures(leads: DataFrame) -> DataFrame:
    """One row of figures that come from the lead table alone.

    ``leads``: score, n_emails, n_phones, n_networks, deliverable, pages_crawled.
    The median is the upper one; scores have one decimal, so the percentile
    buffer holds at most 1,001 distinct values.
    """
    total = F.count(F.lit(1))
    contactable = F.count_if(F.expr("n_emails > 0 or n_phones > 0"))
    deliverable = F.count_if("deliverable")
    s = F.col("score")
    return leads.agg(
        total.alias("total"), contactable.alias("contactable"),
        _pct(contactable, total).alias("contactable_pct"),
        F.count_if(F.expr("n_emails > 0")).alias("with_email"), F.count_if(F.expr("n_phones > 0")).alias("with_phone"),
        F.count_if(F.expr("n_networks > 0")).alias("with_social"),
        deliverable.alias("deliverable_domains"), _pct(deliverable, total).alias("deliverable_pct"),
        F.round(F.avg(s), 1).alias("avg_score"),
        F.expr("percentile_disc(0.5) within group (order by score desc)").alias("median_score"),
        F.count_if(s >= 60).alias("hot"), F.count_if((s >= 30) & (s < 60)).alias("warm"),
        F.count_if(s < 30).alias("cold"),
        F.coalesce(F.sum("pages_crawled"), F.lit(0)).alias("pages_crawled"))


def email_figures(contacts: DataFrame) -> DataFrame:
    """One row of e-mail counts: all, distinct, role, personal, free mail."""
    value = F.col("value")
    role = is_role(value)
    if "meta" in contacts.columns:
        role = role | (F.coalesce(F.col("meta")["role"], F.lit("false")) == "true")
    # distinct values: two-step, so no task sees more than its share of addresses
    per_value = contacts.where("kind = 'email'").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(role).alias("r"),
        F.count_if(is_freemail(value)).alias("f"))
    total, roles = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))
    return per_value.agg(
        total.alias("total_emails"), F.count(F.lit(1)).alias("unique_emails"),
        roles.alias("role_emails"), F.greatest(total - roles, F.lit(0)).alias("personal_emails"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("freemail_emails"))


def report(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Lead and e-mail figures in one row.

    The two one-row tables are stacked and collapsed instead of cross-joined.
    """
    both = lead_figures(leads).unionByName(email_figures(contacts), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def summary(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """The short run summary: leads, how many are reachable and how, average score."""
    r = report(leads, contacts)
    return r.select(F.col("total").alias("leads"), "with_email", "with_phone", "with_social",
                    F.col("total_emails").alias("emails"), "unique_emails",
                    F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"))


def summary_rows(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """The summary as (metric, value) rows."""
    s = summary(leads, contacts)
    names = {"leads": "Leads", "with_email": "With e-mail", "with_phone": "With phone",
             "emails": "Total e-mails", "avg_score": "Avg score"}
    wide = s.select(*[F.col(k).cast("double").alias(v) for k, v in names.items()])
    return wide.unpivot([], list(names.values()), "metric", "value")


def _top(counted: DataFrame, key: str, limit: int | None) -> DataFrame:
    out = counted.orderBy(F.desc("n"), key)
    return out.limit(limit) if limit else out


def top_tlds(leads: DataFrame, limit: int = 6) -> DataFrame:
    tld = F.substring_index("domain", ".", -1)
    return _top(leads.where(F.col("domain").contains(".")).groupBy(tld.alias("tld"))
                .agg(F.count(F.lit(1)).alias("n")), "tld", limit)


def mail_platforms(leads: DataFrame, limit: int = 6) -> DataFrame:
    return _top(leads.where("mail_platform is not null").groupBy("mail_platform")
                .agg(F.count(F.lit(1)).alias("n")), "mail_platform", limit)


def social_networks(contacts: DataFrame, limit: int = 8, org: str = "domain") -> DataFrame:
    """Leads per network."""
    pairs = contacts.where(F.col("kind").isin(*rules.SOCIAL_KINDS)).select(org, "kind").distinct()
    return _top(pairs.groupBy(F.col("kind").alias("network"))
                .agg(F.count(F.lit(1)).alias("n")), "network", limit)


def source_counts(leads: DataFrame) -> DataFrame:
    return _top(leads.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", None)


def enrichment_counters(leads: DataFrame, phones: DataFrame, profiles: DataFrame) -> DataFrame:
    """What enrichment achieved, in one row.

    ``leads`` after mail validation, ``phones`` after phone validation,
    ``profiles`` after the company join.
    """
    parts = [
        leads.agg(F.count_if(F.expr("deliverable is not null")).alias("mx_checked"),
                  F.count_if("deliverable").alias("deliverable_domains"),
                  F.count_if(F.expr("not deliverable")).alias("undeliverable_domains")),
        phones.agg(F.count_if("checked").alias("phones_checked"),
                   F.count_if(F.expr("checked and valid")).alias("phones_valid")),
        profiles.agg(F.count_if(F.expr("wikidata_id is not null")).alias("company_profiles"))]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def api_problems(errors: DataFrame, block_notes: DataFrame, run_found_anything: DataFrame) -> DataFrame:
    """Distinct error messages, plus block notes of runs that found nothing.

    Each table has ``run`` and, for the first two, ``message``.
    """
    empty_runs = block_notes.join(run_found_anything.select("run").distinct(), "run", "left_anti")
    return errors.select("run", "message").unionByName(empty_runs.select("run", "message")).distinct()
