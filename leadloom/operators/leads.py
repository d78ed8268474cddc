"""Leads: contact merge, roll-up, caps, scores, views.

A domain may hold any share of the contacts, so nothing here gathers a whole
domain in one place unless its size is bounded: merges and scores are partial
aggregates, caps are top-k windows whose limit is applied before the shuffle.
Lead documents list all contacts unless the caller bounds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.emails import is_role
from .scan import with_group_rank


def at_least(contacts: DataFrame, confidence: float) -> DataFrame:
    return contacts.where(F.col("confidence") >= confidence)


def merge_contacts(contacts: DataFrame, order: Sequence[str],
                   org: str = "domain") -> DataFrame:
    """One row per (organisation, kind, value ignoring case).

    The first spelling stays; a find that is more confident than all before it
    takes over confidence and source and adds its meta entries.  Only the first
    find at each confidence level can be such a find, so level one keeps those
    (confidences have two decimals, hence at most 101 per value) and level two
    folds them in order.
    """
    c = contacts.withColumns({"confidence": F.round("confidence", 2),
                              "__k": F.lower("value"), "__o": F.struct(*order)})
    levels = (c.groupBy(org, "kind", "__k", "confidence")
              .agg(F.min(F.struct("__o", "value", "source_url", F.map_entries("meta").alias("meta"))
                         ).alias("__f")))
    steps = F.array_sort(F.collect_list(F.struct(
        F.col("__f.__o").alias("o"), "confidence", F.col("__f.value").alias("value"),
        F.col("__f.source_url").alias("source_url"), F.col("__f.meta").alias("meta"))))
    folded = F.aggregate(
        F.slice("__s", 2, 200), F.get("__s", F.lit(0)),
        lambda acc, x: F.when(x["confidence"] > acc["confidence"], F.struct(
            acc["o"].alias("o"), x["confidence"].alias("confidence"), acc["value"].alias("value"),
            F.when(F.coalesce(x["source_url"], F.lit("")) != "", x["source_url"])
            .otherwise(acc["source_url"]).alias("source_url"),
            F.concat(F.filter(acc["meta"], lambda e: ~F.exists(
                x["meta"], lambda n: n["key"] == e["key"])), x["meta"]).alias("meta"))
        ).otherwise(acc))
    return (levels.groupBy(org, "kind", "__k").agg(steps.alias("__s"))
            .withColumn("__m", folded)
            .select(org, "kind", "__m.value", "__m.confidence", "__m.source_url",
                    F.map_from_entries("__m.meta").alias("meta")))


def best_contacts(contacts: DataFrame, order: Sequence[str], org: str = "domain") -> DataFrame:
    """The merge without meta entries: one partial aggregation, one shuffle."""
    place = F.struct(*order)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), place.alias("o"), "source_url"))
    return (contacts.groupBy(org, "kind", F.lower("value").alias("__k"))
            .agg(F.min(F.struct(place.alias("o"), "value")).alias("__f"), best.alias("__b"))
            .select(org, "kind", F.col("__f.value").alias("value"),
                    (-F.col("__b.c")).alias("confidence"), "__b.source_url"))


def cap_emails(contacts: DataFrame, cap: int = rules.MAX_EMAILS_PER_LEAD,
               org: str = "domain") -> DataFrame:
    """Keep an organisation's ``cap`` best e-mails (0: all) and every other contact.

    Of equally confident e-mails role mailboxes come first, then the order of values.
    """
    if not cap:
        return contacts
    mail = contacts.where("kind = 'email'")
    order = [F.desc("confidence"), F.desc(is_role(F.col("value"))), F.col("value")]
    kept = (mail.withColumn("__r", F.row_number().over(W.partitionBy(org).orderBy(*order)))
            .where(F.col("__r") <= cap).drop("__r"))
    return kept.unionByName(contacts.where("kind <> 'email'"))


def truncated_emails(contacts: DataFrame, cap: int = rules.MAX_EMAILS_PER_LEAD,
                     org: str = "domain") -> DataFrame:
    """Organisations over the cap with their true number of e-mails."""
    return (contacts.where("kind = 'email'").groupBy(org)
            .agg(F.count(F.lit(1)).alias("emails_truncated"))
            .where(F.col("emails_truncated") > (cap or 2 ** 62)))


def contact_stats(contacts: DataFrame, org: str = "domain") -> DataFrame:
    """Counts per organisation from merged contacts, as fixed-size partial aggregates."""
    kind = F.col("kind")
    mask = None
    for i, name in enumerate(rules.SOCIAL_KINDS):
        mask = (F if mask is None else mask).when(kind == name, F.lit(1 << i))
    return contacts.groupBy(org).agg(
        F.count(F.lit(1)).alias("n_contacts"),
        F.count_if(kind == "email").alias("n_emails"),
        F.max(F.when(kind == "email", F.col("confidence"))).alias("best_email"),
        F.count_if(kind == "phone").alias("n_phones"),
        F.coalesce(F.bit_count(F.bit_or(mask)), F.lit(0)).alias("n_networks"))


def score(n_emails: Column, best_email: Column, n_phones: Column, n_networks: Column,
          named: Column, addressed: Column) -> Column:
    """Lead quality, 0 to 100, one decimal (half up)."""
    mail = F.when(n_emails > 0, 40 + F.least(n_emails - 1, F.lit(4)) * 3 + best_email * 10).otherwise(0.0)
    total = (mail + F.when(n_phones > 0, 15).otherwise(0) + F.least(n_networks * 5, F.lit(20))
             + F.when(named, 5).otherwise(0) + F.when(addressed, 5).otherwise(0))
    return F.round(F.least(total, F.lit(100.0)), 1)


_FIELDS = ("name", "title", "description", "address", "latitude", "longitude", "rating", "reviews")


def first_metadata(metadata: DataFrame, order: Sequence[str], org: str = "domain",
                   fields: Sequence[str] = _FIELDS) -> DataFrame:
    """Per organisation the earliest set value of each field (numbers: not null; text: not '')."""
    kinds = dict(metadata.dtypes)
    place = F.struct(*order)

    def earliest(field: str) -> Column:
        value = F.col(field)
        present = value.isNotNull() & ((value != "") if kinds[field] == "string" else F.lit(True))
        return F.min_by(value, F.when(present, place)).alias(field)

    return metadata.groupBy(org).agg(*[earliest(f) for f in fields])


def page_rollup(fetches: DataFrame, org: str = "domain") -> DataFrame:
    """Pages parsed, failed fetches (robots blocks apart) and e-mail finds per organisation.

    ``fetches``: org, ``ok``, ``error``, ``n_emails``.
    """
    failed = ~F.col("ok") & F.col("error").isNotNull() & (F.col("error") != "blocked-by-robots")
    return fetches.groupBy(org).agg(
        F.count_if("ok").alias("pages_crawled"), F.count_if(failed).alias("n_errors"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_emails"))), F.lit(0)).alias("emails_found"))


def fetch_errors(fetches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error lines ``url :: reason`` in long form, so that no domain's list must fit a row."""
    return fetches.where("not ok and error is not null and error <> 'blocked-by-robots'").select(
        *keys, F.concat_ws(" :: ", "url", "error").alias("error_line"))


def build_leads(stats: DataFrame, metadata: DataFrame, pages: DataFrame | None = None,
                org: str = "domain", source: str = "crawl") -> DataFrame:
    """Scored leads: organisations with a contact or a name."""
    df = metadata.join(stats, org, "full")
    if pages is not None:
        df = df.join(pages, org, "left")
    zero = {c: 0 for c in ("n_contacts", "n_emails", "n_phones", "n_networks", "pages_crawled")
            if c in df.columns}
    df = df.na.fill(zero)
    name, title = F.coalesce("name", F.lit("")), F.coalesce("title", F.lit(""))
    return df.withColumns({
        "source": F.lit(source),
        "score": score(F.col("n_emails"), F.col("best_email"), F.col("n_phones"), F.col("n_networks"),
                       (name != "") | (title != ""), F.coalesce("address", F.lit("")) != ""),
    }).where("n_contacts > 0 or coalesce(name, '') <> ''")


def non_empty(leads: DataFrame) -> DataFrame:
    return leads.where("n_contacts > 0 or coalesce(name, '') <> ''")


def ordered(leads: DataFrame, org: str = "domain") -> DataFrame:
    return leads.orderBy(F.desc("score"), org)


def sorted_by(leads: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort by a column the caller chose; unknown columns are refused."""
    if column not in leads.columns:
        raise ValueError(f"cannot sort by {column!r}")
    return leads.orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def first_page(leads: DataFrame, n: int = 500, org: str = "domain") -> DataFrame:
    return ordered(leads, org).limit(n)


def lead_documents(contacts: DataFrame, org: str = "domain", top: int | None = None) -> DataFrame:
    """One row per organisation: its contacts of each kind, as arrays, and how many there are.

    Contacts follow confidence and then value.  With ``top`` a row lists up to
    that many of a kind; the limit applies before rows move, so an organisation
    with a third of all contacts costs no more than another.  ``counts`` has the
    number known per kind, ``n_listed`` and ``n_known`` the totals.
    ``ranked_contacts`` lists every contact in long form.
    """
    listed = contacts
    if top is not None:
        place = F.row_number().over(W.partitionBy(org, "kind").orderBy(F.desc("confidence"), "value"))
        listed = contacts.withColumn("__r", place).where(F.col("__r") <= top).drop("__r")
    counts = (contacts.groupBy(org, "kind").agg(F.count(F.lit(1)).alias("n")).groupBy(org).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"), F.sum("n").alias("n_known")))
    entry = F.struct("kind", (-F.col("confidence")).alias("__c"), "value", "source_url")
    grouped = (listed.groupBy(org).agg(F.array_sort(F.collect_list(entry)).alias("__a"), F.count(F.lit(1)).alias("n_listed"))
               .join(counts, org))
    a = F.col("__a")

    def of(kind: str) -> Column:
        return F.transform(F.filter(a, lambda x: x["kind"] == kind), lambda x: x["value"])

    contact = F.transform(a, lambda x: F.struct(
        x["kind"].alias("kind"), x["value"].alias("value"), (-x["__c"]).alias("confidence"),
        x["source_url"].alias("source_url")))
    socials = F.map_filter(F.map_from_arrays(
        F.array(*map(F.lit, rules.SOCIAL_KINDS)), F.array(*[of(k) for k in rules.SOCIAL_KINDS])),
        lambda k, v: F.size(v) > 0)
    return grouped.select(org, contact.alias("contacts"), of("email").alias("emails"),
                          of("phone").alias("phones"), socials.alias("socials"), "counts", "n_listed", "n_known")


def ranked_contacts(contacts: DataFrame, org: str = "domain") -> DataFrame:
    """Every contact in long form with its ``place`` in its organisation (kind, confidence falling, value)."""
    ranked = with_group_rank(contacts.withColumn("__neg", -F.col("confidence")), [org], ["kind", "__neg", "value"], "place")
    return ranked.drop("__neg")


def export_rows(leads: DataFrame, documents: DataFrame, org: str = "domain") -> DataFrame:
    """The 27-column flat form, one row per lead."""
    d = leads.join(documents, org, "left")

    def joined(values: Column) -> Column:
        return F.coalesce(F.array_join(values, "; "), F.lit(""))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in d.columns else F.lit("")

    made = {
        "domain": F.col(org), "score": F.col("score"), "emails": joined(F.col("emails")),
        "phones": joined(F.col("phones")), "website": text("url"), "pages_crawled": F.col("pages_crawled"),
        "fetched_at": (F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")
                       if "fetched_at" in d.columns else F.lit("")),
        **{k: joined(F.col("socials")[k]) for k in rules.SOCIAL_KINDS}}
    return d.select(*[made.get(c, text(c)).alias(c) for c in rules.EXPORT_COLUMNS])


def display_rows(rows: DataFrame) -> DataFrame:
    """Short table view: first four e-mails and how many more, two phones, a badge."""
    known = F.coalesce(F.col("counts")["email"], F.lit(0))
    more = F.when(known > 4, F.concat(F.lit(" +"), (known - 4).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return rows.select(
        "domain", F.substring(F.coalesce("name", F.lit("")), 1, 46).alias("name"), "score",
        badge(F.col("score")).alias("badge"),
        F.concat(F.array_join(F.slice("emails", 1, 4), " "), more).alias("emails"),
        F.array_join(F.slice("phones", 1, 2), " ").alias("phones"))


def badge(score_column: Column) -> Column:
    return F.when(score_column >= 60, "hi").when(score_column >= 30, "md").otherwise("lo")


def first_phones(contacts: DataFrame, n: int = 2, org: str = "domain") -> DataFrame:
    """An organisation's first ``n`` phones in contact order."""
    order = [F.desc("confidence"), F.col("value")]
    return (contacts.where("kind = 'phone'")
            .withColumn("rank", F.row_number().over(W.partitionBy(org).orderBy(*order)))
            .where(F.col("rank") <= n))


def matches_labels(labels: Column, selector: str) -> Column:
    """True where a label map has every ``key=value`` pair of a selector."""
    ok = F.lit(True)
    for key, value in parse_selector(selector).items():
        ok = ok & F.coalesce(F.try_element_at(labels, F.lit(key)) == value, F.lit(False))
    return ok


def parse_selector(text: str | None) -> dict[str, str]:
    pairs = (piece.strip().partition("=") for piece in (text or "").split(",") if piece.strip())
    return {key.strip(): value.strip() for key, _, value in pairs}


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside a (south, west, north, east) box padded on every side; no position passes."""
    s, w, n, e = box
    pad_lat, pad_lon = max(abs(n - s) * 0.25, 0.2), max(abs(e - w) * 0.25, 0.2)
    inside = lat.between(s - pad_lat, n + pad_lat) & lon.between(w - pad_lon, e + pad_lon)
    return lat.isNull() | lon.isNull() | inside


def in_box_columns(lat: Column, lon: Column, box: Column) -> Column:
    """The same test against a STRUCT<s,w,n,e> column."""
    pad_lat = F.greatest(F.abs(box["n"] - box["s"]) * 0.25, F.lit(0.2))
    pad_lon = F.greatest(F.abs(box["e"] - box["w"]) * 0.25, F.lit(0.2))
    inside = (lat.between(box["s"] - pad_lat, box["n"] + pad_lat)
              & lon.between(box["w"] - pad_lon, box["e"] + pad_lon))
    return lat.isNull() | lon.isNull() | inside


def box_radius(s: Column, w: Column, n: Column, e: Column) -> Column:
    """Whole metres covering a box, between 10 and 100 km."""
    height = F.abs(n - s) * 111320.0
    width = F.abs(e - w) * 111320.0 * F.cos(F.radians((n + s) / 2))
    return F.floor(F.least(F.lit(100000.0), F.greatest(
        F.lit(10000.0), F.hypot(height, width) / 2))).cast("bigint")


def box_centre(s: Column, w: Column, n: Column, e: Column) -> Column:
    return F.format_string("%.5f,%.5f", (s + n) / 2, (w + e) / 2)
