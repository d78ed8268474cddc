"""Writers of lead results.  Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .functions.text import sanitise_cell
from .keyed import upsert_or_create
from .operators.scan import with_group_rank

log = logging.getLogger(__name__)


def sanitise_rows(df: DataFrame) -> DataFrame:
    """Neutralise spreadsheet formulas in every text column."""
    return df.select(*[
        sanitise_cell(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    sanitise_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str, settings: dict | None = None, stats: DataFrame | None = None) -> None:
    """Lead documents under ``leads`` and one manifest row under ``manifest``: settings and stats (one row) as objects."""
    rows.write.mode("overwrite").json(f"{path}/leads")
    manifest = rows.agg(F.count(F.lit(1)).alias("count")).select(
        F.current_timestamp().alias("generated_at"), "count",
        F.parse_json(F.lit(None if settings is None else json.dumps(settings))).alias("settings"))
    one = None if stats is None else stats.select(F.to_json(F.struct("*")).alias("row")).head()
    if one is not None:
        manifest = manifest.withColumn("stats", F.from_json(F.lit(one.row), stats.schema))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def report_row(rank: Column) -> Column:
    """A lead's Markdown table row; needs domain, url, name, score, emails, phones."""
    def cell(values: Column, n: int) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.slice(values, 1, n), "<br>"), F.lit("")), F.lit("—"))
    return F.concat(
        F.lit("| "), rank.cast("string"), F.lit(" | ["), F.col("domain"), F.lit("]("),
        F.coalesce(F.nullif("url", F.lit("")), F.lit("#")), F.lit(") | "),
        F.substring(F.coalesce("name", F.lit("")), 1, 40), F.lit(" | "), F.col("score").cast("string"),
        F.lit(" | "), cell(F.col("emails"), 4), F.lit(" | "), cell(F.col("phones"), 2), F.lit(" |"))


def report_lines(rows: DataFrame) -> DataFrame:
    """Numbered Markdown rows in lead order (score falling, then domain).

    The numbering runs over the whole table, so it uses the range-partitioned
    rank instead of one task.
    """
    keyed = rows.withColumns({"__all": F.lit(0), "__neg": -F.col("score")})
    ranked = with_group_rank(keyed, ["__all"], ["__neg", "domain"], "rank")
    return ranked.select("rank", report_row(F.col("rank")).alias("line"))


def report_head(rows: DataFrame) -> DataFrame:
    """Heading and totals of the Markdown report."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("emails") > 0).alias("w"),
                      F.coalesce(F.sum(F.size("emails")), F.lit(0)).alias("e"))
    return totals.select(F.explode(F.array(
        F.lit("# Lead report"), F.lit(""),
        F.format_string("**%d leads** · %d with e-mail · %d addresses total", "n", "w", "e"), F.lit(""),
        F.lit("| # | Domain | Name | Score | E-mails | Phones |"), F.lit("|--:|---|---|--:|---|---|"))).alias("value"))


def write_markdown(rows: DataFrame, path: str) -> None:
    report_head(rows).coalesce(1).write.mode("overwrite").text(f"{path}/head")
    (report_lines(rows).repartitionByRange("rank").sortWithinPartitions("rank")
     .select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/rows"))


LEAD_COLUMNS = ("domain", "name", "url", "score", "address", "latitude", "longitude", "rating", "reviews",
                "category", "title", "description", "source", "pages_crawled", "fetched_at")


def normalised_leads(leads: DataFrame) -> DataFrame:
    return leads.select(*[F.col(c) if c in leads.columns else F.lit(None).cast("string").alias(c)
                          for c in LEAD_COLUMNS])


def normalised_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.select("domain", "kind", "value", "confidence", "source_url",
                           F.to_json(F.coalesce("meta", F.create_map().cast("map<string,string>"))).alias("meta"))


def write_tables(leads: DataFrame, contacts: DataFrame, path: str, buckets: int = 64) -> None:
    """Leads by domain and contacts by (domain, kind, value); rows stored before with a key are replaced."""
    upsert_or_create(normalised_leads(leads), f"{path}/leads", ["domain"], buckets)
    upsert_or_create(normalised_contacts(contacts), f"{path}/contacts", ["domain", "kind", "value"], buckets)


FORMATS = ("csv", "json", "jsonl", "md", "tables")


def write_all(rows: DataFrame, flat: DataFrame, leads: DataFrame, contacts: DataFrame, path: str,
              formats: Sequence[str] = FORMATS) -> list[tuple[str, str]]:
    """Write the wanted formats; an unknown name or a failure does not stop the others.

    Returns (format, "written" | "unknown" | error text) per format.
    """
    writers: dict[str, Callable[[str], None]] = {
        "csv": lambda p: write_csv(flat, p), "json": lambda p: write_json(rows, p),
        "jsonl": lambda p: write_jsonl(rows, p), "md": lambda p: write_markdown(rows, p),
        "tables": lambda p: write_tables(leads, contacts, p)}
    wanted = {f.strip().lower() for f in formats}
    if "all" in wanted:
        wanted = wanted - {"all"} | set(FORMATS)
    results = []
    for name in sorted(wanted):
        if name not in writers:
            log.warning("unknown output format %r skipped", name)
            results.append((name, "unknown"))
            continue
        try:
            writers[name](f"{path}/{name}")
            results.append((name, "written"))
        except Exception as exc:  # one sink's failure must not lose the others
            log.error("writing %s failed: %s", name, exc)
            results.append((name, f"failed: {exc}"))
    return results
