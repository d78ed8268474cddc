"""Text scalars: entity decoding, cleaning, brands, renderings, masking."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from .. import rules


@F.pandas_udf(StringType())
def _entities(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _entities_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", html.unescape(s)),
                      na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Decode HTML entities.  Only values holding ``&`` are sent to Python."""
    return F.coalesce(_entities(F.when(c.contains("&"), c)), c)


def pin(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column whose expression later filters are not pushed into.

    The optimiser moves a filter below a projection by substituting the
    column's expression for every mention of it, which repeats long
    expressions many times.  It does not do so below a generator, hence the
    one-element explode.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(expr)).alias(name))


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_text(c: Column, limit: int = 500) -> Column:
    """Decode entities, normalise to NFKC, collapse white space, cut; '' becomes null.

    Plain ASCII without ``&`` is already in that form and never leaves the JVM.
    """
    special = c.rlike(r"&|[^\x00-\x7F]")
    text = F.coalesce(_entities_nfkc(F.when(special, c)), c)
    return F.nullif(F.substring(collapse_spaces(text), 1, limit), F.lit(""))


def register_sql_functions(spark: SparkSession) -> None:
    """Make the entity decoders callable from SQL text."""
    spark.udf.register("html_unescape", _entities)
    spark.udf.register("html_unescape_nfkc", _entities_nfkc)


def percent_decode(c: Column) -> Column:
    """Percent decoding that keeps ``+`` and leaves undecodable text alone."""
    decoded = F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return F.when(c.contains("%"), F.coalesce(decoded, c)).otherwise(c)


def title_segments(title: Column) -> Column:
    """Parts of a page title without navigation labels."""
    parts = F.transform(F.split(title, r"(?U)\s*[|–—·»:]\s*|\s+-\s+"), strip)
    return F.filter(parts, lambda p: (p != "") & ~F.lower(
        F.regexp_replace(p, r"^[ .]+|[ .]+$", "")).isin(*rules.NAVIGATION_LABELS))


def reads_like_brand(segment: Column) -> Column:
    return ((F.length(segment) <= 60) & ~segment.rlike(rules.HEADLINE)
            & (F.size(F.split(segment, r"(?U)\s+")) <= 6))


def brand_from_title(title: Column, domain: Column) -> Column:
    """Organisation name in a title, or null.

    A segment starting with the first six characters of the domain's first
    label decides alone; otherwise the last and then the first segment may be it.
    """
    label = F.substring(F.regexp_replace(F.substring_index(domain, ".", 1), "-", ""), 1, 6)
    parts = title_segments(title)
    own = F.filter(parts, lambda p: (label != "") & F.startswith(
        F.lower(F.regexp_replace(p, "[ -]", "")), label))
    pick = (F.when(F.size(parts) < 1, F.array().cast("array<string>"))
            .when(F.size(own) > 0, F.slice(own, 1, 1))
            .otherwise(F.array(F.element_at(parts, -1), F.try_element_at(parts, F.lit(1)))))
    return F.get(F.filter(pick, reads_like_brand), F.lit(0))


def human_count(c: Column) -> Column:
    """1500 -> ``2K``: K, M, B, then one decimal and T (half-even digits, as printf gives)."""
    def fixed(scale: float, suffix: str) -> Column:
        return F.concat(F.bround(c / F.lit(scale), 0).cast("bigint").cast("string"), F.lit(suffix))
    size = F.abs(c)
    return (F.when(size < 1e3, fixed(1.0, "")).when(size < 1e6, fixed(1e3, "K"))
            .when(size < 1e9, fixed(1e6, "M")).when(size < 1e12, fixed(1e9, "B"))
            .otherwise(F.format_string("%.1fT", c / F.lit(1e12))))


def _span(seconds: Column) -> Column:
    def unit(size: int, name: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(name))
    return (F.when(seconds >= 86400, unit(86400, "d")).when(seconds >= 3600, unit(3600, "h"))
            .when(seconds >= 60, unit(60, "m")).otherwise(unit(1, "s")))


def age(ts: Column, now: Column) -> Column:
    """Age of an epoch-seconds value: ``3d``, ``5h``, ``7m``, ``12s``; ``-`` when unset."""
    return (F.when(ts.isNull() | (ts == 0), "-")
            .otherwise(_span(F.greatest(now - ts, F.lit(0)))))


def until(ts: Column, now: Column) -> Column:
    """Time left until an epoch-seconds value; ``due`` once reached."""
    return (F.when(ts.isNull() | (ts == 0), "-").when(ts <= now, "due")
            .otherwise(_span(ts - now)))


def location_in_query(query: Column, explicit: Column | None = None) -> Column:
    """Place named by a query: the explicit one, else the text after in/near/around/at."""
    tail = F.trim(F.regexp_extract(query, r"(?isU)^.*?\b(?:in|near|around|at)\b(.*)$", 1))
    found = F.nullif(tail, F.lit(""))
    if explicit is None:
        return found
    return F.coalesce(F.trim(F.nullif(explicit, F.lit(""))), found)


def tags_in_query(query: Column) -> Column:
    """Map-feature tags a query asks for, in rule order; two defaults when none match.

    The rules are literals, so no join is needed.
    """
    hits = [F.when(query.rlike("(?iU)" + pattern), F.array(*map(F.lit, tags)))
            for pattern, tags in rules.CATEGORY_TAGS]
    found = F.flatten(F.array_compact(F.array(*hits)))
    return F.when(F.size(found) > 0, found).otherwise(
        F.array(*map(F.lit, rules.DEFAULT_TAGS)))


def sanitise_cell(c: Column) -> Column:
    """Prefix text a spreadsheet would run as a formula with an apostrophe."""
    negative = c.rlike(r"(?i)^-\s*(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
                       r"(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)\s*$")
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~negative, F.concat(F.lit("'"), c)).otherwise(c)


def mask_secret(c: Column) -> Column:
    """``***`` and the last four characters; empty stays empty."""
    return F.when(c.isNull() | (c == ""), c).otherwise(
        F.concat(F.lit("***"), F.right(c, F.lit(4))))


def interval_seconds(schedule: Column) -> Column:
    """``@daily`` or ``every 30m`` as seconds, else null."""
    s = F.lower(F.trim(schedule))
    number = F.regexp_extract(s, r"^every\s+(\d+)\s*(?:s|m|h|d|sec|min|hour|day)s?$", 1)
    unit = F.regexp_extract(s, r"^every\s+\d+\s*(s|m|h|d|sec|min|hour|day)s?$", 1)
    named = F.lit(None).cast("bigint")
    for name, seconds in rules.NAMED_INTERVALS.items():
        named = F.when(s == name, F.lit(seconds)).otherwise(named)
    size = F.lit(None).cast("bigint")
    for name, seconds in rules.INTERVAL_UNITS.items():
        size = F.when(unit == name, F.lit(seconds)).otherwise(size)
    count = F.when(number != "", number).try_cast("bigint")
    return F.coalesce(named.cast("bigint"), F.greatest(count, F.lit(1)) * size)
