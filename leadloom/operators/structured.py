"""schema.org facts from JSON-LD, over VARIANT values.

The node walk is unrolled level by level (the depth is bounded), each node
carrying its path; sorting by path gives document order, so "first node wins"
is a filter, not a traversal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import clean_text, pin, strip


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _node(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), v.alias("v"))


def _children(level: str) -> Column:
    """Nodes one step below a level: list items, or the values of the followed keys."""
    keyed = ", ".join(
        f"named_struct('path', concat(n.path, array({i})), 'v', try_variant_get(n.v, \"$['{key}']\", 'variant'))"
        for i, key in enumerate(rules.JSONLD_CHILD_KEYS))
    return F.expr(f"""flatten(transform({level}, n -> filter(
        CASE WHEN schema_of_variant(n.v) LIKE 'ARRAY%' THEN transform(
                 slice(try_variant_get(n.v, '$', 'array<variant>'), 1, {rules.JSONLD_MAX_ITEMS}),
                 (item, i) -> named_struct('path', concat(n.path, array(i)), 'v', item))
             WHEN schema_of_variant(n.v) LIKE 'OBJECT%' THEN array({keyed})
             -- a scalar has none; null here would void the whole page
             ELSE slice(array({keyed}), 1, 0) END,
        c -> c.v IS NOT NULL)))""")


def _text(v: Column) -> Column:
    """A scalar as text; null for objects, arrays and JSON null."""
    return F.when(_is_object(v) | _is_array(v), F.lit(None)).otherwise(
        F.try_variant_get(v, "$", "string"))


def _address(v: Column) -> Column:
    parts = F.array(*[_text(_get(v, k)) for k in (
        "streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")])
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ", ")
    return F.when(_is_object(v), joined).otherwise(_text(v))


def _types(v: Column) -> Column:
    raw = F.coalesce(_get(v, "@type"), _get(v, "type"))
    several = F.try_variant_get(raw, "$", "array<string>")
    return F.when(_is_array(raw), several).otherwise(F.array(_text(raw)))


def _facts(node: Column) -> Column:
    v = node["v"]
    geo, rating = _get(v, "geo"), _get(v, "aggregateRating")

    def number(holder: Column, *keys: str) -> Column:
        texts = [F.nullif(_text(_get(holder, k)), F.lit("")) for k in keys]
        # zero counts as missing, so the next spelling of the key is tried
        return F.coalesce(*[F.when(t.try_cast("double") == 0.0, F.lit(None))
                            .otherwise(t.try_cast("double")) for t in texts])

    return F.struct(
        node["path"].alias("path"),
        F.transform(_types(v), lambda t: F.lower(t)).alias("types"),
        _text(_get(v, "name")).alias("name"),
        _text(_get(v, "description")).alias("description"),
        _text(_get(v, "telephone")).alias("telephone"),
        _text(_get(v, "email")).alias("email"),
        _get(v, "address").isNotNull().alias("has_address"),
        F.nullif(_address(_get(v, "address")), F.lit("")).alias("address"),
        number(geo, "latitude").alias("latitude"),
        number(geo, "longitude").alias("longitude"),
        _text(_get(rating, "ratingValue")).try_cast("double").alias("rating"),
        number(rating, "reviewCount", "ratingCount").cast("int").alias("reviews"))


def with_jsonld(pages: DataFrame, html: str = "html", out: str = "jsonld") -> DataFrame:
    """Add a STRUCT of the facts of each page's first accepted nodes.

    Name and description come from the very first accepted node, even when it
    has none; every other field from the first node that has it.  Each level of
    the walk is a column of its own, so no level is evaluated twice.
    """
    keep = list(pages.columns)
    blocks = F.filter(F.transform(
        F.slice(F.regexp_extract_all(html, F.lit(rules.JSONLD), F.lit(1)), 1,
                rules.JSONLD_MAX_BLOCKS), strip), lambda b: b != "")
    df = pin(pages, "__blocks", blocks)
    roots = F.filter(F.transform("__blocks", lambda b, i: _node(
        F.array(i), F.coalesce(F.try_parse_json(b),
                               F.try_parse_json(F.regexp_replace(b, r",\s*([}\]])", "$1"))))),
        lambda n: n["v"].isNotNull())
    df = df.withColumn("__n0", roots)
    levels = [F.col("__n0")]
    for depth in range(1, rules.JSONLD_MAX_DEPTH + 1):
        df = df.withColumn(f"__n{depth}", _children(f"__n{depth - 1}"))
        levels.append(F.col(f"__n{depth}"))
    objects = F.filter(F.concat(*levels), lambda n: _is_object(n["v"]))
    accepted = F.array_sort(F.filter(
        F.transform(objects, _facts),
        lambda f: F.arrays_overlap(f["types"], F.array(*map(F.lit, rules.JSONLD_TYPES)))))
    df = pin(df, "__nodes", accepted)
    nodes = F.col("__nodes")

    def first(field: str) -> Column:
        text = field in ("telephone", "email")
        return F.get(F.filter(nodes, lambda f: f[field].isNotNull() & (
            f[field] != "" if text else F.lit(True))), F.lit(0))[field]

    head = F.get(nodes, F.lit(0))
    df = df.select(*keep, head["name"].alias("__name"), head["description"].alias("__desc"),
                   *[first(k).alias(f"__{k}") for k in (
                       "telephone", "email", "address", "latitude", "longitude", "rating", "reviews")])
    return pin(df, out, F.struct(
        clean_text(F.col("__name"), 120).alias("name"),
        clean_text(F.col("__desc"), 400).alias("description"),
        clean_text(F.col("__telephone"), 40).alias("telephone"),
        strip(F.replace("__email", F.lit("mailto:"), F.lit(""))).alias("email"),
        clean_text(F.col("__address")).alias("address"),
        *[F.col(f"__{k}").alias(k) for k in ("latitude", "longitude", "rating", "reviews")]
    )).select(*keep, out)
