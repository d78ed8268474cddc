"""Quotation linking: which message a reply quotes, and conversations without the quotes.

DataFrame functions only.  A message's lines carry the quote level of their
leading ``>`` marks; runs of lines of one level are passages.  Normalised
passages and lines are hashed.  A quoted passage belongs to the latest earlier
message of the conversation that holds it as its own text; one that the
conversation does not hold belongs to the first message anywhere that does.

The latest earlier holder is found in one pass over (conversation, hash, turn),
range-partitioned, so neither a conversation nor a passage with a third of all
rows goes to one task, and no pairs of holders and quoters are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scan import PART, border_summaries, carried, range_partitioned, with_group_rank
from .common import Stage

# The form of quote marks and of the line that announces a quote.
MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)^[ \t]*(?:on\b.*|.*\b)wrote:[ \t]*$"
_LOWEST = -(1 << 63)


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed: what survives re-wrapping of a quoted passage."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _runs(lines: str) -> Column:
    """Runs of equal level in the array column ``lines``; linear in the number of lines."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(F.col(lines), i)["level"] != F.get(F.col(lines), i - 1)["level"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(F.col(lines), a)["level"].alias("level"),
        F.array_join(F.transform(F.slice(F.col(lines), a + 1, b - a), lambda x: x["line"]), "\n").alias("text")))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages(text, ...)`` with body (the message's own text) and quotes (array of struct(level, text)).

    A line that announces a quote and stands right before a deeper level belongs to neither.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARKS + "[ \t]?", "").alias("line")))
    with_lines = messages.withColumn("__all", lines)
    kept = F.filter("__all", lambda x, i: ~(x["line"].rlike(ANNOUNCES)
                                            & (F.coalesce(F.get(F.col("__all"), i + 1)["level"], F.lit(0))
                                               > x["level"])))
    runs = with_lines.withColumn("__lines", kept).withColumn(
        "__runs", F.when(F.size("__lines") > 0, _runs("__lines")).otherwise(F.array()))
    own = F.array_join(F.transform(F.filter("__runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    return (runs.withColumn("body", F.regexp_replace(own, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", ""))
            .withColumn("quotes", F.filter("__runs", lambda r: (r["level"] > 0) & (F.trim(r["text"]) != "")))
            .drop("__all", "__lines", "__runs"))


def _units(text: Column, least_chars: int) -> Column:
    """Normalised whole text and its lines and paragraphs of ``least_chars`` or more, distinct."""
    parts = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t]*\n", -1))
    long = F.filter(F.transform(parts, normalised), lambda p: F.length(p) >= least_chars)
    return F.array_distinct(F.filter(F.concat(F.array(normalised(text)), long), lambda p: p != ""))


def link_quotes(messages: DataFrame, least_chars: int = 12, least_elsewhere: int = 24) -> DataFrame:
    """Conversations without quotes, in reply order: one row per distinct message.

    ``messages(conv_id, turn, role, text)`` gives conv_id, turn, role, body,
    n_quotes (quoted passages), n_linked (those whose original was found),
    parent_turn (the message of the conversation quoted at the lowest level,
    by the longest match, the latest of ties), source_conv_id and source_turn (the first holder of a
    passage of at least ``least_elsewhere`` characters that the conversation
    itself does not hold), root_turn, depth and position (1-based place in the
    conversation when threads follow each other by their first message and
    replies follow what they quote).

    Lines and paragraphs of fewer than ``least_chars`` characters link only as
    a whole message or passage.  Null and empty texts quote nothing and have an
    empty body.  A message whose conv_id or turn is null links with nothing;
    null ids form a conversation of their own, null turns come first.  Equal
    rows are one message; messages that share a turn are ordered by role and
    text.  Extra columns are ignored.
    """
    spark = messages.sparkSession
    stage = Stage(spark, "quotes")
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    m = stage.put(parsed(base).withColumn("key", F.xxhash64("role", "text"))
                  .withColumn("key2", F.xxhash64(F.lit(1), "role", "text")).drop("text"), "messages")
    row = ["conv_id", "turn", "key", "key2"]
    placed = m.where("conv_id is not null and turn is not null")

    def hashed(df: DataFrame) -> DataFrame:
        return (df.withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(1), "unit"))
                .withColumn("chars", F.length("unit")).drop("unit"))

    held = hashed(placed.select("conv_id", "turn", F.explode(_units(F.col("body"), least_chars)).alias("unit")))
    quoted = placed.select(*row, F.posexplode("quotes").alias("nth", "q")).select(*row, "nth", "q.level", "q.text")
    asked = hashed(quoted.select(*row, "nth", "level", F.explode(_units(F.col("text"), least_chars)).alias("unit")))
    asked = stage.put(asked, "asked")
    # originals that nothing asks for need not be sorted
    held = stage.put(held.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"), "held")

    # latest earlier holder in the conversation: one ordered pass
    group, order = ["conv_id", "h1", "h2"], ["turn", "holds", "key", "key2", "nth"]
    both = held.select(*group, "turn", F.lit(1).alias("holds"), F.lit(None).cast("long").alias("key"),
                       F.lit(None).cast("long").alias("key2"), F.lit(None).cast("int").alias("nth"),
                       F.lit(None).cast("int").alias("level"), "chars").distinct() \
        .unionByName(asked.select(*group, "turn", F.lit(0).alias("holds"), "key", "key2", "nth", "level", "chars"))
    parts = range_partitioned(both, group, order)
    holder = F.when(F.col("holds") == 1, F.col("turn"))
    before = carried(border_summaries(parts, group, [F.max(holder).alias("__last")]), group,
                     {"__before": lambda w: F.max("__last").over(w)})
    local = F.max(holder).over(W.partitionBy(PART, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    # as many carried rows as partitions, at most
    found = (parts.withColumn("__local", local).join(F.broadcast(before), [PART, *group], "left")
             .where("holds = 0").withColumn("origin", F.coalesce("__local", "__before"))
             .select(*row, "nth", "level", "chars", "h1", "h2", "origin"))
    found = stage.put(found, "found")

    within = found.where("origin is not null")
    best = within.groupBy(*row).agg(F.max(F.struct((-F.col("level")).alias("level"), "chars", "origin")).alias("b")) \
        .select(*row, F.col("b.origin").alias("parent_turn"))
    linked = within.select(*row, "nth").distinct()
    # passages that their own conversation does not hold
    open_ones = found.join(linked, [*row, "nth"], "left_anti").where(F.col("chars") >= least_elsewhere)
    first = held.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("s"))
    outside = (open_ones.join(first, ["h1", "h2"]).where(F.col("s.conv_id") != F.col("conv_id"))
               .groupBy(*row).agg(F.max(F.struct("chars", (-F.col("level")).alias("level"),
                                                 (-F.col("s.conv_id")).alias("c"), (-F.col("s.turn")).alias("t"))).alias("b"),
                                  F.count_distinct("nth").alias("n_outside"))
               .select(*row, (-F.col("b.c")).alias("source_conv_id"), (-F.col("b.t")).alias("source_turn"), "n_outside"))
    counts = linked.groupBy(*row).agg(F.count(F.lit(1)).alias("n_within"))

    # root and depth of each (conversation, turn): pointers double until all rest on a root
    nodes = stage.put(placed.select("conv_id", "turn").distinct()
                      .join(best.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")), ["conv_id", "turn"], "left")
                      .select("conv_id", "turn", F.coalesce("up", "turn").alias("up"),
                              F.col("up").isNotNull().cast("int").alias("depth")), "nodes")
    settled, moving = nodes.where("up = turn"), nodes.where("up <> turn")
    while moving.limit(1).count():
        # only nodes whose pointer did not yet rest on a root are joined again
        above = settled.unionByName(moving).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"),
                                                   F.col("depth").alias("more"))
        new = stage.put(moving.join(above, ["conv_id", "up"])
                        .select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
                                (F.col("next") != F.col("up")).alias("moved")), "nodes")
        settled = settled.unionByName(new.where("not moved").drop("moved"))
        moving = new.where("moved").drop("moved")
    nodes = settled
    out = (m.select(*row, "role", "body", F.size("quotes").alias("n_quotes"))
           .join(best, row, "left").join(counts, row, "left").join(outside, row, "left")
           .join(nodes.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth"), ["conv_id", "turn"], "left")
           .withColumn("n_linked", F.coalesce("n_within", F.lit(0)) + F.coalesce("n_outside", F.lit(0)))
           .withColumn("root_turn", F.coalesce("root_turn", "turn"))
           .withColumn("depth", F.coalesce("depth", F.lit(0)))
           .withColumn("__c", F.coalesce("conv_id", F.lit(_LOWEST)))
           .withColumn("__r", F.coalesce("root_turn", F.lit(_LOWEST))).withColumn("__t", F.coalesce("turn", F.lit(_LOWEST)))
           .drop("n_within", "n_outside"))
    out = stage.put(out, "linked")
    ranked = with_group_rank(out.select("__c", "__r", "__t", "role", *row), ["__c"],
                             ["__r", "__t", "role", "key", "key2"], "position")
    place = [F.coalesce("conv_id", F.lit(_LOWEST)).alias("__c"), F.coalesce("turn", F.lit(_LOWEST)).alias("__t")]
    ranked = ranked.select(*place, "key", "key2", "position")
    return (out.join(ranked, ["__c", "__t", "key", "key2"])
            .select("conv_id", "turn", "role", "body", "n_quotes", "n_linked", "parent_turn", "source_conv_id",
                    "source_turn", "root_turn", "depth", "position"))
