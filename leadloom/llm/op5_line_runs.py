"""Exact line deduplication over levelled sorted runs of line hashes.

A run is a sorted table of line keys: hash, number of documents and,
where the key was new to the index when the run was added, the document that
keeps the line.  ``LineRuns.add`` merge-joins a batch with all runs, so that
only keys that no run holds are new, and adds the batch's own run at level 0.  When a level holds ``fanout`` runs they are merged into one
run of the next level, so an index over n batches has O(log n) runs.

Batches come in descending order of doc_id: a key that no run holds is kept by
the largest doc_id of the batch at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage

# The white space that a key is stripped of.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    """A text's lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(lines: DataFrame, least_chars: int) -> DataFrame:
    """128-bit keys of the lines that are long enough."""
    key = line_key(F.col("line"))
    return (lines.withColumn("key", key).where(F.length("key") >= least_chars)
            .withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(1), "key"))
            .drop("line", "key"))


class LineRuns:
    """The levelled index.  Runs are tables under the shared folder, dealt by hash and sorted in each file."""

    def __init__(self, stage: Stage, fanout: int = 2):
        self.stage, self.fanout = stage, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        return self.stage.put(run.sortWithinPartitions("h1", "h2"), "run")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, doc_id: one row per line) as a run of its own."""
        own = (batch.distinct().groupBy("h1", "h2")
               .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")))
        for run in self.runs():
            # a sort-merge join finds the keys that a run holds; only keys new to the index get a keeper
            seen = run.where("keeper is not null").select("h1", "h2", F.col("keeper").alias("seen"))
            own = (own.join(seen, ["h1", "h2"], "left")
                   .withColumn("keeper", F.when(F.col("seen").isNull(), F.col("keeper"))).drop("seen"))
        self._push(0, self._write(own.select("h1", "h2", "docs", "keeper")))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            for table in old:
                self.stage.drop(table)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        # a key has one non-null keeper: from the batch that brought it first
        return both.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def frequent(self, least_docs: int) -> DataFrame:
        """Keys found in at least ``least_docs`` documents, with the keeping document."""
        return self._merged(self.runs()).where(F.col("docs") >= least_docs).select("h1", "h2", "keeper")

    def close(self) -> None:
        for run in self.runs():
            self.stage.drop(run)
        self.levels = []


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4,
                fanout: int = 2) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and kept_text.

    A line whose key has at least ``least_chars`` code points and stands in at
    least ``least_docs`` documents goes from all of them but the one with the
    largest doc_id; in that one every repeat stays.  Other lines stay in order,
    joined by newlines.

    Null and empty texts are one empty line, which is kept.  Rows with a null
    doc_id count as no document and lose every line that is dropped anywhere.
    Repeated doc_ids are one document.  All columns of ``docs`` stay; columns
    of the names n_lines, n_dropped and kept_text are replaced.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = src.select("doc_id", F.xxhash64("text").alias("text_key"),
                          F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = stage.put(_hashed(numbered, least_chars), "keys")
    cuts = keyed.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)
                     .alias("c")).head()["c"] or [] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    index = LineRuns(stage, fanout)
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        batch = keyed.where("doc_id is not null").select("h1", "h2", "doc_id")
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        index.add(batch)
    hot = stage.put(index.frequent(least_docs), "frequent")
    index.close()

    # which lines go: (document, line number), then one short array per document
    gone = (keyed.join(hot, ["h1", "h2"])
            .where("doc_id is null or doc_id <> keeper")
            .groupBy(F.coalesce("doc_id", F.lit(0)).alias("__d"), F.col("doc_id").isNull().alias("__n"),
                     F.col("text_key").alias("__t"))
            .agg(F.collect_set("at").alias("__gone")))
    typed = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                              "__n": F.col("doc_id").isNull(), "__t": F.xxhash64(F.col("text").cast("string"))})
    lines = lines_of(F.col("text").cast("string"))
    some = F.col("__gone").isNotNull()
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")),
                       lambda i: F.get(F.col("__lines"), i))
    return (typed.join(gone, ["__d", "__n", "__t"], "left").withColumn("__lines", lines)
            .withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dropped", F.when(some, F.size("__gone")).otherwise(F.lit(0)).cast("long"))
            .withColumn("kept_text", F.when(some, F.array_join(kept, "\n"))
                        .otherwise(F.coalesce(F.col("text").cast("string"), F.lit(""))))
            .drop("__d", "__n", "__t", "__gone", "__lines"))
