"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy on the executors.  The trees
are grown on a bounded sample of labelled rows (a documented parameter), with
feature values replaced by quantile bins and splits found from per-bin sums of
gradients.  A tree is a complete binary tree in arrays (feature, threshold,
leaf), so a block of rows walks all trees level by level in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage
from .op3_kneser_ney import held_out

FEATURES = ("log_bytes", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits",
            "spaces", "newlines", "stops", "commas", "pipes", "other_marks", "wide", "log_lines", "line_length",
            "distinct_lines", "top_line", "distinct_words", "top_word", "repeats_before", "top_pair",
            "lines_ending_sentence", "capital_words", "all_capital_words", "words_with_marks", "short_words",
            "long_words", "mark_run_words", "top_letter", "byte_entropy")

_MARK_RUN = re.compile(rb"[^\w\s\x80-\xff]{2,}$")


def statistics(text: str | None) -> list[float]:
    """One value per name in FEATURES, over the whole text; an empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = float(len(raw))
    words = raw.split()
    lines = raw.split(b"\n")
    lower = h[97:123].sum()
    upper = h[65:91].sum()
    digits = h[48:58].sum()
    spaces = h[32] + h[9]
    wide = h[128:].sum()
    letters = lower + upper + wide
    other = n - letters - digits - spaces - h[10] - h[46] - h[44] - h[124]
    p = h[h > 0] / n
    line_counts = Counter(lines)
    w = float(max(len(words), 1))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    pairs = Counter(zip(words, words[1:]))
    kinds = marks = capitals = shouting = runs = 0
    for word, times in counts.items():
        clean = word.strip(b".,;:!?'\"()")
        if not clean.isalnum() and not clean.translate(None, bytes(range(128, 256))).isalnum() and clean:
            marks += times
        if word[:1].isupper():
            capitals += times
            if len(clean) > 1 and clean.isupper():
                shouting += times
        if _MARK_RUN.search(word):
            runs += times
        kinds += 1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), letters / n, upper / n, digits / n,
            spaces / n, h[10] / n, h[46] / n, h[44] / n, h[124] / n, other / n, wide / n, np.log(len(lines)),
            n / len(lines), len(line_counts) / len(lines), max(line_counts.values()) / len(lines), kinds / w,
            max(counts.values(), default=0) / w, repeats / w, max(pairs.values(), default=0) / w,
            sum(c for x, c in line_counts.items() if x.rstrip()[-1:] in (b".", b"!", b"?")) / len(lines),
            capitals / w, shouting / w, marks / w, (lengths <= 2).mean(), (lengths >= 14).mean(), runs / w,
            h[97:123].max() / n, float(-(p * np.log(p)).sum())]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for i in range(0, len(texts), 256):
            part = texts.slice(i, 256)
            flat = np.array([statistics(t.as_py()) for t in part], np.float32).reshape(-1)
            arrays = [c.slice(i, 256) for c in (batch.column("row_id"),)]
            width = len(FEATURES)
            yield pa.record_batch([*arrays, pa.ListArray.from_arrays(
                np.arange(0, flat.size + 1, width, dtype=np.int32), flat)], names=["row_id", "stats"])


@dataclass
class Trees:
    """All trees as arrays of shape (trees, nodes); leaf values of shape (trees, 2 ** depth)."""
    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            out += self.leaf[t][node - (2 ** self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64,
         ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost logistic-loss trees; every level's splits come from one histogram of gradients per node and feature."""
    n, f = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** depth - 1
    model = Trees(depth, base, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                  np.zeros((trees, 2 ** depth)))
    if not n or share in (1e-3, 1 - 1e-3):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    offset = code + np.arange(f) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here = 2 ** level
            start = here - 1
            cell = ((node - start)[:, None] * (f * bins) + offset).reshape(-1)
            sums = [np.bincount(cell, np.repeat(v, f), here * f * bins).reshape(here, f, bins) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - all_g ** 2 / (all_h + ridge)
            gain = np.where((left_h * 4 >= least) & (right_h * 4 >= least), gain, -1.0)
            best = gain.reshape(here, -1).argmax(axis=1)
            value = gain.reshape(here, -1)[np.arange(here), best]
            for k in range(here):
                j, b = divmod(int(best[k]), bins)
                if value[k] > 1e-6 and b < len(cuts[j]):
                    model.feature[t, start + k], model.threshold[t, start + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.threshold[t][node])
        leaf = node - nodes
        step = -np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + ridge) * rate
        model.leaf[t] = step
        margin += step[leaf]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, least_score: float = 0.3, sample_rows: int = 20_000,
                  **growing) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` teach where the quality is 0 or 1 and the
    document is not held out; rows with a null doc_id or another quality are
    left out, repeated labels count again.  At most ``sample_rows`` labelled
    rows (smallest hashes) are used.  Statistics and scores cover all rows.

    Null and empty texts have statistics of zero and are scored like any other
    text.  Repeated rows each get a row.  A null doc_id has held_out = null.
    Without usable labels every score is 0.5.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "quality")
    src = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    stats = stage.put(src.mapInArrow(_measure, "row_id long, stats array<float>"), "stats")
    taught = (labels.select(F.col("doc_id").cast("long").alias("row_id"), F.col("quality").cast("int").alias("y"))
              .where("y in (0, 1)").where(~held_out(F.col("row_id"))).join(stats, "row_id"))
    sample = (taught.orderBy(F.xxhash64("row_id"), "row_id", "y", F.xxhash64("stats")).limit(sample_rows)
              .select("y", "stats").toArrow())
    y = sample.column("y").to_numpy().astype(float)
    x = (sample.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False)
         if len(y) else np.zeros(0, np.float32)).reshape(-1, len(FEATURES))
    model = spark.sparkContext.broadcast(grow(x, y, **growing))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("row_id"), pa.array(model.value.scores(rows))],
                                  names=["doc_id", "score"])

    return (stats.mapInArrow(score, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= least_score).cast("int").alias("predicted")))
