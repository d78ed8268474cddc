"""Hard negatives by a vertical scan that drops candidates as dimensions are read.

Vectors lie column by column in chunks, with the smallest and largest value of
every dimension.  An anchor reads the dimensions in descending order of its own
magnitude.  After each few dimensions, a candidate's score lies between its
partial sum plus the least and plus the most that the dimensions not yet read
can add; candidates whose range cannot reach the k best, or no window of
wanted scores, leave the bitmap.  What is left at the end has exact scores.

Anchors meet chunks block by block: a pair of blocks is one row of a join of
two tables of blocks, both read where they are needed.  Neither table passes
the driver, and what a pair returns is bounded by its anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Stage

#: Vectors in a chunk, anchors in a block, dimensions read between two looks at the bounds.
CHUNK, BLOCK, STEP = 4096, 256, 8
#: Scaled components lie below this in magnitude, so that sums of 32,768 products fit 64 bits.
MOST = 1 << 24
MOST_DIMENSIONS = 1 << 15


def _pack(batches: Iterator[pa.RecordBatch], most: int, windows: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v[, windows]) to rows of up to ``most`` vectors of one length, column by column."""
    waiting: dict[int, list] = {}

    def out(rows: list) -> pa.RecordBatch:
        ids, labels, vectors, wanted = zip(*rows)
        matrix = np.array(vectors, np.int32).T.copy()
        spans = np.array([[*(w or ()), *[-1] * (windows - len(w or ()))] for w in wanted], np.int64)
        parts = [np.array(ids, np.int64), np.array(labels, np.int64), matrix, matrix.min(axis=1), matrix.max(axis=1), spans]
        return pa.record_batch([pa.array([len(matrix)], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                               names=["dim", "ids", "labels", "cells", "lo", "hi", "spans"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "windows")]
        for row in zip(*columns):
            rows = waiting.setdefault(len(row[2]), [])
            rows.append(row)
            if len(rows) == most:
                yield out(rows)
                del waiting[len(row[2])]
    for rows in waiting.values():
        yield out(rows)


_PACKED = "dim int, ids binary, labels binary, cells binary, lo binary, hi binary, spans binary"


def bond(columns: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, bitmap: np.ndarray,
         possible: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that stay possible to the end, and their exact scores.

    ``columns`` holds one row per dimension; ``possible(least, most)`` says
    which candidates may still matter, given the bounds of their scores.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    q = q[order]
    ends = np.stack([q * lo[order], q * hi[order]])
    # what the dimensions from each place on can add
    rest_most = np.append(ends.max(axis=0)[::-1].cumsum()[::-1], 0)
    rest_least = np.append(ends.min(axis=0)[::-1].cumsum()[::-1], 0)
    left = np.flatnonzero(bitmap)
    score = np.zeros(len(left), columns.dtype)
    for at in range(0, len(q), STEP):
        dims = order[at:at + STEP]
        read = columns[dims][:, left] if 2 * len(left) > columns.shape[1] else columns[np.ix_(dims, left)]
        score = score + q[at:at + STEP] @ read
        end = min(at + STEP, len(q))
        keep = possible(score + rest_least[end], score + rest_most[end])
        left, score = left[keep], score[keep]
        if not len(left):
            break
    return left, score


def best_possible(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which candidates may be among the k best; equal scores stay, since ids decide between them."""
    def possible(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= k:
            return np.ones(len(least), bool)
        return most >= np.partition(least, len(least) - k)[len(least) - k]
    return possible


def window_possible(windows: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which candidates may be among the k best inside one of the windows (from, to; both included)."""
    def possible(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for low, high in windows:
            may = (most >= low) & (least <= high)
            sure = least[(least >= low) & (most <= high)]
            if len(sure) > k:
                may &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= may
        return keep
    return possible


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _pairs(batches: Iterator[pa.RecordBatch]):
    """The arrays of both sides of each pair of blocks; pairs of different lengths have none."""
    def read(row, side):
        n = len(row[f"ids{side}"]) // 8
        shapes = {"ids": (np.int64, n), "labels": (np.int64, n), "cells": (np.int32, (-1, n)), "lo": (np.int32, -1),
                  "hi": (np.int32, -1), "spans": (np.int64, (n, -1))}
        return {c: np.frombuffer(row[f"{c}{side}"], t).reshape(s) for c, (t, s) in shapes.items() if row[f"{c}{side}"]}

    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row["dim"] == row["dim_a"]:
                chunk, anchors = read(row, ""), read(row, "_a")
                # doubles hold every partial sum exactly, or else whole numbers do
                most = max(int(np.abs(x[c]).max()) for x in (chunk, anchors) for c in ("lo", "hi"))
                kind = np.float64 if most * most * row["dim"] < 1 << 53 else np.int64
                for side, c in ((chunk, "cells"), (anchors, "cells"), (chunk, "lo"), (chunk, "hi")):
                    side[c] = side[c].astype(kind)
                yield chunk, anchors


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of every pair of blocks: the k best others of an anchor's label."""
    for chunk, anchors in _pairs(batches):
        found = []
        for j, (anchor, label) in enumerate(zip(anchors["ids"], anchors["labels"])):
            bitmap = (chunk["labels"] == label) & (chunk["ids"] != anchor)
            left, score = bond(chunk["cells"], chunk["lo"], chunk["hi"], anchors["cells"][:, j], bitmap, best_possible(k))
            best = _best(chunk["ids"][left], score, k)
            found.append((np.full(len(best), anchor), chunk["ids"][left][best], score[best].astype(np.int64)))
        yield _rows(found, ["anchor_id", "vec_id", "score"])


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Of every pair of blocks: the k best of another label inside each of an anchor's windows."""
    for chunk, anchors in _pairs(batches):
        found = []
        for j, (anchor, label) in enumerate(zip(anchors["ids"], anchors["labels"])):
            n, *spans = anchors["spans"][j].tolist()
            scores = spans[:n]
            windows = [(-(-low * s // 100), high * s // 100) for s in scores]
            bitmap = chunk["labels"] != label
            left, score = bond(chunk["cells"], chunk["lo"], chunk["hi"], anchors["cells"][:, j], bitmap,
                               window_possible(windows, k))
            for s, (least, most) in zip(scores, windows):
                inside = np.flatnonzero((score >= least) & (score <= most))
                best = inside[_best(chunk["ids"][left][inside], score[inside], k)]
                found.append((np.full(len(best), anchor), np.full(len(best), s), chunk["ids"][left][best],
                              score[best].astype(np.int64)))
        yield _rows(found, ["anchor_id", "positive_score", "vec_id", "score"])


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)] or [np.empty(0, np.int64)] * len(names)
    return pa.record_batch([pa.array(c) for c in columns], names=names)


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Usable rows, one per vec_id, with components floor(scale * x): vec_id, label, v."""
    if vectors.schema["label"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("label must be a whole number")
    one = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null")
           .groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("v")).select("vec_id", "v.label", "v.e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = one.where("label is not null and e is not null and size(e) between 1 and "
                       f"{MOST_DIMENSIONS}").where(F.coalesce(finite, F.lit(False)))
    near = F.forall("e", lambda x: F.abs(x) * scale < MOST)
    return usable.where(near).select("vec_id", "label", F.transform(
        "e", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors(vec_id, embedding, label)``; ``anchors`` is a condition on
    vec_id.  A score is the whole-number inner product of components
    floor(``scale`` * x).  An anchor's positives are its ``positives`` best
    other rows of its label; for each of them the ``negatives`` best rows of
    other labels with low % <= score / positive_score <= high % (multiplied
    out, so a positive score below 0 has none and one of 0 only zeros) are
    returned.  Higher scores come first, equal ones by the smaller vec_id.

    Rows with a null vec_id, label or vector, an empty vector, or null or
    non-finite components take no part, nor do those with a component of 2^24
    or more after scaling or more than 32,768 dimensions.  Of repeated vec_ids
    the row with the smallest (label, vector) counts; vectors of different
    lengths never meet.  Empty tables give no rows; extra columns are ignored.
    """
    stage = Stage(vectors.sparkSession, "negatives")
    rows = stage.put(scaled(vectors, scale), "scaled")
    asking = rows.where(anchors)

    def packed(df: DataFrame, n: int, most: int, name: str) -> DataFrame:
        return stage.put(df.coalesce(n // most + 1).mapInArrow(partial(_pack, most=most, windows=positives + 1), _PACKED),
                         name)

    none = F.lit(None).cast("array<long>")
    n_rows, n_anchors = rows.count(), asking.count()
    chunks = packed(rows.withColumn("windows", none), n_rows, CHUNK, "chunks")

    def against(df: DataFrame, name: str) -> DataFrame:
        blocks = packed(df, n_anchors, BLOCK, name)
        return chunks.crossJoin(blocks.select(*[F.col(c).alias(f"{c}_a") for c in blocks.columns]))

    first = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = stage.put(
        against(asking.withColumn("windows", none), "anchors")
        .mapInArrow(partial(_positives, k=positives), "anchor_id long, vec_id long, score long")
        .withColumn("n", first).where(F.col("n") <= positives).drop("n"), "positives")
    # at most `positives` scores per anchor: their number, then the distinct ones
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("w")).select(
        "vec_id", F.concat(F.array(F.size("w").cast("long")), F.array_sort("w")).alias("windows"))
    inside = F.row_number().over(W.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id"))
    hard = (against(asking.join(windows, "vec_id"), "windows")
            .mapInArrow(partial(_negatives, k=negatives, low=low, high=high),
                        "anchor_id long, positive_score long, vec_id long, score long")
            .withColumn("rank", inside).where(F.col("rank") <= negatives))
    return (best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            .join(hard, ["anchor_id", "positive_score"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
