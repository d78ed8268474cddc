"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is turned by several random rotations and each turned vector is
replaced by its signs.  The scalar product of a vector with its own sign
vector is stored as a correction factor: dividing by it makes the product of
another vector with the signs an unbiased estimate of their inner product, with
a known deviation.  Short runs of the sign bits are also the bucket keys by
which similar vectors meet.

Groups of copies never become all pairs: a vector within half the linking
angle of a bucket's pivot joins the pivot's class, and by the triangle
inequality of angles any two members of a class are linked.  Their links are
counted, not listed.  Only pairs from different classes are candidates; a
Hamming bound on the codes thins them in the join, the estimate's upper
confidence bound decides which of them need exact recomputation, and only
exact cosines make links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage, components

CODE_BITS = 256


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int) -> np.ndarray:
    """Random rotations of a dimension, enough for ``bits`` sign bits; the same on every executor."""
    rng = np.random.default_rng(dim)
    count = -(-bits // dim)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def _units(rows: list) -> tuple[list[int], list[np.ndarray]]:
    """Rows that hold a usable vector, and those scaled to length one."""
    at, out = [], []
    for i, row in enumerate(rows):
        if not row or any(x is None for x in row):
            continue
        v = np.array(row, float)
        if not np.isfinite(v).all():
            continue
        top = np.abs(v).max()
        if top > 0:
            v = v / top
            at.append(i)
            out.append(v / np.linalg.norm(v))
    return at, out


def _encode(batches: Iterator[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    need = max(tables * bits, CODE_BITS)
    powers = (1 << np.arange(bits)).astype(np.int64)
    for batch in batches:
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        at, units = _units(batch.column("embedding").to_pylist())
        for dim in sorted({len(u) for u in units}):
            some = [(i, u) for i, u in zip(at, units) if len(u) == dim]
            x = np.stack([u for _, u in some])
            turned = np.einsum("nd,rde->nre", x, rotations(dim, need))
            signs = (turned > 0).reshape(len(x), -1)
            factor = np.abs(turned).sum(axis=2) / math.sqrt(dim)
            keys = signs[:, :tables * bits].reshape(len(x), tables, bits) @ powers
            packed = np.packbits(signs, axis=1)
            code = np.ascontiguousarray(packed[:, :CODE_BITS // 8]).view(np.int64)
            yield pa.record_batch(
                [pa.array([ids[i] for i, _ in some], pa.int64()), pa.array([labels[i] for i, _ in some], pa.int64()),
                 pa.array([dim] * len(some), pa.int32()), pa.array(list(keys), pa.list_(pa.int64())),
                 pa.array(list(code), pa.list_(pa.int64())), pa.array([p.tobytes() for p in packed], pa.binary()),
                 pa.array(list(factor), pa.list_(pa.float64()))],
                names=["vec_id", "label", "dim", "keys", "code", "signs", "factor"])


def _possible(batches: Iterator[pa.RecordBatch], bits: int, least: float, z: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimated inner product may reach ``least`` at z standard deviations."""
    for batch in batches:
        query = batch.column("embedding").to_pylist()
        signs, factor = batch.column("signs").to_pylist(), batch.column("factor").to_pylist()
        keep = np.zeros(len(query), bool)
        _, units = _units(query)
        dims = np.array([len(u) for u in units])
        for dim in set(dims.tolist()):
            rows = np.flatnonzero(dims == dim)
            turn = rotations(dim, bits)
            y = np.einsum("nd,rde->nre", np.stack([units[i] for i in rows]), turn)
            n_bits = turn.shape[0] * dim
            s = np.unpackbits(np.stack([np.frombuffer(signs[i], np.uint8) for i in rows]), axis=1)[:, :n_bits]
            s = s.reshape(len(rows), turn.shape[0], dim) * 2.0 - 1.0
            f = np.array([factor[i] for i in rows])
            estimate = ((s * y).sum(axis=2) / math.sqrt(dim) / f).mean(axis=1)
            spread = np.sqrt(((1 - np.minimum(f, 1) ** 2) / f ** 2 / max(dim - 1, 1)).sum(axis=1)) / turn.shape[0]
            keep[rows] = estimate + z * spread >= least - 1e-9
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def _scaled(x: str) -> Column:
    """The vector times a power of two that brings its largest component near 1: exact, and squares stay finite."""
    most = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    power = F.when((most > 0) & (most < float("inf")), F.least(F.greatest(F.floor(F.log2(most)), F.lit(-1000)), F.lit(1000)))
    return F.transform(x, lambda v: v.cast("double") * F.pow(F.lit(2.0), -power))


def _hamming(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(CODE_BITS // 64)), F.lit(0))


def _most_bits(angle: float, z: float) -> int:
    p = angle / math.pi
    return math.ceil(CODE_BITS * p + z * math.sqrt(CODE_BITS * p * (1 - p)))


def near_vectors(vectors: DataFrame, least: float = 0.93, tables: int = 64, bits: int = 12,
                 z: float = 5.5) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``least``.

    ``vectors(vec_id, embedding, label)`` gives one row per distinct non-null
    vec_id: vec_id, n_links, component_id, kept.  Vectors that are null, empty,
    zero or hold null or non-finite components, and vectors with a null label,
    link with nothing; vectors of different lengths never link.  Of repeated
    vec_ids the row with the smallest (label, vector) counts; rows with a null
    vec_id are left out.  Extra columns are ignored.

    A pair at the threshold misses all ``tables`` buckets with probability
    2e-7 at the defaults; for very many vectors of one label raise ``bits``
    by one and ``tables`` by a seventh per doubling.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "vectors")
    every = stage.put(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
        .select("vec_id", "v.label", F.col("v.embedding").cast("array<float>").alias("embedding")
                if dict(vectors.dtypes)["embedding"] == "array<float>" else "v.embedding"), "vectors")
    coded = stage.put(every.where("label is not null and embedding is not null").mapInArrow(
        partial(_encode, tables=tables, bits=bits),
        "vec_id long, label long, dim int, keys array<long>, code array<long>, signs binary, factor array<double>"),
        "codes")
    place = ["label", "dim", "at", "key"]
    spots = coded.select("vec_id", "label", "dim", F.posexplode("keys").alias("at", "key"))

    # classes: vectors within half the linking angle of a pivot
    full, half = math.acos(least), math.acos(least) / 2
    pivots = (spots.groupBy(*place).agg(F.min("vec_id").alias("pivot"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    stars = spots.join(pivots, place).where("vec_id <> pivot").select(F.col("pivot").alias("a"),
                                                                      F.col("vec_id").alias("b")).distinct()
    codes = coded.select("vec_id", "code")

    def with_codes(pairs: DataFrame) -> DataFrame:
        return (pairs.join(codes.select(F.col("vec_id").alias("a"), F.col("code").alias("code_a")), "a")
                .join(codes.select(F.col("vec_id").alias("b"), F.col("code").alias("code_b")), "b"))

    whole = (every.select("vec_id", _scaled("embedding").alias("embedding"))
             .withColumn("size", F.sqrt(_dot("embedding", "embedding"))))

    def cosines(pairs: DataFrame) -> DataFrame:
        left = whole.select(F.col("vec_id").alias("a"), F.col("embedding").alias("e_a"), F.col("size").alias("z_a"))
        right = whole.select(F.col("vec_id").alias("b"), F.col("embedding").alias("e_b"), F.col("size").alias("z_b"))
        return (pairs.join(left, "a").join(right, "b")
                .select("a", "b", (_dot("e_a", "e_b") / (F.col("z_a") * F.col("z_b"))).alias("cosine")))

    close = (with_codes(stars).where(_hamming("code_a", "code_b") <= _most_bits(half, z)).select("a", "b"))
    in_class = (cosines(close).where(F.col("cosine") >= math.cos(half) + 1e-9)
                .groupBy(F.col("b").alias("vec_id")).agg(F.min("a").alias("class")))
    classed = stage.put(coded.select("vec_id", "label", "dim", "keys", "code").join(in_class, "vec_id", "left")
                        .withColumn("class", F.coalesce("class", "vec_id")), "classes")

    # candidates: pairs of different classes that share a bucket
    spots = classed.select("vec_id", "class", "label", "dim", "code", F.posexplode("keys").alias("at", "key"))
    mixed = (spots.groupBy(*place).agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .where("lo < hi").select(*place))
    met = stage.put(spots.join(mixed, place, "left_semi"), "met")
    x, y = (met.select(*[F.col(c).alias(f"{c}_{s}") for c in (*place, "vec_id", "class", "code")]) for s in "ab")
    same = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in place]
    found = (x.join(y, [*same, F.col("vec_id_a") < F.col("vec_id_b"), F.col("class_a") != F.col("class_b"),
                        _hamming("code_a", "code_b") <= _most_bits(full, z)])
             .select(F.col("vec_id_a").alias("a"), F.col("vec_id_b").alias("b")).distinct())
    estimated = (found.join(every.select(F.col("vec_id").alias("a"), "embedding"), "a")
                 .join(coded.select(F.col("vec_id").alias("b"), "signs", "factor"), "b")
                 .mapInArrow(partial(_possible, bits=max(tables * bits, CODE_BITS), least=least, z=z),
                             "a long, b long"))
    links = stage.put(cosines(estimated).where(F.col("cosine") >= least).select("a", "b"), "links")

    own = stage.put(every.select("vec_id").join(classed.select("vec_id", "class"), "vec_id", "left")
                    .withColumn("class", F.coalesce("class", "vec_id")), "members")
    sizes = own.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("mates"))
    across = (links.select(F.col("a").alias("vec_id")).unionByName(links.select(F.col("b").alias("vec_id")))
              .groupBy("vec_id").agg(F.count(F.lit(1)).alias("across")))
    bridges = (links.join(own.select(F.col("vec_id").alias("a"), F.col("class").alias("p")), "a")
               .join(own.select(F.col("vec_id").alias("b"), F.col("class").alias("q")), "b")
               .select(F.col("p").alias("a"), F.col("q").alias("b")).where("a <> b").distinct())
    joined = components(spark, bridges, stage)
    grouped = (own.join(joined.select(F.col("id").alias("class"), "component"), "class", "left")
               .withColumn("component", F.coalesce("component", "class")))
    firsts = grouped.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return (grouped.join(sizes, "class", "left").join(across, "vec_id", "left").join(firsts, "component")
            .select("vec_id", (F.col("mates") + F.coalesce("across", F.lit(0))).cast("long").alias("n_links"),
                    "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
