"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Every shingle visits the signature's slots in its own random order; a slot
keeps the smallest (visit number, random value).  Signatures are built visit
by visit for a whole batch of documents, and a document stops as soon as all
its slots are filled, since later visits carry larger values.

Groups of copies never become all pairs:

1.  Documents with equal shingle sets form a class (one aggregate on a
    128-bit set hash); only class representatives go on.
2.  In every band bucket the class with most copies is the pivot.  Members
    are compared with the pivot only, on their full shingle sets.
3.  Members of linked pivots that union-find has not yet joined are compared
    with each other if their sizes, what each exactly shares with a
    reference pivot, a parity map of their sets and a 1,024-bit signature
    sketch allow the similarity; those few pairs are confirmed on full sets too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Stage, WordHashes, components, mix, slices

SLOTS = 512
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased and words are runs without ASCII white space.  With
    fewer words than ``size`` the whole sequence is one shingle; without words
    the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, n)
    width = min(size, n)
    acc = mix(np.full(n - width + 1, width, U64))
    for k in range(width):
        acc = mix(acc ^ h[k:n - width + 1 + k])
    return np.unique(acc)


def _signatures_of(h: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures of documents whose element hashes stand in ``h``."""
    sig = np.full(docs * m, _EMPTY, U64)
    order = None
    for visit in range(m):
        z = mix(h + U64((visit * 2 + 1) * 0xD6E8FEB86659FD93 % 2 ** 64))
        pick = (visit + (((mix(z) >> U64(33)) * U64(m - visit)) >> U64(31)).astype(np.int64))
        if visit == 0:
            slot = first = pick
        else:
            rows = np.arange(len(h))
            if order is None:
                order = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(h), m)).copy()
                order[rows, first], order[:, 0] = 0, first
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, visit]
            order[:, visit] = slot
        np.minimum.at(sig, doc * m + slot, (U64(visit) << U64(54)) | (z >> U64(10)))
        open_docs = (sig.reshape(docs, m) == _EMPTY).any(axis=1)
        if not open_docs.any():
            break
        keep = open_docs[doc]
        if not keep.all():
            h, doc, first = h[keep], doc[keep], first[keep]
            order = order[keep] if order is not None else None
    return sig.reshape(docs, m)


def signatures(sets: list[np.ndarray], m: int = SLOTS, most: int = 30_000) -> np.ndarray:
    """Signatures of many shingle sets; work is cut into pieces of about ``most`` elements."""
    out = np.full((len(sets), m), _EMPTY, U64)
    by_size = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    start = 0
    while start < len(by_size):
        end, total = start, 0
        while end < len(by_size) and (end == start or total + len(sets[by_size[end]]) <= most):
            total += len(sets[by_size[end]])
            end += 1
        ids = by_size[start:end]
        out[ids] = _signatures_of(np.concatenate([sets[i] for i in ids]),
                                  np.repeat(np.arange(len(ids)), [len(sets[i]) for i in ids]), len(ids), m)
        start = end
    return out


_SIGN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                   ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
#: Bits of the parity map; the fewer members a set has, the nearer the map's distance is to the sets'.
PARITY = 1024


_SALTS = (0x1234567, 0x89ABCDEF01)


def _set_hash(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """64-bit hash of each set, the same in any order of its members."""
    return np.array([mix(s ^ U64(salt)).sum(dtype=U64) for s in sets], U64).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, rows.shape[1], dtype=np.int32), flat)


def _parity(members: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` cells whether an odd number of members falls into it, packed into words.

    A cell differs only where the two sets do, so two maps differ in no more
    bits than the sets have members of their own.
    """
    cells = np.bincount((members >> U64(17)).astype(np.int64) & (PARITY - 1), minlength=PARITY)
    return np.packbits((cells & 1).astype(np.uint8)).view(U64)


def _sign(batches: Iterator[pa.RecordBatch], size: int, m: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(texts):
            sets = [shingle_set(t, size, hashes) for t in texts[i:j]]
            sig = signatures(sets, m)
            band = np.zeros((j - i, bands), U64)
            for k in range(rows):
                band = mix(band ^ sig[:, k:bands * rows:rows])
            band = mix(band + np.arange(bands, dtype=U64))
            bit = mix(sig)
            planes = [np.packbits(((bit >> U64(k)) & U64(1)).astype(np.uint8), axis=1) for k in (0, 1)]
            yield pa.record_batch([
                batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                *[pa.array(_set_hash(sets, salt)) for salt in _SALTS], _lists(band),
                _lists(np.concatenate(planes, axis=1).view(U64)), _lists(np.stack([_parity(s) for s in sets]))], schema=_SIGN)


def _shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(texts):
            sets = [shingle_set(t, size, hashes) for t in texts[i:j]]
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(_set_hash(sets, _SALTS[0])),
                                   pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                  names=["doc_id", "set_a", "shingles"])


def _mismatches(a: str, b: str, words: int):
    """Slots whose two sketch bits differ, as a sum of bit counts."""
    half = words // 2
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])
                            .bitwiseOR(F.col(a)[k + half].bitwiseXOR(F.col(b)[k + half]))) for k in range(half)),
               F.lit(0))


def most_mismatches(slots: int, percent: int, miss: float) -> int:
    """Sketch mismatches that a pair at the threshold passes with a probability of at most ``miss``.

    A slot differs with probability 1 - percent / 100 and shows it in one of
    its two bits with 3/4; the exact binomial tail, whatever the sets' sizes.
    """
    p = (1 - percent / 100) * 0.75
    if p <= 0:
        return 0
    tail = 0.0
    for k in range(slots, -1, -1):
        tail += exp(lgamma(slots + 1) - lgamma(k + 1) - lgamma(slots - k + 1) + k * log(p) + (slots - k) * log(1 - p))
        if tail > miss:
            return k
    return 0


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, slots: int = SLOTS,
                    bands: int = 32, rows: int = 6, broadcast_ids: int = 4_000_000,
                    miss: float = 1e-7) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)`` by Jaccard similarity of word shingles.

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for
    their full shingle sets.  Returns doc_id, n_shingles, component_id, kept,
    one row per distinct non-null doc_id.

    Null and empty texts (and texts of white space) have an empty set: they
    link with nothing.  Rows with a null doc_id are left out, since a group is
    named by an id.  Repeated doc_ids: the rows count as one document if their
    sets are equal; otherwise the row with the smallest set hash stands for the
    id.  Extra columns are ignored.

    With the defaults a pair at the threshold of 0.85 shares no band with
    probability 3e-7, one at 0.8 with 6e-5 (raise ``bands`` to lower it);
    the sketch filter before a comparison of step 3 misses one at the
    threshold with a probability of at most ``miss``.  Ids of the
    documents whose sets are needed are broadcast up to ``broadcast_ids`` of
    them (8 bytes each); beyond that their texts are found by a shuffled join.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id is not null")
    signed = stage.put(src.mapInArrow(partial(_sign, size=shingle, m=slots, bands=bands, rows=rows),
                                      "doc_id long, n long, set_a long, set_b long, bands array<long>, "
                                      "sketch array<long>, parity array<long>"), "signed")
    key = ["n", "set_a", "set_b"]
    one = stage.put(signed.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k"))
                    .select("doc_id", "k.*"), "documents")
    classes = stage.put(one.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"),
                                                             F.count(F.lit(1)).alias("copies")), "classes")
    heads = stage.put(signed.join(classes.select(F.col("class_id").alias("doc_id"), *key, "copies"),
                                  ["doc_id", *key]).dropDuplicates(["doc_id"])
                      .select(F.col("doc_id").alias("id"), "n", "set_a", "copies", "bands", "sketch", "parity"), "heads")

    banded = heads.select("id", F.struct("copies", (-F.col("id")).alias("neg")).alias("rank"),
                          F.explode("bands").alias("band"))
    pivots = (banded.groupBy("band").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("size"))
              .where("size > 1").select("band", (-F.col("top.neg")).alias("pivot")))
    members = stage.put(banded.select("band", "id").join(pivots, "band").select("pivot", "id").distinct(), "members")

    info = heads.select("id", "n")
    sized = (members.where("pivot <> id").join(info, "id")
             .join(info.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n")), "pivot")
             .where(F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n")))
    pairs = stage.put(sized.select(F.col("pivot").alias("a"), F.col("id").alias("b")), "pairs")
    # all that any comparison can need: the members of a pivot
    wanted = stage.put(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    sets = stage.put(src.join(wanted, "doc_id", "left_semi")
                     .mapInArrow(partial(_shingles, size=shingle), "doc_id long, set_a long, shingles array<long>")
                     .join(heads.select(F.col("id").alias("doc_id"), "n", "set_a"), ["doc_id", "set_a"])
                     .dropDuplicates(["doc_id"])
                     .select(F.col("doc_id").alias("id"), "n", "shingles"), "sets")

    def measured(found: DataFrame) -> DataFrame:
        """Exact similarity of each pair, from full sets."""
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
        both = found.join(left, "a").join(right, "b").select(
            "a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))
        union = F.col("n_a") + F.col("n_b") - F.col("common")
        return both.select("a", "b", (F.lit(100) * F.col("common") >= F.lit(percent) * union).alias("linked"),
                           "common")

    seen = stage.put(measured(pairs), "measured")
    links = seen.where("linked").select("a", "b")
    groups = components(spark, links, stage)

    def grouped(df: DataFrame, column: str, out: str) -> DataFrame:
        return (df.join(groups.select(F.col("id").alias(column), F.col("component").alias("__c")), column, "left")
                .withColumn(out, F.coalesce("__c", column)).drop("__c"))

    # pivots that are linked count as one, so a pair meets once; the pivot with most members is the reference
    placed = grouped(grouped(members, "id", "group"), "pivot", "meeting")
    counted = stage.put(placed.groupBy("meeting", "pivot").agg(F.count(F.lit(1)).alias("size"),
                                                              F.min("group").alias("lo"), F.max("group").alias("hi")),
                        "pivots")
    mixed = counted.groupBy("meeting").agg(F.max(F.struct("size", "pivot")).alias("top"), F.min("lo").alias("lo"),
                                           F.max("hi").alias("hi")) \
        .where("lo < hi").select("meeting", F.col("top.pivot").alias("reference"))
    rest = stage.put(placed.select("meeting", "id", "group").distinct().join(mixed, "meeting")
                     .join(seen.select(F.col("a").alias("reference"), F.col("b").alias("id"), "common"),
                           ["reference", "id"], "left")
                     .join(heads.select("id", "n", "sketch", "parity"), "id"), "rest")
    most = most_mismatches(slots, percent, miss)
    fields = ("id", "group", "n", "sketch", "parity", "common")
    x = rest.select("meeting", *[F.col(c).alias(f"{c}_a") for c in fields])
    y = rest.select("meeting", *[F.col(c).alias(f"{c}_b") for c in fields])
    # what two documents share lies in the reference, in both, or outside it, in both
    shared = (F.least("common_a", "common_b")
              + F.least(F.col("n_a") - F.col("common_a"), F.col("n_b") - F.col("common_b")))
    apart = F.lit(100) * shared < F.lit(percent) * (F.col("n_a") + F.col("n_b") - shared)
    # sets of the similarity differ in at most (100 - percent) of (100 + percent) parts of their sizes' sum; no pair is lost by this
    own = sum((F.bit_count(F.col("parity_a")[k].bitwiseXOR(F.col("parity_b")[k])) for k in range(PARITY // 64)), F.lit(0))
    differ = F.lit(100 + percent) * own > F.lit(100 - percent) * (F.col("n_a") + F.col("n_b"))
    left_over = (x.join(y, (x["meeting"] == y["meeting"]) & (F.col("id_a") < F.col("id_b"))
                        & (F.col("group_a") != F.col("group_b"))
                        & (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
                        & ~F.coalesce(apart, F.lit(False))
                        & ~differ & (_mismatches("sketch_a", "sketch_b", slots // 32) <= most))
                 .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    known = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left_over = stage.put(left_over.join(known, ["a", "b"], "left_anti"), "left_over")
    more = stage.put(measured(left_over).where("linked").select("a", "b"), "more")
    if more.limit(1).count():
        groups = components(spark, links.unionByName(more), stage)
    out = (one.join(classes.select(*key, "class_id"), key, "left")
           .withColumn("class_id", F.coalesce("class_id", "doc_id")))
    out = grouped(out, "class_id", "component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))
