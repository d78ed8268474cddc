"""Merkle manifest of a dataset: leaf places by rank in bitmaps, levels reduced in keyed slot arrays.

Where a leaf stands in its group's order is a rank query, not a sort.  The ids
of a group are a sparse bitmap, kept as its non-zero words of 64 bits with the
number of rows each holds; ``bit_or`` merges what the tasks saw.  A directory
of row counts over four levels of the id's upper bits (at most 65,536 entries
below one node, so no window holds an unbounded group) gives the rows before a
word, and the word's masked population count those before an id.

Leaves then go, by place, into arrays of ``fanout ** depth`` keyed slots.  One
pass over the arrays folds ``depth`` levels at once; the arrays' roots are the
next round's nodes.  Paths come back down the same way: each array gets the
path above it and hands every slot its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scan import with_group_rank
from .common import Stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"
_WORD = ["g", "no_id", "word"]
#: Upper bits of a word's number that name its node on each level of the directory.
_SHIFTS = (10, 26, 42)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the fields one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A non-null text that sorts as the group does: null first, then by UTF-8 bytes."""
    return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("s"), value.cast("string")))


# ---- places ------------------------------------------------------------------------------------
def bitmap_words(rows: DataFrame) -> DataFrame:
    """Per (g, no_id, word): the bitmap of the ids and the number of rows; ``plain`` if no id repeats."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    return (rows.groupBy(*_WORD).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
            .withColumn("plain", F.coalesce(F.bit_count("bits") == F.col("n"), F.lit(False))))


def directory(words: DataFrame, stage: Stage) -> DataFrame:
    """The words with ``before`` (rows of the group in front of each) and ``total`` (rows of the group).

    Rows without an id come first.
    """
    def up(k: int) -> Column:
        return F.shiftright("word", _SHIFTS[k]).alias(f"up{k}")

    ids = words.where("not no_id").select("g", "word", "n", *[up(k) for k in range(3)])
    per = [ids]
    for k in range(3):
        per.append(stage.put(per[-1].groupBy("g", *[f"up{j}" for j in range(k, 3)]).agg(F.sum("n").alias("n")),
                             f"directory{k}"))
    whole = words.groupBy("g").agg(F.sum("n").alias("total"),
                                   F.sum(F.when(F.col("no_id"), F.col("n")).otherwise(0)).alias("before"))
    above, key = whole, ["g"]
    for k in (3, 2, 1, 0):
        own = f"up{k - 1}" if k else "word"
        inside = F.sum("n").over(W.partitionBy("g", *[f"up{j}" for j in range(k, 3)]).orderBy(own)
                                 .rowsBetween(W.unboundedPreceding, -1))
        level = per[k].withColumn("inside", F.coalesce(inside, F.lit(0)))
        below = [*key, own] if k else ["g", "word"]
        above = (level.join(above, key).withColumn("before", F.col("before") + F.col("inside"))
                 .select(*below, "before", "total"))
        key = below
    first = whole.select("g", F.lit(True).alias("no_id"), F.lit(0).cast("long").alias("word"),
                         F.lit(0).cast("long").alias("before"), "total")
    return words.join(above.withColumn("no_id", F.lit(False)).unionByName(first), _WORD)


def place(rows: DataFrame, stage: Stage) -> DataFrame:
    """``rows`` (g, no_id, word, doc_id, leaf, row_no, ...) with ``pos`` (0-based, in the group) and ``total``.

    Only words in which an id repeats, and rows without an id, are ordered (by
    id, then leaf), in ranges of bounded size.
    """
    words = stage.put(bitmap_words(rows), "words")
    ranked = stage.put(directory(words, stage), "ranked")
    bit = F.col("doc_id").bitwiseAND(63).cast("int")
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    found = rows.join(ranked.select(*_WORD, "bits", "plain", "before", "total"), _WORD)
    placed = (found.where("plain").withColumn("pos", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(lower)))
              .drop("bits", "plain", "before"))
    if ranked.where("not plain").limit(1).count():
        order = ["doc_id", "leaf", "row_no"]
        rest = with_group_rank(found.where("not plain").drop("bits", "plain"), _WORD, order, "rank")
        placed = placed.unionByName(
            rest.withColumn("pos", F.col("before") + F.col("rank") - 1).drop("before", "rank"))
    return placed


# ---- levels ------------------------------------------------------------------------------------
def levels_of(n: int, fanout: int) -> int:
    """How often ``n`` nodes are grouped until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _hex(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def _slots(block: list[dict]) -> list[str]:
    """Hashes of an array by slot."""
    out: list[str] = [""] * len(block)
    for s in block:
        out[s["slot"]] = s["hash"].hex()
    return out


def _up(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """All levels of an array, the given one first."""
    out = [hashes]
    for _ in range(levels):
        row = out[-1]
        out.append([_hex("".join(row[i:i + fanout])) for i in range(0, len(row), fanout)])
    return out


def _fold(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[pa.RecordBatch]:
    """The root of each array."""
    for batch in batches:
        roots = []
        for i in range(batch.num_rows):
            levels = min(depth, levels_of(batch.column("total")[i].as_py(), fanout))
            roots.append(bytes.fromhex(_up(_slots(batch.column("slots")[i].as_py()), levels, fanout)[-1][0]))
        yield pa.record_batch([batch.column("g"), batch.column("block"), batch.column("total"),
                               pa.array(roots, pa.binary())], names=["g", "pos", "total", "hash"])


_PATHS = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))


def _unfold(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Each array's paths, aligned with its slots; one array per batch, since paths are long."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column("slots")[i].as_py()
            above = batch.column("above")[i].as_py() or []
            levels = min(depth, levels_of(batch.column("total")[i].as_py(), fanout))
            rows, steps = _up(_slots(block), levels, fanout), []
            for row in rows[:levels]:
                steps.append([{"left": "".join(row[k - k % fanout:k]),
                               "right": "".join(row[k + 1:k - k % fanout + fanout])} for k in range(len(row))])
            paths = []
            for s in block:
                k, path = s["slot"], []
                for level in steps:
                    path.append(level[k])
                    k //= fanout
                paths.append(path + above)
            one = batch.slice(i, 1)
            yield pa.record_batch([one.column("g"), one.column("block"), one.column("slots"),
                                   pa.array([paths], _PATHS), one.column("subroot"), one.column("root")],
                                  names=["g", "block", "slots", "paths", "subroot", "root"])


@dataclass
class Tree:
    """Slot arrays of every round, lowest first, and the root of each group."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int
    depth: int

    def down(self, above: DataFrame, k: int) -> DataFrame:
        """Rows of round ``k`` with their paths; ``above(g, block, above, subroot, root)`` names the arrays' own."""
        blocks = self.rounds[k].join(above, ["g", "block"])
        slot = dict(self.rounds[k].dtypes)["slots"]
        wide = blocks.mapInArrow(partial(_unfold, fanout=self.fanout, depth=self.depth),
                                 f"g string, block long, slots {slot}, paths array<{_STEP}>, subroot string, root string")
        return wide.select("g", "block", "subroot", "root", F.explode(F.arrays_zip("slots", "paths")).alias("s")).select(
            "g", (F.col("block") * self.fanout ** self.depth + F.col("s.slots.slot")).alias("pos"), "subroot", "root",
            "s.slots", F.col("s.paths").alias("path"))

    def paths(self, above: DataFrame, stage: Stage) -> DataFrame:
        """Rows of the lowest round with their paths; ``above(g, above, subroot, root)`` is what leads on from a group."""
        top = above.withColumn("block", F.lit(0).cast("long"))
        for k in range(len(self.rounds) - 1, 0, -1):
            inner = self.down(top, k).select("g", F.col("pos").alias("block"), F.col("path").alias("above"),
                                             "subroot", "root")
            # groups that ended in an earlier round enter where they ended
            ended = top.join(self.rounds[k].select("g").distinct(), "g", "left_anti")
            top = stage.put(inner.unionByName(ended.select(*inner.columns)), f"above{k}")
        return self.down(top, 0)


def grow(nodes: DataFrame, stage: Stage, fanout: int, depth: int, extra: Sequence[str] = ()) -> Tree:
    """Reduce ``nodes(g, pos, total, hash, *extra)`` to one root per group."""
    size, rounds, done = fanout ** depth, [], []
    while True:
        blocks = stage.put(
            nodes.groupBy("g", F.expr(f"pos div {size}").alias("block")).agg(
                F.max("total").alias("total"),
                F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("slot"), "hash", *extra)).alias("slots")),
            "slots")
        rounds.append(blocks)
        up = stage.put(blocks.mapInArrow(partial(_fold, fanout=fanout, depth=depth),
                                         "g string, pos long, total long, hash binary"), "roots")
        done.append(up.where(f"total <= {size}").select("g", F.lower(F.hex("hash")).alias("subroot")))
        # a larger group folded depth levels: that many nodes are left
        nodes = up.where(f"total > {size}").withColumn("total", F.expr(f"(total + {size - 1}) div {size}"))
        extra = ()
        if not nodes.limit(1).count():
            break
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return Tree(rounds, roots, fanout, depth)


def prove(docs: DataFrame, altered: Column | None = None, columns: Sequence[str] = COLUMNS, group: str = "source",
          fanout: int = 3, depth: int = 7) -> DataFrame:
    """Merkle path of every row of ``docs``: doc_id, group, position, leaf, subroot, root, path, altered.

    A leaf is the hash of the row's ``columns``; per group (null is a group)
    leaves ascend by doc_id, and each ``fanout`` consecutive nodes become one
    until one is left.  The groups' roots, null first and then by UTF-8 bytes,
    give the root alike.  ``path`` holds for every level from the leaf to the
    root the hex digests left and right of the node; ``fold_path`` recomputes
    the root from it.  ``altered`` is another hash (binary) to carry along.

    One row per input row: rows without a doc_id stand first in their group,
    repeated ids follow one another by leaf, equal rows in any order.  An
    empty table gives no rows.  Texts of any length are hashed whole; only
    digests are shuffled.  Extra columns are ignored.
    """
    stage = Stage(docs.sparkSession, "merkle")
    doc_id = F.col("doc_id").cast("long")
    none = F.lit(None).cast("binary")
    rows = stage.put(docs.select(
        group_key(F.col(group)).alias("g"), doc_id.isNull().alias("no_id"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(0)).alias("word"), doc_id.alias("doc_id"),
        F.unhex(leaf_hash(*[F.col(c) for c in columns])).alias("leaf"),
        (none if altered is None else altered).alias("altered"),
        F.monotonically_increasing_id().alias("row_no")), "leaves")
    placed = place(rows, stage).select("g", "pos", "total", F.col("leaf").alias("hash"), "doc_id", "altered")
    tree = grow(placed, stage, fanout, depth, ["doc_id", "altered"])
    subroots = stage.put(tree.roots, "subroots")
    n_groups = subroots.count()
    tops = (with_group_rank(subroots.withColumn("one", F.lit("")), ["one"], ["g"], "rank")
            .select(F.col("one").alias("g"), (F.col("rank") - 1).alias("pos"), F.lit(n_groups).cast("long").alias("total"),
                    F.unhex("subroot").alias("hash"), F.col("g").alias("of")))
    top = grow(tops, stage, fanout, depth, ["of"])
    start = top.roots.select("g", F.array().cast(_STEP).alias("above"), "subroot", F.col("subroot").alias("root"))
    above = stage.put(top.paths(start, stage).select(
        F.col("slots.of").alias("g"), F.col("path").alias("above"),
        F.lower(F.hex("slots.hash")).alias("subroot"), "root"), "above")
    out = tree.paths(above, stage)
    return out.select(F.col("slots.doc_id").alias("doc_id"),
                      F.when(F.col("g") != "n", F.substring("g", 2, 2_147_483_647)).alias(group),
                      F.col("pos").alias("position"), F.lower(F.hex("slots.hash")).alias("leaf"),
                      "subroot", "root", "path", F.lower(F.hex("slots.altered")).alias("altered"))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of the path's digests, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)
