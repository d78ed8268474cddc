"""Merkle manifest, hard negatives and token counts against brute force, on hostile small tables."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    from leadloom.session import configure
    return configure(s)


# ---- Merkle manifest ---------------------------------------------------------------------------
DOCS = "doc_id long, source string, lang string, n_chars int, text string, leaf string, path int, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(nodes, fanout=3):
    """Root, and per node the list of (left, right) siblings."""
    paths, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(row) > 1:
        for i, k in enumerate(at):
            lo = k - k % fanout
            paths[i].append(("".join(row[lo:k]), "".join(row[k + 1:lo + fanout])))
            at[i] = k // fanout
        row = [h(*row[k:k + fanout]) for k in range(0, len(row), fanout)]
    return row[0], paths


def manifest(rows, fanout=3):
    """Multiset of (doc_id, source, leaf, subroot, root, path)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        ls = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (ls, *tree([leaf_of(r) for r in ls], fanout))
    root, tops = tree([trees[s][1] for s in order], fanout)
    return sorted(((r[0], s, leaf_of(r), trees[s][1], root, tuple(p + tops[k])) for k, s in enumerate(order)
                   for r, p in zip(trees[s][0], trees[s][2])), key=repr)


def proved(df, **options):
    from leadloom.llm.op11_bitmap_merkle import prove
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.path))
                   for r in prove(df, **options).collect()), key=repr)


def doc(i, source, text, lang="en", n=1):
    return (i, source, lang, n, text, "clash", 7, "clash")


HOSTILE = [
    *[doc(i * 37 - 400, "hub", f"text {i}\nx") for i in range(60)],        # more than two levels, negative ids
    *[doc(5, "twice", "same") for _ in range(4)], doc(5, "twice", "other"), doc(4, "twice", None), doc(69, "twice", ""),
    *[doc(None, "hub", f"no id {i % 2}") for i in range(5)],                # rows without an id, two of them alike
    doc(1, None, "null source"), doc(2, None, "x" * 300_000), doc(3, "", "empty source", None, None),
    doc(9, "n", "named like the null group"), doc(2**62, "wide", "é\n中"), doc(-2**63, "wide", "a"), doc(2**63 - 1, "wide", "b"),
    doc(7, "é", "not ASCII"), doc(8, "z", "after é in no order but that of bytes"),
]


@pytest.mark.parametrize("fanout,depth", [(3, 7), (3, 1), (2, 2)])
def test_manifest_equals_brute_force(spark, fanout, depth):
    """Arrays of one level give the same paths as arrays that hold a whole group."""
    got = proved(spark.createDataFrame(HOSTILE, DOCS).repartition(5), fanout=fanout, depth=depth)
    assert got == manifest(HOSTILE, fanout)


def test_manifest_of_one_row_and_of_none(spark):
    one = [doc(3, "s", "alone")]
    assert proved(spark.createDataFrame(one, DOCS)) == manifest(one)
    assert manifest(one)[0][2] == manifest(one)[0][4] and manifest(one)[0][5] == ()
    assert proved(spark.createDataFrame([], DOCS)) == []


def test_folded_paths_tell_altered_rows(spark):
    from leadloom.llm.op11_bitmap_merkle import fold_path, prove
    rows = [doc(i, f"s{i % 3}", f"line {i}\nnext" if i % 4 else None) for i in range(40)]
    other = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    out = prove(spark.createDataFrame(rows, DOCS), altered=other)
    kept = out.select("doc_id", "altered", "root", fold_path(F.col("leaf"), F.col("path")).alias("whole"),
                      fold_path(F.coalesce("altered", "leaf"), F.col("path")).alias("told")).collect()
    assert all(r.whole == r.root for r in kept)
    assert {r.doc_id for r in kept if r.told != r.root} == set(range(0, 40, 2))


def test_directory_of_far_ids(spark):
    """Ids whose upper bits differ on every level of the directory."""
    random.seed(4)
    ids = sorted({random.getrandbits(k) * random.choice((-1, 1)) for k in range(1, 63) for _ in range(6)})
    rows = [doc(i, "s", str(i)) for i in ids]
    assert proved(spark.createDataFrame(rows, DOCS).repartition(3)) == manifest(rows)


# ---- hard negatives ----------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, score string, positive_id int"


def mined(rows, every=5, k=5, m=3, low=50, high=95):
    best = {}
    for i, e, label, *_ in rows:
        if i is not None and (i not in best or key(label, e) < key(*best[i])):
            best[i] = (label, e)
    good = {i: (label, [int(np.floor(256 * x)) for x in e]) for i, (label, e) in best.items()
            if label is not None and e and all(x is not None and np.isfinite(x) and abs(x) * 256 < 1 << 24 for x in e)}
    out = []
    for a, (label, q) in good.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in good.items()
                        if i != a and len(v) == len(q))
        for s, p, other in [x for x in scores if x[2] == label][:k]:
            fit = [(-t, i) for t, i, o in scores if o != label and low * -s <= 100 * -t <= high * -s][:m]
            out += [(a, p, n + 1, i, -s, t) for n, (t, i) in enumerate(fit)]
    return sorted(out)


def key(label, e):
    """Order of (label, vector) with nulls first, as in a struct."""
    return ((label is not None, label or 0), (e is not None, [(x is not None, x if x is not None else 0) for x in e or ()]))


def vectors(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(4, dim))
    return [(i, [float(x) for x in heads[rng.integers(4)] + rng.normal(size=dim) * .6], int(rng.integers(3)), "x", 1)
            for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (500, None, 1), (505, [], 1), (510, [1.0, None], 2), (515, [float("nan"), 1.0], 2),
    (520, [float("inf"), 1.0], 0), (525, [1.0] * 12, None), (530, [0.0] * 12, 1), (535, [2.0, 1.0], 1), (536, [2.0, 1.0], 1),
    (537, [1.5, 1.0], 2), (538, [1.5, 1.0], 2), (539, [1.25, 1.0], 0), (540, [1e9, 1.0], 1), (541, [-2.0, -1.0], 1),
    (545, [2.0, 1.0], 1), (545, [0.0, 0.0], 1), (550, [60000.0] * 12, 0), (551, [60000.0] * 12, 0), (552, [40000.0] * 12, 1),
]


def test_negatives_equal_brute_force(spark):
    from leadloom.llm.op12_bond_negatives import mine
    rows = vectors(1, 300) + [(*r, "x", 1) for r in ODD]
    # copies with other labels: ties that only ids decide
    rows += [(i + 700, e, (label + 1) % 3, "x", 1) for i, e, label, *_ in rows[:40]]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == mined(rows)
    assert {r[0] for r in got} >= {535, 550} and all(r[0] % 5 == 0 for r in got)


def test_negatives_of_small_blocks(spark, monkeypatch):
    """Many blocks on both sides give what one gives."""
    from leadloom.llm import op12_bond_negatives as op
    rows = vectors(2, 200)
    monkeypatch.setattr(op, "CHUNK", 17)
    monkeypatch.setattr(op, "BLOCK", 7)
    monkeypatch.setattr(op, "STEP", 3)
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in op.mine(df, F.col("vec_id") % 5 == 0, low=20, high=99, negatives=4).collect())
    assert got == mined(rows, m=4, low=20, high=99)


def test_negatives_without_rows(spark):
    from leadloom.llm.op12_bond_negatives import mine
    empty = spark.createDataFrame([], VECTORS)
    assert mine(empty, F.col("vec_id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(5, [1.0], 1, "x", 1)], VECTORS)
    assert mine(alone, F.col("vec_id") % 5 == 0).collect() == []


def test_bound_drops_candidates_early():
    """The scan reads all dimensions only of vectors that may still be among the best."""
    from leadloom.llm.op12_bond_negatives import best_possible, bond
    rng = np.random.default_rng(3)
    cells = np.floor(256 * rng.normal(size=(64, 2000)) * (0.9 ** np.arange(64))[:, None])
    q = np.floor(256 * (0.9 ** np.arange(64)))
    seen = []

    def possible(least, most, goal=best_possible(5)):
        seen.append(len(least))
        return goal(least, most)
    left, score = bond(cells, cells.min(axis=1), cells.max(axis=1), q, np.ones(2000, bool), possible)
    exact = q @ cells
    assert set(np.argsort(-exact)[:5]) <= set(left) and (score == exact[left]).all()
    assert seen[0] == 2000 and seen[-1] < 100


# ---- token counts ------------------------------------------------------------------------------
PARTS = ["a", "B", "é", "ß", "中", "\n", " ", "  ", "\t", "\x1c", "\x85", " ", "1", "٣", "½", "'s", "'", "’", "😀",
         "<|endoftext|>", "<|end", "!", "_", "​", "é", "ǅ", "　", "the", " and", "ing"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from leadloom.llm.op13_heap_merges import count_tokens
    random.seed(5)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(4000)]
    texts += ["", None, "a" * 100_000, "ab" * 20_000, " " * 5_000 + "x", "word " * 2_000, "<|endoftext|>" * 3, "é" * 1025]
    rows = [(i if i % 9 else None, t, "clash", 3) for i, t in enumerate(texts)] + [(1, "twice", "c", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int").repartition(3)
    lib = Tokenizer.from_file(VOCABULARY)
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in
            zip(rows, (len(e) for e in lib.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)))]
    got = [tuple(r) for r in count_tokens(df, VOCABULARY).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert count_tokens(df.where("false"), VOCABULARY).collect() == []


def test_heap_merges_equal_plain_merging():
    """The count without ids against merging the first lowest pair again and again."""
    from leadloom.llm.op13_heap_merges import count_symbols, load_merges
    pairs = load_merges(VOCABULARY).pairs
    random.seed(6)
    for _ in range(400):
        word = bytes(random.choice(b"abehinort st'1\xc3\xa9") for _ in range(random.randint(0, 24)))
        row = list(word)
        while True:
            ranks = [(pairs[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(row, row[1:])) if a << 32 | b in pairs]
            if not ranks:
                break
            i = min(ranks)[1]
            row[i:i + 2] = [pairs[row[i] << 32 | row[i + 1]][1]]
        assert count_symbols(word, pairs) == len(row)


def test_other_vocabularies_are_refused():
    from leadloom.llm.op13_heap_merges import load_merges
    with pytest.raises(ValueError):
        load_merges("/opt/tokenizers/word_bpe_49k.json")


def test_crc32_of_ids_is_unsigned(spark):
    """The condition by which the registered query tampers."""
    ids = [0, 1, -5, 51281, 2**40]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(
        F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect()
    assert [r.c for r in got] == [zlib.crc32(str(i).encode()) for i in ids]
