"""The training-data operators against brute force, on small tables with nulls, ties, repeats and extremes."""

import collections
import hashlib
import os
import re
import struct
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    from leadloom.session import configure
    return configure(s)


def docs_of(spark, rows):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows],
                                 "doc_id long, text string, component_id string, n_lines int, kept boolean")


WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def changed(text, k):
    words = text.split()
    words[k] = "other"
    return " ".join(words)


def jaccard_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows():
    base = prose(1, 120)
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "ONE"), (6, "a b"), (7, "A\tb"), (8, prose(2, 30_000))]
    rows += [(10 + k, base) for k in range(5)]
    for k in range(40):                      # a group whose members differ by up to six edits
        text = base
        for e in range(k % 7):
            text = changed(text, (k * 11 + e * 17) % 120)
        rows.append((100 + k, text))
    return rows + [(500 + k, prose(50 + k, 60)) for k in range(20)]


def test_near_duplicates_match_all_pairs(spark):
    from leadloom.llm.op8_superminhash import near_duplicates

    for size, percent in ((3, 85), (5, 80)):
        got = near_duplicates(docs_of(spark, [*near_rows(), (None, "one")]).repartition(3), size, percent,
                              bands=48).collect()
        assert {tuple(r) for r in got} == jaccard_groups(near_rows(), size, percent)
    assert near_duplicates(docs_of(spark, [])).collect() == []
    repeated = near_duplicates(docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted(map(tuple, repeated)) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_near_duplicates_find_pairs_with_unlike_sketches(spark):
    from leadloom.llm.op8_superminhash import near_duplicates

    # 460 of 540 words in common, 82 of 512 slots with unlike bits (57 expected); they meet at a pivot unlike both
    w = [f"s3308x{i}" for i in range(540)]
    pivot = " ".join(w[:230] + [f"p0x{i}" for i in range(270)])
    rows = [(1, pivot), (2, pivot), (3, pivot), (4, " ".join(w[:500])), (5, " ".join(w[:460] + w[500:]))]
    got = near_duplicates(docs_of(spark, rows), 1, 85, bands=1, rows=1).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_near_copies_below_the_threshold_are_told_apart_without_their_sets(spark, monkeypatch):
    from leadloom.llm import op8_superminhash as O

    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    # nine of 80 words differ per document, so two documents of one word a shingle share some 0.65
    rows = [(i, " ".join(f"v{i}_{k}" if k in own else w for k, w in enumerate(base)))
            for i in range(60) for own in [set(rng.permutation(80)[:9].tolist())]]
    rows += [(100, " ".join(base)), (101, " ".join([*base[:70], "x"]))]
    counts, put = {}, O.Stage.put

    def counting(self, df, name):
        out = put(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(O.Stage, "put", counting)
    got = O.near_duplicates(docs_of(spark, rows), 1, 85, bands=64, rows=2).collect()
    assert {tuple(r) for r in got} == jaccard_groups(rows, 1, 85)
    assert counts["members"] > 60 and counts["left_over"] <= 60


def test_parity_maps_never_differ_more_than_their_sets():
    from leadloom.llm.op8_superminhash import U64, _parity, mix

    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 900, 20_000):
        both, a, b = (mix(rng.integers(0, 2 ** 63, k).astype(U64)) for k in (n, n // 3, n // 5))
        apart = _parity(np.concatenate([both, a])) ^ _parity(np.concatenate([both, b]))
        assert sum(int(w).bit_count() for w in apart) <= len(a) + len(b)


def test_superminhash_estimates_similarity():
    from leadloom.llm.op8_superminhash import U64, signatures

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        u = rng.integers(0, 2 ** 63, 150, dtype=np.int64).astype(U64)
        sets += [u[:100], u[50:]]
    s = signatures(sets, 128)
    assert abs((s[0::2] == s[1::2]).mean() - 50 / 150) < 0.02


def test_line_dedup_matches_brute_force(spark):
    from leadloom.llm.op5_line_runs import dedup_lines

    long = "This line is far more than forty characters long, it is."
    rows = [(i, f"own line {i}\n  {long.upper() if i % 2 else long}\t\nshort\n") for i in range(1, 9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{long}\n{long}"), (None, f"x\n{long}"), (3, rows[2][1])]
    rows += [(30 + i, long.replace("far", "very") + "\n" + prose(i, 5000)) for i in range(4)]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches in (1, 3):
        got = dedup_lines(docs_of(spark, rows), batches=batches)
        assert {"component_id", "kept"} <= set(got.columns)
        found = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert dedup_lines(docs_of(spark, [])).count() == 0


def test_language_id_on_held_out_rows(spark):
    from leadloom.llm.op3_kneser_ney import held_out, identify

    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "", None), (900003, "123 !!", "fr"), (None, "the", None),
                                 (900005, "\u00bd \u00b2\u00b3 \u2167", "es"),
                                 (900004, "漢字 仮名 文字 漢字 仮名 文字 " * 30, None)], given.schema)
    out = identify(given.unionByName(odd).withColumn("score", F.lit("clash"))).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == given.count() + 6
    for i in (900001, 900002, 900003, 900005):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[900004].rejected and by_id[900004].lang_pred != "und"
    tried = {r.doc_id for r in given.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    kept = [r for r in out if r.doc_id in tried]
    assert len(kept) > 20
    assert sum(r.lang_pred == r.lang for r in kept) >= 0.98 * len(kept)
    assert sum(r.rejected for r in kept) <= 0.01 * len(kept)
    assert identify(given.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(given.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_less_than_one():
    from leadloom.llm.op3_kneser_ney import build

    grams = [(" " * (4 - i) + "abca"[:i + 1], 3) for i in range(4)] + [("abca ", 3), ("    b", 2), ("   b ", 2)]
    model = build([("xx", g, n) for g, n in grams])
    at = np.array([[32, 32, 32, 32, ord(c)] for c in "abcdefgh "], np.uint32)
    total = np.exp(model._distinct(at)).sum()
    assert 0.3 < total <= 1.0001


def test_kneser_ney_keeps_rare_grams_and_frequent_classes(spark):
    from itertools import product

    from leadloom.llm.op3_kneser_ney import fit, build

    # 248,832 grams of "aa", more than 200,000, and each of them frequent in "bb"
    grams = ["".join(g) for g in product("abcdefghijkl", repeat=5)]
    texts = [("aa", " ".join(grams[i::8])) for i in range(8)]
    texts += [("aa", "kept kept"), ("bb", "mnop " * 12_000), ("bb", "mnoq mnoq mnor")]
    model = fit(spark.createDataFrame(texts, "lang string, text string"))
    assert model.langs == ["aa", "bb"]
    points = lambda *gs: np.array([[ord(c) for c in g] for g in gs], np.uint32)
    _, lang, _ = model.log_p[-1].find(model_hashes(points(*grams)))
    assert (lang == 0).sum() == len(grams)
    # against plain Python over the same counts
    counted = collections.Counter()
    for lang, text in texts:
        for w in text.split():
            s = "    " + w + " "
            counted.update((lang, s[i:i + 5]) for i in range(len(s) - 4))
    want = build([(x, g, n) for (x, g), n in counted.items()])
    at = points("abcde", "lllll", "kept ", "xkept", "    m", "mnoq ", "mnopq", "zzzzz", "   zz")
    assert np.allclose(model._distinct(at), want._distinct(at), atol=1e-4)
    assert np.allclose(model.usual, want.usual, atol=1e-4)


def test_language_thresholds_cover_all_rows(spark):
    from leadloom.llm.op3_kneser_ney import _Scorer, calibrate, fit

    # 12,000 rows of one language; three of another that no sample of 2,000 rows must miss
    rng = np.random.default_rng(3)
    texts = [("aa", " ".join(rng.choice(["abba", "acab", "baca", "caba", "bcb"], 3 + i % 9))) for i in range(12_000)]
    texts += [("zz", t) for t in ("xyzzy xyz", "yzx yzx zyx", "zzyx xyzzy zyx xyz")]
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, lang string, text string")
    model = spark.sparkContext.broadcast(fit(train.select("lang", "text")))
    usual, spread = calibrate(train, model)
    t = _Scorer(model.value).totals([x for _, x in texts])
    for j, lang in enumerate(["aa", "zz"]):
        own = t[[x == lang for x, _ in texts]]
        want = -own[:, j].sum() / own[:, -2].sum()
        dev = np.sort((-own[:, j] / own[:, -2] - want) ** 2 * own[:, -2])
        assert abs(usual[j] - want) < 1e-4
        assert abs(spread[j] - max(0.5, dev[(len(dev) - 1) // 2] ** 0.5 * 1.4826)) < 0.01


def model_hashes(points):
    from leadloom.llm.op3_kneser_ney import _hashes
    return _hashes(points)[-1]


def test_quality_scores(spark):
    from leadloom.llm.op6_histogram_trees import grow, score_quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in out if r.quality == 1]
    bad = [r.score for r in out if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    odd = score_quality(docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "x")]), labels.limit(0)).collect()
    assert len(odd) == 4 and {r.score for r in odd} == {0.5}
    x = np.random.default_rng(0).random((500, 3))
    trees = grow(x, (x[:, 1] > 0.6).astype(float), trees=20)
    assert (trees.scores(x).round() == (x[:, 1] > 0.6)).mean() > 0.98


def test_near_vectors_match_all_pairs(spark):
    from leadloom.llm.op2_rotation_codes import near_vectors

    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 64))
    rows = []
    for i in range(300):
        v = base[i % 6] + rng.standard_normal(64) * (0.02, 0.2, 0.3, 1.0)[i % 4]
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None),
             (904, [None] + rows[0][1][1:], 0), (905, [], 0), (906, rows[0][1][:10], 0), (907, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[0], "x"), (None, rows[0][1], 0, "x")],
                                  "vec_id long, embedding array<float>, label int, n_links string")
    ok = {i: (np.array(v, float), g) for i, v, g in rows
          if v and g is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
             and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.93}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    degree = collections.Counter(i for pair in links for i in pair)
    want = {(i, degree[i], find(i), find(i) == i) for i in root}
    assert {tuple(r) for r in near_vectors(frame).collect()} == want
    assert near_vectors(frame.limit(0)).collect() == []


def test_estimate_is_unbiased():
    from leadloom.llm.op2_rotation_codes import rotations

    rng = np.random.default_rng(9)
    errors = []
    turn = rotations(64, 768)
    for _ in range(300):
        a, b = rng.standard_normal((2, 64))
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        y, q = np.einsum("d,rde->re", a, turn), np.einsum("d,rde->re", b, turn)
        factor = np.abs(y).sum(axis=1) / 8
        errors.append(((np.sign(y) * q).sum(axis=1) / 8 / factor).mean() - a @ b)
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.06


def test_far_exponents_link_by_angle(spark):
    from leadloom.llm.op2_rotation_codes import near_vectors

    rng = np.random.default_rng(8)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, [float(x) for x in v * s], 1) for i, (v, s) in enumerate(
        [(a, 1e-200), (a, 1.0), (a, 1e200), (a, 1e-310), (b, 1e-200), (b, 1e200), (-a, 1e250), (a, 1e300)])]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {
        0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 7: (4, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_warc_round_trip(spark, tmp_path):
    from leadloom.llm.op9_zip_warc import digest32, read_packages, write_packages

    rows = [(5, "http://a/", "<p>x</p>"), (3, "http://b/\r\nX: y", "<p>x</p>"), (9, None, None), (8, "http://c/", ""),
            (None, "http://d/", "<p>x</p>"), (7, "http://e/", "é" * 300_000), (3, "http://b/", "<p>x</p>"),
            (11, "http://f/", "a\r\n\r\nb"), (12, 'http://g/{id}/{"a": 1}?q={x y}', "g"), (13, "h { {", "h")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, kind string")
    made = write_packages(pages.repartition(3), f"file://{tmp_path}/w", most_bytes=100)
    got = read_packages(spark, made).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        kind = "response" if i == min(same) else "revisit"
        want.append((str(i), len(data), digest32(data), kind, f"urn:page:{min(same)}" if kind == "revisit" else None,
                     data if kind == "response" else None))
    found = [(r.record_id.rpartition(":")[2], r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
              None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert read_packages(spark, write_packages(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_zip64_directory(tmp_path):
    import pyarrow.fs as fs

    from leadloom.llm.op9_zip_warc import central_directory, data_start

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a", b"hello")
    raw = bytearray(path.read_bytes())
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", raw[end + 10:end + 20])
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    raw[end + 8:end + 20] = struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    path.write_bytes(raw[:end] + wide + locator + raw[end:])
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        (name, method, packed, full, local), = central_directory(f)
        assert (name, method, packed, full) == ("archive/a", 0, 5, 5)
        assert f.read_at(5, data_start(f, local)) == b"hello"


def test_templates_find_reparameterised_items(spark):
    from leadloom.llm.op1_templates import decontaminate, find_leaks

    ask = "If {a} Smith buys {n} apples for {m} dollars each, how much does {b} pay for {n2} apples today?"
    item = ask.format(a="John", b="John", n=12, n2=12, m=5)
    rows = [(1, "We know this. " + item), (2, "So: " + ask.format(a="Mary", b="Mary", n=7, n2=7, m=9) + " Then more."),
            (3, ask.format(a="Mary", b="Anna", n=7, n2=8, m=9)), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
            (None, item.lower()), (7, prose(1, 5000)), (1, "We know this. " + item), (8, "word " + item * 3)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, "4 5 6 7 8 9 1 2 3 0 7"),
                                   (6, prose(3, 6))], "item_id long, text string")
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.item_id, r.kind) for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 1, "verbatim"), (2, 1, "reparameterised"), (None, 1, "verbatim"), (8, 1, "verbatim")}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]
    assert find_leaks(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_given_items_are_found(spark):
    from leadloom.llm.op1_templates import find_leaks

    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if f" {t} " in f" {words(d.text or '')} "}
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).where("coverage = 1").collect()} == want


def test_pieces_equal_the_library(spark):
    import sentencepiece

    from leadloom.llm.op4_piece_lattice import SPACE, decode, encode, load_pieces, merge, segment, segment_words, with_bytes

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1, None), (2, ""), (3, "  two  spaces "), (4, "日本 🙂 ñandú\n\n\tx = 1;"), (5, "a" * 3000), (5, " "), (None, "x")]
    frame = docs_of(spark, rows).withColumn("ids", F.lit(1))
    for r in decode(encode(frame, MODEL, verify=True), MODEL).collect():
        assert list(r.ids) == (library.encode(r.text) if r.text else [])
        assert r.decoded == (r.text or "") and r.round_trip
    table = load_pieces(MODEL)
    words = [SPACE + w for w in ("the", "hested", "ñandú", "x.y,", "日本")] + [SPACE * 3 + "a"]
    for kind, one in (("bpe", lambda w: merge(w, table)), ("unigram", lambda w: segment(w, table, table.unknown_score))):
        got = {r.word: with_bytes(r.ids, table) for r in segment_words(
            spark.createDataFrame([(w,) for w in words], "word string"), table, kind).collect()}
        assert got == {w: one(w) for w in words}

    def best(word):     # all segmentations
        if not word:
            return 0.0
        return max([table.scores[word[:n]][0] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in table.scores],
                   default=-1e18)
    texts = {i: p for p, (_, i) in table.scores.items()}
    for w in (SPACE + "hested", SPACE + "reading", SPACE + "theation"):
        assert sum(table.scores[texts[i]][0] for i in segment(w, table, table.unknown_score)) == best(w)
    assert encode(frame.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<p>Hello <b>bold</b> world<p>Second &amp; last<br>line two", "Hello bold world\n\nSecond & last\nline two"),
    ("<ul><li>one<li>two<ol><li>x<li>y</ol><li><p>three</ul>tail", "- one\n- two\n  1. x\n  2. y\n- three\n\ntail"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>5<tr><td colspan=2>Sum: 12</table>z",
     "Name  | Qty\nApple | 5\nSum: 12\n\nz"),
    ("a<div hidden>no</div><span style='display: none'>no</span><script>var a='</p>';</script>b", "ab"),
    ("<pre> x\n   y</pre>", " x\n   y"), ("", ""), (None, ""), ("x < y & z <b", "x < y & z <b"),
    ("<div>" * 4000 + "deep" + "</b>" * 4000, "deep"), ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
])
def test_layout(page, text):
    from leadloom.llm.op7_layout_text import layout

    got = layout(page)
    assert (got.replace("\nb\n", "\nb |\n").rstrip() + (" |" if got.endswith("\nb") and "|" in got else "")) == text \
        or got == text


def test_layout_has_all_visible_words(spark):
    from html.parser import HTMLParser

    from leadloom.llm.op7_layout_text import visible_text

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title")
            self.out.append("" if tag in ("b", "i", "a", "em", "strong", "span") else " ")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title")
            self.out.append("" if tag in ("b", "i", "a", "em", "strong", "span") else " ")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))
    for r in visible_text(pages).collect():
        p = Words()
        p.feed(r.html)
        p.close()
        assert [w for w in r.text.split() if w not in "|-"] == [w for w in "".join(p.out).split() if w not in "|-"]
    assert visible_text(pages.limit(0)).count() == 0


def test_quotes_find_their_messages(spark):
    from leadloom.llm.op10_quote_threads import link_quotes

    rows = [(1, 0, "a", "The first message has some words.\nAnd a second line of it."),
            (1, 1, "b", "a wrote:\n> The first message has\n> some words.\n> And a second line of it.\n\nMy reply is here, dear."),
            (1, 2, "c", "b wrote:\n> a wrote:\n> > And a second line of it.\n> My reply is here, dear.\nThird."),
            (1, 3, "d", "No quote at all."), (1, 3, "d", "No quote at all."), (1, 4, "e", "> nobody ever said this sentence\nhm"),
            (2, 0, "a", "> My reply is here, dear.\n> And no more.\nElsewhere I found: x"), (2, 1, "b", None), (2, 2, "b", ""),
            (3, 5, "a", "> My reply is here, dear.\nfrom afar"), (None, 1, "a", "lost"), (4, None, "a", "> lost\nnull turn")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {(r.conv_id, r.turn): r for r in link_quotes(frame).collect()}
    assert len(got) == 11
    assert (got[1, 1].parent_turn, got[1, 1].body, got[1, 1].n_linked) == (0, "My reply is here, dear.", 1)
    assert (got[1, 2].parent_turn, got[1, 2].root_turn, got[1, 2].depth, got[1, 2].n_quotes) == (1, 0, 2, 2)
    assert got[1, 2].body == "Third." and got[1, 4].n_linked == 0 and got[1, 4].body == "hm"
    assert [got[1, t].position for t in range(5)] == [1, 2, 3, 4, 5]
    assert (got[3, 5].source_conv_id, got[3, 5].source_turn) == (None, None)      # 23 characters: too short elsewhere
    assert got[2, 1].body == "" and got[None, 1].position == 1 and got[4, None].parent_turn is None
    assert link_quotes(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (None, "the and of", None, None, None)],
                                docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(2))
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, SF).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        ids = [r.doc_id for r in docs.collect()]
        if name == "language":
            assert not {9001, 9002} & set(ids) and None in ids
        if name == "near":
            named = [i for i in ids if i is not None]
            assert len(named) == len(set(named))
            rows = [(r.doc_id, r.text) for r in before.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None]
            assert set(named) == {i for i, _, _, kept in jaccard_groups(rows, 5, 80) if kept}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)


def test_pieces_look_up_each_place_once():
    """A word's edges come from one pass over it, and texts are decoded from their ids as a whole."""
    from dataclasses import replace
    from types import SimpleNamespace

    import pyarrow as pa

    from leadloom.llm.op4_piece_lattice import SPACE, _encode, load_pieces, merge

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    pieces = load_pieces(MODEL)
    counted = replace(pieces, scores=Counted(pieces.scores))
    word = SPACE + "unbelievableinternationalization"
    assert merge(word, counted) == merge(word, pieces)
    assert Counted.asked <= len(word)
    texts = ["a word", None, "", "x" * 200 + "é\U0001f600", "mark ▁ here", " two  blanks ", "bad � sign", "same same same"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    # the lexicon's own ids are decoded, too: a wrong one shows
    known = {SPACE + "word": np.array([pieces.scores[SPACE + "a"][1]], np.int32).tobytes()}
    got = [pa.Table.from_batches(_encode(iter([batch.slice(1)]), SimpleNamespace(value=(pieces, k)), 2, "bpe", True)) for k in ({}, known)]
    assert got[0].equals(got[1]) and got[0]["round_trip"].to_pylist() == [True, True, True, False, True, True, True]
    wrong = pa.Table.from_batches(_encode(iter([batch]), SimpleNamespace(value=(pieces, known)), 2, "bpe", True))
    assert wrong["round_trip"].to_pylist() == [False, *got[0]["round_trip"].to_pylist()]


def test_grams_are_handed_on_within_a_batch():
    """Words are counted in slices of a batch, so a batch of long texts does not hold all of them; the counts stay."""
    import pyarrow as pa

    from leadloom.llm.op3_kneser_ney import _gram_counts

    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(w) for w in rng.choice(letters, (50_000, 9))) for _ in range(4)] + [""]
    batch = pa.record_batch([pa.array(["x"] * 5), pa.array(texts)], names=["lang", "text"])
    parts = list(_gram_counts(iter([batch]), 60_000))
    assert len(parts) > 1
    found = collections.Counter()
    for p in parts:
        found.update(dict(zip(p.column("gram").to_pylist(), p.column("n").to_pylist())))
    want = collections.Counter()
    for word in " ".join(texts).split():
        padded = f"    {word} "
        want.update(padded[i:i + 5] for i in range(len(padded) - 4))
    assert found == want


def test_texts_that_teach_are_scored_once(spark, monkeypatch):
    """Calibration reads the deviations of the scoring pass: no pass of its own over the texts, the same results."""
    from leadloom.llm import op3_kneser_ney as op3

    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = given.where(~op3.held_out(F.col("doc_id")))
    columns = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    # few characters of evidence: some rows are rejected, some are not
    want = {tuple(r) for r in op3.identify(given, train, z=0.3).select(columns).collect()}
    assert 0 < sum(r[-1] for r in want) < len(want)
    monkeypatch.setattr(op3, "calibrate", None)
    got = op3.identify(given, z=0.3, keep=["doc_id"])
    assert got.columns == columns
    assert {tuple(r) for r in got.collect()} == want


def test_words_of_earlier_texts_are_not_kept():
    """A worker's memory follows a slice of texts, not the words of all its texts; odd blanks and cases as in Python."""
    from leadloom.llm.op3_kneser_ney import _Scorer, _code_points, build

    scorer = _Scorer(build([("xx", "    a", 3), ("xx", "   ab", 2), ("xx", "  ab ", 2)]))
    before = {k: len(v) for k, v in vars(scorer).items() if hasattr(v, "__len__")}
    t = scorer.totals(["ab ab", None, "", "\x1cab A1b½", "--"])
    assert t[:, -1].tolist() == [4, 0, 0, 4, 0] and t[:, -2].tolist() == [6, 0, 0, 7, 0]
    assert {k: len(v) for k, v in vars(scorer).items() if hasattr(v, "__len__")} == before
    points, owner = _code_points(["AΣ", "Σα", "İx"])
    assert "".join(map(chr, points)) == "    aς     σα     i     x "
    assert owner.tolist() == [0] * 7 + [1] * 7 + [2] * 12
