"""Re-parameterised benchmark items: stated cases, and a brute-force search over generated items."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadloom.llm.op1_templates import LEAST_PLAIN, NUMBER_WORDS, UNITS, decontaminate, find_leaks  # noqa: E402

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TOM = "Tom has 5 apples. Tom gives 2 to Anna. Tom buys 3 more. How many apples does Tom hold now?"


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from leadloom.session import configure

    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    return configure(s)


def found(spark, docs, items, **options):
    out = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()
    return {(r.doc_id, r.item_id): r.kind for r in out}


def test_names_numbers_and_lengths_of_values_may_change(spark):
    docs = [
        (1, "A puzzle. " + TOM),
        (2, "Mary has 8 apples. Mary gives 4 to Paul. Mary buys 9 more. How many apples does Mary hold now?"),
        (3, "Tom has 5 apples. Tom gives 2 to Mary Jane. Tom buys 3 more. How many apples does Tom hold now?"),
        (4, "Tom has twenty five apples. Tom gives 2 to Anna. Tom buys 3 more. How many apples does Tom hold now?"),
        (5, "Tom has 4 apples. Tom gives 2 to Anna. Tom buys 4 more. How many apples does Tom hold now?"),
        (6, "Mary has 8 apples. Paul gives 4 to Paul. Mary buys 9 more. How many apples does Anna hold now?"),
        (7, "Tom has a dog. Tom gives it to Anna. Tom buys a cat. How many animals are there in the house now?")]
    assert found(spark, docs, [(1, TOM)]) == {
        (1, 1): "verbatim", **{(i, 1): "reparameterised" for i in (2, 3, 4, 5)}}


def test_other_languages(spark):
    es = "Un tren recorre {n} kilómetros entre {a} y {b} en {m} horas, y vuelve más tarde sin carga."
    de = "Der Zug fährt {n} Stunden lang von {a} nach {b} und hält dabei genau {m} mal an."
    docs = [(1, es.format(n="cuarenta", a="Lugo", b="Vigo", m=3)), (2, de.format(n="zwölf", a="Ulm", b="Bad Aibling", m="drei"))]
    items = [(1, es.format(n=90, a="Madrid", b="Toledo", m="dos")), (2, de.format(n=7, a="Köln", b="Bonn", m=2))]
    assert found(spark, docs, items) == {(1, 1): "reparameterised", (2, 2): "reparameterised"}


def test_repeated_items_tied_alignments_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, TOM + " " + TOM.replace("Tom", "Sam"), 3, "x"), (1, TOM + " " + TOM.replace("Tom", "Sam"), 4, "y"),
                                  (2, None, 1, None), (3, "", 1, None), (None, TOM, 1, "z")],
                                 DOCS + ", item_id int, hash string")
    items = spark.createDataFrame([(1, TOM, 1), (1, TOM + " zzz", 2), (2, TOM, 3), (None, TOM, 4), (3, None, 5)], ITEMS + ", doc_id int")
    got = sorted((str(r.doc_id), r.item_id, r.kind, r.coverage) for r in find_leaks(docs, items).collect())
    assert got == [(d, i, "verbatim", 1.0) for d in ("1", "None") for i in (1, 2)]
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_a_very_long_text_and_a_window_all_items_share(spark):
    opening = "Read the whole passage slowly and choose which of the following answers is most nearly right. "
    words = [f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(6000)]
    items = [(i, opening + " ".join(words[i * 40:i * 40 + 40])) for i in range(60)]
    docs = [(1, " ".join(words[3000:] * 20) + " " + items[7][1]), (2, opening + " ".join(reversed(words[:300]))), (3, opening)]
    got = found(spark, docs, items)
    assert got[1, 7] == "verbatim"
    # the opening is a run of more than 13 words, so it is itself a find, in every item, rare or not
    assert {k for k in got if k[0] == 2} == {(2, i) for i, _ in items}
    assert {k for k in found(spark, docs, items, run_words=30) if k[0] == 2} == set()


# ---- brute force -------------------------------------------------------------------------------
def streams(text):
    """Plain words, and template tokens as (form, values)."""
    plain, tokens, fresh = [], [], True
    for raw in text.split():
        for piece in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", raw):
            low = piece.lower()
            before = tokens[-1][0] if tokens else None
            if piece[0].isdigit() or low in NUMBER_WORDS:
                form = "#"
            elif low in UNITS:
                form = "%" if before == "#" else None
            else:
                form = "@" if piece[0].isupper() else None
            plain.append(low)
            if form is None:
                tokens.append((low, None))
            elif form == before and form != "%" and not fresh:
                tokens[-1][1].append(low)
            else:
                tokens.append((form, [low]))
            fresh = False
        if re.search(r"[.!?:][\"')\]*_]*$", raw):
            fresh = True
    return plain, tokens


def searched(doc, item, width=8, share=0.5, run=13):
    """None, or whether the item is found verbatim or with other values."""
    kinds = set()
    (dp, dt), (ip, it) = streams(doc), streams(item)
    if len(ip) < 5:
        return None
    w = min(width, len(ip))
    for lag in range(-len(ip), len(dp)):
        n = sum(0 <= a + lag and dp[a + lag:a + lag + w] == ip[a:a + w] for a in range(len(ip) - w + 1))
        if n and n >= min(-(-(len(ip) - w + 1) * share // 1), run + 1 - w):
            kinds.add("verbatim")
    w = min(width, len(it))
    usable = [a for a in range(len(it) - w + 1) if len({f for f, v in it[a:a + w] if v is None}) >= LEAST_PLAIN]
    for lag in range(-len(it), len(dt)):
        held = [a for a in usable if 0 <= a + lag and [f for f, _ in dt[a + lag:a + lag + w]] == [f for f, _ in it[a:a + w]]]
        pairs = set()
        for a in held:
            for (_, x), (_, y) in zip(it[a:a + w], dt[a + lag:a + lag + w]):
                if x is not None:
                    pairs |= set(zip(x, y)) if len(x) == len(y) else {(" ".join(x), " ".join(y))}
        one = len({x for x, _ in pairs}) == len(pairs)
        if held and one and len(held) >= min(len(usable), -(-(len(it) - w + 1) * share // 1), run + 1 - w):
            kinds.add("verbatim" if all(x == y for x, y in pairs) else "reparameterised")
    return kinds or None


def test_finds_equal_brute_force(spark):
    rnd = random.Random(11)
    common = "the of a to in has gives takes finds holds then with from more apples trains roads days pays how many".split()
    names, numbers = ["Tom", "Anna", "Mary Jane", "Köln", "Sam Lee Poe"], ["3", "4", "twenty five", "1,200", "dos"]

    def sentence():
        out = []
        for _ in range(rnd.randint(4, 14)):
            r = rnd.random()
            out.append("{n%d}" % rnd.randint(0, 2) if r < 0.12 else "{a%d}" % rnd.randint(0, 2) if r < 0.24
                       else "{n%d} km" % rnd.randint(0, 2) if r < 0.3 else rnd.choice(common))
        return " ".join(out) + rnd.choice([".", "?", ";"])

    def filled(shape, steady=True):
        pick = {f"{k}{i}": rnd.choice(v) for k, v in (("n", numbers), ("a", names)) for i in range(3)}
        if steady:
            return shape.format(**pick)
        return re.sub(r"{(\w)\d}", lambda m: rnd.choice(numbers if m[1] == "n" else names), shape)

    shapes = [" ".join(sentence() for _ in range(rnd.randint(1, 3))) for _ in range(14)]
    items = [(i, filled(s)) for i, s in enumerate(shapes)]
    docs = []
    for s, (_, text) in zip(shapes, items):
        part = text.split()
        for body in (text, filled(s), filled(s), filled(s, False), text.lower(), " ".join(part[:len(part) * 2 // 3]), sentence().format(
                n0="1", n1="2", n2="3", a0="X", a1="Y", a2="Z")):
            docs.append((len(docs), rnd.choice(["", "So we start. ", "and so "]) + body + rnd.choice(["", " And then.", " end"])))
    got = found(spark, docs, items)
    want = {(d, i): searched(t, q) for d, t in docs for i, q in items}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want) and all(got[k] in want[k] for k in got)
    assert sum("reparameterised" == v for v in got.values()) > 10
