"""Benchmark decontamination by templates.

Words become template tokens: a run of numbers, a unit after numbers and a run
of names (capitalised words, wherever they stand) each turn into one typed
placeholder; everything else is lower-cased.  Windows of template tokens are
hash-joined between documents and benchmark items, and so are windows of the
plain words.  For each document, item and alignment of templates the values in
the placeholders are compared: a re-parameterised question gives each of the
item's values one other value throughout, while a chance hit does not.

A document window goes into the join only if a table of fixed size, filled
from the benchmark's window hashes and sent to all tasks, may hold it; a
benchmark of any size only makes that sieve let more windows pass.  Alignments
are proposed by an item's rarer windows alone: whoever matches as many windows
as a find needs cannot miss all of them, so what many items share (the opening
words of an instruction) makes no pairs of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, Stage, broadcast_small, mix, row_key, slices

# Words that name numbers, and units of measure, in English, Spanish, German and French.
# Words that are also articles or common adverbs of one of them are left out.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion half third quarter dozen "
    "cero dos tres cuatro cinco siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta "
    "sesenta setenta ochenta noventa cien ciento mil millones docena "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig "
    "achtzig neunzig hundert tausend dutzend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante "
    "cinquante soixante cent mille millions douzaine".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros "
    "usd eur percent degree degrees watt watts volt volts meter meters metre metres kph mph kmh hz "
    "kilómetros metros centímetros gramos kilos litros horas minutos segundos días semanas meses años euros dólares "
    "grados tage wochen monate jahre stunden minuten sekunden liter gramm kilogramm grad "
    "kilomètres mètres centimètres grammes heures secondes jours semaines mois ans degrés".split())

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: A templated window needs so many different plain words, so that tables of numbers do not match each other.
LEAST_PLAIN = 4
SIEVE_BITS = 22

_PIECES = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")


class _Vocabulary(dict):
    """Place of each raw token, and its word pieces: hash, kind, capital, and whether the token ends a sentence."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.text: list[str] = []
        self.first, self.count, self.ends = array("q"), array("q"), array("b")
        self.hash, self.kind, self.capital = array("Q"), array("b"), array("b")

    def __missing__(self, token: str) -> int:
        import xxhash

        self.first.append(len(self.text))
        bare = token.rstrip(".,;:!?")
        pieces = (bare,) if bare.isalpha() else _PIECES.findall(token)
        for piece in pieces:
            low = piece.lower()
            kind = NUMBER if piece[0].isdigit() or low in NUMBER_WORDS else UNIT if low in UNITS else WORD
            self.text.append(low)
            self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
            self.kind.append(kind)
            self.capital.append(kind == WORD and piece[0].isupper())
        self.count.append(len(pieces))
        self.ends.append(token.rstrip("\"')]*_")[-1:] in (".", "!", "?", ":"))
        n = self[token] = len(self)
        return n

    def tokens(self, text: str) -> np.ndarray:
        raw = text.split()
        if len(self) > self.most:
            self.empty()
        return np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.first), np.array(self.count), np.array(self.ends, bool), np.array(self.hash),
                np.array(self.kind), np.array(self.capital, bool))


def _sequence(tokens: np.ndarray, arrays: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word piece of a text: its place in the vocabulary, plain hash, kind, and whether a template token starts."""
    first, count, ends, hashes, kinds, capital = arrays
    n = count[tokens]
    total = int(n.sum())
    start = np.cumsum(n) - n
    piece = np.repeat(first[tokens] - start, n) + np.arange(total)
    kind = kinds[piece].copy()
    closed = np.concatenate([[True], ends[tokens][:-1]]) if len(tokens) else np.zeros(0, bool)
    opening = np.zeros(total, bool)
    opening[start[(n > 0) & closed]] = True
    kind[capital[piece]] = NAME
    follows = np.concatenate([[False], kind[:-1] == NUMBER]) if total else np.zeros(0, bool)
    kind[(kind == UNIT) & ~follows] = WORD
    changes = np.concatenate([[True], kind[1:] != kind[:-1]]) if total else np.zeros(0, bool)
    return piece, hashes[piece], kind, changes | opening | (kind == WORD)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` values."""
    n = len(h) - width + 1
    acc = np.full(n, width, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            acc = acc * U64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(acc)


_TYPED = mix(np.arange(4, dtype=U64) + U64(0x7E57))
_WINDOW = "at int, width int, templated boolean, hash long, slots array<string>"


def _windows(sequence: tuple, vocabulary: _Vocabulary, plain_widths: list[int], template_widths: list[int],
             sieve: np.ndarray | None) -> Iterator[tuple]:
    """Windows of a text: place (in pieces, or in template tokens), width, whether templated, hash, slot values."""
    piece, plain, kind, starts = sequence
    token = np.flatnonzero(starts)
    held = kind[token]
    is_word = held == WORD
    template = np.where(is_word, plain[token], _TYPED[held]) if len(token) else np.zeros(0, U64)
    words = np.concatenate([[0], np.cumsum(is_word)])
    ends = np.append(token[1:], len(piece))

    def hits(values: np.ndarray, width: int, templated: bool) -> tuple[np.ndarray, np.ndarray]:
        h = _rolled(values, width) ^ U64(templated)
        ok = np.ones(len(h), bool) if sieve is None else sieve[(h >> U64(64 - SIEVE_BITS)).astype(np.int64)]
        if templated:
            ok &= words[width:] - words[:-width] >= LEAST_PLAIN
        return h.view(np.int64), np.flatnonzero(ok)

    for width in plain_widths:
        if len(piece) >= width:
            h, found = hits(plain, width, False)
            for i in found.tolist():
                yield i, width, False, int(h[i]), []
    for width in template_widths:
        if len(token) >= width:
            h, found = hits(template, width, True)
            for i in found.tolist():
                window = range(i, i + width)
                if len({vocabulary.text[piece[token[k]]] for k in window if is_word[k]}) >= LEAST_PLAIN:
                    yield i, width, True, int(h[i]), [
                        " ".join(vocabulary.text[p] for p in piece[token[k]:ends[k]]) for k in window if not is_word[k]]


def _bench_windows(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Windows of benchmark items and how many there are of each kind; what is shorter than ``width`` is one window."""
    vocabulary = _Vocabulary()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            tokens = vocabulary.tokens(text or "")
            sequence = _sequence(tokens, vocabulary.arrays())
            size, short = len(sequence[0]), int(sequence[3].sum())
            if size >= least:
                found = list(_windows(sequence, vocabulary, [min(width, size)], [min(width, short)], None))
                usable = sum(w[2] for w in found)
                for w in found:
                    places = (short if w[2] else size) - w[1] + 1
                    rows.append((item, places, usable if w[2] else places, *w))
        yield _table(rows, [("item_id", pa.int64()), ("places", pa.int32()), ("usable", pa.int32())])


def _table(rows: list[tuple], head: list[tuple]) -> pa.RecordBatch:
    fields = [*head, ("at", pa.int32()), ("width", pa.int32()), ("templated", pa.bool_()), ("hash", pa.int64()),
              ("slots", pa.list_(pa.string()))]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _doc_windows(batches: Iterator[pa.RecordBatch], plain_widths: list[int], template_widths: list[int],
                 sieve) -> Iterator[pa.RecordBatch]:
    vocabulary = _Vocabulary()
    table = np.unpackbits(np.frombuffer(sieve.value, np.uint8)).astype(bool)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys = [batch.column(c).to_pylist() for c in ("__id", "__no_id", "__text")]
        for i, j in slices(texts):
            if len(vocabulary) > vocabulary.most:
                vocabulary.empty()
            # no clearing inside a slice: places in the vocabulary must stay
            held, vocabulary.most = vocabulary.most, 1 << 60
            tokens = [vocabulary.tokens(t or "") for t in texts[i:j]]
            vocabulary.most = held
            arrays = vocabulary.arrays()
            rows = []
            for k, t in enumerate(tokens, i):
                if len(t):
                    rows += [(keys[0][k], keys[1][k], keys[2][k], *w) for w in _windows(
                        _sequence(t, arrays), vocabulary, plain_widths, template_widths, table)]
            yield _table(rows, [("__id", pa.int64()), ("__no_id", pa.bool_()), ("__text", pa.int64())])


def _sieve(hashes: DataFrame) -> bytes:
    """A table of 2 ** SIEVE_BITS bits: which leading bits the hashes have.  Built from one bit set per task."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(U64)
            bits[(h >> U64(64 - SIEVE_BITS)).astype(np.int64)] = True
        slots = np.flatnonzero(np.packbits(bits))
        yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(np.packbits(bits)[slots].astype(np.int64))],
                              names=["slot", "bits"])

    parts = hashes.select("hash").mapInArrow(fill, "slot long, bits long").groupBy("slot") \
        .agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    out[parts.column("slot").to_numpy()] = parts.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def _value_pairs() -> Column:
    """(item value, document value) of each slot: word by word where both have as many words, else as a whole."""
    def pairs(item, doc):
        a, b = F.split(item, " "), F.split(doc, " ")
        alike = F.zip_with(a, b, lambda x, y: F.struct(x.alias("item"), y.alias("doc")))
        return F.when(F.size(a) == F.size(b), alike).otherwise(F.array(F.struct(item.alias("item"), doc.alias("doc"))))
    return F.array_distinct(F.flatten(F.zip_with("item_slots", "slots", pairs)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_words: int = 5, share: float = 0.5,
               run_words: int = 13, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Benchmark items found in documents: a row per document row and item.

    Columns: the document row (__id, __no_id, __text as ``row_key`` makes
    them), doc_id, item_id, kind (``verbatim`` or ``reparameterised``),
    coverage (share of the item's windows that match at the best alignment),
    matched_words and slots (pairs of unlike values in the placeholders).

    An item counts as found when, at one alignment of plain words or of
    template tokens, at least ``share`` of its windows of ``width`` match, or so
    many that ``run_words`` words or tokens do.  Template windows need
    ``LEAST_PLAIN`` different plain words; an item that has fewer of them than
    the share asks for must match in all it has.  Templates count only where
    each value of the item stands for one value of the document throughout (two
    of its values may become equal).  Items of fewer than ``least_words`` words
    are never found; items shorter than ``width`` must match as a whole.  Of
    equally good alignments the one with fewer unlike values is told.

    Null and empty texts hold nothing, null and empty items are found nowhere.
    Repeated items with one id count as one item, with the smallest text; items
    with equal texts are found each.  Repeated rows of docs are one row here.
    Texts of any length are read whole.  Extra columns are ignored, whatever
    their names.  The windows of the items are broadcast up to
    ``broadcast_windows``; beyond that they are joined by a shuffle.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "leaks")
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text")))
    # windows that an alignment needs at least, for either reason
    need = F.greatest(F.lit(1), F.least(F.col("usable"), F.ceil(F.lit(share) * F.col("places")).cast("int"),
                                        F.lit(run_words + 1) - F.col("width")))
    wanted = stage.put(items.mapInArrow(partial(_bench_windows, width=width, least=least_words),
                                        "item_id long, places int, usable int, " + _WINDOW).withColumn("need", need), "wanted")
    sizes = wanted.select("templated", "width").distinct().collect()  # at most 2 * ``width`` values
    plain_widths, template_widths = (sorted(r.width for r in sizes if r.templated == t) for t in (False, True))
    sieve = spark.sparkContext.broadcast(_sieve(wanted))
    src = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in row_key().items()])
    held = stage.put(src.where("text is not null").mapInArrow(
        partial(_doc_windows, plain_widths=plain_widths, template_widths=template_widths, sieve=sieve),
        "__id long, __no_id boolean, __text long, " + _WINDOW), "held")
    row, window = ["__id", "__no_id", "__text"], ["hash", "width", "templated"]

    # an item's windows from rare to common; all but the last need - 1 of them propose alignments
    common = wanted.groupBy(*window).agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("item_id", "templated").orderBy("holders", "hash", "at")
    rare = stage.put(wanted.join(common, window).withColumn("__rank", F.row_number().over(order))
                     .where(F.col("__rank") <= F.col("usable") - F.col("need") + 1)
                     .select(*window, "item_id", F.col("at").alias("item_at")), "rare")
    lag = F.col("at") - F.col("item_at")
    proposed = stage.put(held.join(broadcast_small(rare, broadcast_windows), window)
                         .select(*row, "templated", "item_id", lag.alias("lag")).distinct(), "proposed")
    at_item = wanted.select(*window, "item_id", "places", "usable", "need", F.col("at").alias("item_at"),
                            F.col("slots").alias("item_slots"))
    met = (proposed.join(held, [*row, "templated"]).withColumn("item_at", F.col("at") - F.col("lag"))
           .join(at_item, [*window, "item_id", "item_at"]).withColumn("pairs", _value_pairs()))
    counted = (met.groupBy(*row, "item_id", "templated", "lag").agg(
        F.count_distinct("item_at").cast("int").alias("n"), F.first("width").alias("width"), F.first("need").alias("need"),
        F.first("usable").alias("usable"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
        .where((F.col("n") >= F.col("need"))
               & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))) == F.size("pairs"))))
    differing = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    best = counted.groupBy(*row, "item_id").agg(F.max(F.struct(
        (F.col("n") / F.col("usable")).alias("coverage"), (-differing).alias("same"),
        (F.col("n") + F.col("width") - 1).alias("matched_words"))).alias("b"))
    return best.select(*row, F.when(~F.col("__no_id"), F.col("__id")).alias("doc_id"), "item_id",
                       F.when(F.col("b.same") < 0, "reparameterised").otherwise("verbatim").alias("kind"),
                       F.col("b.coverage").alias("coverage"), F.col("b.matched_words").cast("int").alias("matched_words"),
                       (-F.col("b.same")).cast("int").alias("slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without the rows in which ``find_leaks`` finds an item; columns and other rows stay as they are."""
    stage = Stage(docs.sparkSession, "clean")
    row = ["__id", "__no_id", "__text"]
    leaks = stage.put(find_leaks(docs, benchmark, **options).select(*row).distinct(), "leaky")
    return (docs.withColumns(row_key()).join(broadcast_small(leaks, broadcast_rows), row, "left_anti").drop(*row))
