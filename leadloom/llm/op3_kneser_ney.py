"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

One character model per language over lower-cased words, each padded with word
borders.  Training counts padded n-grams of the top order over all training
rows; counts of the lower orders are continuation counts (how many distinct
characters stand before the gram), which follow from the distinct top grams.
Spark aggregates derive them from all grams.  Every order is a sorted array of
64-bit gram hashes with the languages that have the gram and its interpolated
log probability in each, and one of contexts with log back-off weights, so one
binary search serves all languages.

A text gets the language of the lowest cross-entropy per character.  It is
rejected when even that is further above the language's usual value than
calibration on training rows allows for its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, Stage, mix, slices_of

ORDER = 5
#: Probability of a character that no language has seen: one of so many.
ALPHABET = 100_000
UNKNOWN = "und"
#: Bytes of text whose words are counted or scored at a time.
SLICE = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@cache
def _is_letter() -> np.ndarray:
    """Per code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the tokens' letter runs, each run closed by a border, and the token of each.

    Before a run stand ORDER - 1 borders, so each gram of the top order is full.
    """
    # no token holds a line break, and lower() looks at no letter beyond one
    low = np.frombuffer("\n".join(tokens).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_is_letter()[low])
    if not len(at):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    first = np.append(True, np.diff(at) > 1)
    run = np.cumsum(first) - 1
    points = np.full(len(at) + ORDER * (run[-1] + 1), 32, np.uint32)
    points[np.arange(len(at)) + ORDER * run + ORDER - 1] = low[at]
    start = np.flatnonzero(first)
    token = np.cumsum(low == 10)[at[start]]
    return points, np.repeat(token, np.diff(np.append(start, len(at))) + ORDER)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts; of each word its number among them and its text."""
    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    n = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), n)


def _windows(points: np.ndarray) -> np.ndarray:
    """Start of every window of ORDER characters that ends on a letter or a closing border."""
    space = points == 32
    last = np.arange(ORDER - 1, len(points))
    # a window may end on a border only right after a letter
    return last[~space[last] | ~space[last - 1]] - (ORDER - 1)


def _hashes(grams: np.ndarray) -> list[np.ndarray]:
    """Hashes of the suffixes of length 1..ORDER of each row of code points."""
    out, acc = [], np.zeros(len(grams), U64)
    for k in range(1, ORDER + 1):
        acc = mix(acc ^ grams[:, -k].astype(U64) + U64(k << 32))
        out.append(acc)
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of top-order grams per language."""
    words: dict[str, Counter] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            tokens = list(counter)
            times = np.fromiter(counter.values(), np.int64, len(tokens))
            totals: dict[str, int] = {}
            for i in range(0, len(tokens), 20_000):
                points, owner = _code_points(tokens[i:i + 20_000])
                if not len(points):
                    continue
                start = _windows(points)
                grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)[start]
                key, first, where = np.unique(_hashes(grams)[-1], return_index=True, return_inverse=True)
                n = np.bincount(where, times[i:i + 20_000][owner[start + ORDER - 1]]).astype(np.int64)
                texts = np.ascontiguousarray(grams[first]).view(f"<U{ORDER}").reshape(-1)
                for text, c in zip(texts.tolist(), n.tolist()):
                    totals[text] = totals.get(text, 0) + c
            yield pa.record_batch([pa.array([lang] * len(totals), pa.string()), pa.array(list(totals), pa.string()),
                                   pa.array(list(totals.values()), pa.int64())], names=["lang", "gram", "n"])
        words.clear()

    for batch in batches:
        column = batch.column("text")
        for i, j in slices_of(column, SLICE):
            langs = batch.column("lang").slice(i, j - i)
            for lang in langs.unique():
                found, at, _ = _words(column.slice(i, j - i).filter(pc.equal(langs, lang)))
                counter = words.setdefault(lang.as_py(), Counter())
                counter.update(dict(zip(found, np.bincount(at, minlength=len(found)).tolist())))
            if sum(map(len, words.values())) >= flush:
                yield from counted()
    yield from counted()


class Table:
    """Values of (gram hash, language), sorted by both; one binary search finds a gram's languages."""

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.lexsort((lang, hashes))
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.ptr = np.append(first, len(hashes))
        self.lang, self.value = lang[order].astype(np.int32), value[order].astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``hashes``, language and value of all entries of the given grams."""
        if not len(self.keys):
            return np.empty(0, np.int64), self.lang, self.value
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[i] == hashes)
        start = self.ptr[i[row]]
        n = self.ptr[i[row] + 1] - start
        flat = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), self.lang[flat], self.value[flat]


@dataclass
class Model:
    langs: list[str]
    log_p: list[Table]              # per order, grams seen
    log_back: list[Table]           # per length from 1, contexts seen
    log_back_root: np.ndarray | None = None  # back-off weight of the empty context, per language
    usual: np.ndarray | None = None          # cross-entropy of all training rows together, per language

    def log_probs(self, points: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each window, a column per language."""
        if not self.langs:
            return np.zeros((len(start), 0))
        grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)[start]
        # texts repeat their grams: each distinct one is looked up once
        _, first, where = np.unique(_hashes(grams)[-1], return_index=True, return_inverse=True)
        return self._distinct(grams[first])[where]

    def _distinct(self, grams: np.ndarray) -> np.ndarray:
        out = np.full((len(grams), len(self.langs)), -np.log(ALPHABET), np.float64) + self.log_back_root
        whole = _hashes(grams)
        context = _hashes(np.concatenate([grams[:, :1], grams[:, :-1]], axis=1))
        for k in range(ORDER):
            if k:  # weight of leaving the context of length k
                row, lang, value = self.log_back[k - 1].find(context[k - 1])
                out[row, lang] += value
            row, lang, value = self.log_p[k].find(whole[k])
            out[row, lang] = value
        return out


def _discount(n1: int, n2: int) -> float:
    """Absolute discount from the numbers of grams seen once and twice."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _hashed(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Grams of any length up to ORDER as hashes, languages as numbers."""
    for batch in batches:
        grams = [g.rjust(ORDER) for g in batch.column("gram").to_pylist()]
        k = batch.column("k").to_numpy()
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        h = np.stack(_hashes(points))[k - 1, np.arange(len(grams))] if grams else np.empty(0, U64)
        lang = pa.array([at[x] for x in batch.column("lang").to_pylist()], pa.int32())
        yield pa.record_batch([batch.column("k"), lang, pa.array(h.view(np.int64)), batch.column("value")],
                              names=["k", "lang", "h", "value"])


def _tables(df: DataFrame, langs: list[str], most: int) -> list[Table]:
    """``df(k, lang, gram, value)`` as sorted arrays, one table for each k up to ``most``."""
    at = {x: i for i, x in enumerate(langs)}
    got = df.mapInArrow(partial(_hashed, at=at), "k int, lang int, h long, value float").toArrow()
    k, lang, h, value = (got.column(c).to_numpy() for c in ("k", "lang", "h", "value"))
    return [Table(h[k == i].view(U64), lang[k == i], value[k == i]) for i in range(1, most + 1)]


def model_of(counts: DataFrame, stage: Stage) -> Model:
    """Models from ``counts(lang, gram, n)`` of all grams of the top order; one row per language and gram.

    Continuation counts, discounts, back-off weights and probabilities are
    joins and aggregates over all grams; the driver gets hashes and values.
    """
    levels = {ORDER: counts.select("lang", "gram", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        # distinct left neighbours
        levels[k] = stage.put(levels[k + 1].groupBy("lang", F.substring("gram", -k, k).alias("gram"))
                              .agg(F.count(F.lit(1)).alias("c")), f"order{k}")
    union = None
    for k, level in levels.items():
        level = level.withColumn("k", F.lit(k))
        union = level if union is None else union.unionByName(level)
    stats = union.groupBy("k", "lang").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") == 1).alias("n1"),
        F.count_if(F.col("c") == 2).alias("n2")).collect()
    langs = sorted({r["lang"] for r in stats})
    if not langs:
        return Model([], [], [])
    root = {r["lang"]: _discount(r["n1"], r["n2"]) * r["kinds"] / r["total"] for r in stats if r["k"] == 1}
    # a few numbers per order and language
    known = F.broadcast(counts.sparkSession.createDataFrame(
        [(r["k"], r["lang"], _discount(r["n1"], r["n2"]), r["total"], root[r["lang"]]) for r in stats],
        "k int, lang string, d double, total long, root double"))
    held = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    p = stage.put(levels[1].join(known.where("k = 1"), "lang")
                  .select("lang", "gram", "c", (held + F.col("root") / ALPHABET).alias("p")), "p1")
    found, contexts = [p], []
    for k in range(2, ORDER + 1):
        grams = levels[k].withColumn("ctx", F.substring("gram", 1, k - 1))
        left = stage.put(grams.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
                         .join(known.where(F.col("k") == k).select("lang", "d"), "lang")
                         .select("lang", "ctx", "d", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")),
                         f"contexts{k}")
        low = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        p = stage.put(grams.withColumn("suffix", F.substring("gram", 2, k - 1)).join(left, ["lang", "ctx"])
                      .join(low, ["lang", "suffix"])
                      .select("lang", "gram", "c", (held + F.col("back") * F.col("low")).alias("p")), f"p{k}")
        found.append(p)
        contexts.append(left)
    usual = {r["lang"]: r["u"] for r in p.groupBy("lang").agg(
        (-F.sum(F.col("c") * F.log("p")) / F.sum("c")).alias("u")).collect()}
    log_p = log_back = None
    for k, df in enumerate(found, 1):
        df = df.select(F.lit(k).alias("k"), "lang", "gram", F.log("p").alias("value"))
        log_p = df if log_p is None else log_p.unionByName(df)
    for k, df in enumerate(contexts, 1):
        df = df.select(F.lit(k).alias("k"), "lang", F.col("ctx").alias("gram"), F.log("back").alias("value"))
        log_back = df if log_back is None else log_back.unionByName(df)
    return Model(langs, _tables(log_p.withColumn("value", F.col("value").cast("float")), langs, ORDER),
                 _tables(log_back.withColumn("value", F.col("value").cast("float")), langs, ORDER - 1),
                 np.log([root[x] for x in langs]), np.array([usual[x] for x in langs]))


def build(rows: list[tuple[str, str, int]]) -> Model:
    """The model of ``model_of`` from (language, gram of the top order, count) in plain Python, for small lists."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], [], [])
    out, back_out = [([], [], []) for _ in range(ORDER)], [([], [], []) for _ in range(ORDER - 1)]
    roots, usual = [], []

    def put(table, grams, j, values):
        points = np.frombuffer("".join(g.rjust(ORDER) for g in grams).encode("utf-32-le"), np.uint32)
        table[0].append(_hashes(points.reshape(-1, ORDER))[len(grams[0]) - 1])
        table[1].append(np.full(len(grams), j))
        table[2].append(np.log(values))

    for j, lang in enumerate(langs):
        levels = {ORDER: Counter({g: n for x, g, n in rows if x == lang})}
        for k in range(ORDER - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        low: dict[str, float] = {}
        for k in range(1, ORDER + 1):
            c = levels[k]
            d = _discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
            total, kinds = Counter(), Counter(g[:-1] for g in c)
            for g, n in c.items():
                total[g[:-1]] += n
            back = {x: d * kinds[x] / total[x] for x in kinds}
            low = {g: max(n - d, 0) / total[g[:-1]] + back[g[:-1]] * (low[g[1:]] if k > 1 else 1 / ALPHABET)
                   for g, n in c.items()}
            put(out[k - 1], list(low), j, list(low.values()))
            if k > 1:
                put(back_out[k - 2], list(back), j, list(back.values()))
            else:
                roots.append(np.log(back[""]))
        usual.append(-sum(n * np.log(low[g]) for g, n in c.items()) / sum(c.values()))
    return Model(langs, *([Table(*map(np.concatenate, t)) for t in tables] for tables in (out, back_out)),
                 np.array(roots), np.array(usual))


class _Scorer:
    """Scores of whole texts; the sums of each distinct word are computed once for the texts of a call."""

    def __init__(self, model: Model):
        self.model = model

    def _sums(self, tokens: list[str]) -> np.ndarray:
        """Per token: log probability per language, scored characters, letters."""
        out = np.zeros((len(tokens), len(self.model.langs) + 2))
        for i in range(0, len(tokens), 20_000):
            some = tokens[i:i + 20_000]
            points, owner = _code_points(some)
            if not len(points):
                continue
            start = _windows(points)
            of = owner[start + ORDER - 1]
            logs = self.model.log_probs(points, start)
            for j in range(logs.shape[1]):
                out[i:i + len(some), j] = np.bincount(of, logs[:, j], len(some))
            out[i:i + len(some), -2] = np.bincount(of, minlength=len(some))
            out[i:i + len(some), -1] = np.bincount(of, points[start + ORDER - 1] != 32, minlength=len(some))
        return out

    def totals(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Per text: summed log probability per language, scored characters, letters."""
        tokens, word, text = _words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        sums = self._sums(tokens)
        out = np.zeros((len(texts), sums.shape[1]))
        for j in range(sums.shape[1]):
            out[:, j] = np.bincount(text, sums[word, j], len(texts))
        return out


def _bins(t: np.ndarray, lang: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that calibrate, and their bin of (cross-entropy - usual)^2 * characters; 1,000 bins to a factor of e."""
    row = np.flatnonzero((t[:, -1] > 0) & (lang >= 0))
    t, lang = t[row], lang[row]
    entropy = -t[np.arange(len(t)), lang] / t[:, -2]
    x = np.maximum((entropy - usual[lang]) ** 2 * t[:, -2], 1e-9)
    return row, np.rint(np.log(x) * 1000).astype(np.int64)


def _score(batches: Iterator[pa.RecordBatch], model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns and the scores; of rows with a language to learn in ``__own`` also its number and the bin."""
    m: Model = model.value
    at = {x: i for i, x in enumerate(m.langs)}
    scorer = _Scorer(m)
    names = pa.array([*m.langs, UNKNOWN])
    for batch in batches:
        column = batch.column("text")
        for i, j in slices_of(column, SLICE):
            t = scorer.totals(column.slice(i, j - i))
            chars, letters = t[:, -2], t[:, -1]
            known = (letters > 0) & bool(m.langs)
            own, bin_, has = np.full(len(t), -1), np.zeros(len(t), np.int64), np.zeros(len(t), bool)
            if m.langs:
                cross = -t[:, :-2] / np.maximum(chars, 1)[:, None]
                best = cross.argmin(axis=1)
                low = cross[np.arange(len(t)), best]
                # posterior of a text of at most 20 characters of evidence, so that it stays below 1
                weight = np.exp((low[:, None] - cross) * np.minimum(chars, 20)[:, None])
                share = 1 / weight.sum(axis=1)
                if "__own" in batch.schema.names:
                    own = np.array([at.get(x, -1) for x in batch.column("__own").slice(i, j - i).to_pylist()], np.int64)
                    row, bin_[row] = _bins(t, own, m.usual)
                    has[row] = True
            else:
                best, low, share = np.zeros(len(t), int), np.zeros(len(t)), np.zeros(len(t))
            pick = np.where(known, best, len(m.langs))
            yield pa.record_batch(
                [*[batch.column(k).slice(i, j - i) for k in keep], names.take(pa.array(pick)),
                 pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, low, 0.0)),
                 pa.array(chars), pa.array(pick + 1, pa.int32()),
                 pa.array(own, pa.int32(), mask=~has), pa.array(bin_, mask=~has)],
                names=[*keep, *_SCORES])


#: Columns of ``_score`` after those of the table; the last four lead to ``rejected``.
_SCORES = {"lang_pred": "string", "score": "double", "cross_entropy": "double",
           "__chars": "double", "__pick": "int", "__lang": "int", "__bin": "long"}


def fit(train: DataFrame) -> Model:
    """Learn from all rows and all grams of ``train(text, lang)``; rows with a null text or lang are left out.

    The whole model goes to the executors: about 16 bytes for each distinct
    gram of each order and language.
    """
    train = train.where("text is not null and lang is not null")
    stage = Stage(train.sparkSession, "grams")
    counts = stage.put(train.select("lang", "text").mapInArrow(partial(_gram_counts, flush=400_000),
                                                               "lang string, gram string, n long")
                       .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    return model_of(counts, stage)


def _deviations(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Rows by language and bin."""
    m: Model = model.value
    at = {x: i for i, x in enumerate(m.langs)}
    scorer = _Scorer(m)
    found: Counter = Counter()
    for batch in batches:
        column = batch.column("text")
        own = np.array([at.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
        for i, j in slices_of(column, SLICE):
            row, bin_ = _bins(scorer.totals(column.slice(i, j - i)), own[i:j], m.usual)
            found.update(zip(own[i:j][row].tolist(), bin_.tolist()))
    rows = list(found.items())
    yield pa.record_batch([pa.array([r[0][0] for r in rows], pa.int32()), pa.array([r[0][1] for r in rows], pa.int64()),
                           pa.array([r[1] for r in rows], pa.int64())], names=["lang", "bin", "rows"])


def _spread(bins: DataFrame, langs: int) -> np.ndarray:
    """Per language the median deviation of ``bins(lang, bin, rows)``, to 0.05 %."""
    found = bins.groupBy("lang", "bin").agg(F.sum("rows").alias("rows")).toPandas().sort_values("bin")
    spread = np.full(langs, 0.5)
    for j, own in found.groupby("lang"):
        below = own["rows"].cumsum().to_numpy()
        median = np.exp(own["bin"].to_numpy()[np.searchsorted(below, below[-1] / 2)] / 1000)
        spread[j] = max(0.5, np.sqrt(median) * 1.4826)
    return spread


def calibrate(train: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """Per language the usual cross-entropy, and its deviation times the square root of the length.

    Both cover all rows of ``train(text, lang)``, which the model has learnt
    from: the first follows from the gram counts, the second is the median of
    the rows' deviations, to 0.05 %.
    """
    langs, usual = model.value.langs, model.value.usual
    if not langs:
        return np.zeros(0), np.zeros(0)
    bins = (train.where("text is not null and lang is not null").select("text", "lang")
            .mapInArrow(partial(_deviations, model=model), "lang int, bin long, rows long"))
    return usual, _spread(bins, len(langs))


def identify(docs: DataFrame, train: DataFrame | None = None, z: float = 6.0,
             keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy and rejected.

    ``train`` has text and lang; without it the rows of ``docs`` that
    are not held out teach.  Null texts and texts without a letter get ``und``,
    score 0 and rejected = true; so does everything if no row can teach.  Other
    texts always name a learned language; ``rejected`` says that their
    cross-entropy is too far above that language's.  Ties go to the language
    first in the alphabet.  The columns of ``docs`` that ``keep`` names stay
    (default: all); columns with the names of results are replaced.

    Rows that teach are scored and calibrated on in one pass, so the scored
    rows are written to shared storage with the columns kept.
    """
    spark = docs.sparkSession
    teaches = ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)) if train is None else None
    model = spark.sparkContext.broadcast(
        fit((docs.where(teaches) if train is None else train).select("text", "lang")))
    langs = len(model.value.langs)
    base = docs if train is not None else docs.withColumn("__own", F.when(teaches, F.col("lang")))
    base = base.drop("lang_pred", "score", "cross_entropy", "rejected")
    kept = [f for f in base.schema.fields if f.name != "__own" and (keep is None or f.name in keep)]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept],
                        *[f"{name} {kind}" for name, kind in _SCORES.items()]])
    scored = base.mapInArrow(partial(_score, model=model, keep=[f.name for f in kept]), fields)
    names = [f.name for f in kept]
    if not langs:
        return scored.select(*names, "lang_pred", "score", "cross_entropy", F.lit(True).alias("rejected"))
    if train is None:
        scored = Stage(spark, "languages").put(scored, "scored")
        usual = model.value.usual
        spread = _spread(scored.where("__lang is not null").select(
            F.col("__lang").alias("lang"), F.col("__bin").alias("bin"), F.lit(1).alias("rows")), langs)
    else:
        usual, spread = calibrate(train.select("text", "lang"), model)
    # __pick counts from 1; a text without a letter has the number after the last language
    at = F.least("__pick", F.lit(langs))
    most = (F.element_at(F.lit((usual * 1.25).tolist()), at)
            + F.element_at(F.lit((z * spread).tolist()), at) / F.sqrt(F.greatest("__chars", F.lit(1.0))))
    return scored.select(*names, "lang_pred", "score", "cross_entropy",
                         ((F.col("__pick") > langs) | (F.col("cross_entropy") > most)).alias("rejected"))
