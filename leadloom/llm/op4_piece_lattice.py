"""SentencePiece encoding and decoding through a relational lattice of pieces.

The words of a corpus are segmented once each: every bounded-length substring
of a word is exploded, an equi-join with the piece table turns substrings into
lattice edges, the edges are grouped by word and a higher-order ``aggregate``
folds them into the word's path.  The words worth a row of that table are the
most frequent ones of the whole corpus (a bounded lexicon, sent to all tasks);
a rarer word is segmented by the task that meets it, with the same rule, over
the same pieces.  The lexicon only saves work, it never changes a result.

The fold depends on the kind of model.  For a unigram model it is Viterbi's:
the highest sum of scores wins; of equal sums the one whose last piece begins
earliest.  Scores of a BPE model are merge ranks, not log probabilities, and
Viterbi over them gives other pieces than the model; there the fold goes
through the edges by rank and joins two neighbouring pieces whenever they make
up an edge.  A character without a piece becomes its UTF-8 byte pieces (or the
unknown piece, if the table has no byte pieces); in the unigram fold it costs
the lowest score less 10.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stage, slices_of

SPACE = "▁"
#: What an unknown character costs below the lowest score, as the library has it.
UNKNOWN_COST = 10.0


@dataclass
class Pieces:
    """The piece table of a model file."""
    scores: dict[str, tuple[float, int]]     # ordinary pieces: score and id
    byte_ids: list[int]                      # ids of the 256 byte pieces, or none
    unknown: int
    joined: frozenset[str]                   # pairs of characters that some piece holds side by side
    texts: list[bytes]                       # what each id decodes to; control pieces to nothing
    longest: int

    @property
    def unknown_score(self) -> float:
        return min(s for s, _ in self.scores.values()) - UNKNOWN_COST

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        """All pieces of two characters or more with rank (lowest first) and length; one pass over a word gives its edges."""
        found = ahocorasick.Automaton()
        for piece, (score, _) in self.scores.items():
            if len(piece) > 1:
                found.add_word(piece, (-score, len(piece)))
        found.make_automaton()
        return found

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


def load_pieces(model_file: str) -> Pieces:
    """Read a model file on the driver.  Words are cut before each run of word marks, so no piece may cross there."""
    import re

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores, byte_ids, texts = {}, [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids.append(i)
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unused(i):
            texts.append(b"")
        elif model.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            scores[piece] = (float(model.get_score(i)), i)
            texts.append(piece.replace(SPACE, " ").encode("utf-8", "surrogatepass"))
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"piece {piece!r} spans words; words could not be segmented one by one")
    joined = frozenset(piece[i:i + 2] for piece in scores for i in range(len(piece) - 1))
    return Pieces(scores, byte_ids, model.unk_id(), joined, texts, max(map(len, scores)))


def words_of(text: str) -> list[str]:
    """The words of a text: runs of word marks with what follows them."""
    if "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " ":
        return [SPACE + part for part in text.split(" ")]
    parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
    out, marks = [], ""
    for part in parts:
        marks += SPACE
        if part:
            out.append(marks + part)
            marks = ""
    if marks:
        out.append(marks)
    return out


def parts_of(word: str, joined: frozenset[str]) -> list[str]:
    """The word cut wherever no piece holds the two characters side by side: no piece can cross there."""
    cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in joined]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]


def segment(word: str, pieces: Pieces, unknown: float) -> tuple[int, ...]:
    """Viterbi over one word; linear in its length."""
    n, longest, scores = len(word), pieces.longest, pieces.scores
    best, back = [0.0] + [None] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        top = None
        for start in range(max(0, end - longest), end):
            hit = scores.get(word[start:end])
            if hit is not None:
                value = best[start] + hit[0]
                if top is None or value > top:
                    top, back[end] = value, (start, hit[1])
        if word[end - 1] not in scores:
            value = best[end - 1] + unknown
            if top is None or value > top:
                top, back[end] = value, (end - 1, None)
        best[end] = top
    ids, end = [], n
    while end:
        start, i = back[end]
        ids.append([i] if i is not None else pieces.fallback(word[start:end]))
        end = start
    return tuple(chain.from_iterable(reversed(ids)))


def merge(word: str, pieces: Pieces) -> tuple[int, ...]:
    """Merges by rank over one word: edges from the best score down, leftmost first.

    A piece ranks after the two it was merged from, so when an edge comes up all
    merges that could make its parts are done.
    """
    n, scores = len(word), pieces.scores
    edges = [(rank, last + 1 - size, last + 1) for last, (rank, size) in pieces.finder.iter(word)]
    edges.sort()
    after = list(range(1, n + 1))     # where the piece that begins here ends; 0 once joined to an earlier one
    for _, start, end in edges:
        middle = after[start]
        if middle and middle < end and after[middle] == end:
            after[start], after[middle] = end, 0
    ids, start = [], 0
    while start < n:
        end = after[start]
        hit = scores.get(word[start:end])
        ids += [hit[1]] if hit is not None else pieces.fallback(word[start:end])
        start = end
    return tuple(ids)


def segment_words(words: DataFrame, pieces: Pieces, kind: str = "unigram") -> DataFrame:
    """``word`` and ``ids`` for the distinct non-null words of ``words(word)``: the relational lattice.

    Unknown characters have the id -1 - code point here; ``with_bytes`` turns
    them into byte pieces.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([(p, s, i) for p, (s, i) in pieces.scores.items()],
                                  "piece string, score double, id int")
    if kind not in ("bpe", "unigram"):
        raise ValueError(f"no such kind of model: {kind}")
    words = words.where("word is not null and word <> ''").select("word").distinct()
    spans = F.flatten(F.transform(
        F.sequence(F.lit(0), F.length("word") - 1),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("word") - i)),
                              lambda n: F.struct(i.alias("start"), (i + n).alias("end"),
                                                 F.substr(F.col("word"), i + 1, n).alias("piece")))))
    edges = (words.select("word", F.explode(spans).alias("s")).select("word", "s.*")
             .join(F.broadcast(table), "piece", "left")   # as many rows as the vocabulary has pieces
             .where((F.col("id").isNotNull()) | (F.col("end") - F.col("start") == 1))
             .select("word", "start", "end", F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
                     F.coalesce("id", -1 - F.ascii("piece")).alias("id")))
    if kind == "bpe":
        return _merged(edges)
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"))
    # fold over the edges by (end, start): the state holds the best path to every place reached so far
    path = "struct<score: double, ids: array<int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")).cast(path))

    def step(state, edge):
        before = F.get(state, edge["start"])
        offer = F.struct((before["score"] + edge["score"]).alias("score"),
                         F.concat(before["ids"], F.array(edge["id"])).alias("ids")).cast(path)
        reached = F.size(state) > edge["end"]
        better = offer["score"] > F.get(state, edge["end"])["score"]
        return (F.when(~reached, F.concat(state, F.array(offer)))
                .when(better, F.concat(F.slice(state, F.lit(1), edge["end"]), F.array(offer)))
                .otherwise(state))

    folded = F.aggregate("edges", start, step, lambda state: F.element_at(state, -1)["ids"])
    return lattice.select("word", folded.alias("ids"))


def _merged(edges: DataFrame) -> DataFrame:
    """The fold of a BPE model; its state is the array of places where pieces begin and end."""
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("rank"), "start", "end", "id"))).alias("edges"))

    def step(state, edge):
        inside = F.filter(state, lambda p: (p > edge["start"]) & (p < edge["end"]))
        joins = (F.array_contains(state, edge["start"]) & F.array_contains(state, edge["end"]) & (F.size(inside) == 1))
        return F.when(joins, F.array_remove(state, F.get(inside, F.lit(0)))).otherwise(state)

    long_edges = F.filter("edges", lambda e: e["end"] - e["start"] > 1)
    places = F.aggregate(long_edges, F.sequence(F.lit(0), F.length("word")), step)
    spans = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1),
                       lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    ids = F.transform(spans, lambda s: F.get(F.filter(
        "edges", lambda e: (e["start"] == s["start"]) & (e["end"] == s["end"])), F.lit(0))["id"])
    return lattice.withColumn("places", places).select("word", ids.alias("ids"))


def with_bytes(ids: list[int], pieces: Pieces) -> tuple[int, ...]:
    """Ids with the unknown characters replaced by their byte pieces."""
    if min(ids) >= 0:
        return tuple(ids)
    return tuple(chain.from_iterable([i] if i >= 0 else pieces.fallback(chr(-1 - i)) for i in ids))


def lexicon(docs: DataFrame, pieces: Pieces, most_words: int, most_chars: int, kind: str) -> dict[str, bytes]:
    """Segmentations of the most frequent words: at most ``most_words``, of at most ``most_chars`` characters."""
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), " ", -1)).alias("part")).where("part <> ''")
    stage = Stage(docs.sparkSession, "lexicon")
    counted = stage.put(words.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
                        .where((F.col("n") > 1) & (F.length("part") < most_chars)
                               & ~F.contains("part", F.lit(SPACE))), "words")
    least, total = None, 0
    # how many words have each count: few rows, the highest counts first
    for n, words_with in (counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("w"))
                          .orderBy(F.desc("n")).collect()):
        total += words_with
        if total > most_words:
            break
        least = n
    if least is None:
        return {}
    chosen = counted.where(F.col("n") >= least).select(F.concat(F.lit(SPACE), "part").alias("word"))
    rows = segment_words(chosen, pieces, kind).toArrow()
    return {w: array("i", with_bytes(ids, pieces)).tobytes() for w, ids in zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist())}


def _text(ids: list[int], texts: list[bytes]) -> str:
    raw = b"".join(map(texts.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Paths(dict):
    """The ids of each word as bytes of 32-bit numbers: those of the lexicon, and what a task finds, for a bounded number of words."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes], keep: int, kind: str):
        super().__init__(known)
        self.pieces, self.known, self.kind, self.most = pieces, known, kind, len(known) + keep
        self.unknown = pieces.unknown_score

    def _of(self, part: str) -> bytes:
        ids = merge(part, self.pieces) if self.kind == "bpe" else segment(part, self.pieces, self.unknown)
        return array("i", ids).tobytes()

    def _remember(self, word: str, found: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.known)
            self[word] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if len(word) <= 64:
            return self._remember(word, self._of(word))
        # texts without blanks: their parts are many, short and repeated
        parts = parts_of(word, self.pieces.joined)
        return b"".join([self.get(part) or self._remember(part, self._of(part)) for part in parts])


def _same(texts: list[str | None], ids: np.ndarray, ends: list[int], decoded: pa.Array, table: list[bytes]) -> list[bool]:
    """Whether the ids of each text, all of them decoded again, give that text."""
    pieces = decoded.take(pa.array(ids))
    at, raw = np.zeros(1, np.int64), b""
    if len(pieces):
        _, offsets, data = pieces.buffers()
        at = np.frombuffer(offsets, np.int64, len(pieces) + 1, pieces.offset * 8)
        raw = memoryview(data) if data is not None else b""
    out = []
    for text, a, b in zip(texts, ends, ends[1:]):
        own = bytes(raw[at[a]:at[b]])
        # bytes that differ can still decode to the text where it holds replacement characters
        out.append((own[1:] if own[:1] == b" " else own) == (text or "").encode("utf-8", "surrogatepass")
                   or _text(ids[a:b].tolist(), table) == (text or ""))
    return out


def _encode(batches: Iterator[pa.RecordBatch], shared, keep: int, kind: str, verify: bool) -> Iterator[pa.RecordBatch]:
    pieces, known = shared.value
    path = _Paths(pieces, known, keep, kind).__getitem__
    decoded = pa.array(pieces.texts, pa.large_binary()) if verify else None
    for batch in batches:
        column = batch.column("text")
        for i, j in slices_of(column, 1_000_000):
            texts = column.slice(i, j - i).to_pylist()
            found = [b"".join(map(path, words_of(text))) if text else b"" for text in texts]
            ends = [0, *accumulate(len(f) // 4 for f in found)]
            flat = np.frombuffer(b"".join(found), np.int32)
            checked = [pa.array(_same(texts, flat, ends, decoded, pieces.texts), pa.bool_())] if verify else []
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat))
            yield pa.record_batch([*[c.slice(i, j - i) for c in batch.columns], ids, *checked],
                                  names=[*batch.schema.names, "ids", *["round_trip"] * verify])


def encode(docs: DataFrame, model_file: str, kind: str = "bpe", lexicon_words: int = 150_000, lexicon_chars: int = 48,
           keep: int = 400_000, verify: bool = False) -> DataFrame:
    """``docs`` with the column ids: the pieces of each whole text.  ``kind`` is ``bpe`` or ``unigram``.

    As the library does for models without normalisation, a space is put in
    front of the text and spaces become word marks; a null or empty text has
    no pieces.  ``lexicon_words`` bounds the table sent to the tasks, ``keep``
    the words and parts of words a task remembers besides.  With ``verify`` the ids are
    decoded again in the task, and round_trip says whether that gives the text
    (null counts as empty).  All columns stay; ids, and with ``verify``
    round_trip, replace columns of these names.  Rows are independent: null or repeated ids do no harm.
    """
    spark = docs.sparkSession
    pieces = load_pieces(model_file)
    base = docs.drop("ids", *["round_trip"] * verify)
    shared = spark.sparkContext.broadcast((pieces, lexicon(base, pieces, lexicon_words, lexicon_chars, kind)))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields)
    return base.mapInArrow(partial(_encode, shared=shared, keep=keep, kind=kind, verify=verify),
                           fields + "ids array<int>" + ", round_trip boolean" * verify)


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    texts = shared.value
    for batch in batches:
        place = batch.schema.get_field_index("ids")
        lists = batch.column(place)
        out = []
        for i in range(len(lists)):
            row = lists[i].values
            out.append(_text(row.to_pylist(), texts) if row is not None else None)
        yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with the column decoded: the text its ids stand for.

    The space in front is taken off.  Null ids give null, no ids the empty
    text; control pieces stand for nothing.  Encoding and decoding returns
    every text without the word mark U+2581, which comes back as a space.
    """
    pieces = load_pieces(model_file)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces.texts)
    base = encoded.drop("decoded")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields)
    return base.mapInArrow(partial(_decode, shared=shared), fields + "decoded string")


def default_model(spark: SparkSession) -> str:
    """The model file of the setting ``leadloom.piece.model``, else the public 32k piece model."""
    return spark.conf.get("leadloom.piece.model", "/opt/tokenizers/piece_bpe_32k.model")
