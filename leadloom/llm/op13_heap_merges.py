"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The symbols of a word (its bytes) form a doubly linked list.  A heap holds the
rank of every adjacent pair that the vocabulary can merge; the lowest rank
(leftmost among equals) is popped, stale entries are passed over, the pair
becomes one node and its two new neighbour pairs enter the heap.  The count is
the number of initial symbols less that of merges: n log n for any word, also
one that fills a whole text.

Texts split into words by the tokenizer's own rules first.  A task remembers
the counts of a bounded number of short words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F


#: Fixed value: how byte-level tokenizers split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of words up to this many characters are remembered, for so many words.
REMEMBER_LENGTH, REMEMBER = 64, 800_000


@dataclass(frozen=True)
class Merges:
    """Merge ranks over symbol numbers; the first 256 numbers are the bytes."""

    #: left number << 32 | right number -> (rank, number of the joined symbol)
    pairs: dict[int, tuple[int, int]]
    #: strings that count as one token wherever they stand in a text
    special: tuple[str, ...]


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """Merges of a byte-level BPE file of the tokenizers library.

    Other kinds (normalising, prefixing, with an unknown token, with spaces
    taken into special strings) raise a ValueError: their counts would differ.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and spec.get("normalizer") is None
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                "end_of_word_suffix", "ignore_merges"))
             and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")))
    if not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    number = {s: i for i, s in enumerate(byte_symbols())}
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        joined = number.setdefault(left + right, len(number))
        pairs.setdefault(number[left] << 32 | number[right], (rank, joined))
    return Merges(pairs, tuple(t["content"] for t in added))


def count_symbols(word: bytes, pairs: dict[int, tuple[int, int]]) -> int:
    """How many symbols are left of ``word`` after all merges."""
    n = len(word)
    if n < 2:
        return n
    symbol = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = pairs.get(symbol[i] << 32 | symbol[i + 1])
        if found:
            heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right, joined = heapq.heappop(heap)
        j = after[i]
        # a merged-away node holds -1; a pair whose sides have changed is stale
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue
        merges += 1
        symbol[i], symbol[j] = joined, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = pairs.get(joined << 32 | symbol[k])
            if found:
                heapq.heappush(heap, (found[0], i, joined, symbol[k], found[1]))
        h = before[i]
        if h >= 0:
            found = pairs.get(symbol[h] << 32 | joined)
            if found:
                heapq.heappush(heap, (found[0], h, symbol[h], joined, found[1]))
    return n - merges


class _Counts(dict):
    """Token count of each word, computed when first asked for."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> int:
        n = count_symbols(word.encode("utf-8"), self.pairs)
        if len(word) <= REMEMBER_LENGTH:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, merges: Merges):
        self.counts = _Counts(merges.pairs)
        self.words = regex.compile(WORDS).findall
        # the longest of several special strings at one place counts
        names = sorted(filter(None, merges.special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def __call__(self, text: str) -> int:
        of = self.counts.__getitem__
        if self.special is None:
            return sum(map(of, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(of, self.words(part))) for part in parts)


def _count(batches: Iterator[pa.RecordBatch], merges: Broadcast, text: str, out: str) -> Iterator[pa.RecordBatch]:
    count = Counter(merges.value)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        keep = [n for n in batch.schema.names if n != text]
        texts = batch.column(at)
        counts = []
        for lo in range(0, len(texts), 256):
            counts += [count(t) if t else 0 for t in texts.slice(lo, 256).to_pylist()]
        yield pa.record_batch([*[batch.column(n) for n in keep], pa.array(counts, pa.int64())], names=[*keep, out])


def default_vocabulary(spark: SparkSession) -> str:
    """The file of the setting ``leadloom.bpe.vocabulary``, else the public byte-level vocabulary of 50k."""
    return spark.conf.get("leadloom.bpe.vocabulary", "/opt/tokenizers/byte_bpe_50k.json")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` counted: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the tokenizers library for the file ``vocabulary``,
    without begin and end tokens, truncation or padding; special strings inside
    a text are one token each.  One row per input row in any case: null ids and
    repeated rows are kept, null and empty texts count 0, texts of any length
    are counted whole.  Columns other than the two are ignored, so names may
    clash.  The vocabulary (read on the driver, its size does not depend on the
    documents) is broadcast to the tasks; there is no shuffle.
    """
    spark = docs.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(vocabulary))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sized = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = sized.schema["doc_id"].dataType.simpleString()
    return (sized.mapInArrow(partial(_count, merges=merges, text="text", out="n_tokens"),
                             f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
