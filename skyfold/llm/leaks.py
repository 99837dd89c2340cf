"""Held-out test items in a corpus, by pigeonhole edit matching on words.

Every window of `words` words of an item is cut into budget + 1 pieces: a passage within `budget` word edits of the
window holds one of them unchanged. The corpus is searched for all pieces by an equi-join on hashes of word runs; each
hit gives the window and the stretch of the document where it would lie, and Myers' bit-parallel algorithm finds the
least number of edits there. Words are compared by 64-bit hashes.

A run of few words is common, so most hits are chance. Each run of a document and each window of an item therefore
carries a bitmap of the words around it; an edit loses at most one word of the window, so a hit whose stretch lacks the
bits of more than `budget` words is dropped inside the join, before anything is shuffled. This loses no passage.

Words are runs of letters and digits, after HTML tags became blanks, entities were decoded, format characters removed,
compatibility forms unified and letters lower-cased.

Defined cases: several items may share a passage, and each comes out; null texts and texts with fewer words than a window match nothing; rows with a null identifier don't
count; repeated rows give a pair once; several rows with one identifier count as one document; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.common import Scratch, maybe_broadcast

WORDS, BUDGET = 12, 2
_TAG = re.compile(r"</?[^\W\d_][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]")


_SEPARATE = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():  # has neither format characters nor compatibility forms
        return text.lower().translate(_SEPARATE).split()
    return _WORD.findall(unicodedata.normalize("NFKC", _FORMAT.sub("", text)).lower())


def _lists(per: np.ndarray, flat: np.ndarray) -> pa.Array:
    """A list column of so many values a row."""
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(per)]).astype(np.int64), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))


def _runs(h: np.ndarray, per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, laid end to end, and their number per text."""
    n = np.maximum(per - size + 1, 0)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(per) - per - (np.cumsum(n) - n), n)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, n


def _bitmaps(h: np.ndarray, per: np.ndarray, before: int, after: int, n: np.ndarray) -> np.ndarray:
    """For the first n positions of each text, the bitmap of the words from `before` before it to `after` after it."""
    width, first = before + after, np.cumsum(per) - per
    gap = width * np.arange(1, len(per) + 1)  # texts with gaps between them, so that none reaches into another
    bits = np.zeros(len(h) + width * (len(per) + 1), np.uint64)
    bits[np.arange(len(h)) + np.repeat(gap, per)] = np.uint64(1) << (h >> np.uint64(58))
    span = 1
    while span * 2 <= width:  # bits of so many words from each place on
        bits, span = bits[:-span] | bits[span:], span * 2
    at = np.arange(n.sum()) + np.repeat(first + gap - (np.cumsum(n) - n), n) - before
    return bits[at] | bits[at + width - span]


def _hash_words(size: int, before: int, after: int):
    """Per text the hashes of its words and, at each run of `size` words, the run's hash and the bitmap around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [words_of(t) if t else [] for t in b.column(1).to_pylist()]
            coded = pa.array([w for p in texts for w in p], pa.string()).dictionary_encode()
            known = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
            h = known[coded.indices.to_numpy()].astype(np.uint64) if len(coded) else np.zeros(0, np.uint64)
            per = np.array([len(p) for p in texts], np.int64)
            runs, n = _runs(h, per, size)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(per, h), _lists(n, runs), _lists(n, _bitmaps(h, per, before, after, n))], names=["id", "words", "runs", "around"])

    return run


def edit_distances(patterns: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least edits between each pattern (row, at most 64 symbols) and any stretch of its text, all rows at once.

    Myers' bit vectors hold a column of the edit table as its vertical differences, one bit per pattern symbol.
    """
    m = patterns.shape[1]
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    up, down = np.full(len(patterns), full), np.zeros(len(patterns), np.uint64)
    score = np.full(len(patterns), m, np.int64)
    best = score.copy()
    for t in range(texts.shape[1]):
        equal = np.zeros(len(patterns), np.uint64)
        for i in range(m):
            equal |= (patterns[:, i] == texts[:, t]).astype(np.uint64) << np.uint64(i)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(diagonal | up), up & diagonal
        here = t < lengths
        score += np.where(here, ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64), 0)
        more, less = (more << one) & full, (less << one) & full
        up, down = (less | ~(vertical | more)) & full, more & vertical
        best = np.where(here, np.minimum(best, score), best)
    return best


def _verify(words: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pattern = b.column(2).flatten().to_numpy().reshape(b.num_rows, words)
            n = b.column(3).value_lengths().to_numpy().astype(np.int64)
            flat = b.column(3).flatten().to_numpy()
            text = np.zeros((b.num_rows, reach), np.int64)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            text[np.repeat(np.arange(b.num_rows), n), at] = flat
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edit_distances(pattern, text, n))], names=["doc", "item", "edits"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """Rows (doc, item, edits): documents with a stretch within `budget` word edits of some `words` consecutive words of the item."""
    if not 0 <= budget < words <= 64:
        raise ValueError("budget must be below words, and words at most 64")
    size, reach = words // (budget + 1), words + 2 * budget
    scratch = Scratch(docs.sparkSession)

    def hashed(df: DataFrame, ident: str, name: str) -> DataFrame:
        kind = df.schema[ident].dataType.simpleString()
        rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
        # A piece is one of the window's budget + 1, so a run's window begins at most so far before it.
        words_ = rows.mapInArrow(_hash_words(size, budget * size + budget, words + budget), f"id {kind}, words array<bigint>, runs array<bigint>, around array<bigint>")
        # The number tells rows apart, so that rows of one identifier don't meet each other; it is written, hence stable.
        return scratch.write(words_.withColumn("row", F.monotonically_increasing_id()), name)

    corpus, tests = hashed(docs, doc, "corpus"), hashed(items, item, "tests").withColumnRenamed("id", "item")
    # Pieces: every run of an item, once for each place that it may have in a window, with the window's words as bits.
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 58).cast("int"))
    pieces = tests.where(F.size("words") >= words).select(F.col("row").alias("__irow"), "words", F.posexplode("runs").alias("__ipos", "__run"))
    pieces = pieces.withColumn("__at", F.explode(F.array(*[F.lit(k * size) for k in range(budget + 1)]))).withColumn("__window", F.col("__ipos") - F.col("__at"))
    pieces = pieces.where((F.col("__window") >= 0) & (F.col("__window") + words <= F.size("words")))
    window_bits = F.aggregate(F.slice("words", F.col("__window") + 1, F.lit(words)), F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(bit(w)))
    pieces = pieces.select("__irow", "__run", "__at", "__window", window_bits.alias("__bits"))
    runs = corpus.where(F.size("words") >= size).select("row", F.posexplode(F.arrays_zip("runs", "around")).alias("__dpos", "__r")).select("row", "__dpos", F.col("__r.runs").alias("__run"), F.col("__r.around").alias("__around"))
    # Words whose bits are missing around the run: each is lost, and two lost words may share a bit.
    lost = F.bit_count(F.col("__bits").bitwiseAND(F.bitwise_not("__around")))
    hits = runs.join(maybe_broadcast(pieces, scratch), "__run").where(lost <= budget)
    hits = hits.select("row", "__irow", "__window", (F.col("__dpos") - F.col("__at") - budget).alias("__start")).distinct()
    few = maybe_broadcast(hits, scratch)
    sides = corpus.select(F.col("id").alias("doc"), "row", "words").join(few, "row").join(maybe_broadcast(tests.select("item", F.col("row").alias("__irow"), F.col("words").alias("__iwords")), scratch), "__irow")
    first = F.greatest(F.col("__start"), F.lit(0))
    sides = sides.select("doc", "item", F.slice("__iwords", F.col("__window") + 1, F.lit(words)).alias("p"), F.slice("words", first + 1, F.col("__start") + reach - first).alias("t"))
    # An edit loses one word of the window at most.
    sides = sides.where(F.size(F.array_except("p", "t")) <= budget)
    kinds = f"doc {docs.schema[doc].dataType.simpleString()}, item {items.schema[item].dataType.simpleString()}, edits long"
    found = sides.mapInArrow(_verify(words, reach), kinds).where(F.col("edits") <= budget)
    return found.groupBy("doc", "item").agg(F.min("edits").alias("edits")).select(F.col("doc").alias(doc), F.col("item").alias(item), "edits")
