"""Texts over a token limit, cut at natural boundaries into overlapping pieces within the limit.

A piece begins `overlap` tokens before the cut where the piece before ended, or up to three earlier where that would
split a character, so every boundary has one place where a piece after it begins and one, `limit` tokens on, that it can't
pass. Every boundary is joined to its farthest legal successor: the last natural boundary (end of a paragraph, sentence,
code line or row) within reach, else the last word start, else the last edge of a token that doesn't split a character.
The cuts of a text are what its beginning reaches by these pointers; squaring the pointer table doubles their range, so
all texts are cut in as many rounds as the logarithm of the largest number of pieces.

Word starts are listed only between natural boundaries too far apart for one step, and token edges only between word
starts too far apart: no cut falls anywhere else.

Pieces are stretches of the text's own tokens, and none has more than `limit`.

Defined cases: texts within the limit, null and empty texts have no pieces; rows with a null identifier don't count;
repeated rows count once, and different texts under one identifier are cut each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfold.common import Scratch
from skyfold.llm.tokens import PATTERN, TOKENIZER, tokenizer

#: Tokens that a character may spread over beyond its first: how much earlier than the overlap a piece may begin.
SPREAD = 3
NATURAL, WORD, EDGE = 2, 1, 0
_NATURAL = re.compile(r"\n+|[.!?]+[\"'”’)\]]*(?=\s)|[。！？]+[」』”’）]*")


def _between(pos: np.ndarray, ends: np.ndarray, reach) -> np.ndarray:
    """The positions that lie between two of the ends (0 is one, too) of which the later is out of the earlier's reach."""
    first = np.concatenate([[0], ends[:-1]])
    far = ends > reach(first)
    at = np.searchsorted(ends, pos, "left")
    return pos[far[np.minimum(at, len(ends) - 1)] & ~np.isin(pos, ends)]


def boundaries(text: str, tok, limit: int, overlap: int) -> tuple[np.ndarray, ...] | None:
    """Token positions, kinds, characters before, and the token and character where a piece after the cut begins; first the text's beginning."""
    ids = tok.encode(text)
    n = len(ids)
    if n <= limit:
        return None
    edges = np.concatenate([[0], np.cumsum(tok.lengths[ids])])
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])  # characters that begin before a byte
    byte_of = np.append(np.flatnonzero(starts), len(raw))
    aligned = np.append(starts, True)[edges]
    whole = np.flatnonzero(aligned)
    # A natural boundary is the token edge there, or the one before if only white space lies between.
    ends = np.array([m.end() for m in _NATURAL.finditer(text)], np.int64)
    at = byte_of[ends] if len(ends) else ends
    tokens = np.searchsorted(edges, at, "right") - 1
    space = np.concatenate([[0], np.cumsum(np.isin(raw, [9, 10, 11, 12, 13, 32]))])
    blank = space[at] - space[edges[tokens]] == at - edges[tokens]
    natural = np.unique(tokens[blank & aligned[tokens]])
    # A piece after a cut within the overlap would begin where the text does.
    natural = np.append(natural[(natural > overlap) & (natural < n)], n)
    begin = lambda pos: whole[np.searchsorted(whole, np.maximum(pos - overlap, 0), "right") - 1]
    reach = lambda pos: begin(pos) + limit
    first_byte = raw[np.minimum(edges, len(raw) - 1)]
    words = np.flatnonzero(aligned & ((first_byte == 32) | (first_byte == 10)))
    words = _between(words[(words > overlap) & (words < n)], natural, reach)
    listed = np.union1d(natural, words)
    others = _between(whole[(whole > overlap) & (whole < n)], listed, reach)
    pos = np.concatenate([[0], natural, words, others]).astype(np.int64)
    kind = np.repeat([EDGE, NATURAL, WORD, EDGE], [1, len(natural), len(words), len(others)]).astype(np.int32)
    start = begin(pos)
    return pos, kind, chars[edges[pos]], start, chars[edges[start]]


def _list_boundaries(path: str, pattern: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                found = boundaries(text, tok, limit, overlap)
                if found is not None:
                    at = pa.array(np.full(len(found[0]), i))
                    cols = [b.column(0).take(at), b.column(1).take(at), pa.array(found[0]), pa.array(found[1]), *[pa.array(c.astype(np.int64)) for c in found[2:]]]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "hash", "pos", "kind", "char", "start", "start_char"])

    return run


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece; a text is walked once, whatever the number of its pieces."""
    for b in batches:
        names = ("pos", "natural", "char", "start", "start_char")
        cuts = b.column(2)
        n = cuts.value_lengths().to_numpy().astype(np.int64)
        flat = cuts.flatten()
        got = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in names}
        row, k = np.repeat(np.arange(b.num_rows), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        before = lambda c: np.where(k == 0, 0, np.concatenate([[0], got[c][:-1]]))
        start, a, z = before("start"), before("start_char"), got["char"]
        texts = b.column(1).to_pylist()
        body = [texts[i][x:y] for i, x, y in zip(row, a, z)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(got["pos"] - start), pa.array(got["natural"]), pa.array(body, pa.string())],
            names=["id", "piece", "token_from", "n_tokens", "natural", "text"])


def reached_cuts(jumps: DataFrame, cuts: DataFrame, scratch: Scratch, keys: list[str]) -> DataFrame:
    """All cuts (keys, pos) that the given ones reach over the pointers (keys, pos, to), by squaring the pointers."""
    k, known = 0, -1
    while True:
        step = cuts.join(jumps, [*keys, "pos"]).select(*keys, F.col("to").alias("pos"))
        more = scratch.write(cuts.union(step).distinct(), f"cuts-{k}", cuts=F.count(F.lit(1)))
        now = scratch.seen.get("cuts", 0)
        if now == known or not now:
            return more
        hop = jumps.select(*keys, F.col("pos").alias("to"), F.col("to").alias("__far"))
        jumps = scratch.write(jumps.join(hop, [*keys, "to"]).select(*keys, "pos", F.col("__far").alias("to")), f"jumps-{k}")
        if k:
            scratch.drop(f"cuts-{k - 1}")
            scratch.drop(f"jumps-{k - 1}")
        cuts, known, k = more, now, k + 1


def successors(bounds: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The boundaries with to, the farthest legal one after each; null for the last.

    Boundaries and the ends of their reach are put in one order of a text; what was last seen of each kind at such an
    end is the farthest of its kind within reach.
    """
    both = bounds.withColumn("__e", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(False).alias("end")), F.struct((F.col("start") + limit).alias("at"), F.lit(True).alias("end")))))
    upto = W.partitionBy(*keys).orderBy("__e.at", "__e.end").rowsBetween(W.unboundedPreceding, 0)
    last = lambda kind: F.max(F.when(~F.col("__e.end") & (F.col("kind") == kind), F.col("pos"))).over(upto)
    seen = both.select("*", *[last(kind).alias(f"__{kind}") for kind in (NATURAL, WORD, EDGE)]).where("__e.end")
    ahead = F.coalesce(*[F.when(F.col(f"__{kind}") > F.col("pos"), F.col(f"__{kind}")) for kind in (NATURAL, WORD, EDGE)])
    return seen.select(*bounds.columns, ahead.alias("to"))


def split_texts(docs: DataFrame, ident: str, text: str, limit: int, overlap: int, tokenizer_path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Rows (ident, piece, token_from, n_tokens, natural, text) of all texts with more than limit tokens; piece from 0."""
    # Between a cut and the end of its reach there must be room for a whole character, wherever the piece begins.
    if overlap < 0 or limit < 1 or overlap + 2 * SPREAD + 2 > limit:
        raise ValueError(f"the overlap must be at least {2 * SPREAD + 2} tokens below the limit")
    scratch = Scratch(docs.sparkSession)
    kind, keys = docs.schema[ident].dataType.simpleString(), ["id", "hash"]
    # A token is at least one byte, so shorter texts can't exceed the limit.
    long_texts = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.octet_length("text") > limit))
    bounds = long_texts.mapInArrow(_list_boundaries(tokenizer_path, pattern, limit, overlap), f"id {kind}, hash long, pos long, kind int, char long, start long, start_char long")
    # One shuffle by text serves the removal of repeats and the search for successors.
    bounds = scratch.write(successors(bounds.repartition(*keys).dropDuplicates([*keys, "pos"]), keys, limit), "bounds")
    jumps = bounds.select(*keys, "pos", "to").where("to is not null")
    cuts = reached_cuts(jumps, bounds.where("pos = 0").select(*keys, "pos"), scratch, keys)
    there = cuts.where("pos > 0").join(bounds, [*keys, "pos"])
    listed = there.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("kind") == NATURAL).alias("natural"), "char", "start", "start_char"))).alias("cuts"))
    whole = long_texts.join(listed, keys)
    # Repeated rows are told apart by nothing, so one of them is kept; only texts that are cut get here.
    whole = whole.groupBy(*keys).agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    out = whole.select("id", "text", "cuts").mapInArrow(_cut_texts, f"id {kind}, piece int, token_from long, n_tokens long, natural boolean, text string")
    return out.select(F.col("id").alias(ident), "piece", "token_from", "n_tokens", "natural", F.col("text").alias(text))
