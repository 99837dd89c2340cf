"""Texts of varying length into containers of a fixed number of tokens.

Every text becomes a hashed vector (signs of its different tokens), projected to a few dimensions and placed on a
Hilbert curve. Items are range-sorted by that key, so each task has a stretch of the curve, and neighbours are packed
together: an item goes into the open container that it fills best. Containers hold whole texts; only a text larger than
a container is cut, into full containers and a rest that is packed like any other.

Empty texts take no room, so any number of them goes to one container of a stretch, at once; other items are at most as
many in a container as it has tokens, and what is held of open containers is bounded by that.

Defined cases: a null text is an empty one; an empty text has 0 tokens and is assigned, too; null and repeated
identifiers each come out, row by row; copies share a curve position and are told apart by identifier, so that they
don't all fall into one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.common import Scratch
from skyfold.llm.tokens import PATTERN, TOKENIZER, tokenizer

DIMS, BITS = 4, 8
#: A task's stretch of the curve, in tokens.
TASK_TOKENS = 4_000_000
OPEN = 64


def token_signs(n: int, dims: int) -> np.ndarray:
    """For each token, a hashed sign in each dimension."""
    x = (np.arange(n, dtype=np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)[None, :]) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(63)).astype(np.float32) * 2 - 1).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x dims), each coordinate of `bits` bits; at most 63 bits in all."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work, from the highest bit down
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        signs = token_signs(len(tok.lengths), DIMS)
        for b in batches:
            n, vec = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, DIMS))
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = tok.encode(text or "")
                n[i] = len(ids)
                if len(ids):
                    own = np.unique(ids)
                    vec[i] = signs[own].sum(axis=0) / np.sqrt(len(own))
            # Sums of signs are about normal; the logistic curve spreads them evenly over the cells.
            cells = np.clip((1 << BITS) / (1 + np.exp(-1.702 * vec)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(hilbert_keys(cells, BITS))], names=["__id", "__n", "__key"])

    return run


def _pack(capacity: int):
    """Rows of one stretch, in curve order, with a container each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made, held = 0, {}
        free: list[tuple[int, int]] = []  # of the open containers: space, number
        done: list[tuple] = []
        home, moves = None, True  # where empty texts go; a container that is still open then must keep its number

        def close(c: int) -> None:
            done.extend((*row, base + c) for row in held.pop(c))

        def out() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["__id", "__piece", "__from", "__n", "__c"])

        def fresh() -> int:
            nonlocal made
            held[made] = []
            made += 1
            return made - 1

        kind = None
        for b in batches:
            kind = b.column(0).type
            for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                n = row[3]
                if n == 0:
                    if home is None:
                        if not free:
                            free.append((capacity, fresh()))
                        home, moves = free[0][1], False
                    done.append((*row, base + home))
                    continue
                at = bisect_left(free, (n, -1))
                if at < len(free):
                    space, c = free.pop(at)
                else:
                    if len(free) >= OPEN:
                        close(free.pop(0)[1])  # the fullest
                    space, c = capacity, fresh()
                held[c].append(row)
                if space == n:
                    close(c)
                    home = c if home is None else home
                else:
                    insort(free, (space - n, c))
            if len(done) > 50_000:
                yield out()
        # What is still open at the stretch's end is put together where it fits.
        kept: list[tuple[int, int]] = []
        for space, c in sorted(free, key=lambda x: (moves or x[1] != home, x)):
            at = bisect_left(kept, (capacity - space, -1))
            if at < len(kept) and (moves or c != home):
                room, into = kept.pop(at)
                held[into] += held.pop(c)
                insort(kept, (room - (capacity - space), into))
            else:
                insort(kept, (space, c))
        for _, c in kept:
            close(c)
        if kind is not None:
            yield out()

    return run


def pack(docs: DataFrame, ident: str, text: str, capacity: int, tokenizer_path: str = TOKENIZER, pattern: str = PATTERN, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Rows (ident, piece, token_from, n_tokens, container): every text whole in one container, or cut if it is larger than one."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    sizes = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text")).mapInArrow(_measure(tokenizer_path, pattern), f"__id {kind}, __n long, __key long")
    sizes = scratch.write(sizes, "sizes")  # texts are tokenized once, not again for the bounds of the ranges
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__n") / capacity)).cast("int")
    items = sizes.select("__id", "__n", "__key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__piece"))
    start = F.col("__piece").cast("long") * capacity
    items = items.select("__id", F.col("__piece").cast("long").alias("__piece"), start.alias("__from"), F.least(F.lit(capacity).cast("long"), F.col("__n") - start).alias("__size"), "__key")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    order = ["__key", F.xxhash64("__id", "__piece")]
    stretches = items.repartitionByRange(max(1, -(-total // task_tokens)), *order).sortWithinPartitions(*order, "__id", "__piece")
    rows = stretches.select("__id", "__piece", "__from", "__size").mapInArrow(_pack(capacity), f"__id {kind}, __piece long, __from long, __n long, __c long")
    return rows.select(F.col("__id").alias(ident), F.col("__piece").alias("piece"), F.col("__from").alias("token_from"), F.col("__n").alias("n_tokens"), F.col("__c").alias("container"))
