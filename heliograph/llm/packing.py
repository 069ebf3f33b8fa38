"""Packing token pieces into sequences: vector bin packing by the dot-product heuristic.

Every sequence has three limits at once: tokens, segments and loss-bearing tokens.
Bins are filled one after another; of the items that still fit, the next is the one
whose demands have the largest dot product with what the bin has left (Panigrahy et
al., "Heuristics for Vector Bin Packing").  Items of equal demands are one type, so
a step scores the types of a pool, not its items.

Documents are cut into full sequences and a remainder; remainders wait in a pool of
bounded size in the task that reads them.  Nothing is shuffled; each task leaves at
most a few sequences that are not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.pretok import PieceCache, Rules, Splitter, rules_from
from heliograph.llm.tables import extended, read, tidy, without


PIECE = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def full(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


class Pool:
    """Items that wait for a place: payloads by type, a type being (tokens, 1, loss)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: dict[tuple[int, int], list] = {}
        self.count = 0
        self.demands = np.empty((0, 3))
        self.kinds: list[tuple[int, int]] = []

    def add(self, tokens: int, loss: int, payload) -> None:
        if tokens > self.limits.tokens or loss > self.limits.loss or self.limits.segments < 1:
            raise ValueError(f"an item of {tokens} tokens, {loss} with loss, fits no sequence")
        kind = (tokens, loss)
        if kind not in self.items:
            self.items[kind] = []
            self.kinds.append(kind)
            self.demands = np.vstack([self.demands, [tokens, 1, loss]])
        self.items[kind].append(payload)
        self.count += 1

    def next_bin(self) -> list:
        """The payloads of one sequence, in the order of their placing."""
        whole = self.limits.full()
        left, out = whole.copy(), []
        waiting = np.array([len(self.items[k]) for k in self.kinds])
        weight = (self.demands * waiting[:, None]).sum(axis=0) / whole
        scale = weight / max(weight.sum(), 1e-9) / (whole * whole)
        while True:
            fits = (waiting > 0) & (self.demands <= left).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, self.demands @ (scale * left), -1.0)
            best = int(score.argmax())
            out.append(self.items[self.kinds[best]].pop())
            waiting[best] -= 1
            left -= self.demands[best]
            self.count -= 1
        if len(self.kinds) > 4 * max(self.limits.tokens, self.count):
            live = np.flatnonzero(waiting > 0)
            self.items = {self.kinds[i]: self.items[self.kinds[i]] for i in live}
            self.kinds = [self.kinds[i] for i in live]
            self.demands = self.demands[live]
        return out


def _pack(rules, limits: Limits, text: str, keys: list[str], closing: int, pool_size: int, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(Splitter(rules.value))
        pool = Pool(limits)
        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 33
        names = [*keys, *PIECE]
        kinds = [*types, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []

        def place(pieces: list) -> None:
            nonlocal number
            offset = 0
            for key, start, ids, total in pieces:
                rows.append((*key, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

        def flushed():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        step = min(limits.tokens, limits.loss)
        for batch in batches:
            at = batch.schema.names.index(text)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            own = list(zip(*(batch.column(batch.schema.names.index(k)).to_pylist() for k in keys), strict=True))
            done = 0
            for ids, ends in cache.encode(texts):
                begin = 0
                for end in ends.tolist():
                    piece = np.append(ids[begin:end], np.uint32(closing))
                    begin, n = end, len(piece)
                    for s in range(0, n, step):
                        part = piece[s : s + step]
                        if len(part) == limits.tokens:
                            place([(own[done], s, part, n)])
                        else:
                            pool.add(len(part), len(part) - (s + step >= n), (own[done], s, part.copy(), n))
                    done += 1
                    if pool.count >= 2 * pool_size:
                        while pool.count > pool_size:
                            place(pool.next_bin())
                    if len(rows) >= 4096:
                        yield flushed()
        while pool.count:
            place(pool.next_bin())
        if rows:
            yield flushed()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, limits: Limits = Limits(), keys: tuple[str, ...] = ("doc_id",), text: str = "text", closing: int = 0, pool_size: int = 4096
) -> DataFrame:
    """One row per piece: ``keys``, start, length, ids binary (little-endian uint32), doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids (null: none) and the ``closing`` id, which
    alone bears no loss.  Repeated rows are packed each; an empty table gives no rows;
    only ``keys`` are carried along, and one named like an output is an error.  ``docs``
    should be read from a table, so that a task run again meets its rows in the same order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if clash := {k.lower() for k in keys} & set(PIECE):
        raise ValueError(f"keys named like an output: {sorted(clash)}")
    spark = docs.sparkSession
    slim = docs.select(*keys, F.col(text).cast("string").alias(text))
    rules = spark.sparkContext.broadcast(rules_from(tokenizer_path))
    types = [to_arrow_type(slim.schema[k].dataType) for k in keys]
    schema = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"])
    return slim.mapInArrow(tidy(_pack(rules, limits, text, list(keys), closing, pool_size, types)), schema)


def pack_items(items: list[tuple[int, int]], limits: Limits) -> list[list[int]]:
    """Bins of item numbers for a short list of whole items (tokens, loss-bearing tokens) that may not be cut."""
    pool = Pool(limits)
    for i, (tokens, loss) in enumerate(items):
        pool.add(tokens, loss, i)
    out = []
    while pool.count:
        out.append(pool.next_bin())
    return out


def _pack_whole(limits: Limits, tokens: str, loss: str, pool_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, ctx = Pool(limits), TaskContext.get()
        number, held, base = (ctx.partitionId() if ctx else 0) << 33, {}, 0

        def placed(bins: list[list[tuple[int, int]]], schema: pa.Schema):
            """The rows of some sequences: their own columns, taken from the batches that hold them."""
            nonlocal number
            parts = []
            for one in bins:
                for k, (at, i) in enumerate(one):
                    parts.append((at, i, number if at is not None else None, k))
                number += 1
            by: dict[int, list] = {}
            for at, i, seq, k in parts:
                by.setdefault(at, []).append((i, seq, k))
            for at, rows in by.items():
                batch, left = held[at]
                got = batch.take(pa.array([i for i, _, _ in rows]))
                held[at] = (batch, left - len(rows))
                if held[at][1] == 0:
                    del held[at]
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([s for _, s, _ in rows], pa.int64()), pa.array([k for _, _, k in rows], pa.int32())], [*schema.names, "sequence_id", "segment"])

        for batch in batches:
            names = batch.schema.names
            n, bears = (batch.column(names.index(c)).to_pylist() for c in (tokens, loss))
            unfit = [i for i, (a, b) in enumerate(zip(n, bears, strict=True)) if a is None or a < 1 or a > limits.tokens or (b or 0) > limits.loss]
            if unfit:
                got = batch.take(pa.array(unfit))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(len(unfit), pa.int64()), pa.nulls(len(unfit), pa.int32())], [*names, "sequence_id", "segment"])
            whole = sorted(set(range(len(n))) - set(unfit))
            if not whole:
                continue
            held[base] = (batch, len(whole))
            for i in whole:
                pool.add(n[i], max(0, bears[i] or 0), (base, i))
            base += 1
            bins = []
            while pool.count > pool_size:
                bins.append(pool.next_bin())
            yield from placed(bins, batch.schema)
        if pool.count:
            schema = next(iter(held.values()))[0].schema
            bins = []
            while pool.count:
                bins.append(pool.next_bin())
            yield from placed(bins, schema)

    return run


def pack_examples(examples: DataFrame, *, limits: Limits = Limits(), tokens: str = "n_tokens", loss: str = "n_loss", pool_size: int = 4096) -> DataFrame:
    """``examples`` plus sequence_id long and segment int (from 0): instruction examples packed whole under all three limits.

    ``tokens`` and ``loss`` are columns with an example's tokens and loss-bearing tokens
    (null: none).  An example that no sequence can hold, or without a token, keeps its
    row with null outputs; repeated rows are packed each; an empty table gives no rows;
    input columns named like the outputs are replaced.  Nothing is shuffled: each task
    packs its own rows, of which it holds about ``pool_size`` and their batches.
    """
    base = without(examples, "sequence_id", "segment")
    schema = extended(base, T.StructField("sequence_id", T.LongType()), T.StructField("segment", T.IntegerType()))
    return base.mapInArrow(tidy(_pack_whole(limits, tokens, loss, pool_size)), schema)


def op5_vector_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
