"""Token counts without ids: each distinct pre-token is counted once, documents add up frequencies.

Pass one gathers the distinct pre-tokens of all texts and lets the library count the
pieces of each.  Pass two splits the texts again and joins each document's pre-token
frequencies to those counts.  The counts of the widest-spread pre-tokens, at most
``max_broadcast``, travel to the tasks as sorted arrays and are joined where the texts
lie; so no pre-token that stands in many documents is ever shuffled.  What is left, the
long tail, is shuffled by pre-token and summed by document.

A pre-token is known by two independent 64-bit hashes.  Texts that the vectorised
splitting doesn't cover are counted whole by the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.pretok import Splitter, rules_from
from heliograph.llm.tables import extended, read, tidy, without
from heliograph.storage import Scratch

SEEN = 1_000_000


def _at(keys: np.ndarray, checks: np.ndarray, h: np.ndarray, g: np.ndarray):
    """(place, whether it is there) of (h, g) in arrays sorted by (keys, checks)."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    there = (keys[place] == h) & (checks[place] == g)
    for i in np.flatnonzero(~there & (keys[place] == h)):  # two pre-tokens share the first hash
        p = int(place[i])
        while p < len(keys) and keys[p] == h[i] and checks[p] != g[i]:
            p += 1
        if p < len(keys) and keys[p] == h[i]:
            place[i], there[i] = p, True
    return place, there


def _distinct(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Splitter(rules.value)
        seen, checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for _, _, _, _, units, starts, ends in sp.chunks(texts):
                h, g = sp.hashes(units, starts, ends)
                own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                odd = np.flatnonzero(g != g[first][inverse])  # share the first hash with another one of this chunk
                fresh = ~_at(seen, checks, own, g[first])[1]
                if len(seen) > SEEN:
                    seen, checks = own, g[first]
                else:
                    where = np.searchsorted(seen, own[fresh])
                    seen, checks = np.insert(seen, where, own[fresh]), np.insert(checks, where, g[first[fresh]])
                out = np.concatenate([first[fresh], odd])
                strings = [sp.string(units, starts[i], ends[i]) for i in out]
                yield pa.RecordBatch.from_arrays([pa.array(h[out].view(np.int64)), pa.array(g[out].view(np.int64)), pa.array(strings, pa.string())], ["h", "g", "piece"])

    return run


def _counted(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Splitter(rules.value)
        for batch in batches:
            n = [len(e) for e in sp.tok.encode_batch_fast(batch.column(2).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), batch.column(3)], ["h", "g", "n", "spread"])

    return run


def piece_counts(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """(h, g, n, spread): the number of pieces of every distinct pre-token, and in how many places of the scan it was new."""
    slim = docs.select(F.col(text).cast("string"))
    each = slim.mapInArrow(tidy(_distinct(rules)), "h long, g long, piece string").groupBy("h", "g", "piece").agg(F.count("*").cast("int").alias("spread"))
    return each.mapInArrow(tidy(_counted(rules)), "h long, g long, n int, spread int")


def _summed(rules, table, text: str, out: str):
    """The input columns and the sum over all pre-tokens, every one of which is in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Splitter(rules.value)
        keys, checks, n = table.value
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            total = np.zeros(len(texts), np.int64)
            for a, b, left, owner, units, starts, ends in sp.chunks(texts):
                place, _ = _at(keys, checks, *sp.hashes(units, starts, ends))
                total[a:b] = np.bincount(owner, weights=n[place] if len(n) else None, minlength=b - a).astype(np.int64)
                for i, ids in zip(sorted(left), sp.whole([texts[a + i] for i in sorted(left)]), strict=True):
                    total[a + i] = len(ids)
            yield pa.RecordBatch.from_arrays([*(c for c, x in zip(batch.columns, names, strict=True) if x != text), pa.array(total)], [*(x for x in names if x != text), out])

    return run


def _parted(rules, table, text: str):
    """Rows of two kinds: (row, own columns, sum over the table's pre-tokens) once a document, (row, h, g, f) for its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, ctx = Splitter(rules.value), TaskContext.get()
        keys, checks, n = table.value
        row = (ctx.partitionId() if ctx else 0) << 33
        fields = ["row", "own", "part", "h", "g", "f"]
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            rest = pa.StructArray.from_arrays([c for c, x in zip(batch.columns, names, strict=True) if x != text], [x for x in names if x != text])
            for a, b, left, owner, units, starts, ends in sp.chunks(texts):
                h, g = sp.hashes(units, starts, ends)
                place, there = _at(keys, checks, h, g)
                part = np.bincount(owner[there], weights=n[place[there]], minlength=b - a).astype(np.int64)
                for i, ids in zip(sorted(left), sp.whole([texts[a + i] for i in sorted(left)]), strict=True):
                    part[i] = len(ids)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + a, row + b)), rest.slice(a, b - a), pa.array(part), none, none, none], fields)
                rare = np.empty(int((~there).sum()), [("o", np.int64), ("h", np.int64), ("g", np.int64)])
                rare["o"], rare["h"], rare["g"] = owner[~there], h[~there].view(np.int64), g[~there].view(np.int64)
                rare, f = np.unique(rare, return_counts=True)
                cols = [pa.array(rare["o"] + row + a), pa.nulls(len(f), rest.type), pa.nulls(len(f), pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (rare["h"], rare["g"], f.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, fields)
            row += len(texts)

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", out: str = "n_tokens", max_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` with a long column ``out`` in place of the text: the library's number of tokens of the whole text.

    Null and empty texts have none.  Repeated rows are counted each; an input column
    named like the output is replaced.  No special tokens are added; an added token's
    string inside a text counts as the library counts it.  ``max_broadcast`` bounds the
    table that tasks hold (20 bytes an entry) and has no part in the result.
    """
    spark = docs.sparkSession
    base = without(docs, out)
    alone = base.columns == [text]  # rows of the text only need something to be known by
    base = base.select(*[F.col(f"`{c}`") for c in base.columns if c != text], *([F.lit(0).alias("__own")] if alone else []), F.col(text).cast("string").alias(text))
    rules = spark.sparkContext.broadcast(rules_from(tokenizer_path))
    scratch = Scratch(spark, "pieces")
    pieces = scratch.table(piece_counts(base, rules, text), "pieces").withColumn("level", F.floor(F.log2("spread")).cast("int"))
    # the lowest level of spread from which on all pre-tokens fit the bound
    held, least = 0, 64
    for level, n in sorted(map(tuple, pieces.groupBy("level").count().collect()), reverse=True):
        held += n
        if held > max_broadcast:
            break
        least = level
    got = pieces.where(F.col("level") >= least).select("h", "g", "n").toArrow()
    keys, checks, n = got["h"].to_numpy().view(np.uint64), got["g"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.lexsort((checks, keys))
    table = spark.sparkContext.broadcast((keys[order], checks[order], n[order]))
    rest = base.drop(text)
    if held <= max_broadcast:
        return base.mapInArrow(tidy(_summed(rules, table, text, out)), extended(rest, T.StructField(out, T.LongType()))).drop("__own")
    longs = [T.StructField(x, T.LongType()) for x in ("part", "h", "g", "f")]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("own", rest.schema), *longs])
    rows = scratch.table(base.mapInArrow(tidy(_parted(rules, table, text)), schema), "rows")
    tail = rows.where("f is not null").join(pieces.where(F.col("level") < least).select("h", "g", "n"), ["h", "g"]).groupBy("row").agg(F.sum(F.col("n") * F.col("f")).alias("more"))
    summed = rows.where("f is null").select("row", "own", "part").join(tail, "row", "left")
    return summed.select("own.*", (F.col("part") + F.coalesce("more", F.lit(0))).cast("long").alias(out)).drop("__own")


def op10_pretoken_counts(spark, sf_dir):
    """Tokens of every document by the lower-casing word tokenizer."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
