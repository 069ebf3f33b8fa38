"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 8 positional bytes (place, value).  Two fingerprints that differ
in at most 2 bits differ in at most 2 bytes, so they share at least 6 of the 8.  The
index has a list for every choice of ``WIDTH`` = 5 places and their values: single bytes
would make lists of 1/256 of all fingerprints and n*n/64 pairs.  For every pair the
lists that both stand in are tallied: a pair that shares 6 bytes stands in at least
C(6, 5) = 6 of them, the guaranteed minimum, one that shares 5 only in one.  Pairs that
reach the minimum are verified on their bits.

A list of more than ``LONG`` fingerprints is not paired.  There every member looks up the
300 fingerprints that differ from it in one or two of the list's free 24 bits, an equality
join, so the work stays linear in the list.  Equal fingerprints are collapsed before all
this with a partial aggregate; copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import extended, read, tidy, without
from heliograph.llm.wordscan import chunks
from heliograph.operators.components import connected_components
from heliograph.storage import Scratch, join_checked

SHARED, WIDTH = 6, 5
#: Lists of more fingerprints than this are not paired; their members look their neighbours up.
LONG = 512


def fingerprint_of(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text (ASCII letters lower-cased, words split at ASCII white space)."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False)
    return np.fromiter((digest(b" ".join(r), seed) for r in runs), np.uint64, len(words) - shingle + 1)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each list of hashes: bit i is set if more than half of them have it; none: zero."""
    counts = np.zeros((len(hashes), 64), np.int64)
    for d, h in enumerate(hashes):
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[d] += bits.sum(axis=0, dtype=np.int64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()


def _fingerprints(text: str, shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            texts = batch.column(at).to_pylist()
            out = [majority([fingerprint_of(t, shingle, seed) for t in texts[a:b]]) for a, b in chunks([len(t or "") for t in texts], 1 << 20)]
            prints = pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, prints], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "fp"])

    return run


def fingerprints(docs: DataFrame, *, shingle: int, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with fp long in place of the text: the SimHash of its word shingles, repeats included.

    A text of fewer words than a shingle is one shingle; a null text or one without a
    word has fingerprint zero.  An input column named fp is replaced.
    """
    base = without(docs, "fp")
    schema = extended(base.drop(text), T.StructField("fp", T.LongType()))
    return base.mapInArrow(tidy(_fingerprints(text, shingle, seed)), schema)


def _choices() -> list[tuple[int, int]]:
    """(mask of a choice of WIDTH places as a signed long, mask of the free bits)."""
    out = []
    for places in combinations(range(8), WIDTH):
        mask = sum(255 << (8 * p) for p in places)
        out.append((mask - (1 << 64 if mask >> 63 else 0), mask ^ ((1 << 64) - 1)))
    return out


def _lists(prints: DataFrame) -> DataFrame:
    """(fp, places, bytes): each fingerprint in its list of every choice of places."""
    masked = F.array(*(F.col("fp").bitwiseAND(F.lit(mask)) for mask, _ in _choices()))
    return prints.select("fp", F.posexplode(masked).alias("places", "bytes"))


def tallied(lists: DataFrame, max_bits: int = 2) -> DataFrame:
    """(src, dst, shared) of pairs, src > dst, that stand together in ``shared`` lists, at least the guaranteed minimum, and are verified."""
    least = comb(8 - max_bits, WIDTH)
    a, b = (lists.select("places", "bytes", F.col("fp").alias(x)) for x in ("src", "dst"))
    pairs = a.join(b, ["places", "bytes"]).where("src > dst")
    tally = pairs.groupBy("src", "dst").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return tally.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)


def _neighbours(lists: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) in long lists: each member with its neighbours that differ in a list's free bits, if they are members too."""
    flips = []
    for _, free in _choices():
        bits = [1 << i for i in range(64) if free >> i & 1]
        flips.append([sum(c) - (1 << 64 if sum(c) >> 63 else 0) for n in range(1, max_bits + 1) for c in combinations(bits, n)])
    if not flips[0]:
        return lists.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    table = F.broadcast(lists.sparkSession.createDataFrame(list(enumerate(flips)), "places int, flips array<long>"))  # 56 rows
    near = lists.join(table, "places").select(F.col("fp").alias("src"), F.explode(F.transform("flips", lambda x: F.col("fp").bitwiseXOR(x))).alias("dst")).where("src > dst")
    return near.join(lists.select(F.col("fp").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def links(prints: DataFrame, max_bits: int = 2, long: int = LONG) -> DataFrame:
    """(src, dst) of distinct fingerprints, src > dst, that differ in at most ``max_bits`` <= 2 bits.

    A pair that shares a long list is found there; any other one that qualifies has all
    its lists among the short ones, so the tally's minimum holds for it.
    """
    if not 0 <= max_bits <= 8 - SHARED:
        raise ValueError("the index guarantees a meeting for 0 to 2 differing bits")
    scratch = Scratch(prints.sparkSession, "bytelists")
    lists = _lists(prints)
    held = scratch.table(lists.groupBy("places", "bytes").agg(F.count("*").alias("held")).where("held > 1"), "held")
    shared = scratch.table(join_checked(lists, held, ["places", "bytes"]), "shared")
    found = tallied(shared.where(F.col("held") <= long), max_bits).select("src", "dst")
    return found.unionByName(_neighbours(shared.where(F.col("held") > long), max_bits)).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int, max_bits: int = 2, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the row's own included.

    One row for each input row.  Rows with equal fingerprints are linked, texts without
    a word among them.  A null doc_id takes part but is never chosen; a group of null
    ids alone has a null component_id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = scratch.table(fingerprints(slim, shingle=shingle, seed=seed), "rows")
    prints = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = connected_components(scratch.table(links(prints, max_bits), "links"))
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    rooted = scratch.table(rooted, "rooted")
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.table(rooted.join(smallest, "component").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_byte_position_simhash(spark, sf_dir):
    """Components of documents whose 64-bit fingerprints differ in at most two bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
