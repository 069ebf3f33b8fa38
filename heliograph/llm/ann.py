"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every unit vector with a pseudo-rotation (three rounds of random signs
and a fast Hadamard transform) and assigns it to the nearest signed axis, its bucket.  A
query probes, in each table, the axes that its own turned vector comes nearest to; the
index has a list of the probing queries for each (table, bucket).  Every row looks its
buckets up there and adds the query's coordinate on that axis to the pair's tally.  Pairs
whose tally reaches a threshold are candidates; they are reranked on the original vectors.

The threshold is fitted: a bounded sample of queries (``sample``) is answered by brute
force, and the threshold is the tally that a share ``target`` of their true neighbours
reaches.  So denser tables, whose neighbours are nearer, have smaller shares of candidates.
Queries left with fewer than k candidates are answered by brute force.

The stated query set is taken in blocks of bounded size, each broadcast, its answers
written, then released.  Rows are never shuffled, buckets never gathered, so a bucket or
vector that holds a third of all rows costs no more than any other.  Each task keeps the
k best of each query; a last step merges those few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.tables import read, tidy
from heliograph.storage import Scratch

TALLY = 1 << 22
PAIRS = 1 << 17
NONE = np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in O(d log d) each."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


class Hashes:
    """The tables' pseudo-rotations for vectors of one dimension, padded to a power of two."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.size = 1 << max(0, dim - 1).bit_length()
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], size=(tables, 3, self.size))

    def turned(self, unit: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        for s in self.signs[table]:
            x = hadamard(x * s)
        return x

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axis: axis for +, axis + size for -."""
        x = self.turned(unit, table)
        axis = np.abs(x).argmax(axis=1)
        return axis + np.where(x[np.arange(len(x)), axis] < 0, self.size, 0)



class Index:
    """The queries of one dimension by (table, bucket): who probes it, and with what coordinate."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, tables: int, probes: int, seed: int, least: float):
        self.ids, self.rows, self.least = ids, rows, least
        self.hashes = Hashes(rows.shape[1], tables, seed)
        unit, width = _unit(rows), 2 * self.hashes.size
        self.lists = []
        for t in range(tables):
            x = self.hashes.turned(unit, t)
            both = np.concatenate([x, -x], axis=1)
            near = np.argsort(-both, axis=1, kind="stable")[:, : min(probes, self.hashes.size)]
            order = np.argsort(near, axis=None, kind="stable")
            starts = np.searchsorted(near.ravel()[order], np.arange(width + 1))
            query = np.repeat(np.arange(len(ids)), near.shape[1])[order]
            self.lists.append((starts, query, np.take_along_axis(both, near, 1).ravel()[order].astype(np.float32)))

    def tally(self, unit: np.ndarray) -> np.ndarray:
        """The sum over shared buckets for each (row, query); zero where they share none."""
        n = len(self.ids)
        out = np.zeros(len(unit) * n, np.float32)
        for t, (starts, query, value) in enumerate(self.lists):
            bucket = self.hashes.buckets(unit, t)
            size = starts[bucket + 1] - starts[bucket]
            stop = np.cumsum(size)
            at = np.arange(int(stop[-1])) + np.repeat(starts[bucket] - stop + size, size)
            out[np.repeat(np.arange(len(unit)) * n, size) + query[at]] += value[at]  # a pair shares a bucket once a table
        return out.reshape(len(unit), n)


def _by_dim(ids: list, vectors: list):
    """Usable vectors of a batch by dimension: {dim: (ids, matrix)}; the others take no part."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        if i is not None and v and None not in v:
            own = groups.setdefault(len(v), ([], []))
            own[0].append(i)
            own[1].append(v)
    out = {}
    for dim, (own, rows) in groups.items():
        m = np.array(rows, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if good.any():
            out[dim] = (np.array(own, np.int64)[good], m[good])
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, scaled where squares would leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = a - b
        out = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
        if len(odd):
            most = np.abs(diff[odd]).max(axis=1)
            scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
            small = diff[odd] / scale[:, None]
            out[odd] = np.where(np.isfinite(most), scale * np.sqrt(np.einsum("ij,ij->i", small, small)), np.inf)
    return out


class _Best:
    """Each query's k best so far: nearest first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.v, self.w = k, np.full((n, k), np.inf), np.full((n, k), NONE), np.zeros((n, k), np.float32)

    def offer(self, q: np.ndarray, dist: np.ndarray, ids: np.ndarray, tally: np.ndarray) -> None:
        near = dist <= self.d[q, self.k - 1]
        q, dist, ids, tally = q[near], dist[near], ids[near], tally[near]
        if not len(q):
            return
        order = np.lexsort((ids, dist, q))
        q, dist, ids, tally = q[order], dist[order], ids[order], tally[order]
        own, first, counts = np.unique(q, return_index=True, return_counts=True)
        rank = np.arange(len(q)) - np.repeat(first, counts)
        top = rank < self.k
        line, rank = np.repeat(np.arange(len(own)), counts)[top], rank[top]
        d, v, w = np.full((len(own), self.k), np.inf), np.full((len(own), self.k), NONE), np.zeros((len(own), self.k), np.float32)
        d[line, rank], v[line, rank], w[line, rank] = dist[top], ids[top], tally[top]
        d, v, w = np.concatenate([self.d[own], d], axis=1), np.concatenate([self.v[own], v], axis=1), np.concatenate([self.w[own], w], axis=1)
        keep = np.lexsort((v, d), axis=1)[:, : self.k]
        self.d[own], self.v[own], self.w[own] = (np.take_along_axis(x, keep, 1) for x in (d, v, w))


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: _Best(len(index.ids), k) for dim, index in block.value.items()}
        for batch in batches:
            for dim, (ids, rows) in _by_dim(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                index = block.value.get(dim)
                if index is None:
                    continue
                step = max(1, TALLY // len(index.ids))
                for at in range(0, len(ids), step):
                    part, own = rows[at : at + step], ids[at : at + step]
                    tally = index.tally(_unit(part))
                    r, q = np.nonzero(tally >= index.least)
                    other = index.ids[q] != own[r]
                    r, q = r[other], q[other]
                    for s in range(0, len(q), PAIRS):
                        a, b = q[s : s + PAIRS], r[s : s + PAIRS]
                        best[dim].offer(a, distances(index.rows[a], part[b]), own[b], tally[b, a])
        for dim, found in best.items():
            line, place = np.nonzero(found.v != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.value[dim].ids[line]), pa.array(found.v[line, place]), pa.array(found.d[line, place]), pa.array(found.w[line, place])], ["query_id", "vec_id", "score", "tally"]
            )

    return run


def nearest(
    rows: DataFrame, queries: DataFrame, *, k: int = 10, tables: int = 20, probes: int = 8, target: float = 0.96, sample: int = 100, block_bytes: int = 16 << 20, seed: int = 7,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest found rows, other than itself, by Euclidean distance.

    Vectors that are null, zero, or hold null or non-finite components take no part, as
    do rows without an id; vectors of different lengths never meet.  Ties go to the
    smaller vec_id.  Repeated rows are candidates each; of queries that repeat an id one
    is asked.  A query has fewer than k rows only if there are no more.  Very large and
    very small components are measured without overflow; a distance beyond the range of
    doubles is infinite and comes last.  An empty table gives no rows.  Other columns
    are not looked at.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    slim = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    asked = scratch.table(asked.where("vec_id is not null and embedding is not null").dropDuplicates(["vec_id"]), "queries")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def answered(some: DataFrame, name: str, least) -> DataFrame:
        """The answers to a bounded number of queries, written; least: the tally threshold of a dimension."""
        part = some.collect()
        found = {dim: Index(ids, m, tables, probes, seed, least(dim)) for dim, (ids, m) in _by_dim([x[0] for x in part], [x[1] for x in part]).items()}
        block = spark.sparkContext.broadcast(found)
        hits = slim.mapInArrow(tidy(_search(block, k)), "query_id long, vec_id long, score double, tally float")
        out = scratch.table(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)
        block.destroy()
        return out

    n, wide = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = 8 * max(1, wide or 0) + 16 * tables * probes

    def in_blocks(some: DataFrame, n: int, name: str, least) -> DataFrame | None:
        blocks, out = max(1, -(-n * width // block_bytes)), None
        for b in range(blocks if n else 0):
            part = answered(some.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), f"{name}{b}", least)
            out = part if out is None else out.unionByName(part)
        return out

    draw = asked.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(sample)
    by_brute_force = answered(draw, "sample", lambda dim: -np.inf)
    fitted = by_brute_force.join(asked.select(F.col("vec_id").alias("query_id"), F.size("embedding").alias("dim")), "query_id").groupBy("dim").agg(F.percentile("tally", 1 - target).alias("least"))
    least = {dim: max(x, 1e-9) for dim, x in map(tuple, fitted.limit(sample).collect())}
    found = in_blocks(asked, n, "found", lambda dim: least.get(dim, 1e-9))
    if found is not None:
        full = scratch.table(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id")), "full")
        short = scratch.table(asked.join(full, "vec_id", "left_anti"), "short")
        if lacking := short.count():
            rest = in_blocks(short, lacking, "rest", lambda dim: -np.inf)
            found = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)
    else:
        found = by_brute_force
    return found.select("query_id", "rank", "vec_id", "score")


def op4_cross_polytope(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
