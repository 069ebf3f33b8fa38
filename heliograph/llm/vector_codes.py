"""Compressing vectors to codes: one codebook per part, entries found by Exponion search in exact integers.

A vector's components become integers and the vector is cut into parts.  Every part has a
codebook; assigning means finding the nearest entry for each part.  The search starts at
the entry the part had before.  All entries as near as that one or nearer lie in a ball
around it: by the triangle inequality within the distance to it plus the distance to the
nearest entry found so far.  So the entry's list of other entries, sorted by distance, is
walked only as far as that radius, which shrinks as better entries turn up.  Radii are
rounded up, distances are exact integers and ties go to the lower index, so the outcome is
that of comparing all entries.

A round is one pass: tasks assign their rows and add up what each entry was given, and only
those sums, a row for each part and entry, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import read, tidy, without
from heliograph.storage import Scratch, join_checked

#: Components are whole numbers below this in magnitude, so that distances are exact in 64 bits.
LIMIT = 1 << 25


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not below the roots: floating point may be off by far less than the one that is added."""
    return np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1


class Codebook:
    """The entries of one part and, of each, all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.near = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of each row, and how many distances it took."""
        best, entry = ((x - self.entries[start]) ** 2).sum(axis=1), start.astype(np.int64)
        own = _ceil_root(best)
        within = (2 * own) ** 2
        walking, steps = np.arange(len(x)), len(x)
        for place in range(len(self.entries)):
            walking = walking[self.gaps[start[walking], place] <= within[walking]]
            if not len(walking):
                break
            steps += len(walking)
            other = self.near[start[walking], place]
            d = ((x[walking] - self.entries[other]) ** 2).sum(axis=1)
            better = (d < best[walking]) | ((d == best[walking]) & (other < entry[walking]))
            at = walking[better]
            best[at], entry[at] = d[better], other[better]
            within[at] = (own[at] + _ceil_root(d[better])) ** 2
        return entry, best, steps


def _passes(books, tally: bool):
    """Rows with new codes and errors; after a task's rows, if asked for, one row for each part and entry that was given any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books.value]
        k, w = books.value[0].shape
        counts, sums, kind = np.zeros((len(own), k), np.int64), np.zeros((len(own), k, w), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(own), w)
            before = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, len(own))
            codes, error = np.empty_like(before), np.zeros(batch.num_rows, np.int64)
            for p, book in enumerate(own):
                entry, d, _ = book.assign(q[:, p], before[:, p])
                codes[:, p], error = entry, error + d
                if tally:
                    counts[p] += np.bincount(entry, minlength=k)
                    np.add.at(sums[p], entry, q[:, p])
            none = pa.nulls(batch.num_rows, pa.int64())
            held = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held, pa.array(error), none, none, none, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], _FIELDS)
        if kind is not None and tally:
            part, entry = np.nonzero(counts)
            empty = [pa.nulls(len(part), t) for t in (kind, pa.list_(pa.int64()), pa.binary(), pa.int64())]
            given = [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, *given], _FIELDS)

    return run


_FIELDS = ["own", "q", "code", "error", "part", "entry", "n", "total"]


def _schema(own: T.DataType) -> T.StructType:
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    return T.StructType([T.StructField(f, t) for f, t in zip(_FIELDS, (own, longs, T.BinaryType(), long, long, long, long, longs), strict=True)])


def quantised(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows with a usable vector: not null, all components finite; beside the others a column q of floor(scale * component)."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    q = F.transform(x, lambda v: F.when(F.abs(v * float(scale)) < float(LIMIT), F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LIMIT}"))).cast("long"))
    return df.where(usable).withColumn("__q", q)


def compress(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """(``df`` with code string and code_error long in place of the vector, the final codebooks: one array entries x width a part).

    Rows whose vector is null or holds a null or non-finite component are left out, as are
    those of another length than the row that comes first by id (nulls last): they have no
    such parts.  That length must be a multiple of ``parts``.  Codebooks start as the parts of
    the first ``entries`` rows by id, fewer if there are fewer; ties and repeated rows are
    rows like others.  An empty table gives no row and no codebook.  Input columns named
    like the outputs are replaced.  A component of 2**25 / ``scale`` or more is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    spark = df.sparkSession
    base = without(df, "code", "code_error", "__q")
    scratch = Scratch(spark, "codes")
    rows = quantised(base, vector, scale)
    first = rows.orderBy(F.asc_nulls_last(vec_id), "__q").select("__q").limit(entries).collect()
    rest = [c for c in base.columns if c != vector]
    own = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`").alias(c) for c in rest))
    outputs = [*(F.col("own")[c].alias(c) for c in rest)]
    if not first:
        return rows.select(*rest, F.lit("").alias("code"), F.lit(0).cast("long").alias("code_error")), []
    size = len(first[0][0])
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    seeds = np.array([r[0] for r in first if len(r[0]) == size], np.int64).reshape(-1, parts, size // parts)
    books = [np.ascontiguousarray(seeds[:, p]) for p in range(parts)]
    table = rows.where(F.size("__q") == size).select(own.alias("own"), F.col("__q").alias("q"), F.unhex(F.lit("00" * parts)).alias("code"))
    table = scratch.table(table, "round0")
    schema = _schema(table.schema["own"].dataType)
    for k in range(1, rounds + 2):
        shared = spark.sparkContext.broadcast(books)
        last = k == rounds + 1
        new = scratch.table(table.select("own", "q", "code").mapInArrow(tidy(_passes(shared, not last)), schema), f"round{k}")
        scratch.drop(f"round{k - 1}")
        shared.unpersist()
        table = new.where("code is not null")
        if not last:
            totals = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size // parts)]
            given = new.where("part is not null").groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *totals).collect()
            books = [b.copy() for b in books]
            for r in given:
                books[r.part][r.entry] = [int(r[f"t{i}"]) // int(r.n) for i in range(size // parts)]
    return table.select(*outputs, F.lower(F.hex("code")).alias("code"), F.col("error").alias("code_error")), books


def with_group_error(coded: DataFrame, by: str, out: str = "label_error") -> DataFrame:
    """``coded``, read from a written table, plus the sum of code_error over rows with an equal value of ``by``; nulls are equal."""
    sums = coded.groupBy(F.col(by).alias("__by")).agg(F.sum("code_error").alias(out))
    sums = Scratch(coded.sparkSession, "sums").table(sums, out)
    return join_checked(without(coded, out), sums, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def op11_exponion_codes(spark, sf_dir):
    """The code of every usable vector of ``embeddings``, its error, and the error of its label."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = compress(rows)
    return with_group_error(coded, "label").select("vec_id", "code", F.col("code_error").alias("error"), "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """near{k}: each part's nearest entry of book{k} and its distance, as 64 * distance + entry; book{k + 1}: the entries after it."""
    return f"""near{k} AS (
  SELECT rid, p, any_value(v) AS v, min(64 * d + e) AS m
  FROM (SELECT x.rid, x.p, x.v, b.e, list_sum(list_transform(range(1, x.w + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d FROM parts x JOIN book{k} b ON x.p = b.p)
  GROUP BY rid, p
), given{k} AS (
  SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v
  FROM (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT p, m % 64 AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM near{k}) GROUP BY p, e, i)
  GROUP BY p, e
), book{k + 1} AS (
  SELECT b.p, b.e, coalesce(g.v, b.v) AS v FROM book{k} b LEFT JOIN given{k} g ON b.p = g.p AND b.e = g.e
)"""


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT rid, p, len(q) // 16 AS w, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) t(p)
), book0 AS (
  SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= 64
), {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}, coded AS (
  SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
