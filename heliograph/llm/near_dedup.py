"""Near-dedup of texts: an index of fingerprint bytes finds near copies first, prefixes of shingle sets those it misses; whole sets verify all.

The first step is that of ``simhash``: fingerprints within two bits meet in its inverted
index of positional bytes and pass its count filter.  Texts at Jaccard t may differ in
more bits, so no index of bytes finds all of them; the prefixes below find the rest, and
members that the index has joined are not held against each other again.

Texts are classed by two independent 64-bit hashes of their distinct five-word shingles; all
else is done once a class.  All shingles have one order (frequent ones of a sample last, else that of their
hashes).  Let a pair's sets have Jaccard similarity t or more, x of n shingles being the
larger and y of m the smaller.  They have a = t / (1 + t) * (n + m) or more in common, so
their first common one has at least a of both sets from itself on.  As a is at least t * n
and 2t / (1 + t) * m, every set probes with its first n - ceil(t * n) + 1 shingles and is
indexed with a shorter prefix, its first m - ceil(2t / (1 + t) * m) + 1; and a pair meets
in a list only if the shingle's places in both sets leave them a each.  That leaves out no
pair, wherever and however the texts differ, and hardly pairs sets that have only a common
passage.

In lists of up to ``CROWD`` members all who probe are held against all who are indexed.  In
a longer one its smallest indexed member is held against all others, which one large group
of near copies mostly settles, then the next smallest, in ``ROUNDS`` rounds.  What is left
after them are lists whose members links haven't joined; there only members of different
groups are held against each other, and long lists are split over tasks.  As such members
are alike, a bitmap of each set goes along, a bit of which says whether an odd number of
shingles fall on it: sets that differ in d shingles differ in at most d bits, so a pair
whose bitmaps differ in more bits than near copies may have shingles is left out before it
is made (the bitmap filter of Sandes et al.).  All other candidates pass the same filter
before their whole sets are fetched, since sets take many times a bitmap's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.simhash import fingerprint_of, links as fingerprint_links, majority
from heliograph.llm.tables import tidy
from heliograph.llm.wordscan import chunks, mixed, range_hashes, window_hashes
from heliograph.operators.components import connected_components
from heliograph.storage import Scratch, join_checked

CROWD = 32
ROUNDS = 3
#: Shingles that OFTEN of about SAMPLE sets hold come last in the order; at most MOST of them (4 MB).
SAMPLE, OFTEN, MOST = 20_000, 4, 500_000
#: Members of a long list that one task holds against others.
PART = 1024
#: Longs of a set's bitmap.
LONGS = 16
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, words of each text); words split at ASCII white space, A-Z lower-cased."""
    data = "\n".join(texts).encode().lower()
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([0], (~_GAP[raw]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum(np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64) + 1)
    counts = np.bincount(np.searchsorted(stops, starts, side="right"), minlength=len(texts))
    return range_hashes(raw, starts, ends), counts


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles; a shorter text is one shingle, an empty one none."""
    return window_hashes(words, min(n, len(words))) if len(words) else words


def _each(texts: list[str]):
    """(index, word hashes) of each text."""
    for a, b in chunks([len(t) for t in texts], 1 << 20):
        words, counts = _word_hashes(texts[a:b])
        stops = np.cumsum(counts)
        for i in range(b - a):
            yield a + i, words[stops[i] - counts[i] : stops[i]]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By id: two hashes of the set of shingles, how many they are, 32 bits of each in order, the set's bitmap, and the text's fingerprint."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        keys, checks = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        sizes, rows = np.zeros(len(texts), np.int32), [b""] * len(texts)
        maps = np.zeros((len(texts), 64 * LONGS), np.uint8)
        for i, words in _each(texts):
            own = np.unique(_shingles(words, 5))
            spread = mixed(own * np.uint64(0xA0761D6478BD642F))
            keys[i], checks[i] = spread.sum(dtype=np.uint64), mixed(spread * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1)).sum(dtype=np.uint64)
            short = np.unique((own >> np.uint64(32)).astype("<u4"))
            sizes[i], rows[i] = len(short), short.tobytes()
            maps[i] = np.bincount(short % (64 * LONGS), minlength=64 * LONGS) & 1
        prints = [majority([fingerprint_of(t, 3) for t in texts[a:b]]) for a, b in chunks([len(t) for t in texts], 1 << 20)]
        fp = pa.array(np.concatenate(prints) if prints else np.empty(0, np.int64), pa.int64())
        longs = np.packbits(maps, axis=1, bitorder="little").view("<i8").ravel()
        odd = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * LONGS), pa.array(longs))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(sizes), pa.array(rows, pa.binary()), odd, fp], ["id", "c", "check", "n", "shingles", "odd", "fp"])


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(2).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i4"))], ["key"])


def _prefixes(threshold: float, last):
    """(c, n, indexed, keys): the first ``indexed`` of the keys are the shorter prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = last.value
        for batch in batches:
            keys, indexed = [], []
            for x in batch.column(2).to_pylist():
                own = np.frombuffer(x, "<i4")
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    own = own[np.argsort(np.where(late[at] == own, rank[at], 0), kind="stable")]
                n = len(own)
                must, both = (int(np.ceil(share * n - 1e-9)) for share in (threshold, 2 * threshold / (1 + threshold)))
                indexed.append(n - both + 1)
                keys.append(own[: n - must + 1])
            stops = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(indexed, pa.int32()), lists], ["c", "n", "indexed", "keys"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                keep.append(union == 0 or both >= threshold * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, their rank from 1): those that several sets of a sample hold, rarer ones first.

    They come last in the order of all shingles, so lists are long only where sets hold little else.
    """
    share = SAMPLE / max(1, sets.count())
    drawn = sets.where(F.pmod(F.xxhash64(F.lit("shingles"), "c"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else sets
    keys = drawn.select("c", "n", "shingles").mapInArrow(tidy(_all), "key int")
    found = keys.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {OFTEN}").orderBy(F.desc("n"), "key").limit(MOST).toPandas()
    found = found.sort_values(["n", "key"])
    late, rank = found["key"].to_numpy(np.int32), np.arange(1, len(found) + 1)
    order = np.argsort(late)
    return late[order], rank[order]


def _alike(n: str, m: str, a: str, b: str, similarity: float) -> Column:
    """Whether sets of n and m shingles with the bitmaps a and b can be near copies."""
    both = F.col(n) + F.col(m)
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONGS)), F.lit(0))
    return differ <= both - 2 * F.ceil(both * F.lit(similarity / (1 + similarity)) - 1e-9)


def _by_fingerprint(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) of classes whose fingerprints the index of positional bytes links; those of one fingerprint are held against its first."""
    prints = scratch.table(sets.groupBy("fp").agg(F.min("c").alias("first")), "prints")
    near = scratch.table(fingerprint_links(prints), "near")
    end = lambda fp, c: prints.select(F.col("fp").alias(fp), F.col("first").alias(c))
    across = near.toDF("x", "y").join(end("x", "a"), "x").join(end("y", "b"), "y")
    within = sets.select("fp", F.col("c").alias("a")).join(prints.select("fp", F.col("first").alias("b")), "fp").where("a <> b")
    return across.select("a", "b").unionByName(within.select("a", "b")).select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()


def _groups(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, component) of the classes that have a near copy."""

    def meet(x: str, y: str) -> Column:
        """Whether the larger set x and the smaller y can have their first common shingle here and be near copies."""
        (n, c, at), (m, d, to) = ([F.col(f"{s}.{f}") for f in ("n", "c", "at")] for s in (x, y))
        a = F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - 1e-9)
        return ((n > m) | ((n == m) & (c > d))) & (m >= n * F.lit(similarity - 1e-9)) & (n - at >= a) & (m - to >= a)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"{name}_pairs")
        slim = lambda end, n, odd: sets.select(F.col("c").alias(end), F.col("n").alias(n), F.col("odd").alias(odd))
        likely = pairs.join(slim("src", "n", "a"), "src").join(slim("dst", "m", "b"), "dst").where(_alike("n", "m", "a", "b", similarity)).select("src", "dst")
        likely = scratch.table(likely, f"{name}_likely")
        scratch.drop(f"{name}_pairs")
        # only the sets of such pairs are shuffled
        ends = scratch.table(likely.select(F.col("src").alias("c")).union(likely.select("dst")).distinct(), f"{name}_ends")
        held = scratch.table(join_checked(sets.select("c", "shingles"), ends, "c", "left_semi"), f"{name}_sets")
        side = lambda end, x: held.select(F.col("c").alias(end), F.col("shingles").alias(x))
        both = likely.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
        links = scratch.table(both.select("src", "dst", "a", "b").mapInArrow(tidy(_verified(similarity)), "src long, dst long"), f"{name}_links")
        for x in ("likely", "ends", "sets"):
            scratch.drop(f"{name}_{x}")
        return links

    by_bytes = scratch.table(connected_components(verified(_by_fingerprint(sets, scratch), "bytes")), "by_bytes")
    scratch.drop("bytes_links")
    last = sets.sparkSession.sparkContext.broadcast(_frequent(sets))
    prefixes = sets.where("n > 0").select("c", "n", "shingles").mapInArrow(tidy(_prefixes(similarity, last)), "c long, n int, indexed int, keys array<int>")
    prefixes = prefixes.join(by_bytes.withColumnRenamed("node", "c"), "c", "left").select("c", "n", "indexed", "keys", F.coalesce("component", "c").alias("g"))
    prefixes = scratch.table(prefixes, "prefixes").select("c", "n", "indexed", "g", F.posexplode("keys").alias("at", "key"))
    lists = prefixes.select("key", F.struct("c", "n", "at").alias("s"), (F.col("at") < F.col("indexed")).alias("indexed"), "g")
    shared = lists.groupBy("key").agg(F.count("*").cast("int").alias("held"), F.max("indexed").alias("any")).where("held > 1 and any").drop("any")
    lists = scratch.table(lists.join(shared, "key"), "lists")
    scratch.drop("prefixes")
    few = lists.where(F.col("held") <= CROWD)
    pairs = few.select("key", F.col("s").alias("x"), "g").join(few.where("indexed").select("key", F.col("s").alias("y"), F.col("g").alias("h")), "key").where((F.col("g") != F.col("h")) & meet("x", "y"))
    links = verified(pairs.select(F.col("x.c").alias("src"), F.col("y.c").alias("dst")).distinct(), "few")
    found, past = scratch.table(connected_components(links.unionByName(by_bytes.toDF("src", "dst"))), "found"), "found"
    scratch.drop("few_links")

    open_lists = lists.where(F.col("held") > CROWD).select("key", "s", "indexed")
    for r in range(ROUNDS + 1):
        named = open_lists.join(found.withColumnRenamed("node", "c"), F.col("s.c") == F.col("c"), "left").select("key", "s", "indexed", F.coalesce("component", "s.c").alias("g"))
        named = scratch.table(named, f"named{r}")
        if r:
            scratch.drop(f"named{r - 1}")
            scratch.drop(f"tops{r - 1}")
        else:
            scratch.drop("lists")
        # a list is settled if links have joined all its members or none of those left is indexed
        tops = named.groupBy("key").agg(F.min(F.struct(~F.col("indexed"), "s", "g")).alias("p"), F.min("g").alias("low"), F.max("g").alias("high"), F.max("indexed").alias("any"))
        tops = scratch.table(tops.where("low < high and any").select("key", F.col("p.s").alias("p"), F.col("p.g").alias("pg")), f"tops{r}")
        if not tops.limit(1).count():
            break
        if r < ROUNDS:
            held = named.join(tops, "key").where("s.c <> p.c")
            open_lists = held.select("key", "s", "indexed")
            pairs = held.where((F.col("g") != F.col("pg")) & (meet("s", "p") | meet("p", "s"))).select(F.greatest("s.c", "p.c").alias("src"), F.least("s.c", "p.c").alias("dst"))
        else:
            rest = named.join(tops.select("key"), "key", "left_semi")
            pairs = _across(rest.join(sets.select("c", "odd"), F.col("s.c") == F.col("c")).select("key", F.col("s").withField("odd", F.col("odd")).alias("s"), "indexed", "g"), meet, similarity)
        new = verified(pairs.distinct(), f"round{r}")
        found = scratch.table(connected_components(new.unionByName(found.toDF("src", "dst"))), f"found{r}")
        scratch.drop(past)
        scratch.drop(f"round{r}_links")
        past = f"found{r}"
    return found


def _across(rest: DataFrame, meet, similarity: float) -> DataFrame:
    """(src, dst) of members of different groups that meet in the lists ``rest`` (key, s, indexed, g).

    Members of a list's largest group are only held against those outside it.
    """
    sizes = rest.groupBy("key", "g").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("g", F.struct("m", "g")).alias("top"), F.ceil(F.sum("m") / PART).cast("int").alias("parts"))
    rest = rest.join(largest, "key").withColumn("inner", F.col("g") == F.col("top"))
    y = rest.where("indexed").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", F.col("s").alias("y"), F.col("g").alias("h"), F.col("inner").alias("y_inner"))
    x = rest.withColumn("part", F.pmod(F.xxhash64("s.c"), F.col("parts")).cast("int")).select("key", "part", F.col("s").alias("x"), "g", F.col("inner").alias("x_inner"))
    good = (F.col("g") != F.col("h")) & meet("x", "y") & _alike("x.n", "y.n", "x.odd", "y.odd", similarity)
    met = x.join(y.where("not y_inner"), ["key", "part"]).where(good).unionByName(x.where("not x_inner").join(y.where("y_inner"), ["key", "part"]).where(good))
    return met.select(F.col("x.c").alias("src"), F.col("y.c").alias("dst"))


def near_copies(docs: DataFrame, *, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, component_id): every non-null doc_id with the smallest id of its group of near copies, its own if it has none.

    Texts are near copies if the Jaccard similarity of their sets of five-word shingles
    is at least ``similarity``; texts without a word are copies of one another.  Ids may be
    of any type that has an order.  An id that is repeated has a row for each of its texts.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    slim = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    rows = scratch.table(slim.mapInArrow(tidy(_sets), f"id {kind}, c long, check long, n int, shingles binary, odd array<long>, fp long"), "rows")
    classes = scratch.table(rows.groupBy("c").agg(F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high")), "classes")
    clashes = classes.where("low < high").select("c", "low")
    if clashes.limit(1).count():  # sets of one first hash that are not the same: all but one get another
        rows = join_checked(rows, scratch.table(clashes, "clashes"), "c", "left").withColumn("c", F.when(F.col("check") != F.col("low"), F.xxhash64("c", "check")).otherwise(F.col("c"))).drop("low")
        classes = scratch.table(rows.groupBy("c").agg(F.min("id").alias("id")), "told_apart")
    classes = classes.select("c", "id")
    # all rows of a class have its set, so that any of them will do and sets are shuffled once
    sets = scratch.table(rows.groupBy("c").agg(*(F.first(x).alias(x) for x in ("n", "shingles", "odd")), F.min("fp").alias("fp")), "sets")
    rows = scratch.table(rows.select("id", "c"), "ids")
    scratch.drop("rows")  # the sets are written once more by class; this and their shuffle are most of the space
    found = _groups(sets, similarity, scratch)
    named = classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "id", F.coalesce("component", "c").alias("g"))
    named = scratch.table(named, "named")
    least = named.groupBy("g").agg(F.min("id").alias("component_id"))
    groups = scratch.table(named.join(least, "g").select("c", "component_id"), "groups")
    return rows.select("id", "c").join(groups, "c").select("id", "component_id")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies.

    Rows without an id stay.  Of rows that repeat one id in a group, one stays.
    """
    found = near_copies(docs, doc_id=doc_id, **options)
    scratch = Scratch(docs.sparkSession, "kept")
    gone = scratch.table(found.groupBy("id").agg(F.bool_and(F.col("id") != F.col("component_id")).alias("out"), F.count("*").alias("n")).where("out or n > 1"), "gone")
    out = gone.where("out").select("id")
    kept = join_checked(docs, out, docs[f"`{doc_id}`"] == out["id"], "left_anti")
    twice = scratch.table(gone.where("not out").select("id"), "twice")
    if twice.limit(1).count():
        again = join_checked(kept, twice, kept[f"`{doc_id}`"] == twice["id"], "left_semi").dropDuplicates([doc_id])
        kept = join_checked(kept, twice, kept[f"`{doc_id}`"] == twice["id"], "left_anti").unionByName(again)
    return kept
