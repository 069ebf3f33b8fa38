"""Benchmark decontamination by a broadcast set of word n-grams.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters.  A benchmark item gives every window of n consecutive words; an item
of fewer words, but not none, is one window.  Training texts are scanned window
by window against the hash set; each hit is verified on the words themselves.

The set is broadcast as sorted arrays, in blocks of about ``block_bytes``.  Its size is
checked first; a larger benchmark runs as several blocks one after another, the rows and
what was found in them written between, and each block is released before the next is
sent.  So no text is ever shuffled and no worker holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import extended, read, tidy, without
from heliograph.llm.wordscan import chunks, range_hashes, window_hashes, words_of
from heliograph.storage import Scratch

CHUNK = 1 << 19
STATE = ("__n_words", "__ranges", "__items")


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, starts, ends = words_of((text or "").encode())
                size = min(n, len(starts))
                if not size:
                    continue
                found = window_hashes(range_hashes(low, starts, ends), size).view(np.int64)
                words = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                out += [(size, int(h), b" ".join(words[i : i + size]).decode(), item) for i, h in enumerate(found)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["size", "hash", "gram", "item"]
            )

    return run


def benchmark_grams(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (size, hash, gram, item) of the benchmark; null texts and texts without a word give none."""
    slim = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(tidy(_grams(n)), "size int, hash long, gram string, item string").distinct()


class _Packed:
    """Byte strings end to end."""

    def __init__(self, values: pa.ChunkedArray):
        parts = values.to_pylist()
        self.ends = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        self.data = b"".join(parts)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]]


class _Block:
    """One block of windows in sorted arrays: hashes by window size, and the words and items behind each."""

    def __init__(self, size: np.ndarray, hashes: np.ndarray, grams: _Packed, items: _Packed):
        self.grams, self.items, self.sizes, self.maps = grams, items, {}, {}
        order = np.lexsort((hashes, size))
        for s in np.unique(size).tolist():
            own = order[size[order] == s]
            self.sizes[s] = (hashes[own], own)

    @classmethod
    def of(cls, rows: DataFrame) -> _Block:
        """A bounded number of rows, collected as Arrow."""
        got = rows.select("size", "hash", F.col("gram").cast("binary").alias("gram"), F.col("item").cast("binary").alias("item")).toArrow()
        kept = [_Packed(got[c]) for c in ("gram", "item")]
        return cls(got["size"].to_numpy(), got["hash"].to_numpy().view(np.uint64), *kept)

    def matches(self, size: int, h: np.uint64, text: bytes) -> list[str]:
        """Items with this very window."""
        known, rows = self.sizes[size]
        out = []
        for k in range(np.searchsorted(known, h), len(known)):
            if known[k] != h:
                break
            if self.grams[rows[k]] == text:
                out.append(self.items[rows[k]].decode())
        return out

    def hits(self, texts: list[str]):
        """(words of each text, {text: ([word ranges], {items})}) for a chunk of texts."""
        data = "\n".join(texts).encode()
        low, starts, ends = words_of(data)
        lengths = np.array([len(t.encode()) if not t.isascii() else len(t) for t in texts], np.int64) + 1
        edges = np.cumsum(lengths)
        owner = np.searchsorted(edges, starts, side="right")
        n_words = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(n_words) - n_words
        words = range_hashes(low, starts, ends)
        found: dict[int, tuple[list, set]] = {}
        for size, (known, _) in self.sizes.items():
            seen = window_hashes(words, size)
            if size not in self.maps:
                self.maps[size] = np.zeros(1 << 20, bool)
                self.maps[size][known >> np.uint64(44)] = True
            at = np.flatnonzero(self.maps[size][seen >> np.uint64(44)])
            at = at[owner[at] == owner[at + size - 1]]
            place = np.minimum(np.searchsorted(known, seen[at]), len(known) - 1)
            for i in at[known[place] == seen[at]]:
                text = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                if items := self.matches(size, seen[i], text):
                    d = int(owner[i])
                    spans, whose = found.setdefault(d, ([], set()))
                    spans.append((int(i - first[d]), int(i - first[d]) + size))
                    whose.update(items)
        return n_words, found


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, merged ranges, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(block, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            ranges = batch.column(names.index(STATE[1])).to_pylist()
            items = batch.column(names.index(STATE[2])).to_pylist()
            n_words: list[int] = []
            for a, b in chunks([len(t) for t in texts], CHUNK):
                counts, found = own.hits(texts[a:b])
                n_words += counts.tolist()
                for d, (spans, whose) in found.items():
                    old = ranges[a + d]
                    ranges[a + d] = _merged(spans + list(zip(old[::2], old[1::2], strict=True)))
                    items[a + d] = sorted({*items[a + d], *whose})
            state = [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 3], *state], names=names)

    return run


def scan(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 64 << 20, names: tuple[str, str, str] = ("n_words", "hit_ranges", "hit_items")
) -> DataFrame:
    """``docs`` plus n_words long, hit_ranges array<int> (start, end, start, end, ... in words) and hit_items array<string>.

    Null texts have no words.  Repeated rows are scanned each; an empty benchmark hits
    nothing, as do items without an id; input columns named like the outputs (``names``)
    are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "grams")
    grams = scratch.table(benchmark_grams(benchmark, n, item, item_text).where("item is not null"), "grams")
    size = grams.agg(F.sum(F.octet_length("gram") + F.octet_length("item") + 32)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    base = without(docs, *names, *STATE)
    rows = base.withColumns(
        {STATE[0]: F.lit(0).cast("long"), STATE[1]: F.array().cast("array<int>"), STATE[2]: F.array().cast("array<string>")}
    )
    schema = extended(
        base, T.StructField(STATE[0], T.LongType()), T.StructField(STATE[1], T.ArrayType(T.IntegerType())), T.StructField(STATE[2], T.ArrayType(T.StringType()))
    )
    for b in range(n_blocks):
        own = grams.where(F.pmod("hash", F.lit(n_blocks)) == b) if n_blocks > 1 else grams
        block = spark.sparkContext.broadcast(_Block.of(own))
        rows = rows.mapInArrow(tidy(_scan(block, text)), schema)
        if b + 1 < n_blocks:
            rows = scratch.table(rows, f"block{b}")
            block.destroy()
            if b:
                scratch.drop(f"block{b - 1}")
    return rows.select(*[f"`{c}`" for c in base.columns], *(F.col(s).alias(x) for s, x in zip(STATE, names, strict=True)))


def _cut(text: str, ranges: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index(text)
            texts = batch.column(at).to_pylist()
            for i, r in enumerate(batch.column(names.index(ranges)).to_pylist()):
                if r:
                    data = texts[i].encode()
                    _, starts, ends = words_of(data)
                    kept, done = [], 0
                    for a, b in zip(r[::2], r[1::2], strict=True):
                        kept.append(data[done : starts[a]])
                        done = ends[b - 1]
                    texts[i] = b"\n".join([*kept, data[done:]]).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without what the benchmark leaked into it, in the columns of ``docs``.

    remove="documents" drops every document with a hit; remove="spans" keeps all
    documents and puts a line break for each run of hit words.  Documents without a
    hit, null texts among them, stay as they are, with all their columns.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = ("__words_seen", "__hit_ranges", "__hit_items")
    found = scan(docs, benchmark, text=text, names=names, **options)
    if remove == "documents":
        kept = found.where(F.size(names[1]) == 0)
    else:
        kept = found.mapInArrow(tidy(_cut(text, names[1])), found.schema)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def op3_benchmark_ngrams(spark, sf_dir):
    """Each document's words hit by ten-word windows of the benchmark."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    pairs = F.sequence(F.lit(0), F.size("hit_ranges") - 2, F.lit(2))
    n_hit = F.when(F.size("hit_ranges") == 0, F.lit(0)).otherwise(
        F.aggregate(pairs, F.lit(0), lambda s, i: s + F.get("hit_ranges", i + 1) - F.get("hit_ranges", i))
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM grams)),
hits AS (SELECT doc_id, i, places.n, item FROM places JOIN grams ON grams.n = places.n AND g = array_to_string(w[i:i + places.n - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
