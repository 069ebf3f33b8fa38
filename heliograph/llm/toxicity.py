"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text, compared window by window.

Texts are normalised: lower case, single spaces between runs of letters, one byte a
character.  The toxic dictionary is trained on the stretches of toxic texts whose n-grams
stand in significantly more toxic than ordinary texts, so the background that both classes
share takes no room in it.  The ordinary dictionary is trained on what is typical of
ordinary texts in the same way, and on those stretches of them that the toxic dictionary
knows too although they are not typical of toxic texts.  A text is cut into overlapping
windows and every window is compressed with both dictionaries: what the toxic one saves over
the ordinary one is the window's margin.

Windows begin with a lead that both dictionaries know, which pays the fixed cost of a
window's first match.  With Huffman coding off (zstandard's fast strategy with a target
length), a margin is close to the number of characters that the toxic dictionary knows and
the ordinary one doesn't, less a few bytes a match.

A text's score is a logistic function of its largest margin, of the sum of its margins above
what ordinary windows have, and of its length, fitted on labelled texts kept aside.  The
score is shifted so that 0.5 is the threshold with the best F1 among these, of those under
which half of what is called toxic is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import extended, read, tidy, without

#: Bytes that no normalised text has; both dictionaries end with the lead, every window begins with it and ends with the tail.
LEAD, TAIL = b"0123456789-=+*/&%$#@!~<>", b"\0" * 8
GRAM, WINDOW, STRIDE = 6, 96, 80
#: Typical n-grams stand in so many times the other class's share of texts, with a log-likelihood ratio of at least this.
TIMES, RATIO = 8, 24.0
#: Windows are compressed so many at a time.
BATCH = 20_000
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str | None) -> bytes:
    """Lower case, runs of letters and marks between single spaces, a space at either end; letters beyond ASCII share 128 bytes."""
    inner = _GAP.sub(" ", (text or "").lower()).strip()
    units = np.frombuffer(f" {inner} ".encode("utf-32-le", "surrogatepass"), "<u4") if inner else np.empty(0, np.uint32)
    return np.where(units < 128, units, 128 + units % 128).astype(np.uint8).tobytes()


def windows(text: bytes) -> list[bytes]:
    """Pieces of WINDOW characters, each STRIDE after the one before; one at least."""
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


def _grams(text: bytes) -> np.ndarray:
    """The GRAM characters from each place as a number."""
    units = np.frombuffer(text, np.uint8).astype(np.uint64)
    m = max(len(units) - GRAM + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | units[k : k + m]
    return out


def _spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, in how many of the texts), sorted."""
    return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts]), return_counts=True)


def _typical(own: tuple, n: int, other: tuple, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that are typical of own texts against other ones, and in how many they are."""
    grams, a = own
    if not len(grams) or not len(other[0]):
        return grams[a >= 3], a[a >= 3]
    place = np.minimum(np.searchsorted(other[0], grams), len(other[0]) - 1)
    b = np.where(other[0][place] == grams, other[1][place], 0)
    share = (a + b) / (n + n_other)
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-9)), 0)
    ratio = 2 * (part(a, n * share) + part(b, n_other * share) + part(n - a, n * (1 - share)) + part(n_other - b, n_other * (1 - share)))
    keep = (a >= 3) & (a / n > TIMES * b / n_other) & (ratio >= RATIO)
    return grams[keep], a[keep]


def _stretches(texts: list[bytes], typical: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The stretches of the texts under the given grams; of overlapping grams those at least half as widespread as the most widespread one."""
    grams, spread = typical
    out = []
    for text in texts if len(grams) else ():
        own = _grams(text)
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        at = np.flatnonzero(grams[place] == own)
        if not len(at):
            continue
        n, run = spread[place[at]], np.cumsum(np.diff(at, prepend=at[0]) >= GRAM)
        most = np.zeros(run[-1] + 1, np.int64)
        np.maximum.at(most, run, n)
        at = at[2 * n >= most[run]]
        out += [text[p[0] : p[-1] + GRAM] for p in np.split(at, np.flatnonzero(np.diff(at) > GRAM) + 1)]
    return out


def trained(stretches: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; of few samples, which it can't be trained on, the most frequent ones themselves."""
    samples = [s.ljust(8) + b"    " for s in stretches]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zstandard.ZstdError:
        kinds = Counter(samples)
        return b"".join(sorted(kinds, key=lambda s: (kinds[s], s)))[-size:]


@dataclass
class Classifier:
    """Dictionaries and the fitted score; holds no compressor, so that it can travel to tasks."""

    toxic: bytes = b""
    ordinary: bytes = b""
    noise: int = 3
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, -20.0])

    def margins(self, pieces: list[bytes]) -> np.ndarray:
        """What the toxic dictionary saves of each window over the ordinary one, in bytes."""
        sizes = np.fromiter(map(len, pieces), np.uint64, len(pieces)) + np.uint64(len(LEAD) + len(TAIL))
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).tobytes()
        buffer = zstandard.BufferWithSegments(LEAD + (TAIL + LEAD).join(pieces) + TAIL, segments)
        long, short = (c.multi_compress_to_buffer(buffer, threads=1) for c in self._compressors())
        return np.fromiter((len(a) - len(b) for a, b in zip(long, short, strict=True)), np.int64, len(pieces))

    def _compressors(self):
        if "_made" not in self.__dict__:
            params = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=GRAM, window_log=17, hash_log=14, chain_log=6, search_log=1, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            made = []
            size = max(len(self.ordinary), len(self.toxic))  # alike, as zstandard sizes its tables by it
            for content in (self.ordinary, self.toxic):
                filled = b"\1" * (size - len(content)) + content + LEAD + TAIL
                d = zstandard.ZstdCompressionDict(filled, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))
            self._made = made
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, texts: Iterable[bytes]) -> np.ndarray:
        """(largest margin, log of the margins above noise, log of the number of windows, 1) of each normalised text."""
        found, held, owner = [], [], []

        def flush():
            if held:
                m, of = self.margins(held), np.array(owner)
                for i in range(of[0], of[-1] + 1):  # a text's windows stand together
                    own = m[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]
                    row = (max(int(own.max()), 0), int(own[own > self.noise].sum()), len(own))
                    if i < len(found):  # it began in an earlier batch
                        row = (max(row[0], found[i][0]), row[1] + found[i][1], row[2] + found[i][2])
                        found.pop()
                    found.append(row)
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            pieces = windows(text)
            for a in range(0, len(pieces), BATCH):
                held += pieces[a : a + BATCH]
                owner += [i] * len(pieces[a : a + BATCH])
                if len(held) >= BATCH:
                    flush()
        flush()
        top, above, n = (np.array(c, np.float64) for c in zip(*found, strict=True)) if found else (np.empty(0),) * 3
        return np.stack([top, np.log1p(above), np.log(n), np.ones(len(n))], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(map(normalised, texts)) @ np.array(self.weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method, the classes weighed alike."""
    w = np.zeros(x.shape[1])
    each = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) * len(y)
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty * len(y), x.T @ (each * (y - p)) - len(y) * penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(toxic: list[str], ordinary: list[str], size: int = 8_192) -> Classifier:
    """A classifier of labelled texts.  Every third text is kept aside for the score; copies of a text count once."""
    model = Classifier()
    sides = [sorted({normalised(t) for t in texts} - {b""}) for texts in (toxic, ordinary)]
    if not all(sides):
        return model
    learn = [[t for i, t in enumerate(s) if i % 3] or s for s in sides]
    aside = [s[::3] for s in sides]
    spreads = [_spread(s) for s in learn]
    kept = [_typical(spreads[i], len(learn[i]), spreads[1 - i], len(learn[1 - i])) for i in (0, 1)]
    if not len(kept[0][0]):  # too few labels to tell: nothing is toxic
        return model
    model.toxic = trained(_stretches(learn[0], kept[0]), size)
    alike = np.isin(spreads[1][0], np.setdiff1d(_grams(model.toxic), kept[0][0]))
    model.ordinary = trained(_stretches(learn[1], kept[1]) + _stretches(learn[1], (spreads[1][0][alike], spreads[1][1][alike])), size)
    pieces = [w for t in aside[1] for w in windows(t)]
    model.noise = int(np.quantile(model.margins(pieces), 0.99))
    x = model.features(aside[0] + aside[1])
    y = np.arange(len(x)) < len(aside[0])
    w = _logistic(x, y)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits, at = np.cumsum(y[order]), np.arange(1, len(z) + 1)
    possible = np.append(z[order][1:] < z[order][:-1], True) & (2 * hits >= at)
    f1 = np.where(possible, 2 * hits / (at + y.sum()), -1)
    best = int(f1.argmax())
    after = z[order][best + 1] if best + 1 < len(z) else z[order][best]
    w[-1] -= (z[order][best] + after) / 2 if possible.any() else z[order][0] + 1
    model.weights = w.tolist()
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 1_000, ordinary_rows: int = 3_000, max_chars: int = 20_000, size: int = 8_192, row_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """A classifier from a bounded sample of the labelled texts: about ``toxic_rows`` and ``ordinary_rows`` of at most ``max_chars`` characters.

    Rows are drawn by a hash of their id, alike at any size.  An id with several labels is
    toxic if one of them says so; null labels and ids say nothing.
    """
    said = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("id")).agg((F.max(F.col(label).cast("int")) == 1).alias("bad"))
    counts = {r.bad: r["count"] for r in said.groupBy("bad").count().collect()}
    u = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "id"), 11) / F.lit(float(1 << 53))
    share = F.when(F.col("bad"), toxic_rows / max(counts.get(True, 0), 1)).otherwise(ordinary_rows / max(counts.get(False, 0), 1))
    drawn = said.where(u < share)  # about toxic_rows + ordinary_rows ids: small enough to send to all
    texts = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= max_chars))
    rows = texts.join(F.broadcast(drawn), "id").select("bad", "t").collect()
    return fitted([r.t for r in rows if r.bad], [r.t for r in rows if not r.bad], size)


def _scored(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column(batch.schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, "toxic_score", "toxic_pred"])

    return run


def classify(docs: DataFrame, model: Classifier, *, text: str = "text") -> DataFrame:
    """``docs`` plus toxic_score double (0 to 1, higher is likelier toxic) and toxic_pred int (1 from 0.5 on).

    Whole texts are scored, every row by its text alone.  Null, empty and letterless texts
    have one empty window and so no margin; without labels of both classes nothing is toxic.
    Input columns named like the outputs are replaced.
    """
    base = without(docs, "toxic_score", "toxic_pred")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_pred", T.IntegerType())]
    return base.mapInArrow(tidy(_scored(shared, text)), extended(base, *fields))


def op13_compression_toxicity(spark, sf_dir):
    """The toxicity of every document, learned from the labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    found = classify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return found.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"))
