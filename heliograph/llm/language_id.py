"""Language identification by interpolated Kneser-Ney character models.

One model of order n is learned per language.  A text is lower-cased, everything but
letters and their marks becomes a single space, and every character is predicted from
the n-1 before it.  The language with the lowest cross-entropy per character wins.

Models live in sorted hash arrays: for each order, the sorted 64-bit hashes of all
n-grams seen in any language, and beside them one fully interpolated log probability
per language; likewise the back-off weights of all contexts.  A character mostly costs
one binary search for all languages together.

The models are fitted on a bounded sample: about ``sample_rows`` labelled rows of each
language, whole texts of at most ``max_chars`` characters, at most ``sample_chars`` in
all.  A quarter of the sample is kept aside to calibrate the score's temperature and
the cross-entropy above which a text is rejected; that bound is wider for short texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import extended, read, tidy, without
from heliograph.llm.wordscan import chunks, mixed

#: Stands before the start of every text.
START = 1
NONE = "und"
#: The probability floor: characters that no sample has shown share one in this many.
UNSEEN = 100_000
#: Excess entropies are taken in units that grow as texts shorten: 1 + SHORT / sqrt(characters) nats.
SHORT = 20
#: At most so many units are added to the bound of the clean texts where other languages lie further off.
ROOM = 0.6


def _characters() -> np.ndarray:
    """For every code point: 2 letter, 1 mark, 0 other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            out[c] = 2 if kind == "L" else 1
    return out


def _sequences(texts: list[str], kinds: np.ndarray, order: int):
    """(units, scored, owner, letters) of the texts in a row: units to predict are those with ``scored``."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 2 for t in low], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    kind = kinds[np.minimum(raw, 0x10FFFF)]
    letters = np.bincount(owner[kind == 2], minlength=len(texts))
    units = np.where(kind > 0, raw, 32)
    keep = np.ones(len(units), bool)
    keep[1:] = (units[1:] != 32) | (units[:-1] != 32) | (owner[1:] != owner[:-1])
    units, owner = units[keep], owner[keep]
    counts = np.bincount(owner, minlength=len(texts))
    pad = order - 1
    out = np.full(len(units) + pad * len(texts), START, np.uint64)
    at = np.arange(len(units)) + pad * (owner + 1)
    out[at] = units
    scored = np.zeros(len(out), bool)
    scored[at] = True
    return out, np.flatnonzero(scored), owner, letters, counts


_TIMES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(16)], np.uint64)


def _grams(units: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k units that end at each place."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h += (units[at - j] + np.uint64(1)) * _TIMES[j]
    return mixed(h)


def _units(counts: np.ndarray) -> np.ndarray:
    """The unit of excess entropy of texts with so many characters: short texts scatter more."""
    return 1 + SHORT / np.sqrt(np.maximum(counts, 1))


def _find(keys: np.ndarray, wanted: np.ndarray):
    """(place, whether it is there) in a sorted array."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Models:
    """The models of all languages in shared sorted arrays."""

    def __init__(self, samples: dict[str, list[str]], order: int = 4):
        self.kinds = _characters()
        self.order, self.langs = order, sorted(samples)
        self.temperature, self.mean, self.most = 8.0, 0.0, np.inf  # most: the largest excess that is kept
        fit = {lang: [t for i, t in enumerate(texts) if i % 4 or len(texts) < 4] for lang, texts in samples.items()}
        if self.langs:
            self._fit(fit)
            self._calibrate({lang: [t for i, t in enumerate(texts) if i % 4 == 0] for lang, texts in samples.items()})

    def _fit(self, samples: dict[str, list[str]]) -> None:
        """Counts by order and language, then probabilities from the lowest order up."""
        counted: list[list] = [[] for _ in range(self.order + 1)]
        for lang in self.langs:
            units, at, *_ = _sequences(samples[lang], self.kinds, self.order)
            higher = None
            for k in range(self.order, 0, -1):
                own, first, n = np.unique(_grams(units, at, k), return_index=True, return_counts=True)
                if higher is not None:  # how many different characters stand before it
                    n = np.unique(higher, return_counts=True)[1]
                place = at[first]
                higher = _grams(units, place, k - 1) if k > 1 else None
                context = _grams(units, place - 1, k - 1)
                counted[k].append((own, context, higher, n.astype(np.float64)))
        width = len(self.langs)
        self.keys, self.logs, self.contexts, self.weights = ([None] * (self.order + 1) for _ in range(4))
        below = None
        for k in range(1, self.order + 1):
            parts = counted[k]
            every, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
            contexts = np.unique(np.concatenate([p[1] for p in parts]))
            of = np.searchsorted(contexts, np.concatenate([p[1] for p in parts])[first])
            p, gamma = np.zeros((len(every), width)), np.ones((len(contexts), width))
            for i, (own, context, _, n) in enumerate(parts):
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                c = np.searchsorted(contexts, context)
                total = np.bincount(c, weights=n, minlength=len(contexts))
                kinds = np.bincount(c, minlength=len(contexts))
                seen = total > 0
                gamma[seen, i] = d * kinds[seen] / total[seen]
                p[np.searchsorted(every, own), i] = np.maximum(n - d, 0) / total[c]
            if k == 1:
                p += gamma[of] / UNSEEN
            else:
                p += gamma[of] * below[np.searchsorted(self.keys[k - 1], np.concatenate([x[2] for x in parts])[first])]
            self.keys[k], self.contexts[k] = every, contexts
            self.logs[k], self.weights[k] = np.log(p).astype(np.float32), np.log(gamma).astype(np.float32)
            below = p

    def entropies(self, texts: list[str]):
        """(cross-entropy per character of each text under each language, letters, characters)."""
        units, at, owner, letters, counts = _sequences(texts, self.kinds, self.order)
        width = len(self.langs)
        total = np.zeros((len(texts), width))
        spent = np.zeros((len(at), width), np.float32) if self.langs else None
        left = np.arange(len(at))
        for k in range(self.order, 0, -1):
            if not self.langs or not len(left):
                break
            place, there = _find(self.keys[k], _grams(units, at[left], k))
            found = left[there]
            value = spent[found] + self.logs[k][place[there]]
            for i in range(width):
                total[:, i] += np.bincount(owner[found], weights=value[:, i], minlength=len(texts))
            left = left[~there]
            place, there = _find(self.contexts[k], _grams(units, at[left] - 1, k - 1))
            spent[left[there]] += self.weights[k][place[there]]
        if self.langs and len(left):
            for i in range(width):
                total[:, i] += np.bincount(owner[left], weights=spent[left, i] - np.log(UNSEEN), minlength=len(texts))
        return -total / np.maximum(counts, 1)[:, None], letters, counts

    def _calibrate(self, aside: dict[str, list[str]]) -> None:
        """Temperature: best likelihood of the true language; rejection: a bound on the excess over the mean entropy.

        The bound is a high quantile of the texts kept aside, widened for few of them.  Where
        other languages' models first reach these texts only further off, it lies there, at
        most ROOM over what is usual, so that rare clean texts a sample has not shown stay.
        """
        texts = [(t, i) for i, lang in enumerate(self.langs) for t in aside[lang] if t]
        if not texts:
            return
        ce, letters, counts = self.entropies([t for t, _ in texts])
        real, truth = letters > 0, np.array([i for _, i in texts])
        if not real.any():
            return
        ce, truth = ce[real], truth[real]

        def loss(t: float) -> float:
            z = -ce * t
            z -= z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

        self.temperature = min((2.0**e for e in range(0, 7)), key=loss)
        best, units = ce.min(axis=1), _units(counts[real])
        self.mean = float(np.average(best, weights=1 / units**2))
        excess = (best - self.mean) / units
        widened = 1 + 4 / np.sqrt(len(excess))
        clean, usual = np.quantile(excess, 0.995) * widened, np.quantile(excess, 0.98)
        other = np.inf
        if len(self.langs) > 1:  # each text as one of a language not learned: by the other languages' models only
            foreign = ce.copy()
            foreign[np.arange(len(ce)), truth] = np.inf
            other = np.quantile((foreign.min(axis=1) - self.mean) / units, 0.05)
        self.most = float(max(clean, min(other, usual + ROOM)))

    def predict(self, texts: list[str]):
        """(language, score, rejected) lists; ties go to the first language by name."""
        langs, scores, rejected = [], [], []
        step = max(1 << 14, (1 << 21) // max(1, len(self.langs)))
        for a, b in chunks([len(t) for t in texts], step):
            ce, letters, counts = self.entropies(texts[a:b])
            if not self.langs:
                langs += [NONE] * (b - a)
                scores += [0.0] * (b - a)
                rejected += (letters == 0).tolist()
                continue
            best = ce.argmin(axis=1)
            low = ce[np.arange(b - a), best]
            z = np.exp((low[:, None] - ce) * self.temperature)
            bound = self.mean + self.most * _units(counts)
            none = letters == 0
            langs += [NONE if n else self.langs[i] for n, i in zip(none, best, strict=True)]
            scores += np.where(none, 0.0, 1 / z.sum(axis=1)).tolist()
            rejected += (none | (low > bound)).tolist()
        return langs, scores, rejected


def learn(docs: DataFrame, *, order: int = 4, sample_rows: int = 400, max_chars: int = 20_000, sample_chars: int = 1_000_000, max_languages: int = 200, row_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Models:
    """Models from the rows of ``docs`` with a language.

    Rows are drawn by a hash of their id, alike at any size; the driver receives about
    ``sample_rows`` rows of each of the ``max_languages`` most frequent languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= max_chars))
    counts = labelled.groupBy(F.col(lang).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(max_languages).collect()
    if not counts:
        return Models({}, order)
    share = F.create_map(*(F.lit(x) for row in counts for x in (row[0], sample_rows / row[1])))
    draw = F.xxhash64(F.lit("language sample"), row_id)
    u = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    rows = labelled.where(u < share[F.col(lang).cast("string")]).select(draw.alias("u"), F.col(lang).cast("string").alias("l"), text).collect()
    samples: dict[str, list[str]] = {row[0]: [] for row in counts}
    used = dict.fromkeys(samples, 0)
    for _, l, t in sorted(map(tuple, rows)):
        if used[l] < sample_chars:
            samples[l].append(t)
            used[l] += len(t)
    return Models({l: ts for l, ts in samples.items() if ts}, order)


def _predicted(models, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            langs, scores, rejected = models.value.predict(texts)
            own = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return run


def identify(docs: DataFrame, models: Models, *, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred string, lang_score double (0 to 1) and lang_rejected boolean.

    A null text or one without a letter is ``und`` with score 0 and is rejected; so is,
    with its nearest language named, a text whose cross-entropy is above what the
    calibration allows.  Without any model every text is ``und`` and only those without
    a letter are rejected.  Input columns named like the outputs are replaced.
    """
    base = without(docs, "lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    return base.mapInArrow(tidy(_predicted(shared, text)), extended(base, *fields))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_kneser_ney(spark, sf_dir):
    """The language of every document, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
