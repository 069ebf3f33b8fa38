"""Vector codes, Merkle manifests and toxicity against brute force and planted cases, with odd rows and tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

# -- op 11 ----------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """{(id, copy): (code, error)} and the digest, comparing all entries; rows: (id, vector)."""
    kept = sorted(((i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            given = defaultdict(list)
            for c in cut:
                given[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(given[k]) for x in zip(*given[k], strict=True)] if k in given else e for k, e in enumerate(books[p])]
    out = []
    for (i, _), c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return sorted(out, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def odd_vectors(n, dim=32):
    rng = random.Random(11)
    some = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(n)]
    some[3] = some[4] = some[5]  # ties among the first entries
    odd = [None, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [None] + [0.1] * (dim - 1), [0.0] * dim, [-3.7] * dim]
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(some + odd)]
    return [*rows, rows[7], rows[7], (None, some[9], 1)]


@pytest.mark.parametrize("n", [300, 20])
def test_codes_equal_those_of_comparing_all_entries(spark, n):
    from heliograph.llm.vector_codes import compress, digest, with_group_error

    rows = odd_vectors(n)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    coded, books = compress(df)
    got = coded.collect()
    want, sha = brute_codes([r[:2] for r in rows])
    assert sorted(((r.vec_id, r.code, r.code_error) for r in got), key=repr) == want and digest(books) == sha
    sums = defaultdict(int)
    for r in got:
        sums[r.label] += r.code_error
    assert {(r.label, r.label_error) for r in with_group_error(coded, "label").collect()} == set(sums.items())


def test_codes_of_no_rows_odd_lengths_and_huge_components(spark):
    from heliograph.llm.vector_codes import compress

    kind = "vec_id long, embedding array<double>, label int"
    coded, books = compress(spark.createDataFrame([(1, None, 2)], kind))
    assert (coded.count(), books, coded.columns) == (0, [], ["vec_id", "label", "code", "code_error"])
    rows = [(1, [0.5] * 16, 0), (2, [0.25] * 16, 0), (3, [0.5] * 8, 0), (4, [], 0)]  # of another length than the first: no such parts
    assert sorted(r.vec_id for r in compress(spark.createDataFrame(rows, kind))[0].collect()) == [1, 2]
    with pytest.raises(ValueError, match="can't be cut"):
        compress(spark.createDataFrame([(1, [0.5] * 15, 0)], kind))
    with pytest.raises(Exception, match="reaches"):
        compress(spark.createDataFrame([(1, [1e12] * 16, 0)], kind))


def test_exponion_search_is_exact_and_looks_at_few_entries():
    from heliograph.llm.vector_codes import Codebook

    rng = np.random.default_rng(2)
    book = Codebook(np.vstack([rng.integers(-90, 90, (62, 4)), np.zeros((2, 4), np.int64)]))
    x = rng.integers(-120, 120, (3000, 4))
    x[:50] = (book.entries[rng.integers(0, 64, 50)] + book.entries[rng.integers(0, 64, 50)]) // 2  # near the middle between two entries
    d = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    for start in (np.zeros(3000, np.uint8), d.argmin(axis=1).astype(np.uint8), rng.integers(0, 64, 3000).astype(np.uint8)):
        entry, best, steps = book.assign(x, start)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert book.assign(x, d.argmin(axis=1).astype(np.uint8))[2] < 0.5 * d.size


def test_the_code_query_and_its_sql_agree(spark, data, duck):
    from heliograph.llm.vector_codes import SQL, op11_exponion_codes

    got = op11_exponion_codes(spark, data)
    want = duck.sql(SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# -- op 12 ----------------------------------------------------------------------------


def hexed(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hexed("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append([None if k == i else level[k] for k in range(first, min(first + 3, len(level)))])
        i //= 3
    return out


def brute_manifest(rows):
    """Sorted result rows of the query for (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    trees = {s: tree([plain_leaf(r) for r in sorted(g, key=order)]) for s, g in by.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s], key=order)):
            path = siblings(trees[s], i) + siblings(top, k)
            leaf = x = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                x = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for run in path:
                x = hexed("".join(h or x for h in run))
            proof = hexed("".join(h for run in path for h in run if h))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return sorted(out, key=repr)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def odd_documents():
    rng = random.Random(4)
    rows = [(i, f"text {i}\nline " * rng.randint(0, 3), "en" if i % 3 else None, rng.choice(["a", "b", "é", "", "hot"]) if i % 2 else "hot", i if i % 4 else None, "clash") for i in range(400)]
    rows += [(900, None, "en", None, 1, "c"), (901, "", None, None, None, "c"), (None, "no id\n", "en", "a", 2, "c"), (902, "very long\n" * 100_000, "en", "a", 3, "c"), (903, "alone", "x", "single", 4, "c"), rows[5], rows[5], (7, "another\n", "fr", rows[7][3], 1, "c")]
    return rows


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifests_equal_plain_trees(spark, tmp_path, levels, monkeypatch):
    import functools

    from heliograph.llm import merkle

    rows = odd_documents()
    spark.createDataFrame(rows, DOCUMENTS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle, "manifest", functools.partial(merkle.manifest, levels=levels))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_the_manifest_of_nothing_and_of_one_row(spark, tmp_path):
    from heliograph.llm.merkle import manifest, op12_merkle_manifest

    one = [(1, "only\n", "en", "s", 5, "c")]
    for name, rows in (("none", []), ("one", one)):
        spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = op12_merkle_manifest(spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, got.collect())) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]) if rows else got.count() == 0
    r = manifest(spark.createDataFrame(one, DOCUMENTS)).first()
    assert (r["rank"], r.n, r.n_groups, r.proof) == (0, 1, 1, b"") and r.leaf == r.subroot == r.root


def test_merging_fragments_is_associative_and_keeps_few_nodes():
    from heliograph.llm.merkle import Forest

    n, rng = 1000, random.Random(8)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    want = tree([h.hex() for h in leaves])[-1][0]
    for cuts in ([0, n], [0, 1, 500, 501, n], sorted({0, n, *rng.sample(range(n), 30)})):
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            f = Forest(n, 99)
            for i in rng.sample(range(a, b), b - a):  # leaves come in any order
                f.add(0, i, leaves[i])
            assert len(f.open) <= 4 * len(f.widths)
            parts.append(f)
        rng.shuffle(parts)
        while len(parts) > 1:
            a, b = parts.pop(), parts.pop(0)
            for at, d in b.open.items():
                a.add(*at, d)
            parts.insert(rng.randint(0, len(parts)), a)
        assert parts[0].whole and [d.hex() for d in parts[0].open.values()] == [want]


def test_ranks_are_gapless_in_every_group(spark):
    from heliograph.operators.ranks import numbered

    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 11, i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, k int, i int").repartition(6), ["g"], [F.desc("k"), "i"], size="n").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    for rs in by.values():
        assert [(r["rank"], r.n) for r in sorted(rs, key=lambda r: (-r.k, r.i))] == [(k, len(rs)) for k in range(len(rs))]


# -- op 13 ----------------------------------------------------------------------------

INSULTS = ["grubworm", "slimebag", "ratfink"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "the", "on", "ti", "st", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS).upper() if rng.random() < 0.3 else rng.choice(INSULTS) + ",")
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxic_texts_are_told_apart_and_odd_ones_scored(spark):
    from heliograph.llm.toxicity import classify, learn

    rows = labelled(900)
    fit, aside = rows[:600], rows[600:]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in fit] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = learn(docs, labels)
    assert len(model.toxic) and any(w.encode() in model.toxic for w in INSULTS)
    odd = [(1000, None), (1001, ""), (1002, "123 !!! \n"), (1003, prose(random.Random(9), 60_000)), (1004, prose(random.Random(9), 60_000) + " you slimebag, you ratfink and grubworm"), (None, "slimebag ratfink grubworm"), (1005, "平和な文章 \ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"))]
    asked = spark.createDataFrame([(i, t, "clash") for i, t in [(i, t) for i, t, _ in aside] + odd + odd[:1]], "doc_id long, text string, toxic_score string")
    got = classify(asked, model).collect()
    assert len(got) == len(aside) + len(odd) + 1
    pred = {r.doc_id: r.toxic_pred for r in got}
    hits = [pred[i] for i, _, y in aside if y]
    false = [pred[i] for i, _, y in aside if not y]
    assert sum(hits) >= 0.95 * len(hits) and sum(false) <= 0.02 * len(false)
    assert all(0 <= r.toxic_score <= 1 for r in got) and [pred[i] for i in (1000, 1001, 1002, 1005)] == [0] * 4
    assert (pred[1003], pred[1004], pred[None]) == (0, 1, 1)  # the end of a very long text counts too


def test_without_labels_of_both_kinds_nothing_is_toxic(spark):
    from heliograph.llm.toxicity import classify, fitted, learn

    docs = spark.createDataFrame([(1, "slimebag"), (2, None)], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r.toxic_pred for r in classify(docs, model).collect()] == [0, 0]
    assert classify(docs.limit(0), model).count() == 0
    few = fitted(["you slimebag"] * 3 + ["a slimebag too", "slimebag"], ["kind words", "more of them"])  # too few to train a dictionary on
    assert few.scores([None, "slimebag"]).shape == (2,)


def test_windows_cover_whole_texts():
    from heliograph.llm.toxicity import STRIDE, WINDOW, normalised, windows

    text = normalised(prose(random.Random(1), 3000))
    pieces = windows(text)
    assert b"".join([p[:STRIDE] for p in pieces[:-1]] + pieces[-1:]) == text and all(len(p) <= WINDOW for p in pieces)
    assert windows(b"") == [b""] and normalised(None) == b"" and normalised("ÀB-c\n1") == bytes([32, 128 + 0xE0 % 128]) + b"b c "


def test_the_toxicity_query_on_held_out_rows(spark, data):
    from heliograph.llm.toxicity import op13_compression_toxicity

    rows = op13_compression_toxicity(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(rows) == docs.count() and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [r.predicted for r in rows if truth.get(r.doc_id) == 0]
    assert sum(clean) <= 0.05 * len(clean)
