"""Every operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): nulls, empty, white space, repeats, copies, near copies, one very long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    near = texts[0].split() if len(texts[0].split()) > 30 else prose(rng, 60).split()
    texts += [" ".join(near), " ".join([*near[:-1], "changed"]), None, "", "  \n\t ", "Ünïcode ÉÈ 漢字 test’s 😀", prose(rng, 30_000), "<|endoftext|> it's"]
    texts += [texts[1]] * 5
    out = list(enumerate(texts))
    return [*out, out[3], out[3], (None, "an orphan text without an id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "extra") for i, t in rows], "doc_id long, text string, shard string, n_words int, fp string").repartition(3).cache()


def empty(docs):
    return docs.limit(0)


# -- op 1 -----------------------------------------------------------------------------


def test_quotes_link_reorder_and_disappear(spark):
    from heliograph.llm.quotes import link_quotes

    rows = [
        (1, 0, "a", "Hello there dear friends.\nHow are you all doing today?"),
        (1, 1, "b", "On Monday, a wrote:\n> Hello there dear friends.\n> How are you all\n> doing today?\n\nI am fine, thank you very much."),
        (1, 2, "c", "> > Hello there dear friends.\n> I am FINE, thank you very much.\nGlad to hear that indeed."),
        (1, 3, "d", "no quote"),
        (1, 4, "e", ">   how ARE you all doing today?\nwell"),
        (2, 0, "f", "> Glad to hear that indeed.\nforwarded"),
        (2, 1, "g", "> something never said before\nhm"),
        (2, 2, None, None), (None, 3, "x", "> Hello there dear friends.\ny"), (3, None, "z", ""), (4, 0, "q", "same"), (4, 0, "q", "same"),
        (5, 0, "r", "> this was only said later on\nearly bird"), (7, 0, "s", "this was only said later on"), (8, 0, "t", "> EARLY bird\nlast"),
        (3, 1, "k", "> stands in later turns and in seven\nasks"), (3, 5, "k", "stands in later turns and in seven"), (7, 1, "k", "stands in later turns and in seven"),
        (3, 7, "k", "> said in the seventh only once\nsaid in the seventh only once"), (7, 2, "k", "said in the seventh only once"),
        (11, 0, "c", "> the second of the chain\nthe first of the chain"), (12, 0, "c", "> the third of the chain\nthe second of the chain"), (13, 0, "c", "> the fourth of the chain\nthe third of the chain"), (14, 0, "c", "the fourth of the chain"),
        (5, 1, "u", "> one ring to rule\nwords of the fifth"), (6, 0, "v", "> words of the fifth\none ring to rule"), (9, 0, "w", ">>> print(1)\n1"), (9, 1, "w", ("word " * 30_000) + "\n> " + "long " * 30_000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, reply_depth int")
    out = link_quotes(df).orderBy("thread_conv", "thread_turn", "reply_depth", "turn").collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): (r.thread_conv, r.thread_turn, r.reply_depth, r.parent_conv, r.parent_turn, r.n_quotes, r.text) for r in out}
    assert got[1, 1] == (1, 0, 1, 1, 0, 1, "I am fine, thank you very much.")
    assert got[1, 2] == (1, 0, 2, 1, 1, 2, "Glad to hear that indeed.")
    assert got[1, 4] == (1, 0, 1, 1, 0, 1, "well")
    assert got[2, 0] == (1, 0, 3, 1, 2, 1, "forwarded")
    assert got[2, 1] == (2, 1, 0, None, None, 1, "> something never said before\nhm")  # no message's words: kept
    assert got[5, 0] == (7, 0, 1, 7, 0, 1, "early bird")  # said in a later conversation only
    assert got[6, 0][3:5] == (5, 1) and got[5, 1][3:5] == (None, None)  # a ring loses the link of its earliest message
    assert got[3, 1][3:5] == (7, 1) and got[3, 7][3:5] == (7, 2)  # the asker's own conversation has it only later
    assert [got[c, 0][:3] for c in (11, 12, 13, 14)] == [(14, 0, 3), (14, 0, 2), (14, 0, 1), (14, 0, 0)]  # forward links in a chain
    assert got[9, 0][6] == ">>> print(1)\n1"
    bare = link_quotes(df, keep_unlinked=False).where("conv_id = 2 and turn = 1 or conv_id = 9 and turn = 0").orderBy("conv_id").collect()
    assert [r.text for r in bare] == ["hm", "1"]
    assert got[2, 2] == (2, 2, 0, None, None, 0, "")
    assert got[None, 3][2:] == (0, None, None, 1, "> Hello there dear friends.\ny")
    import duckdb

    from heliograph.llm.quotes import SQL

    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(SQL)
    at = [want.columns.index(c) for c in ("conv_id", "turn", "role", "text", "thread_conv", "thread_turn", "reply_depth", "parent_conv", "parent_turn", "n_quotes")]
    mine = [(r.conv_id, r.turn, r.role, r.text, r.thread_conv, r.thread_turn, r.reply_depth, r.parent_conv, r.parent_turn, r.n_quotes) for r in out]
    assert sorted(mine, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert link_quotes(df.limit(0)).count() == 0
    long_chain = [(9, i, "u", (f"> the message number {i - 1} says so\n" if i else "") + f"the message number {i} says so") for i in range(40)]
    chain = link_quotes(spark.createDataFrame(long_chain, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.reply_depth) for r in chain) == [(i, i) for i in range(40)]


# -- op 2 -----------------------------------------------------------------------------


def test_sharding_is_balanced_gapless_and_keeps_groups(spark, docs, rows):
    from heliograph.llm.sharding import shard_by_size

    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    out = shard_by_size(small, 3, size, F.col("text"), F.col("doc_id")).withColumn("size", size).collect()
    assert len(out) == len(rows) - 1 and "extra" in {r.fp for r in out}
    load, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in out)
    assert shard_by_size(empty(docs), 3, size, F.col("text"), F.col("doc_id")).count() == 0


def test_sharding_splits_a_group_that_no_shard_can_hold(spark):
    from heliograph.llm.sharding import shard_by_size

    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("g"))
    load = Counter(r.shard for r in shard_by_size(df, 8, F.lit(10), F.col("g"), F.col("id"), ranges_per_shard=16).collect())
    assert len(load) == 8 and max(load.values()) < 1.3 * min(load.values())


def test_sharding_splits_rows_alike_in_group_and_id_and_sets_heavy_ones_apart(spark):
    from heliograph.llm.sharding import shard_by_size

    same = spark.range(3000).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("g"), F.lit(10).alias("n"))
    rest = spark.range(3000).select("id", F.col("id").cast("string").alias("g"), F.when(F.col("id") < 3, 9000).otherwise(10).alias("n"))
    out = shard_by_size(same.unionByName(rest), 8, F.col("n"), F.col("g"), F.col("id"), ranges_per_shard=16).collect()
    load, slots, ranges = Counter(), defaultdict(list), Counter()
    for r in out:
        load[r.shard] += r.n
        slots[r.shard].append(r.slot)
        ranges[r.range_id] += r.n - (9000 if r.n == 9000 else 0)
    assert len(out) == 6000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(ranges.values()) <= 2 * sum(load.values()) / 128 and max(load.values()) < 1.2 * min(load.values())


def test_the_sharding_query_keeps_its_law(spark, tmp_path, rows):
    from heliograph.llm.sharding import op2_sampled_splitters

    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_sampled_splitters(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and {r.shard for r in out} <= set(range(8))
    slots, of_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r["size"]].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    light = sorted(load.values())[:-1]  # one text of some 250 kB outweighs all else
    assert max(light) - min(light) <= sorted(r["size"] for r in out)[-2]


# -- op 3 -----------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TR))


def test_decontamination_against_brute_force(spark, docs, rows):
    from heliograph.llm.decontaminate import decontaminate, scan

    texts = [t for _, t in rows if t and len(t) < 5000]
    bench = [(1, " ".join(texts[5].split()[:14])), (2, texts[6].upper()), (3, "one two"), (4, None), (5, "--"), (6, "test’s"), (6, "test’s"), (10, " ".join(texts[5].split()[:11]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    grams = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(str(i))

    def expected(t):
        w, hit, items = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        return len(w), len(hit), sorted(items)

    for most in (64 << 20, 600):
        out = scan(docs, b, block_bytes=most).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.n_words, sum(r.hit_ranges[1::2]) - sum(r.hit_ranges[::2]), sorted(r.hit_items)) == expected(r.text)
    clean = [r for r in rows if not expected(r[1])[1]]
    kept = decontaminate(docs, b)
    assert kept.count() == len(clean) and kept.columns == docs.columns and {r.n_words for r in kept.collect()} == {7}
    assert decontaminate(docs.withColumnRenamed("shard", "hit_items"), b, remove="spans").where("hit_items = 'x'").count() == len(rows)
    cut = decontaminate(docs, b, remove="spans")
    assert cut.count() == len(rows) and scan(cut, b).where("size(hit_ranges) > 0").count() == 0
    assert scan(docs, b.limit(0)).where("size(hit_ranges) > 0").count() == 0
    assert scan(empty(docs), b).count() == 0


# -- op 4 -----------------------------------------------------------------------------


def test_nearest_neighbours_recall_ties_and_unfit_vectors(spark):
    from heliograph.llm.ann import nearest

    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 24))
    m[10] = m[300]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(600, None), (601, [0.0] * 24), (602, [math.nan] + [1.0] * 23), (603, [1.0, 2.0]), (604, [1.0] * 23 + [None]), (None, [1.0] * 24), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        want = sorted((float(d[i]), i) for i in range(600) if i != q)[:5]
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert got[q] == sorted(got[q]) and all(abs(s - d[i]) < 1e-12 for s, i in got[q])
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.9 * 150
    assert got[300][0] == (0.0, 10)
    blocks = nearest(df, df.where("vec_id % 20 = 0"), k=5, block_bytes=30_000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found))
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    # repeated rows are candidates each, the query's own id never
    twice = nearest(df.union(df.where("vec_id in (10, 11)")), df.where("vec_id = 300"), k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in twice[:2]] == [(10, 0.0), (10, 0.0)]


def test_every_query_has_k_neighbours_and_huge_components_are_measured(spark):
    from heliograph.llm.ann import nearest

    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m[:12])] + [(100 + i, [float(x) * 1e200 for x in v]) for i, v in enumerate(m[12:15])]
    rows += [(200, [1.7e308] * 8), (201, [-1.7e308] * 8), (202, [1e-200] * 8), (203, [2e-200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in nearest(df, df, k=18).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q, v in rows:
        d = sorted((math.dist(v, w) if max(map(abs, v + w)) < 1e308 else math.hypot(*(a - b for a, b in zip(v, w))), i) for i, w in rows if i != q)
        assert [i for _, i in got[q]] == [i for _, i in d] or math.inf in (s for s, _ in d)
        assert len(got[q]) == 18 and all(s == t or abs(s - t) <= 1e-12 * t for (s, _), (t, _) in zip(got[q], d))
    assert len(nearest(df.where("vec_id < 4"), df.where("vec_id < 4"), k=10).collect()) == 12
    wide = df.select("vec_id", "embedding", F.lit(1).alias("score"), F.lit(2).alias("rank"))
    assert nearest(wide, wide, k=2).columns == ["query_id", "rank", "vec_id", "score"]


def test_the_nearest_query_finds_nine_in_ten(spark, data):
    from heliograph.llm.ann import op4_cross_polytope

    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r.embedding]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = defaultdict(set)
    for r in op4_cross_polytope(spark, data).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        want = set(ids[np.lexsort((ids, d))][:11].tolist()) - {q}
        assert len(got[q]) == 10
        hits, total = hits + len(want & got[q]), total + 10
    assert hits >= 0.9 * total


# -- op 5 -----------------------------------------------------------------------------


def test_packing_holds_limits_and_loses_no_token(spark, docs, rows):
    from heliograph.llm.packing import Limits, pack_documents, pack_items
    from heliograph.llm.pretok import library

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = library(open(path).read())
    limits = Limits(tokens=256, segments=5, loss=256)
    out = pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, limits=limits).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if i is not None}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for spans, total in [*((v, len(want[k])) for k, v in pieces.items()), *((v, None) for v in seqs.values())]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == total if total is not None else at <= 256
    assert max(map(len, seqs.values())) <= 5
    assert pack_documents(docs, path).count() >= len(rows)
    assert pack_documents(empty(docs), path).count() == 0
    rng = random.Random(2)
    items = [(n := rng.randint(1, 100), rng.randint(0, n)) for _ in range(300)]
    bins = pack_items(items, Limits(tokens=128, segments=4, loss=70 + 30))
    assert sorted(i for b in bins for i in b) == list(range(300))
    for b in bins:
        assert sum(items[i][0] for i in b) <= 128 and len(b) <= 4 and sum(items[i][1] for i in b) <= 100
    with pytest.raises(ValueError):
        pack_items([(200, 1)], Limits(tokens=128))


def test_examples_are_packed_whole_under_three_limits(spark):
    from heliograph.llm.packing import Limits, pack_examples

    rng = random.Random(8)
    rows = [(i, n := rng.randint(1, 100), rng.randint(0, n), 3) for i in range(500)] + [(500, None, None, 3), (501, 200, 1, 3), (502, 10, 90, 3), (503, 5, None, 3), (504, 0, 0, 3)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "id long, n_tokens int, n_loss int, segment int").repartition(2)
    limits = Limits(tokens=128, segments=4, loss=80)
    out = pack_examples(df, limits=limits, pool_size=50).collect()
    assert Counter((r.id, r.n_tokens, r.n_loss) for r in out) == Counter(r[:3] for r in rows)
    seqs = defaultdict(list)
    for r in out:
        fits = r.n_tokens and r.n_tokens <= 128 and (r.n_loss or 0) <= 80
        assert (r.sequence_id is not None) == bool(fits) and (r.segment is None) == (r.sequence_id is None)
        if fits:
            seqs[r.sequence_id].append(r)
    for own in seqs.values():
        assert sorted(r.segment for r in own) == list(range(len(own)))
        assert sum(r.n_tokens for r in own) <= 128 and len(own) <= 4 and sum(r.n_loss or 0 for r in own) <= 80
    used = sum(r.n_tokens for own in seqs.values() for r in own)
    assert len(seqs) <= 1.25 * max(used / 128, sum(map(len, seqs.values())) / 4, sum(r.n_loss or 0 for own in seqs.values() for r in own) / 80)
    assert pack_examples(df.limit(0)).count() == 0


def test_packing_through_the_query(spark, tmp_path):
    from heliograph.llm.packing import op5_vector_packing, pack_documents
    from heliograph.llm.pretok import library

    texts = [None, "", "x " * 3000, "same", "same", *(prose(random.Random(i), 40) for i in range(30))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = library(open(path).read())
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen = Counter()
    for r in op5_vector_packing(spark, str(tmp_path)).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id]) and 0 <= r.offset <= 1024 - r.length
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in want.items()}
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame([(1, "a")], "start long, text string"), path, keys=("start",))


# -- op 6 -----------------------------------------------------------------------------


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in ids:
        for b in ids:
            if b < a and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components_against_brute_force(spark, docs, rows):
    from heliograph.llm.simhash import hex_of, near_duplicates

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TR))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))

    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    out = near_duplicates(docs, shingle=3).select("doc_id", hex_of(F.col("fp")).alias("fp"), "component_id").collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.fp, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert near_duplicates(empty(docs), shingle=3).count() == 0


def test_the_simhash_and_token_queries_against_brute_force(spark, tmp_path, rows):
    from heliograph.llm.pretok import library
    from heliograph.llm.simhash import op6_byte_position_simhash
    from heliograph.llm.token_counts import op10_pretoken_counts

    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TR))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))

    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    parts = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = Counter(map(tuple, op6_byte_position_simhash(spark, str(tmp_path)).where("doc_id is not null").collect()))
    assert got == Counter((i, f"{prints[i]:016x}", parts[i]) for i, _ in rows if i is not None)
    tok = library(open(public_tokenizers.path("word_bpe_49k.json")).read())
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert Counter(map(tuple, op10_pretoken_counts(spark, str(tmp_path)).collect())) == Counter((i, len((t or "").encode()), count(t), count(t) > 2048) for i, t in rows)


def test_simhash_links_are_all_pairs_within_two_bits(spark):
    from heliograph.llm.simhash import links

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {*base, *(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in base for _ in range(4)), *(v ^ (7 << rng.randrange(60)) for v in base)}
    crowd = rng.getrandbits(40)
    values |= {rng.getrandbits(24) << 20 & (1 << 64) - 1 ^ crowd << 24 & ~(0xFFFFFF << 20) for _ in range(300)}  # agree on five bytes or so
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(v,) for v in signed], "fp long").cache()
    for bits in (0, 1, 2):
        want = {(a, b) for a in signed for b in signed if a > b and (signed[a] ^ signed[b]).bit_count() <= bits}
        for long in (256, 2):
            assert {(r.src, r.dst) for r in links(df, bits, long).collect()} == want
    with pytest.raises(ValueError):
        links(df, 3)


def test_simhash_count_filter_rejects_pairs_below_the_minimum(spark):
    from heliograph.llm.simhash import _lists, tallied

    # bytes shared with zero: 7, 6, 5 (three bits apart in three bytes), 5 (one list), 4 (no list)
    values = [0, 1, 1 | 1 << 8, 1 | 1 << 8 | 1 << 16, 3 << 40 | 1 << 48 | 1 << 56, 1 | 1 << 8 | 1 << 16 | 1 << 24]
    got = {(r.src, r.dst): r.shared for r in tallied(_lists(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert got[1, 0] == 21 and got[values[2], 0] == 6
    assert (values[3], 0) not in got and (values[4], 0) not in got and (values[5], 0) not in got
    lists = _lists(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    met = Counter()
    for p, v in {(r.places, r.bytes) for r in lists}:
        own = {r.fp for r in lists if (r.places, r.bytes) == (p, v)}
        met.update((a, b) for a in own for b in own if a > b)
    assert met[values[3], 0] == 1 and met[values[4], 0] == 1 and (values[5], 0) not in met  # the filter, not the lists, rejects these


def test_near_copies_are_verified_on_shingles(spark, docs, rows):
    from heliograph.llm.near_dedup import drop_near_copies, near_copies

    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(30)]
    texts = list(base)
    for t in base:
        for n in (1, 2, 12):
            w = t.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))

    def shingles(t):
        w = (t or "").translate(TR).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = dict(enumerate(map(shingles, texts)))
    want = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in found} == want
    kept = drop_near_copies(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and len({r.doc_id for r in kept}) == len(kept) - 1
    texts_kept = [r.text for r in kept if r.doc_id is not None]
    assert len({t for t in texts_kept if t}) == len([t for t in texts_kept if t and t.strip()])
    assert drop_near_copies(empty(docs)).count() == 0


def groups_and_brute_force(spark, texts):
    from heliograph.llm.near_dedup import near_copies

    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.id: r.component_id for r in found}, want


def test_near_copies_with_a_block_replaced_or_appended(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(120):
        w = prose(rng, rng.randint(60, 400)).split()
        at, n = rng.randrange(len(w) * 8 // 10), len(w) * 9 // 100
        texts += [" ".join(w), " ".join([*w[:at], *prose(rng, n).split(), *w[at + n :]]), " ".join([*w, *prose(rng, len(w) * 23 // 100).split()])]
    got, want = groups_and_brute_force(spark, texts)
    assert got == want and sum(a != b for a, b in want.items()) > 150


def test_near_copies_of_a_family_of_revisions(spark):
    rng = random.Random(22)
    texts, w = [], prose(rng, 400).split()
    for _ in range(200):
        texts.append(" ".join(w))
        at = rng.sample(range(400), 8)
        for i in at:
            w[i] = prose(rng, 1)
    rng.shuffle(texts)
    got, want = groups_and_brute_force(spark, texts)
    assert got == want and len(set(want.values())) < 20


def test_near_copies_in_crowded_lists(spark, monkeypatch):
    """Lists of more than two members count as crowded, so that pivots, rounds and split lists do nearly all of the work."""
    from heliograph.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CROWD", 2)
    monkeypatch.setattr(near_dedup, "PART", 3)
    rng = random.Random(24)
    passage, texts, w = prose(rng, 60), [], prose(rng, 150).split()
    for _ in range(60):
        texts.append(" ".join(w))
        for i in rng.sample(range(150), 4):
            w[i] = prose(rng, 1)
    texts += [f"{passage} {prose(rng, rng.randint(1, 40))}" for _ in range(40)]  # share a passage, some near copies of one another
    rng.shuffle(texts)
    got, want = groups_and_brute_force(spark, texts)
    assert got == want and 10 < len(set(want.values())) < 90


def test_texts_that_share_one_frequent_bigram_are_no_copies(spark):
    rng = random.Random(23)
    texts = ["la " * 500 + " ".join(f"{rng.choice(WORDS)}{rng.random()}" for _ in range(400)) for _ in range(12)]
    got, want = groups_and_brute_force(spark, texts)
    assert got == want == {i: i for i in range(12)}


# -- op 7 -----------------------------------------------------------------------------


def test_line_templates_drop_recurring_lines_only(spark):
    from heliograph.llm.line_dedup import drop_templates

    rng = random.Random(6)
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(3)]
        if i < 30:
            lines.insert(1, f"User {i * 7} logged in from 10.0.0.{i} at noon")
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a b c " * 5000)]
    rows += [(200 + i, "the very same text in many copies\nand nothing more than that") for i in range(30)]
    rows += [rows[2], (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_lines int")
    out = drop_templates(df, min_docs=20).collect()
    assert len(out) == len(rows)
    for r in out:
        logged = r.doc_id is None or r.doc_id < 30
        assert r.n_dropped == (1 if logged and r.doc_id != 0 else 0), r
        assert (r.text is None) == (r.doc_id == 100)
        if logged and r.doc_id != 0:
            assert "logged in" not in r.text and r.text.count("\n") == 2
    by = {r.doc_id: r for r in out}
    assert by[0].text == rows[0][1] and by[101].text == "" and by[101].n_lines == 1 and by[102].n_lines == 3 and by[100].n_lines == 0
    assert drop_templates(df.limit(0)).count() == 0


def test_texts_that_share_their_first_hash_lose_their_own_lines_only(spark, monkeypatch):
    from heliograph.llm import line_dedup

    monkeypatch.setattr(line_dedup, "known", lambda text: [F.lit(7).cast("long").alias("h"), F.hash(F.lit("text"), text).alias("g")])
    rows = [(i, f"own words of text number {'abcdefghijklmnopqrstuvwxyz'[i]} here\nthe very same old footer line") for i in range(26)] + [(99, "a\nb\nc d e f g")]
    got = {r.doc_id: r.text for r in line_dedup.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=20).collect()}
    assert got[0] == rows[0][1] and all("footer" not in got[i] for i in range(1, 26)) and got[99] == rows[26][1]


@pytest.mark.parametrize("n", [300, 30_000])
def test_line_templates_have_word_fields_at_every_size(spark, n):
    from heliograph.llm.line_dedup import drop_templates

    rng = random.Random(7)
    name = lambda: "name" + "".join(chr(97 + int(c)) for c in str(rng.randrange(500)))
    rows = [(i, f"{i} {i}\nThe quick notice was sent by {name()} to our office in {name()} for review") for i in range(n)]
    rows += [(n + i, rows[1][1].split("\n")[1] + f"\ncopy {i % 2}") for i in range(40)]
    out = drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped"), F.sum(F.when(F.col("doc_id") == 0, F.col("n_dropped")))).first()
    assert tuple(out) == (n + 39, 0)


def test_long_lines_recur_from_two_texts_on_and_copies_stay_copies(spark):
    from heliograph.llm.line_dedup import SQL, drop_templates

    rng = random.Random(14)
    own = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long, short, number = own(60), own(50), "on 12 June " + own(60)
    rows = [(i, f"{own(9)}\n{long}\n{short}\n{number.replace('12', str(i))}\nLes.") for i in (3, 4, 5)]
    rows += [(i, rows[0][1]) for i in (1, 2)]  # copies of the first, of a smaller id
    rows += [(9, "  ".join(long.split()) + "\n" + own(4)), (10, None), (11, ""), (None, long + "\nx y z"), (12, "w " * 60_000)]
    rows += [(20 + i, f"{own(7)}\nLes.\nyes no") for i in range(25)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, __h int").repartition(3)
    by = {r.doc_id: (r.n_dropped, r.text) for r in drop_templates(df).collect()}
    assert by[1] == by[2] == by[3] == (0, rows[0][1])
    for i in (4, 5):  # same words: dropped; 50 words, or another number: not
        assert by[i][0] == 1 and long not in by[i][1] and short in by[i][1] and f"on {i} June" in by[i][1]
    assert by[9][0] == 1 and by[None] == (1, "x y z") and by[12][0] == 0 and all(by[20 + i][0] == 0 for i in range(25))
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r[2] for r in con.sql(SQL).fetchall()} == {i: n for i, (n, _) in by.items()}


# -- op 8 -----------------------------------------------------------------------------


def test_language_models(spark, data):
    from heliograph.llm.language_id import Models, held_out, identify, learn, op8_kneser_ney

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = op8_kneser_ney(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in out if r.held_out]
    assert len(out) == docs.count() and 0.2 < len(test) / len(out) < 0.5
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang == r.lang_pred for r in test) / len(test) >= 0.95
    assert all(0 <= r.score <= 1 for r in out) and not any(r.rejected for r in out)
    models = learn(docs)
    p = models.entropies(["der und die", "der und die"])[0]
    assert (p[0] == p[1]).all()
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %$ 34\n", "x"), (4, "Привет как дела друг мой " * 5, "x"), (5, "THE AND OF WAS " * 3, "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in identify(odd, models).collect()}
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 and got[i].lang_rejected for i in (1, 2, 3))
    assert got[4].lang_rejected and not got[5].lang_rejected and got[5].lang_pred == "en"
    nothing = learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert [x[0] for x in nothing.predict(["abc"])] == ["und", 0.0, False]
    assert identify(odd.limit(0), models).count() == 0
    assert held_out(F.col("x")) is not None and isinstance(models, Models)


@pytest.mark.parametrize("left_out", ["de", "fr", "es", "en"])
def test_texts_of_an_unlearned_language_are_rejected(spark, data, left_out):
    from heliograph.llm.language_id import held_out, learn

    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) >= 200")
    models = learn(docs.where(~held_out(F.col("doc_id")) & (F.col("lang") != left_out)))
    test = docs.where(held_out(F.col("doc_id"))).select("lang", "text").collect()
    gone = models.predict([r.text for r in test])[2]
    assert sum(g for g, r in zip(gone, test) if r.lang == left_out) >= 0.9 * sum(r.lang == left_out for r in test)
    assert not any(g for g, r in zip(gone, test) if r.lang != left_out)


def test_language_probabilities_sum_to_one():
    from heliograph.llm.language_id import UNSEEN, Models, _find, _grams

    m = Models({"x": ["abab abba baab ab a b abc"] * 3, "y": ["zz zy"] * 3}, order=3)

    def log_p(units):
        units, at, spent = np.array(units, np.uint64), np.array([len(units) - 1]), 0.0
        for k in (3, 2, 1):
            place, there = _find(m.keys[k], _grams(units, at, k))
            if there[0]:
                return spent + float(m.logs[k][place[0], 0])
            place, there = _find(m.contexts[k], _grams(units, at - 1, k - 1))
            spent += float(m.weights[k][place[0], 0]) if there[0] else 0.0
        return spent - math.log(UNSEEN)

    seen = [ord(c) for c in "abcyz "]
    for context in ("ab", "bb", "qq", "zz"):
        before = [ord(c) for c in context]
        total = sum(math.exp(log_p([*before, c])) for c in seen) + (UNSEEN - len(seen)) * math.exp(log_p([*before, 0x4E00]))
        assert abs(total - 1) < 1e-4, (context, total)
    assert m.entropies(["abab abba"])[0][0, 0] < m.entropies(["aaaa bbbb"])[0][0, 0]


# -- op 9 -----------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    from heliograph.llm.warc import op9_gzip_normaliser, records_of

    html = ["<p>one</p>", "<p>two</p>\r\n\r\nWARC/1.1\r\n", None, "", "x" * 300_000, "Ünï 漢字 😀", "<p>one</p>", "<p>one</p>", None]
    rows = [(i, f"http://h/{i}" if i % 2 else ("http://h/a b\nc" if i else None), t) for i, t in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op9_gzip_normaliser(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        data = (t or "").encode()
        own = first.setdefault(data, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own == i else ("revisit", own))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op9_gzip_normaliser(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        list(records_of(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def test_an_archive_cut_at_a_records_edge_is_an_error():
    import io

    from heliograph.llm.warc import inflated, record, records_of

    raw = [record("response", str(i), "http://h", random.Random(i).randbytes(3000)) for i in range(3)]
    box = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [box.compress(r) + box.flush(zlib.Z_FULL_FLUSH) for r in raw]
    whole = b"".join([*parts, box.flush()])
    assert list(records_of(inflated(io.BytesIO(whole)))) == raw
    with pytest.raises(ValueError):
        list(records_of(inflated(io.BytesIO(b"".join(parts[:2])))))
    members = [(c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(r) + c.flush() for r in raw]
    assert list(records_of(inflated(io.BytesIO(b"".join(members))))) == raw


def test_archives_are_addressed_as_on_a_cluster(tmp_path):
    from heliograph.llm.warc import Store, known

    assert [known(u) for u in ("s3a://b/x", "S3N://b/x", "hdfs://n/x", "file:/tmp/x", "file:///tmp/x", "/tmp/x")] == ["s3://b/x", "s3://b/x", "hdfs://n/x", "file:///tmp/x", "file:///tmp/x", "file:///tmp/x"]

    def broken():
        yield b"half"
        raise RuntimeError("lost")

    store = Store(str(tmp_path))
    with pytest.raises(RuntimeError, match="lost"):
        store.write("a.warc", broken())
    assert list(tmp_path.iterdir()) == []


def test_revisits_of_repeated_pages_and_pages_without_an_id(spark):
    from heliograph.llm.warc import with_revisits

    rows = [(3, b"a"), (1, b"a"), (1, b"a"), (2, b"b"), (None, b"a"), (None, b"c"), (None, b"c"), (5, None), (6, b""), (7, b"")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, payload binary, refers_to string").repartition(2)
    got = Counter((r.page_id, r.payload and bytes(r.payload), r.refers_to) for r in with_revisits(df).collect())
    want = [(3, b"a", 1), (1, b"a", None), (1, b"a", None), (2, b"b", None), (None, b"a", 1), (None, b"c", None), (None, b"c", None), (5, None, None), (6, b"", None), (7, b"", 6)]
    assert got == Counter(want)
    assert {r.refers_to for r in with_revisits(df, min_bytes=2).collect()} == {None} and with_revisits(df.limit(0)).count() == 0


def test_normaliser_makes_one_member_a_record_with_an_index(spark, tmp_path):
    import gzip
    import json

    from heliograph.llm.warc import normalise, parsed, read_records, record, write_monolithic

    df = spark.createDataFrame([(str(i), f"http://h/{i}", f"body {i}".encode() * 50, None) for i in range(20)], "id string, url string, payload binary, refers string").coalesce(1)
    names = write_monolithic(df, f"file://{tmp_path}/mono").collect()
    whole = gzip.decompress((tmp_path / "mono" / names[0].name).read_bytes())
    assert whole == b"".join(record("response", str(i), f"http://h/{i}", f"body {i}".encode() * 50) for i in range(20))
    index = normalise(spark.createDataFrame([(names[0].name,)], "name string"), f"file://{tmp_path}/mono", f"file://{tmp_path}/members")
    index = spark.createDataFrame(index.collect(), index.schema)
    data = (tmp_path / "members" / names[0].name).read_bytes()
    side = [json.loads(x) for x in (tmp_path / "members" / f"{names[0].name}.idx").read_text().splitlines()]
    assert [x.asDict() for x in sorted(index.collect(), key=lambda x: x.offset)] == side and sum(x["length"] for x in side) == len(data)
    for x in side:
        assert parsed(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31))["record"] == x["record"]
    assert read_records(index, f"file://{tmp_path}/members").count() == 20


# -- op 10 ----------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, docs, rows):
    from heliograph.llm.pretok import library
    from heliograph.llm.token_counts import token_counts

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok = library(open(path).read())
        want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        for most in (6_000_000, 40, 0):
            got = token_counts(docs.withColumn("n_tokens", F.lit("clash")), path, max_broadcast=most)
            assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
        assert token_counts(empty(docs), path).count() == 0


def morse(n, a, b):
    return "".join(a if i.bit_count() % 2 else b for i in range(n))


def test_tables_of_the_text_alone_are_counted_too(spark):
    from heliograph.llm.token_counts import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([("one two three",), (None,), ("one two three",)], "text string")
    for most in (1_000_000, 0):
        assert sorted(r.n_tokens for r in token_counts(df, path, max_broadcast=most).collect()) == [0, 3, 3]
        assert token_counts(df, path, max_broadcast=most).columns == ["n_tokens"]


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements collide under every polynomial modulo 2**64."""
    from heliograph.llm.packing import pack_documents
    from heliograph.llm.pretok import library
    from heliograph.llm.token_counts import token_counts

    rows = [(0, morse(1024, "a", "b")), (1, morse(1024, "b", "a")), (2, "plain"), (3, morse(4096, "a", "b") + " " + morse(4096, "b", "a"))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        tok = library(open(path).read())
        want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows}
        for parts in (1, 2):
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            for most in (1_000_000, 0):
                assert {r.doc_id: r.n_tokens for r in token_counts(docs, path, max_broadcast=most).collect()} == {i: len(x) for i, x in want.items()}
        got = defaultdict(list)
        for r in sorted(pack_documents(docs, path).collect(), key=lambda r: r.start):
            got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert got == {i: [*x, 0] for i, x in want.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pretokens_that_share_a_hash_are_told_apart(name, rows):
    """Four bits of the first hash only: nearly all pre-tokens share one, and the second hash decides."""
    import pyarrow as pa

    from heliograph.llm import token_counts as tc
    from heliograph.llm.pretok import PieceCache, Splitter, rules_from

    class Weak(Splitter):
        def hashes(self, *units):
            h, g = super().hashes(*units)
            return h & np.uint64(15), g

    class Held:
        value = rules_from(public_tokenizers.path(name))

    texts = [t or "" for _, t in rows]
    cache = PieceCache(Weak(Held.value))
    got = []
    for ids, ends in cache.encode(texts):
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    want = cache.splitter.whole(texts)
    assert got == want
    strong, tc.Splitter = tc.Splitter, Weak
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        new = pa.Table.from_batches(tc._distinct(Held)(iter([batch, batch]))).to_pandas().drop_duplicates()
        n = np.array([len(x) for x in cache.splitter.whole(new["piece"].tolist())], np.int32)
        keys, checks = new["h"].to_numpy().view(np.uint64), new["g"].to_numpy().view(np.uint64)
        order = np.lexsort((checks, keys))
        table = type("Table", (), {"value": (keys[order], checks[order], n[order])})
        out = pa.Table.from_batches(tc._summed(Held, table, "text", "n")(iter([batch])))
        assert out["n"].to_pylist() == list(map(len, want))
    finally:
        tc.Splitter = strong


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pretokens_agree_with_the_library_on_odd_texts(name):
    from heliograph.llm.pretok import PieceCache, Splitter, rules_from

    rng = random.Random(9)
    signs = "  \n\t'''sstrevemlld abcXYZ019²½!?.,-_é ñßΣσİıǅ ́漢字ア😀  　\x00<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "it's <|endoftext|> we'll", "I'M don'T they're  he'd\n'sx \n's  's", "<|startoftext|> 12'345", "x" * 3_000_000]
    cache = PieceCache(Splitter(rules_from(public_tokenizers.path(name))))
    got = []
    for ids, ends in cache.encode(texts):
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got[:-1] == cache.splitter.whole(texts[:-1]) and len(got) == len(texts)


# -- the pipeline ---------------------------------------------------------------------


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("1234 %%").alias("text"), "lang", "source", "n_chars").limit(1)
    rows = docs.unionByName(extra).withColumn("n_chars", F.col("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, data)
        assert out.columns == docs.columns, name
        assert out.count() <= rows.count()
        if name == "language_id":
            assert out.count() == docs.count()
    packed = corpus_pipeline.run(spark, data)
    assert packed.count() > 0 and "ids" in packed.columns


@pytest.fixture(scope="module")
def odd_folder(spark, data, tmp_path_factory):
    """The tables, ``documents`` with nulls in every column, empty, wordless, repeated and very long texts."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    long = " ".join(r.text for r in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").collect())
    odd = [(10**6, None, "en", "s", None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " \n\t ", None, "s", 4), (10**6 + 3, "12 %%", "en", "s", 5)]
    odd += [(10**6 + 4, long, None, None, None), (None, first.text, None, None, None), (None, None, None, None, None), tuple(first), (10**6 + 5, "", "en", "s", 0)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_on_odd_rows_and_none(spark, odd_folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), odd_folder).count() == 0, name
        out = stage(spark, docs, odd_folder)
        if name == "packing":
            assert out.count() >= docs.count()
            continue
        assert out.columns == docs.columns, name
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":  # a text without a letter goes
            assert not {10**6 + k for k in (0, 1, 2, 3, 5)} & set(ids) and 10**6 + 4 in ids and ids[None] == 1
        if name == "line_dedup":
            assert ids == Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "near_dedup":  # texts without a word are copies; rows without an id stay
            assert {k for k in range(6) if 10**6 + k in ids} == {0, 3, 4} and ids[None] == 2 and max(n for i, n in ids.items() if i is not None) == 1
        if name == "decontaminate":
            assert {10**6 + k for k in (0, 1, 2, 3, 5)} <= set(ids)
    assert corpus_pipeline.run(spark, odd_folder).count() > 0


def test_the_language_query_on_odd_rows(spark, odd_folder):
    from heliograph.llm.registry import QUERIES

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").collect()
    got = QUERIES["op8_kneser_ney"](spark, odd_folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs)
    learned = {r.lang for r in docs} - {None}
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.lang_pred in learned | {"und"} for i, r in by_id.items())
    assert {i for i, r in by_id.items() if r.lang_pred == "und"} == {10**6 + k for k in (0, 1, 2, 3, 5)}
    kept_aside = [(r.lang, by_id[r.doc_id].lang_pred) for r in docs if r.lang and r.doc_id is not None and r.doc_id < 10**6 and by_id[r.doc_id].held_out]
    assert sum(a == b for a, b in kept_aside) >= 0.95 * len(kept_aside)


def test_queries_and_sql_agree(spark, data, duck):
    from heliograph.llm import registry

    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, data)
        want = duck.sql(sql)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_near_copies_come_through_the_index_of_fingerprint_bytes(spark, monkeypatch):
    """What the index links and the sets confirm is joined even where the prefixes find nothing; what they don't confirm is not."""
    from heliograph.llm import near_dedup

    rng = random.Random(31)
    base = [prose(rng, 2000) for _ in range(6)]
    texts = base + [" ".join([*t.split()[:-1], "other"]) for t in base] + ["la " * 500 + prose(rng, 400) for _ in range(2)]
    nothing = lambda threshold, last: lambda batches: iter(())
    monkeypatch.setattr(near_dedup, "_prefixes", nothing)
    got, want = groups_and_brute_force(spark, texts)
    assert sum(got[i + 6] == i for i in range(6)) >= 4 and all(got[i] in (i, want[i]) for i in got)
    assert want[12] == got[12] == 12 and want[13] == got[13] == 13


def test_sets_of_shingles_are_shuffled_once_to_have_one_a_class(spark, monkeypatch):
    from heliograph.storage import Scratch

    plans, write = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(self, df, name))[1])
    rng = random.Random(11)
    base = [prose(rng, 40) for _ in range(20)]
    texts = [*base, *base, *(f"{t} {t}" for t in base[:5]), *(f" {t}  " for t in base)]  # copies, some with other repeats or spaces
    got, want = groups_and_brute_force(spark, texts)
    assert got == want and sum(got[i] < i for i in got) >= 40
    assert plans["sets"].count("Exchange") == 1 and "Join" not in plans["sets"]
