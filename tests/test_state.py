"""State that is kept on disk or in a stream: journals, the band index, caches, appended logs, reviews; and spans, walks, settings."""

import os
import random

import pytest
from pyspark.sql import functions as F


def test_an_interrupted_plan_ends_as_an_unbroken_one(spark, tmp_path):
    from heliograph.operators.journal import Journal, moved_file

    (tmp_path / "in").mkdir()
    rows = []
    for i in range(25):
        (tmp_path / "in" / f"{i:02d}").write_text(str(i))
        rows.append((i, f"{tmp_path}/in/{i:02d}", f"{tmp_path}/out/{i % 3}/{i:02d}", 1))
    (tmp_path / "out" / "0").mkdir(parents=True)
    (tmp_path / "out" / "0" / "03").write_text("in the way")
    moves = spark.createDataFrame(rows, "id long, src string, dest string, size_bytes long")
    photos = spark.createDataFrame([(i, s, "missing" if i == 4 else "active") for i, s, *_ in rows], "id long, path string, status string")
    first = Journal(spark, f"file://{tmp_path}/journal", size=4)
    first.plan(moves)
    assert first.run(photos, moved_file, together=2, stop_after=2) == 2 and first.done() == [0, 2]
    half = f"{tmp_path}/journal/batches/from=4"
    os.makedirs(half)  # a batch that a stop has cut off: some files are moved, the folder isn't complete
    moved_file(*rows[16][1:3])
    again = Journal(spark, f"file://{tmp_path}/journal", size=4)
    assert again.run(photos, moved_file, together=2) == 2 and again.run(photos, moved_file, together=2) == 0
    out = {r.id: r for r in again.outcome().collect()}
    assert len(out) == 25 and sorted(i for i, r in out.items() if r.error) == [3, 4] and "planning" in out[4].error
    state = {r.id: r.path for r in again.applied(photos).collect()}
    assert state == {i: s if i in (3, 4) else d for i, s, d, _ in rows}
    assert all(os.path.exists(p) for p in state.values()) and (tmp_path / "out" / "0" / "03").read_text() == "in the way"
    empty = Journal(spark, f"file://{tmp_path}/none")
    empty.plan(moves.limit(0))
    assert empty.run(photos) == 0 and empty.outcome().count() == 0


def test_the_band_index_equals_a_scan_and_reads_few_partitions(spark, tmp_path):
    from heliograph.sources.band_index import BandIndex

    rng = random.Random(6)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    base = [rng.getrandbits(64) for _ in range(60)]
    hashes = {i: signed(h ^ sum(1 << b for b in rng.sample(range(64), i % 8))) for i, h in enumerate(base * 4)} | {900: None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, phash long")
    index = BandIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(hashes))
    distance = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()

    def check(now):
        for probe in (hashes[3], hashes[77], 0):
            for t in (0, 6, 7):
                want = {(i, distance(h, probe)) for i, h in now.items() if h is not None and distance(h, probe) <= t}
                assert {(r.id, r.distance) for r in index.near(probe, t).collect()} == want

    check(hashes)
    plan = index.near(hashes[3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(index.near(hashes[3]).inputFiles()) >= 1
    read = index.near(hashes[3], 0).select("id").distinct()
    whole = len(index.read().inputFiles())
    assert whole > 60 and "place" in plan and read.count() >= 1
    now = dict(hashes)
    changes = []
    for i in rng.sample(range(240), 40):
        new = None if i % 3 == 0 else signed(rng.getrandbits(64))
        changes.append((i, hashes[i], new))
        now[i] = new
    changes += [(901, None, 0), (900, None, hashes[3])]
    now |= {901: 0, 900: hashes[3]}
    index.merge(spark.createDataFrame(changes, "id long, old_phash long, new_phash long"))
    check(now)
    index.merge(spark.createDataFrame(changes, "id long, old_phash long, new_phash long"))  # again, as after a stop
    check(now)
    index.merge(spark.createDataFrame([(i, h, None) for i, h in now.items() if h is not None], "id long, old_phash long, new_phash long"))
    assert index.near(hashes[3], 7).count() == 0


def test_cached_files_are_whole_and_written_once(spark, tmp_path):
    from heliograph.sources.cache_sink import CacheSink

    spark.dataSource.register(CacheSink)
    put = lambda rows: spark.createDataFrame(rows, "key string, content binary").repartition(3).write.format("content_cache").option("folder", str(tmp_path)).option("suffix", ".webp").mode("append").save()
    put([("abcd", b"one"), ("abcd", b"one"), ("xyz1", b"two")])
    files = {os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names}
    assert files == {"ab/abcd.webp", "xy/xyz1.webp"} and (tmp_path / "ab/abcd.webp").read_bytes() == b"one"
    with pytest.raises(Exception, match="no file can have the key"):
        put([("good", b"three"), ("../evil", b"x")])
    left = {n for _, _, names in os.walk(tmp_path) for n in names}
    assert not [n for n in left if n.startswith(".")] and left <= {"abcd.webp", "xyz1.webp", "good.webp"}


def test_appending_a_stream_twice_adds_nothing(spark, tmp_path):
    from heliograph.streaming.append import append_once

    schema = "id long, op string, performed_at timestamp"
    rows = [(i, "delete", f"2024-01-01 00:{i:02d}:00") for i in range(6)]
    put = lambda name, part: spark.createDataFrame(part, "id long, op string, performed_at string").withColumn("performed_at", F.to_timestamp("performed_at")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    go = lambda: append_once(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    read = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/log/batch=*").collect())
    put("a", rows[:4])
    go()
    assert read() == [0, 1, 2, 3]
    put("b", rows[2:])  # two rows are sent again
    go()
    assert read() == [0, 1, 2, 3, 4, 5]
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # a stop after the batch was written, before it was committed
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    go()
    assert read() == [0, 1, 2, 3, 4, 5]


def test_reviews_in_a_stream_equal_the_fold_on_the_driver(spark, tmp_path):
    from heliograph.operators.review import PairQueue
    from heliograph.streaming.review import STEPS, decisions, queue_json

    rng = random.Random(12)
    rows, want = [], {}
    for who in ("ann", "bo"):
        items = {g: (g * 100, [g * 100 + k for k in range(1, rng.randint(2, 5))]) for g in rng.sample(range(1, 40), 6)}
        sizes = {p: p % 7 + 1 for k, left in items.values() for p in (k, *left)}
        queue, steps = PairQueue(dict(items), sizes), [("start", queue_json(items, sizes))]
        while queue.current():
            step = rng.choice(["skip", "keep_a", "keep_b", "keep_both", "remove_both"])
            steps.append((step, None))
            queue.skip() if step == "skip" else queue.decide(step)
        steps.append(("keep_a", None))  # nothing is left
        rows += [(who, i, s, q) for i, (s, q) in enumerate(steps)]
        want[who] = (queue.decisions, queue.freed)
    put = lambda name, part: spark.createDataFrame(part, STEPS).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    (tmp_path / "in").mkdir()
    stream = decisions(spark.readStream.schema(STEPS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    cut = [r for r in rows if r[1] < 4]
    for name, part in (("a", rng.sample(cut, len(cut))), ("b", [r for r in rows if r[1] >= 3])):  # step 3 is sent twice
        put(name, part)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    for who, (made, freed) in want.items():
        own = sorted((r for r in got if r.reviewer == who and r.error is None), key=lambda r: r.seq)
        by_step = lambda ds: [sorted(ds[i : i + 2]) for i in range(0, len(ds), 2)]
        assert by_step([(r.group_id, r.photo_id, r.decision) for r in own]) == by_step(made) and own[-1].freed == freed
        assert [r.error for r in got if r.reviewer == who and r.error] == ["nothing is left to review"]


def test_skipping_rotates_within_a_group_first():
    from heliograph.operators.review import PairQueue

    q = PairQueue({1: (10, [11, 12]), 2: (20, [21])})
    q.skip()
    assert q.current() == (1, 10, 12)
    q.decide("keep_a")
    q.skip()
    assert q.current() == (2, 20, 21)


def test_one_root_is_walked_by_many_tasks(spark, tmp_path):
    from heliograph.sources.walk import FolderWalk, _Reader, walk

    for i in range(12):
        for j in range(6):
            p = tmp_path / f"d{i}" / f"e{j}"
            p.mkdir(parents=True)
            for k in range(3):
                (p / f"{k}.jpg").write_bytes(b"x" * k)
        (tmp_path / f"d{i}" / "own.png").write_bytes(b"y")
    (tmp_path / "top.gif").write_bytes(b"z")
    reader = _Reader([str(tmp_path), f"{tmp_path}/nowhere"], 5)
    parts = reader.partitions()
    rows = [sorted(reader.read(p)) for p in parts]
    assert len(parts) == 5 and max(map(len, rows)) < 2 * sum(map(len, rows)) / 5
    want = sorted([*walk(str(tmp_path)), *walk(f"{tmp_path}/nowhere")], key=repr)
    assert sorted((r for part in rows for r in part), key=repr) == want and len(want) == 12 * 19 + 1 + 1
    spark.dataSource.register(FolderWalk)
    assert spark.read.format("folder_walk").option("roots", str(tmp_path)).option("partitions", 4).load().count() == 12 * 19 + 1


def test_spans_below_refused_ones_go(spark):
    from heliograph.operators.spans import kept_spans, redacted

    rng = random.Random(3)
    rows = [(i, None if i == 0 or rng.random() < 0.05 else rng.randint(max(0, i - 3), i - 1), rng.choice(["server", "client", "internal", None]), rng.choice(["GET", "OPTIONS", None])) for i in range(400)]
    rows += [(1000, 999, "client", "GET"), (1001, 1000, "internal", None)]  # a parent of another process
    good = {}
    for i, up, kind, method in rows:
        good[i] = not (kind == "server" and method == "OPTIONS") and not (kind == "client" and up is None) and good.get(up, True)
    df = spark.createDataFrame(rows, "span_id long, parent_id long, kind string, method string")
    assert {r.span_id for r in kept_spans(df).collect()} == {i for i, g in good.items() if g} and good[1001]
    with pytest.raises(RuntimeError, match="ring"):
        kept_spans(spark.createDataFrame([(1, 2, "internal", None), (2, 1, "internal", None)], df.schema), 6)
    named = spark.createDataFrame([({"http.url": "http://h/a?q=/home/x", "url.query": "q=1", "n": "7", "file": "/home/x", "home": "~x"}, "/a")], "attributes map<string,string>, path string")
    assert redacted(named).first().attributes == {"http.url": "/a", "url.query": "", "n": "7"}


def test_backfill_writes_places_and_leaves_far_photos_open(spark):
    from heliograph.operators import geo, library as L

    kind = "id long, status string, latitude double, longitude double, city string, region string, country string, place_distance_km float"
    photos = spark.createDataFrame([(1, "active", None, None, None, None, None, None), (2, "active", 50.0, 8.0, None, None, None, None), (3, "active", -40.0, -120.0, None, "r", None, 3.0), (4, "active", None, None, None, None, None, None), (5, "missing", None, None, None, None, None, None), (6, "active", 1.0, 1.0, "c", "r", "X", 0.5)], kind)
    places = spark.createDataFrame([("Mainz", "RP", "DE", 50.0, 8.27), ("Null", "I", "XX", 0.0, 0.0)], "city string, region string, country string, latitude double, longitude double")
    found = spark.createDataFrame([(1, 0.1, 0.1), (4, None, 3.0)], "id long, latitude double, longitude double")
    new = geo.apply_backfill(photos, geo.backfilled(photos, found, places, 0, 10))
    got = {r.id: (r.latitude, r.city, r.region, r.place_distance_km is not None) for r in new.collect()}
    assert got == {1: (0.1, "Null", "I", True), 2: (50.0, "Mainz", "RP", True), 3: (-40.0, None, None, False), 4: (None, None, None, False), 5: (None, None, None, False), 6: (1.0, "c", "r", True)}
    assert sorted(r.id for r in L.keyset_page(new, 0, 10).collect()) == [3, 4]


def test_settings_from_the_environment():
    from heliograph.schemas import Settings, ValidationFailed

    assert Settings.from_env({"HELIOGRAPH_HAMMING": "3", "HELIOGRAPH_PLACE_MAX_KM": "12.5", "OTHER": "x"}) == Settings(hamming=3, place_max_km=12.5)
    for bad in ({"HELIOGRAPH_HAMMING": "many"}, {"HELIOGRAPH_HAMMING": "9"}):
        with pytest.raises(ValidationFailed):
            Settings.from_env(bad)


def test_the_work_list_sorts_by_a_collation(spark):
    from heliograph.operators import library as L

    paths = ["/z", "/É", "/e", "/E", "/f", "/a"]
    photos = spark.createDataFrame([(i, p, "active", True) for i, p in enumerate(paths)], "id long, path string, status string, marked_for_deletion boolean")
    none = spark.createDataFrame([], "photo_id long, decision string")
    assert [r.path for r in L.marked_worklist(photos, none).collect()] == sorted(paths)
    assert [r.path for r in L.marked_worklist(photos, none, "UNICODE").collect()] == ["/a", "/e", "/E", "/É", "/f", "/z"]
