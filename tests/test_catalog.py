"""Facts of the catalog's operators on small inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions import columns as C
from heliograph.operators import audit, folders, geo, groups as G, library as L, organize as O, reconcile as R, review
from heliograph.operators.components import connected_components
from heliograph.schemas import Conflict, Settings, ValidationFailed

SCHEMA = "id long, sha256 string, phash long, size_bytes long, width int, height int, status string"
BASE = 0x0F0F0F0F0F0F0F0F


def photo(i, sha, phash, size=100, side=10, status="active"):
    return (i, sha, phash - (1 << 64) if phash is not None and phash >> 63 else phash, size, side, side, status)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def as_groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.kind, r.key, r.keeper_photo_id), {})[r.photo_id] = r.similarity_pct
    return out


def test_components_on_chains_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1)] + [(500, 500 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, **{500 + k: 500 for k in range(40)}}
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long"), one_task_edges=10**6).collect())) == got
    for bound in (0, 10):
        assert connected_components(spark.createDataFrame([], "src long, dst long"), one_task_edges=bound).count() == 0


def test_similar_group_facts(spark):
    near = spark.createDataFrame([photo(1, "a", BASE, 2000, 200), photo(2, "b", BASE ^ 3), photo(3, "c", BASE ^ 0xFFF)], SCHEMA)
    assert as_groups(G.similar_groups(near)) == {("similar", "a", 1): {1: 100, 2: 97}}
    chain = spark.createDataFrame([photo(1, "a", BASE), photo(2, "b", BASE ^ 0xF), photo(3, "c", BASE ^ 0xFF)], SCHEMA)
    assert len(next(iter(as_groups(G.similar_groups(chain)).values()))) == 3
    same = spark.createDataFrame([photo(1, "a", BASE), photo(2, "a", BASE)], SCHEMA)
    assert as_groups(G.similar_groups(same)) == {} and len(as_groups(G.exact_groups(same))) == 1
    seven = spark.createDataFrame([photo(1, "a", BASE), photo(2, "b", BASE ^ 0x7F)], SCHEMA)
    assert as_groups(G.similar_groups(seven, 6)) == {} and len(as_groups(G.similar_groups(seven, 7))) == 1
    with pytest.raises(ValidationFailed):
        G.similar_groups(seven, 8).count()


@pytest.mark.parametrize("seed,threshold", [(1, 0), (2, 3), (3, 6), (4, 7)])
def test_banded_links_equal_brute_force(spark, seed, threshold):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {*base, *(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 9))) & (1 << 64) - 1 for b in base for _ in range(8))}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    got = {(r.src, r.dst) for r in G.hamming_links(spark.createDataFrame([(v,) for v in signed], "phash long"), threshold).collect()}
    assert got == {(a, b) for a in signed for b in signed if a > b and (signed[a] ^ signed[b]).bit_count() <= threshold}


def test_bounded_rebuild_equals_full(spark):
    far = 0x5A5A5A5A5A5A5A5A
    old = [photo(1, "sha-a", BASE), photo(2, "sha-a", BASE), photo(3, "sha-b", BASE ^ 7), photo(4, "sha-c", far), photo(5, "sha-d", far ^ 3), photo(6, "sha-e", 0x1234)]
    new = [photo(7, "sha-f", BASE ^ 31), photo(8, "sha-a", BASE), photo(9, "sha-g", far ^ 15), photo(10, "sha-e", None)]
    before = G.derive_groups(spark.createDataFrame(old, SCHEMA))
    heads = {(r.kind, r.key): r.keeper_photo_id for r in before.collect()}
    ids = {k: i + 1 for i, k in enumerate(sorted(heads))}
    stored = spark.createDataFrame([(ids[k], *k, "pending", v) for k, v in heads.items()], "id long, kind string, key string, status string, keeper_photo_id long")
    members = spark.createDataFrame([(ids[r.kind, r.key], r.photo_id, r.similarity_pct) for r in before.collect()], "group_id long, photo_id long, similarity_pct int")
    photos = spark.createDataFrame(old + new, SCHEMA)
    touched = spark.createDataFrame([(7,), (8,), (9,), (10,)], "id long")
    assert as_groups(G.bounded_rebuild(photos, touched, stored, members)) == as_groups(G.derive_groups(photos))
    assert G.full_rebuild_is_better(30, 100) and not G.full_rebuild_is_better(20, 100) and G.full_rebuild_is_better(0, 100)


def test_quarantine_guard_and_prune(spark):
    photos = spark.createDataFrame([(*photo(i, "s", None), False) for i in (1, 2, 3)], SCHEMA + ", marked_for_deletion boolean")
    members = spark.createDataFrame([(1, i, 100) for i in (1, 2, 3)], "group_id long, photo_id long, similarity_pct int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    with pytest.raises(Conflict):
        audit.quarantine(photos, members, ids(1, 2, 3))
    state = {r.id: r.status for r in audit.quarantine(photos, members, ids(1)).collect()}
    assert state == {1: "quarantined", 2: "active", 3: "active"}
    groups = spark.createDataFrame([(1, 1)], "group_id long, keeper_photo_id long")
    after = audit.quarantine(photos, members, ids(1))
    assert {(r.photo_id, r.keeper_photo_id) for r in G.prune(groups, members, after, ids(1)).collect()} == {(2, 2), (3, 2)}
    assert G.prune(groups, members, audit.quarantine(photos, members, ids(1, 2)), ids(1, 2)).count() == 0
    with pytest.raises(ValidationFailed):
        audit.delete_permanently(photos, photos, ids(1), False)


def test_review_rules_and_queue():
    review.checked_request([1, 2], {1: "remove"})
    for bad in ({1: "remove", 2: "remove"}, {1: "burn"}, {9: "keep"}):
        with pytest.raises(ValidationFailed):
            review.checked_request([1, 2], bad)
    review.checked_request([1, 2], {1: "remove", 2: "remove"}, force=True)
    q = review.PairQueue({7: (1, [2, 3]), 8: (5, [6])}, sizes={1: 10, 2: 20, 6: 5})
    q.decide("keep_b")
    assert q.current() == (7, 2, 3) and q.freed == 10
    q.skip()
    assert q.current() == (8, 5, 6)
    q.decide("keep_a")
    q.decide("keep_both")
    assert q.current() is None and q.freed == 15 and (7, 3, "keep") in q.decisions
    with pytest.raises(ValidationFailed):
        q.decide("keep_a")


def test_scalar_facts(spark):
    place = lambda *v: one(spark, C.format_place(*(F.lit(x) for x in v)).alias("p")).p
    assert place("Boston", "Massachusetts", "US", 0.2) == "Boston, Massachusetts"
    assert place("Gorham", "New Hampshire", "US", 16.7) == "near Gorham, New Hampshire"
    assert place("Conway", "New Hampshire", "US", 5.0) == "Conway, New Hampshire"
    assert place("Kyoto", "Kyoto", "JP", 1.0) == "Kyoto, Kyoto" and place("Singapore", None, "SG", 1.0) == "Singapore, SG"
    assert place("Atlantis", None, None, None) == "Atlantis" and place(None, None, None, None) is None
    at = lambda a, b: one(spark, C.format_coordinates(F.lit(a), F.lit(b)).alias("p")).p
    assert at(44.2697, -71.3034) == "44.26970° N, 71.30340° W" and at(-33.8688, 151.2093) == "33.86880° S, 151.20930° E" and at(0.0, 0.0) == "0.00000° N, 0.00000° E"
    km = lambda *v: one(spark, C.haversine(*map(F.lit, v)).alias("k")).k
    assert km(1.0, 2.0, 1.0, 2.0) == 0 and abs(km(0.0, 0.0, 0.0, 1.0) - 111.2) < 0.1 and abs(km(42.36, -71.06, 51.51, -0.13) - 5263) < 53
    signed = 0xF0000000000000AA - (1 << 64)
    assert [x.value for x in one(spark, C.bands(F.lit(signed)).alias("b")).b][::7] == [0xAA, 0xF0]
    assert [one(spark, C.similarity_pct(F.lit(d)).alias("p")).p for d in (0, 2, 24, 56, 64)] == [100, 97, 62, 12, 0]
    seg = lambda s: one(spark, C.sanitize_segment(F.lit(s)).alias("p")).p
    assert [seg(s) for s in ("PowerShot A/B", None, " ..x ", "...", "\0")] == ["PowerShot A-B", "Unknown camera", "x", "Unknown camera", "Unknown camera"]
    assert one(spark, C.exif_datetime(F.lit("garbage")).alias("p")).p is None
    assert one(spark, C.with_suffix(F.lit("a.b.jpg"), F.lit(1)).alias("p")).p == "a.b_01.jpg"


def test_folder_tree_and_layout(spark):
    paths = ["/lib/top.jpg", "/lib/2024/iceland/a.jpg", "/lib/2024/iceland/b.jpg", "/lib/2024/summer/c.jpg"]
    df = spark.createDataFrame([(p, os.path.dirname(p), "active") for p in paths], "path string, directory string, status string")
    tree = {r.path: r for r in folders.folder_tree(df, spark.createDataFrame([(1, "/lib/")], "id int, path string")).collect()}
    assert (tree["/lib"].photo_count, tree["/lib"].direct_count, tree["/lib"].depth, tree["/lib"].parent) == (4, 1, 0, None)
    assert (tree["/lib/2024"].photo_count, tree["/lib/2024"].direct_count, tree["/lib/2024"].has_children) == (3, 0, True)
    assert (tree["/lib/2024/iceland"].depth, tree["/lib/2024/iceland"].has_children) == (2, False)
    dated = spark.createDataFrame([(f"/lib/Photos/{x}", "active") for x in ("2019/01", "2019/02", "2019/03", "2020/11", "Undated")] + [("/lib/Photos/2019/1", "active")], "directory string, status string")
    assert [tuple(r) for r in folders.library_layout(dated).collect()] == [("/lib/Photos", 5), ("/lib/Photos/2019/1", 1)]
    assert folders.nested_root(["/a/b"], "/a") == "/a/b" and folders.nested_root(["/a/b"], "/a/bc") is None


def plan_of(spark, rows, spec, taken=()):
    schema = "id long, path string, filename string, size_bytes long, captured_at timestamp_ntz, camera_model string, status string, sha256 string, width int, height int"
    import datetime as dt

    at = lambda x: dt.datetime.fromisoformat(x) if x else None
    full = [(i, p, os.path.basename(p), 5, at(t), None, s, sha, 1, 1) for i, p, t, s, sha in [*rows, *taken]]
    photos = spark.createDataFrame(full, schema)
    derived = G.exact_groups(photos.where("status = 'active'"))
    groups = derived.select(F.col("key").alias("group_id"), "kind", "keeper_photo_id").distinct()
    members = derived.select(F.col("key").alias("group_id"), "photo_id")
    own = O.classified(photos, spec, groups, members)
    return {r.id: r.dest for r in O.planned_moves(own, photos, spec).collect()}, O.plan_counters(own).first()


def test_organize_plans(spark):
    t = "2024-07-15T14:30:22"
    spec = O.OrganizeSpec(("/lib/in",), "/lib/out", "date", rename=True)
    got, _ = plan_of(spark, [(1, "/lib/in/a.JPG", t, "active", "x"), (2, "/lib/in/b.jpg", t, "active", "y")], spec)
    assert got == {1: "/lib/out/2024/07/2024-07-15_143022.jpg", 2: "/lib/out/2024/07/2024-07-15_143022_01.jpg"}
    plain = O.OrganizeSpec(("/lib/in",), "/lib/out")
    rows = [(1, "/lib/in/1/a.jpg", None, "active", "p"), (2, "/lib/in/2/a.jpg", None, "active", "q"), (3, "/lib/in/3/a_01.jpg", None, "active", "r")]
    got, _ = plan_of(spark, rows, plain, [(9, "/lib/out/Undated/a.jpg", None, "quarantined", "z")])
    assert got == {1: "/lib/out/Undated/a_01.jpg", 2: "/lib/out/Undated/a_02.jpg", 3: "/lib/out/Undated/a_01_01.jpg"}
    copies = [(1, "/lib/in/a.jpg", t, "active", "s"), (2, "/lib/in/b.jpg", t, "active", "s"), (3, "/lib/in/c.jpg", t, "active", "s")]
    got, c = plan_of(spark, copies, plain)
    assert list(got) == [1] and (c.total, c.duplicates_in_set, c.duplicates_skipped, c.undated) == (3, 2, 2, 0)
    keep = O.OrganizeSpec(tuple(O.top_folders(["/lib/vacation", "/lib/vacation/day1/"])), "/lib/Organized", "keep")
    got, _ = plan_of(spark, [(1, "/lib/vacation/day1/beach.jpg", t, "active", "s")], keep)
    assert keep.folders == ("/lib/vacation",) and got == {1: "/lib/Organized/vacation/day1/beach.jpg"}
    got, c = plan_of(spark, [(1, "/lib/out/2024/07/a.jpg", t, "active", "s")], O.OrganizeSpec(("/lib",), "/lib/out"))
    assert got == {} and c.already_organized == 1
    with pytest.raises(ValidationFailed):
        O.checked_spec(O.OrganizeSpec(("/x",), "/lib/out"), ["/lib"], "/q")


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_equal_one_pass_over_all_names(spark, seed):
    rng = random.Random(seed)
    names = [stem + "".join(f"_{rng.choice(['01', '02', '03', '10', '0001', '1'])}" for _ in range(rng.randint(0, 2))) + end for stem in ("a", ".a", "b.c", "IMG") for end in ("", ".jpg", ".x_01") for _ in range(6)]
    rows = [(i, f"/lib/in/{i % 7}/{i}/{n}", None, "active", str(i)) for i, n in enumerate(names)]
    taken = [(1000 + i, f"/lib/out/Undated/{n}", None, rng.choice(["active", "missing", "quarantined"]), str(1000 + i)) for i, n in enumerate(sorted(set(rng.sample(names, 20))))]
    got, _ = plan_of(spark, rows, O.OrganizeSpec(("/lib/in",), "/lib/out"), taken)
    held, want = {r[1] for r in taken}, {}
    for i, path, *_ in sorted(rows, key=lambda r: r[1]):
        base, n = path.rsplit("/", 1)[1], 0
        dot = base.rfind(".") if base.rfind(".") > 0 else len(base)
        free = f"/lib/out/Undated/{base}"
        while free in held:
            n += 1
            free = f"/lib/out/Undated/{base[:dot]}_{n:02d}{base[dot:]}"
        held.add(free)
        want[i] = free
    assert got == want


def test_numbered_names_of_a_camera_come_from_no_other(spark):
    names = ["/d/IMG_0001.jpg", "/d/IMG_01_02.jpg", "/d/x", "/d/.a_07", "/d/_01.jpg", "/d/a_01.x_02", "/d/a_100", "/d/a_" + "9" * 30]
    got = [r.o for r in spark.createDataFrame([(n,) for n in names], "p string").select(O.origin(F.col("p")).alias("o")).collect()]
    assert [o and (o.name, o.number) for o in got] == [None, ("/d/IMG_01.jpg", 2), None, ("/d/.a", 7), None, ("/d/a.x_02", 1), ("/d/a", 100), None]


def test_one_common_name_is_spread_over_tasks(spark):
    from heliograph.operators.ranks import numbered

    rows = spark.range(20_000).select("id", F.concat(F.lit("/lib/in/"), F.lpad("id", 6, "0")).alias("path"), F.lit("/out/a.jpg").alias("candidate"), F.lit(1).alias("size_bytes"), F.lit("move").alias("class"))
    there = spark.createDataFrame([("/out/a.jpg",), ("/out/a_03.jpg",), ("/out/a_04.jpg",), ("/out/a_10001.jpg",)], "path string")
    got = {r.id: r.dest for r in O.planned_moves(rows, there, O.OrganizeSpec(("/lib/in",), "/out")).collect()}
    numbers = [n for n in range(1, 20_100) if n not in (3, 4, 10_001)]
    assert [got[i] for i in range(20_000)] == [f"/out/a_{numbers[i]:02d}.jpg" for i in range(20_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        dealt = numbered(rows, ["candidate"], ["path"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.6 * 20_000


def test_rescan(spark):
    index = spark.createDataFrame([(1, 1, "/a/x.jpg", 5, 1, "active", "s1"), (2, 1, "/a/y.jpg", 5, 1, "active", "s2"), (3, 1, "/a/z.jpg", 5, 1, "missing", "s3")], "id long, root_id int, path string, size_bytes long, mtime_ns long, status string, sha256 string")
    disk = spark.createDataFrame([("/b/x.jpg", 5, 1, "s1", None), ("/a/z.jpg", 5, 1, "s3", None), ("/a/bad.jpg", None, None, None, "denied")], "path string, size_bytes long, mtime_ns long, sha256 string, error string")
    classes = R.classify(disk, index)
    moves = R.move_pairs(index.join(classes.where("class = 'unseen'").select("id"), "id", "left_semi"), disk.join(classes.where("class = 'added'").select("path"), "path", "left_semi"))
    c = R.counters(classes, moves).first()
    assert (c.files_added, c.files_moved, c.files_missing, c.files_changed, c.error_count) == (0, 1, 1, 1, 1) and R.changed_anything(c)
    assert [r.id for r in R.missing(classes, moves).collect()] == [2]
    assert {r.id: r.path for r in R.apply_moves(index, moves).collect()}[1] == "/b/x.jpg"


def test_nearest_place_equals_brute_force(spark):
    rng = random.Random(8)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), 89.9, -89.9, 0.0]), rng.choice([rng.uniform(-180, 180), 179.99, -179.99, 180.0]))
    places = spark.createDataFrame([(f"c{i}", "r", "X", *spot()) for i in range(150)], "city string, region string, country string, latitude double, longitude double")
    points = spark.createDataFrame([(i, *spot()) for i in range(150)] + [(900, None, 1.0)], "id long, latitude double, longitude double")
    for most in (30.0, 700.0, 4000.0):
        got = {r.id: r.city for r in geo.nearest_place(points, places, most).collect()}
        g = places.select("city", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
        met = points.crossJoin(g).withColumn("km", C.haversine("latitude", "longitude", "a", "b")).where(F.col("km") <= most)
        want = {r.id: r.m.city for r in met.groupBy("id").agg(F.min(F.struct("km", "city")).alias("m")).collect()}
        assert {k: v for k, v in got.items() if v} == want and len(got) == 151


def test_listing_specs(spark):
    rows = [(1, "A7 IV"), (2, "A7 IV"), (3, "NIKON D70"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, c, "active") for i, c in rows], "id long, camera_model string, status string")
    n = lambda *c: L.listed(df, L.ListSpec(cameras=c)).count()
    assert (n(""), n("A7 IV"), n("A7 IV", "NIKON D70"), n("NIKON D70", "")) == (2, 2, 3, 3)
    facets = [tuple(r) for r in L.camera_facets(df).collect()]
    assert facets[-1] == ("", 2) and sum(x[1] for x in facets) == 5
    assert L.expand_types(["JPEG", "png"]) == ["jpg", "jpeg", "png"]
    assert L.active_under(df.withColumn("path", F.lit("/a/b")), []).count() == 0
    with pytest.raises(ValidationFailed):
        Settings(hamming=8)


def test_roots_and_jobs(spark):
    from heliograph.operators import jobs

    roots = spark.createDataFrame([(1, "/lib/a", True), (2, "/lib/b", False)], "id int, path string, enabled boolean")
    assert {r.path for r in jobs.add_root(roots, "/lib/c/").collect()} == {"/lib/a", "/lib/b", "/lib/c"}
    for bad, error in (("/lib", Conflict), ("/lib/a/x", Conflict), ("lib", ValidationFailed)):
        with pytest.raises(error):
            jobs.add_root(roots, bad)
    assert [r.id for r in jobs.roots_of(roots, None).collect()] == [1]
    scans = spark.createDataFrame([(1, "running"), (2, "completed")], "id int, status string")
    assert jobs.is_running(scans) and not jobs.is_running(R.recover_interrupted(scans))
    assert [jobs.valid_destination(x) for x in ("a/b", "a//b", ".a", "a: b", "a /b")] == [True, False, False, False, False]


def test_organize_specs_are_checked_on_resolved_paths(tmp_path):
    root, other, quarantine = tmp_path / "root", tmp_path / "other", tmp_path / "quarantine"
    for p in (root / "a", other, quarantine):
        p.mkdir(parents=True)
    (root / "link").symlink_to(other)
    (root / "file").write_text("x")
    spec = lambda folders=(f"{root}/a/", f"{root}/a"), to=f"{tmp_path}/out", mode="date": O.checked_spec(O.OrganizeSpec(tuple(folders), to, mode), [str(root)], str(quarantine))
    assert spec().folders == (f"{root}/a",) and spec().destination == f"{tmp_path}/out"
    assert spec(to=str(other)).destination == str(other)  # outside the roots is allowed
    for bad in (dict(mode="size"), dict(folders=()), dict(folders=[str(other)]), dict(folders=[f"{root}/link"]), dict(folders=[f"{root}/../other"]), dict(to=f"{quarantine}/x"), dict(to=f"{other}/../quarantine")):
        with pytest.raises(ValidationFailed):
            spec(**bad)
    with pytest.raises(ValidationFailed):
        O.checked_spec(O.OrganizeSpec((str(root),), "/out"), [], str(quarantine))
    assert O.existing_file(f"{root}/a/../file") == f"{root}/file"
    for bad in (f"{root}/none", f"{root}/a"):
        with pytest.raises(ValidationFailed):
            O.existing_file(bad)
    O.ensure_within(f"{root}/a", [str(root)])
    with pytest.raises(ValidationFailed):
        O.ensure_within(f"{root}2/a", [str(root)])


def test_bounded_neighbours_meet_on_several_bytes(spark):
    import random

    rng = random.Random(11)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), n)) for h in hashes[:30] for n in (5, 6, 7)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    p = spark.createDataFrame([(i, h, "active") for i, h in enumerate(signed)], "id long, phash long, status string")
    near = lambda a, b: ((signed[a] ^ signed[b]) & (1 << 64) - 1).bit_count()
    got = {(r.seed_id, r.photo_id, r.distance) for r in G.band_neighbours(p, p.where("id % 3 = 0")).collect()}
    n = range(len(signed))
    assert got == {(a, b, near(a, b)) for a in n if a % 3 == 0 for b in n if a != b and near(a, b) <= 6}
