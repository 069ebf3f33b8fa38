"""Queries of the library, its statistics, folders, groups, scans, plans and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions.columns import dirname
from heliograph.operators import audit, folders, geo, groups as G, jobs, library as L, organize as O, reconcile as R, review, stats
from heliograph.plans import proxies as P
from heliograph.plans.registry import query
from heliograph.schemas import INFO_COLUMNS, LIST_COLUMNS

PH, GR = P.PHOTOS, P.GROUPS
DUPES = "SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_photos, coalesce(sum((n - 1) * size), 0)::BIGINT AS reclaimable_bytes FROM (SELECT count(*) AS n, max(size_bytes) AS size FROM photos WHERE status = 'active' GROUP BY sha256 HAVING count(*) > 1)"
ACTIVE = "SELECT count(*) AS photos, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes FROM photos WHERE status = 'active'"
TALLY = "SELECT count(*) AS deleted_count, coalesce(sum(size_bytes), 0)::BIGINT AS space_saved FROM operations WHERE op = 'delete'"
COLS = ", ".join(c for c in LIST_COLUMNS if c not in ("captured_at", "camera_make")) + ", strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at"


def shown(df):
    """A page with its time as text."""
    return df.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))


# -- statistics --------------------------------------------------------------------


@query("a04_duplicate_preview", f"WITH {PH} {DUPES}")
def _(spark, d):
    return stats.duplicate_preview(P.photos(spark, d))


@query("a01_active_count", f"WITH {PH} {ACTIVE}")
def _(spark, d):
    return stats.active_count(P.photos(spark, d))


@query("a03_folder_count", f"WITH {PH} SELECT count(DISTINCT directory) AS folders FROM photos WHERE status = 'active'")
def _(spark, d):
    return stats.folder_count(P.photos(spark, d))


@query("a06_delete_tally", f"WITH {P.OPERATIONS} {TALLY}")
def _(spark, d):
    return stats.delete_tally(P.operations(spark, d))


@query(
    "a07_stats_bundle",
    f"WITH {PH}, {P.OPERATIONS}, {P.SCANS} SELECT a.*, f.folders, m.missing, x.*, strftime(s.last, '%Y-%m-%d %H:%M:%S') AS last_scan_at, t.* FROM ({ACTIVE}) a, "
    f"(SELECT count(DISTINCT directory) AS folders FROM photos WHERE status = 'active') f, (SELECT count(*) AS missing FROM photos WHERE status = 'missing') m, ({DUPES}) x, "
    f"(SELECT max(finished_at) AS last FROM scans WHERE status = 'completed') s, ({TALLY}) t",
)
def _(spark, d):
    out = stats.stats_bundle(P.photos(spark, d), P.scans(spark, d), P.operations(spark, d))
    return out.withColumn("last_scan_at", F.date_format("last_scan_at", "yyyy-MM-dd HH:mm:ss"))


@query("a08_directory_counts", f"WITH {PH} SELECT directory, count(*) AS n FROM photos WHERE status = 'active' GROUP BY directory")
def _(spark, d):
    return stats.directory_counts(P.photos(spark, d))


@query("a10_type_facets", f"WITH {PH} SELECT CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' ELSE ext END AS type, count(*) AS n FROM photos WHERE status <> 'quarantined' GROUP BY 1")
def _(spark, d):
    return L.type_facets(P.photos(spark, d))


@query("a11_camera_facets", f"WITH {PH} SELECT coalesce(camera_model, '') AS camera, count(*) AS n FROM photos WHERE status <> 'quarantined' GROUP BY 1")
def _(spark, d):
    return L.camera_facets(P.photos(spark, d))


REMOVE = "SELECT count(*) AS marked_remove_count, coalesce(sum(size_bytes), 0)::BIGINT AS marked_remove_bytes FROM decisions JOIN photos ON id = photo_id WHERE decision = 'remove'"


@query(
    "a12_duplicate_summary",
    f"WITH {GR}, {P.DECISIONS} SELECT * FROM (SELECT count(*) AS groups, count_if(kind = 'exact')::BIGINT AS exact, count_if(kind = 'similar')::BIGINT AS similar, count_if(status = 'pending')::BIGINT AS pending, "
    f"count_if(status = 'reviewed')::BIGINT AS reviewed, count_if(status = 'dismissed')::BIGINT AS dismissed FROM groups), (SELECT count(*) AS member_rows FROM members), ({REMOVE})",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return stats.duplicate_summary(g, m, P.decisions(m), P.photos(spark, d))


@query(
    "a13_folder_tree",
    f"WITH {PH}, {P.ROOTS}, up AS (SELECT directory, '/' || array_to_string(string_split(directory, '/')[2:i + 1], '/') AS path, length(r.path) AS root_len FROM (SELECT * FROM photos WHERE status <> 'quarantined') p "
    "JOIN roots r ON directory = r.path OR starts_with(directory, r.path || '/'), range(1, 10) t(i) WHERE i <= len(string_split(directory, '/')) - 1) "
    "SELECT path, CASE WHEN length(path) > root_len THEN regexp_replace(path, '/[^/]*$', '') END AS parent, string_split(path, '/')[-1] AS name, (len(string_split(path, '/')) - len(string_split(path[1:root_len], '/')))::INT AS depth, "
    "count(*) AS photo_count, count_if(directory = path)::BIGINT AS direct_count, bool_or(directory <> path) AS has_children FROM up WHERE length(path) >= root_len GROUP BY path, root_len",
)
def _(spark, d):
    return folders.folder_tree(P.photos(spark, d), P.roots(spark))


def _dated(spark, d):
    """Photos filed by date below their folder, one in five without a date."""
    p = P.photos(spark, d)
    return p.withColumn("directory", F.concat("directory", F.when(F.col("id") % 5 == 0, F.lit("/Undated")).when(F.col("id") % 5 < 3, F.lit("/2019/0")).otherwise(F.lit("")), F.when((F.col("id") % 5).between(1, 2), (F.col("id") % 9 + 1).cast("string")).otherwise("")))


LAYOUT = f"WITH {PH}, dated AS (SELECT status, directory || CASE WHEN id % 5 = 0 THEN '/Undated' WHEN id % 5 < 3 THEN '/2019/0' || (id % 9 + 1) ELSE '' END AS directory FROM photos), layout AS (SELECT regexp_replace(directory, '/([0-9]{{4}}/[0-9]{{2}}|Undated)$', '') AS location, count(*) AS photos FROM dated WHERE status = 'active' GROUP BY 1)"


@query("a14_library_layout", f"{LAYOUT} SELECT * FROM layout")
def _(spark, d):
    return folders.library_layout(_dated(spark, d))


@query("a14_splits_library", f"{LAYOUT} SELECT location <> '/lib/en/src0' AS splits FROM layout ORDER BY photos DESC, location LIMIT 1")
def _(spark, d):
    return folders.splits_library(_dated(spark, d), "/lib/en/src0/")


@query("a15_exact_groups", f"WITH {GR} SELECT kind, key, keeper_photo_id, photo_id, 100 AS similarity_pct FROM members JOIN groups USING (group_id)")
def _(spark, d):
    return G.exact_groups(P.photos(spark, d))


@query("a16_keepers", f"WITH {GR} SELECT key, keeper_photo_id FROM groups")
def _(spark, d):
    return G.exact_groups(P.photos(spark, d)).select("key", "keeper_photo_id").distinct()


EDGES = f"{P.HASHED}, nodes AS (SELECT DISTINCT phash FROM hashed WHERE status = 'active'), edges AS (SELECT a.phash AS a, b.phash AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.phash, b.phash)) <= 6), reach AS (SELECT phash AS node, phash AS root FROM nodes UNION SELECT b, root FROM reach JOIN edges ON a = node), comp AS (SELECT node AS phash, min(root) AS component FROM reach GROUP BY node)"
SIMILAR = f"{EDGES}, placed AS (SELECT h.*, component FROM hashed h JOIN comp USING (phash) WHERE status = 'active'), heads2 AS (SELECT component, min(sha256) AS key, arg_max({{'id': id, 'phash': phash}}, (width::BIGINT * height, size_bytes, -id)) AS k FROM placed GROUP BY component HAVING count(DISTINCT sha256) > 1), sims AS (SELECT 'similar' AS kind, key, k.id AS keeper_photo_id, id AS photo_id, round_even((64 - bit_count(xor(phash, k.phash))) / 64.0::DOUBLE * 100, 0)::INT AS similarity_pct FROM placed JOIN heads2 USING (component))"


@query("a17_components", f"WITH RECURSIVE {EDGES} SELECT phash, component FROM comp")
def _(spark, d):
    return G.hash_components(P.hashed_photos(spark, d).where(L.is_active()), 6)


@query("a18_similar_groups", f"WITH RECURSIVE {SIMILAR} SELECT * FROM sims")
def _(spark, d):
    return G.similar_groups(P.hashed_photos(spark, d).where(L.is_active()))


ALL = "SELECT 'exact' AS kind, sha256 AS key, keeper AS keeper_photo_id, id AS photo_id, 100 AS similarity_pct FROM (SELECT * FROM photos WHERE status = 'active') JOIN (SELECT sha256, arg_max(id, (width::BIGINT * height, size_bytes, -id)) AS keeper FROM photos WHERE status = 'active' GROUP BY sha256 HAVING count(*) > 1) USING (sha256) UNION ALL SELECT * FROM sims"


@query("a19_derived_groups", f"WITH RECURSIVE {SIMILAR} {ALL}")
def _(spark, d):
    return G.derive_groups(P.hashed_photos(spark, d))


def import_state(spark, d):
    """(photos, touched, stored groups, members): the library after an import, with groups that are still those of before."""
    from heliograph.storage import Scratch

    scratch = Scratch(spark, "a20")
    p = scratch.table(P.hashed_photos(spark, d), "photos")
    before = scratch.table(G.derive_groups(p.where("id % 50 <> 7")), "before")
    heads = before.groupBy("kind", "key").agg(F.max("keeper_photo_id").alias("keeper_photo_id"))
    stored = scratch.table(heads.select(F.xxhash64("kind", "key").alias("id"), "kind", "key", F.lit("pending").alias("status"), "keeper_photo_id"), "stored")
    members = before.join(stored.select("id", "kind", "key").hint("merge"), ["kind", "key"]).select(F.col("id").alias("group_id"), "photo_id", "similarity_pct")
    return p, p.where("id % 50 = 7").select("id"), stored, scratch.table(members, "members")


@query("a20_bounded_rebuild", f"WITH RECURSIVE {SIMILAR} {ALL}")
def _(spark, d):
    """Only what an import touches is derived again; the outcome is that of a full rebuild."""
    return G.bounded_rebuild(*import_state(spark, d))


@query(
    "a22_group_reclaimable",
    f"WITH {GR} SELECT group_id, greatest(0, sum(size_bytes) - coalesce(max(CASE WHEN id = keeper_photo_id THEN size_bytes END), max(size_bytes)))::BIGINT AS reclaimable_bytes FROM members JOIN groups USING (group_id) JOIN photos ON id = photo_id GROUP BY group_id",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return G.group_reclaimable(m, g, P.photos(spark, d))


# -- library -----------------------------------------------------------------------


def _listing(name, where, spec):
    @query(name, f"WITH {PH} SELECT id, path FROM photos WHERE {where}")
    def _(spark, d):
        return L.listed(P.photos(spark, d), spec).select("id", "path")


_listing("f02_any_status", "true", L.ListSpec(status=None))
_listing("f03_folder_filter", "status = 'active' AND starts_with(path, '/lib/de/')", L.ListSpec(folder="/lib/de/"))
_listing("f04_type_filter", "status = 'active' AND ext IN ('jpg', 'jpeg', 'tif', 'tiff', 'png')", L.ListSpec(types=("JPEG", "tiff", "PNG")))
_listing("f05_camera_filter", "status = 'active' AND (camera_model IN ('fr') OR camera_model IS NULL OR camera_model = '')", L.ListSpec(cameras=("fr", "")))
_listing("f06_filename_search", "status = 'active' AND filename ILIKE '%C_1%7%'", L.ListSpec(q="C_1%7"))


@query("f01_detail", f"WITH {PH} SELECT * EXCLUDE (captured_at) FROM photos WHERE id = 17")
def _(spark, d):
    return L.by_id(P.photos(spark, d), 17).drop("captured_at")


@query("s06_by_path", f"WITH {PH} SELECT id, path FROM photos WHERE path = '/lib/en/src5/doc_5.jpg'")
def _(spark, d):
    return L.by_path(P.photos(spark, d), "/lib/en/src5/doc_5.jpg").select("id", "path")


@query("s07_index_of_root", f"WITH {PH} SELECT path, id, size_bytes, mtime_ns, status, sha256 FROM photos WHERE root_id = 2")
def _(spark, d):
    return L.index_of_root(P.photos(spark, d), 2)


@query("s08_infos", f"WITH {P.HASHED} SELECT {', '.join(INFO_COLUMNS)} FROM hashed WHERE status = 'active'")
def _(spark, d):
    return L.infos(P.hashed_photos(spark, d))


@query("f07_under_folders", f"WITH {PH} SELECT id FROM photos WHERE status = 'active' AND (starts_with(path, '/lib/es/src3/') OR starts_with(path, '/lib/fr/'))")
def _(spark, d):
    return L.active_under(P.photos(spark, d), ["/lib/es/src3", "/lib/fr/"]).select("id")


@query("f08_paths_under", f"WITH {PH} SELECT path FROM photos WHERE starts_with(path, '/lib/es/')")
def _(spark, d):
    return L.paths_under(P.photos(spark, d), "/lib/es")


@query("f09_needs_location", f"WITH {PH} SELECT id FROM photos WHERE (latitude IS NULL AND longitude IS NULL) OR (latitude IS NOT NULL AND city IS NULL)")
def _(spark, d):
    return P.photos(spark, d).where(L.needs_location()).select("id")


@query("f11_group_filter", f"WITH {GR} SELECT * FROM groups WHERE kind = 'exact' AND status = 'pending' ORDER BY group_id LIMIT 20 OFFSET 5")
def _(spark, d):
    return G.list_groups(P.members_and_groups(spark, d)[1], "exact", "pending", 20, 5)


TREE = "tree AS (SELECT DISTINCT '/' || array_to_string(string_split(directory, '/')[2:i + 1], '/') AS path FROM photos, range(1, 4) t(i))"


@query("f17_visible_tree", f"WITH {PH}, {TREE} SELECT t.path FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree u WHERE starts_with(t.path, u.path || '/') AND u.path NOT IN ('/lib', '/lib/de', '/lib/fr'))")
def _(spark, d):
    from heliograph.functions.columns import ancestors

    tree = P.photos(spark, d).select(F.explode(ancestors("directory")).alias("path")).distinct()
    return folders.visible_rows(tree, spark.createDataFrame([("/lib",), ("/lib/de",), ("/lib/fr",)], "path string"))


def _sort(name, order):
    @query(f"t01_sort_{name}", f"WITH {PH} SELECT {COLS} FROM photos WHERE status = 'active' ORDER BY {order} LIMIT 50")
    def _(spark, d):
        return shown(L.page(P.photos(spark, d), L.ListSpec(sort=name, limit=50)))


for _name, _order in {
    "captured_desc": "photos.captured_at DESC NULLS LAST, id DESC", "captured_asc": "photos.captured_at ASC NULLS LAST, id", "name_asc": "filename, id", "name_desc": "filename DESC, id DESC",
    "size_desc": "size_bytes DESC, id DESC", "size_asc": "size_bytes, id", "added_desc": "id DESC",
}.items():
    _sort(_name, _order)


@query("t02_page", f"WITH {PH} SELECT {COLS} FROM photos WHERE status = 'active' AND starts_with(path, '/lib/en/') ORDER BY photos.captured_at DESC NULLS LAST, id DESC LIMIT 30 OFFSET 60")
def _(spark, d):
    return shown(L.page(P.photos(spark, d), L.ListSpec(folder="/lib/en", limit=30, offset=60)))


@query("w08_page_range", f"WITH {PH} SELECT total, 61::BIGINT AS first, least(total, 90) AS last, ceil(total / 30.0)::BIGINT AS pages FROM (SELECT count(*) AS total FROM photos WHERE status = 'active' AND starts_with(path, '/lib/en/'))")
def _(spark, d):
    return L.page_range(L.total(P.photos(spark, d), L.ListSpec(folder="/lib/en")), 60, 30)


@query("t07_keyset_page", f"WITH {PH} SELECT id FROM photos WHERE status = 'active' AND (latitude IS NULL OR city IS NULL) AND id > 100 ORDER BY id LIMIT 40")
def _(spark, d):
    return L.keyset_page(P.photos(spark, d), 100, 40).select("id")


PAGE = "page AS (SELECT *, row_number() OVER (ORDER BY photos.captured_at DESC NULLS LAST, id DESC) AS rn FROM photos WHERE status = 'active' ORDER BY photos.captured_at DESC NULLS LAST, id DESC LIMIT 200)"


def _page(spark, d):
    return L.numbered(L.page(P.photos(spark, d), L.ListSpec(limit=200)), "captured_desc")


def _section(by, key):
    @query(f"w04_sections_{by}", f"WITH {PH}, {PAGE} SELECT {key} AS section, min(rn)::INT AS first_rn, string_agg(id, ',' ORDER BY rn) AS ids FROM page GROUP BY 1")
    def _(spark, d):
        return L.sections(_page(spark, d), by).withColumn("ids", F.array_join("ids", ","))


_section("folder", "directory")
_section("date", "coalesce(strftime(captured_at, '%B %Y'), 'No capture date')")
_section("camera", "coalesce(camera_model, 'Unknown camera')")


@query("w06_filmstrip", f"WITH {PH}, {PAGE} SELECT id, array_to_string(list(id) OVER (ORDER BY rn ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), ',') AS strip, lag(id) OVER (ORDER BY rn) AS prev_id, lead(id) OVER (ORDER BY rn) AS next_id FROM page")
def _(spark, d):
    return L.filmstrip(_page(spark, d)).withColumn("strip", F.array_join("strip", ","))


@query("w09_range", f"WITH {PH}, {PAGE} SELECT id FROM page WHERE rn BETWEEN 20 AND 60")
def _(spark, d):
    rows = _page(spark, d)
    ends = [r["id"] for r in rows.where("rn in (20, 60)").collect()]
    return L.selected_range(rows, ends[0], ends[-1]).select("id")


@query("j05_marked_worklist", f"WITH {GR}, {P.DECISIONS} SELECT id, path FROM photos WHERE status = 'active' AND (marked_for_deletion OR id IN (SELECT photo_id FROM decisions WHERE decision = 'remove'))")
def _(spark, d):
    return L.marked_worklist(P.photos(spark, d), P.decisions(P.members_and_groups(spark, d)[0])).select("id", "path")


@query(
    "j15_similar_to",
    f"WITH {P.HASHED}, probe AS (SELECT phash FROM hashed WHERE id = 10) SELECT id, bit_count(xor(hashed.phash, probe.phash))::INT AS distance FROM hashed, probe WHERE status = 'active' AND id <> 10 AND bit_count(xor(hashed.phash, probe.phash)) <= 6 ORDER BY distance, id LIMIT 12",
)
def _(spark, d):
    from heliograph.storage import Scratch

    p = Scratch(spark, "j15").table(P.hashed_photos(spark, d), "photos")
    probe = p.where("id = 10").first()
    return L.similar_to(p, 10, probe["phash"]).select("id", F.col("distance").cast("int").alias("distance"))


@query("w05_rates", "SELECT user_id AS who, event_id AS seq, (event_id - lag(event_id) OVER w) / greatest(epoch(ts) - lag(epoch(ts)) OVER w, 1e-6) AS per_sec FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id)")
def _(spark, d):
    e = P.read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return stats.ticks(e.select(F.col("user_id").alias("who"), at.alias("at"), F.col("event_id").alias("seq"), F.col("event_id").alias("done")))


@query("t12_report", "SELECT left(regexp_replace(text, '\\s+', ' ', 'g'), 90) AS text, n_chars FROM documents ORDER BY n_chars DESC, documents.text LIMIT 12")
def _(spark, d):
    return stats.report(P.read(spark, d, "documents").select("text", "n_chars"), "n_chars", 12, "text")


# -- folders -----------------------------------------------------------------------


@query("j13_root_of_path", f"WITH {PH}, roots3(id, path) AS (VALUES (1, '/lib'), (2, '/lib/de'), (3, '/lib/fr/src1')) SELECT p.path, arg_max(r.id, length(r.path)) AS root_id FROM photos p JOIN roots3 r ON starts_with(p.path, r.path || '/') GROUP BY p.path")
def _(spark, d):
    return folders.root_of_path(P.photos(spark, d).select("path"), spark.createDataFrame([(1, "/lib"), (2, "/lib/de/"), (3, "/lib/fr/src1")], "id int, path string"))


@query("j17_top_level_folders", f"WITH {PH}, f AS (SELECT DISTINCT directory AS folder FROM photos WHERE id % 3 = 0 UNION SELECT '/lib/de') SELECT folder FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE starts_with(f.folder, o.folder || '/'))")
def _(spark, d):
    own = P.photos(spark, d).where("id % 3 = 0").select(F.concat("directory", F.lit("/")).alias("folder"))
    return folders.top_level(own.unionByName(spark.createDataFrame([("/lib/de",)], "folder string")))


# -- groups ------------------------------------------------------------------------


@query("j01_redundant_copies", f"WITH {GR} SELECT DISTINCT photo_id FROM members JOIN groups USING (group_id) WHERE kind = 'exact' AND photo_id % 2 = 0 AND photo_id <> keeper_photo_id")
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return G.redundant_copies(g, m, P.photos(spark, d).where("id % 2 = 0").select("id"))


@query("j02_marked_remove", f"WITH {GR}, {P.DECISIONS} {REMOVE}")
def _(spark, d):
    return stats.marked_remove(P.decisions(P.members_and_groups(spark, d)[0]), P.photos(spark, d))


@query("j03_band_neighbours", f"WITH {P.HASHED} SELECT s.id AS seed_id, p.id AS photo_id, bit_count(xor(s.phash, p.phash))::INT AS distance FROM hashed s JOIN hashed p ON s.id % 7 = 3 AND p.status = 'active' AND s.id <> p.id AND bit_count(xor(s.phash, p.phash)) <= 6")
def _(spark, d):
    from heliograph.storage import Scratch

    p = Scratch(spark, "j03").table(P.hashed_photos(spark, d).select("id", "phash", "status"), "photos")
    return G.band_neighbours(p, p.where("id % 7 = 3")).withColumn("distance", F.col("distance").cast("int"))


@query("j06_sha_mates", f"WITH {PH} SELECT id FROM photos WHERE status = 'active' AND sha256 IN (SELECT sha256 FROM photos WHERE id % 7 = 3)")
def _(spark, d):
    p = P.photos(spark, d)
    return G.sha_mates(p, p.where("id % 7 = 3").select("id"))


@query("j07_groups_touching", f"WITH {GR} SELECT DISTINCT group_id FROM members WHERE photo_id % 7 = 3")
def _(spark, d):
    return G.groups_touching(P.members_and_groups(spark, d)[0], P.photos(spark, d).where("id % 7 = 3").select("id"))


@query(
    "j11_group_detail",
    f"WITH {GR}, {P.DECISIONS} SELECT group_id, kind, key, status, keeper_photo_id, string_agg(photo_id || ':' || coalesce(decision, '-') || ':' || size_bytes, ',' ORDER BY photo_id) AS members FROM members JOIN groups USING (group_id) JOIN photos p ON p.id = photo_id LEFT JOIN decisions USING (group_id, photo_id) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY group_id, kind, key, groups.status, keeper_photo_id").replace("key, status,", "key, groups.status,"),
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    out = G.group_detail(g, m, P.decisions(m), P.photos(spark, d))
    line = lambda x: F.concat_ws(":", x["photo_id"].cast("string"), F.coalesce(x["decision"], F.lit("-")), x["size_bytes"].cast("string"))
    return out.withColumn("members", F.array_join(F.transform("members", line), ","))


@query("j18_fully_covered_groups", f"WITH {GR} SELECT group_id FROM members JOIN photos ON id = photo_id WHERE status = 'active' GROUP BY group_id HAVING bool_and(id % 4 <> 1)")
def _(spark, d):
    return G.fully_covered(P.members_and_groups(spark, d)[0], P.photos(spark, d), P.photos(spark, d).where("id % 4 <> 1").select("id"))


STORED = "stored AS (SELECT group_id AS id, kind, CASE WHEN group_id % 4 = 1 THEN 'gone' || group_id ELSE key END AS key, status, keeper_photo_id FROM groups WHERE group_id % 4 <> 2)"


def _stored(groups):
    key = F.when(F.col("group_id") % 4 == 1, F.concat(F.lit("gone"), F.col("group_id").cast("string"))).otherwise(F.col("key"))
    return groups.where("group_id % 4 <> 2").select(F.col("group_id").alias("id"), "kind", key.alias("key"), "status", "keeper_photo_id")


@query(
    "d08_merge_groups",
    f"WITH {GR}, {STORED}, heads3 AS (SELECT 'exact' AS kind, key, keeper_photo_id AS k FROM heads) SELECT kind, key, id, CASE WHEN k IS NULL THEN 'delete' ELSE 'update' END AS action, coalesce(k, keeper_photo_id) AS keeper_photo_id, status FROM stored LEFT JOIN heads3 USING (kind, key) "
    "UNION ALL SELECT kind, key, (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY kind, key), 'insert', k, 'pending' FROM heads3 h WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.kind = h.kind AND s.key = h.key)",
)
def _(spark, d):
    return G.merge_groups(G.exact_groups(P.photos(spark, d)), _stored(P.members_and_groups(spark, d)[1]))


@query(
    "d09_sync_status",
    f"WITH {GR}, before AS (SELECT * FROM members WHERE photo_id % 5 <> 4), now AS (SELECT group_id, photo_id FROM members WHERE photo_id % 7 <> 6), changed AS (SELECT group_id, bool_or(b.photo_id IS NULL OR n.photo_id IS NULL) AS c FROM before b FULL JOIN now n USING (group_id, photo_id) GROUP BY group_id) "
    "SELECT group_id, CASE WHEN status = 'reviewed' AND c THEN 'pending' ELSE status END AS status FROM groups LEFT JOIN changed USING (group_id)",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    stored = g.select(F.col("group_id").alias("id"), "kind", "key", "status")
    derived = m.where("photo_id % 7 <> 6").join(g.select("group_id", "kind", "key"), "group_id").select("kind", "key", "photo_id")
    return G.sync_members(derived, stored, m.where("photo_id % 5 <> 4"), P.decisions(m))[0]


@query(
    "d10_prune",
    f"WITH {GR}, rest AS (SELECT group_id, photo_id FROM members WHERE photo_id % 3 <> 1), live AS (SELECT r.group_id, p.*, g.keeper_photo_id AS keeper FROM rest r JOIN photos p ON p.id = r.photo_id JOIN groups g USING (group_id) WHERE p.status = 'active'), "
    "best AS (SELECT group_id, arg_max(id, (width::BIGINT * height, size_bytes, -id)) AS b, max(keeper) AS keeper, bool_or(id = keeper) AS has FROM live GROUP BY group_id HAVING count(*) > 1) SELECT group_id, photo_id, CASE WHEN has THEN keeper ELSE b END AS keeper_photo_id FROM rest JOIN best USING (group_id)",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    p = P.photos(spark, d)
    return G.prune(g, m, p, p.where("id % 3 = 1").select("id"))


@query(
    "d11_restore",
    f"WITH {PH}, own AS (SELECT * FROM photos WHERE status = 'active' AND sha256 IN (SELECT sha256 FROM photos WHERE status = 'active' AND id % 6 = 1)) SELECT 'exact' AS kind, sha256 AS key, k AS keeper_photo_id, id AS photo_id, 100 AS similarity_pct FROM own JOIN (SELECT sha256, arg_max(id, (width::BIGINT * height, size_bytes, -id)) AS k FROM own GROUP BY sha256 HAVING count(*) > 1) USING (sha256)",
)
def _(spark, d):
    p = P.photos(spark, d)
    return G.restore(p, p.where("id % 6 = 1").select("id"))


# -- review ------------------------------------------------------------------------

REQUEST = "request AS (SELECT group_id, photo_id, CASE photo_id % 5 WHEN 0 THEN 'undecided' WHEN 1 THEN 'remove' ELSE 'keep' END AS decision FROM members WHERE photo_id % 5 < 3)"


def _request(m):
    return m.where("photo_id % 5 < 3").select("group_id", "photo_id", F.expr("CASE photo_id % 5 WHEN 0 THEN 'undecided' WHEN 1 THEN 'remove' ELSE 'keep' END").alias("decision"))


APPLIED = f"{GR}, {P.DECISIONS}, {REQUEST}, applied AS (SELECT * FROM (SELECT group_id, photo_id, coalesce(r.decision, o.decision) AS decision FROM decisions o FULL JOIN request r USING (group_id, photo_id)) WHERE decision <> 'undecided')"


@query("d05_apply_decisions", f"WITH {APPLIED} SELECT * FROM applied")
def _(spark, d):
    m = P.members_and_groups(spark, d)[0]
    return review.apply_decisions(P.decisions(m), _request(m))


@query("d06_group_status", f"WITH {APPLIED} SELECT group_id, CASE WHEN bool_and(decision IS NOT NULL) THEN 'reviewed' ELSE 'pending' END AS status FROM members LEFT JOIN applied USING (group_id, photo_id) GROUP BY group_id")
def _(spark, d):
    m = P.members_and_groups(spark, d)[0]
    return review.group_status(m, review.apply_decisions(P.decisions(m), _request(m)))


@query("d07_dismiss", f"WITH {GR} SELECT group_id, CASE WHEN group_id % 3 = 0 THEN 'dismissed' ELSE status END AS status FROM groups")
def _(spark, d):
    g = P.members_and_groups(spark, d)[1]
    return review.dismiss(g, g.where("group_id % 3 = 0").select(F.col("group_id").alias("id"))).select("group_id", "status")


@query("d07_reopen", f"WITH {GR} SELECT group_id, CASE WHEN group_id % 3 = 1 THEN 'pending' ELSE status END AS status FROM groups")
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return review.reopen(g, P.decisions(m), g.where("group_id % 3 = 1").select(F.col("group_id").alias("id")))[0].select("group_id", "status")


@query("d07_reopen_decisions", f"WITH {GR}, {P.DECISIONS} SELECT group_id, photo_id, decision FROM decisions WHERE group_id % 3 <> 1")
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return review.reopen(g, P.decisions(m), g.where("group_id % 3 = 1").select(F.col("group_id").alias("id")))[1]


@query(
    "r01_review_queue",
    f"WITH {GR}, {P.DECISIONS} SELECT group_id, keeper_photo_id AS keeper_id, photo_id, row_number() OVER (PARTITION BY group_id ORDER BY photo_id)::INT AS position FROM members m JOIN groups g USING (group_id) WHERE g.status = 'pending' AND photo_id <> keeper_photo_id AND NOT EXISTS (SELECT 1 FROM decisions o WHERE o.group_id = m.group_id AND o.photo_id = m.photo_id)",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    return review.review_queue(g, m, P.decisions(m))


@query(
    "f18_pair_diff",
    f"WITH {GR}, pairs AS (SELECT k.id AS keeper_id, p.id AS photo_id, k.ext IS NOT DISTINCT FROM p.ext AS ext, k.size_bytes IS NOT DISTINCT FROM p.size_bytes AS size_bytes, k.width IS NOT DISTINCT FROM p.width AS width, k.height IS NOT DISTINCT FROM p.height AS height, "
    "k.captured_at IS NOT DISTINCT FROM p.captured_at AS captured_at, k.camera_model IS NOT DISTINCT FROM p.camera_model AS camera_model FROM members JOIN groups USING (group_id) JOIN photos k ON k.id = keeper_photo_id JOIN photos p ON p.id = photo_id WHERE k.id <> p.id) UNPIVOT pairs ON ext, size_bytes, width, height, captured_at, camera_model INTO NAME attribute VALUE same".replace("UNPIVOT pairs", "SELECT * FROM (UNPIVOT pairs") + ")",
)
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    pairs = m.join(g.select("group_id", F.col("keeper_photo_id").alias("keeper_id")), "group_id").where("photo_id <> keeper_id").select("keeper_id", "photo_id")
    return review.pair_diff(pairs, P.photos(spark, d))


# -- scans -------------------------------------------------------------------------


def _scan(spark, d):
    index, disk = P.index_and_disk(spark, d)
    classes = R.classify(disk, index)
    vanished = index.join(classes.where("class = 'unseen'").select("id"), "id", "left_semi")
    added = disk.join(classes.where("class = 'added'").select("path"), "path", "left_semi")
    return index, disk, classes, R.move_pairs(vanished, added)


@query("j09_scan_classify", f"WITH {PH}, {P.INDEX} SELECT path, id, class, status FROM classes")
def _(spark, d):
    return _scan(spark, d)[2]


@query("j10_move_pairs", f"WITH {PH}, {P.INDEX} SELECT old_id, old_path, new_path FROM moves")
def _(spark, d):
    return _scan(spark, d)[3]


GONE = "gone AS (SELECT id, path FROM classes WHERE class = 'unseen' AND status = 'active' AND id NOT IN (SELECT old_id FROM moves))"


@query("d03_missing", f"WITH {PH}, {P.INDEX}, {GONE} SELECT * FROM gone")
def _(spark, d):
    _, _, classes, moves = _scan(spark, d)
    return R.missing(classes, moves)


@query("d03_mark_missing", f"WITH {PH}, {P.INDEX}, {GONE} SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 'missing' ELSE status END AS status FROM idx")
def _(spark, d):
    index, _, classes, moves = _scan(spark, d)
    return R.mark_missing(index, R.missing(classes, moves)).select("id", "status")


@query("d04_moved", f"WITH {PH}, {P.INDEX} SELECT id, coalesce(new_path, path) AS path, CASE WHEN new_path IS NULL THEN status ELSE 'active' END AS status FROM idx LEFT JOIN moves ON id = old_id")
def _(spark, d):
    index, _, _, moves = _scan(spark, d)
    return R.apply_moves(index, moves).select("id", "path", "status")


UPSERT = "size_bytes, mtime_ns, sha256, width, height, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, camera_make, camera_model, latitude, longitude, city, region, country, place_distance_km, exif, phash, last_error, status"
BOTH = ", ".join(f"CASE WHEN s.path IS NULL THEN i.{c} ELSE s.{c} END AS {c}" for c in R.WRITTEN)


@query(
    "d02_upsert",
    f"WITH {PH}, i AS (SELECT *, 'old' AS camera_make, id AS phash, 'was bad' AS last_error FROM photos WHERE id % 10 <> 9), s AS (SELECT path, size_bytes + 1 AS size_bytes, mtime_ns + 1 AS mtime_ns, reverse(sha256) AS sha256, height AS width, CASE WHEN id % 3 > 0 THEN width END AS height, captured_at, "
    "'new' AS camera_make, country AS camera_model, longitude / 2 AS latitude, latitude AS longitude, region AS city, city AS region, 'XX' AS country, CAST(id % 7 AS FLOAT) AS place_distance_km, '{}' AS exif, -id AS phash, CASE WHEN id % 5 = 0 THEN 'broken' END AS last_error, 'active' AS status, root_id FROM photos WHERE id % 10 <> 1), "
    f"merged AS (SELECT coalesce(i.path, s.path) AS path, i.id IS NULL AS is_new, coalesce(i.root_id, s.root_id) AS root_id, {BOTH} FROM i FULL JOIN s ON i.path = s.path) "
    f"SELECT path, regexp_extract(path, '[^/]*$') AS filename, is_new, root_id, {UPSERT} FROM merged",
)
def _(spark, d):
    p, i = P.photos(spark, d), F.col("id")
    index = p.where("id % 10 <> 9").withColumns({"camera_make": F.lit("old"), "phash": i, "last_error": F.lit("was bad")})
    read = p.where("id % 10 <> 1").select(
        "path", "root_id", (F.col("size_bytes") + 1).alias("size_bytes"), (F.col("mtime_ns") + 1).alias("mtime_ns"), F.reverse("sha256").alias("sha256"), F.col("height").alias("width"),
        F.when(i % 3 > 0, F.col("width")).alias("height"), "captured_at", F.lit("new").alias("camera_make"), F.col("country").alias("camera_model"), (F.col("longitude") / 2).alias("latitude"), F.col("latitude").alias("longitude"),
        F.col("region").alias("city"), F.col("city").alias("region"), F.lit("XX").alias("country"), (i % 7).cast("float").alias("place_distance_km"), F.lit("{}").alias("exif"), (-i).alias("phash"), F.when(i % 5 == 0, "broken").alias("last_error"),
    )
    top = index.agg(F.max("id").alias("top"))
    out = R.upsert(index, read).crossJoin(F.broadcast(top))
    return shown(out.select("path", "filename", (i > F.col("top")).alias("is_new"), "root_id", *R.WRITTEN))


@query("d20_scan_errors", f"WITH {PH}, {P.INDEX} SELECT 7::BIGINT AS scan_id, path, error FROM disk WHERE error IS NOT NULL")
def _(spark, d):
    return R.split_errors(P.index_and_disk(spark, d)[1], 7)[1]


@query("d20_usable", f"WITH {PH}, {P.INDEX} SELECT path, error IS NOT NULL AS undecoded FROM disk WHERE sha256 IS NOT NULL")
def _(spark, d):
    return R.split_errors(P.index_and_disk(spark, d)[1], 7)[0].select("path", F.col("error").isNotNull().alias("undecoded"))


@query(
    "f13_changed_anything",
    f"WITH {PH}, {P.INDEX}, {GONE} SELECT count_if(class = 'added') > (SELECT count(*) FROM moves) OR count_if(class = 'changed') > 0 OR (SELECT count(*) FROM gone) > 0 OR (SELECT count(*) FROM moves) > 0 AS anything FROM classes",
)
def _(spark, d):
    _, _, classes, moves = _scan(spark, d)
    return spark.createDataFrame([(R.changed_anything(R.counters(classes, moves).first()),)], "anything boolean")


@query("c06_job_times", f"WITH {P.SCANS} SELECT id, CASE id WHEN 50 THEN 'running' WHEN 100 THEN 'failed' ELSE status END AS status, id = 50 AS started, id = 100 AS ended FROM scans")
def _(spark, d):
    scans = P.scans(spark, d).withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
    out = jobs.finished(jobs.started(scans, 50), 100, "failed")
    return out.select("id", "status", F.col("started_at").isNotNull().alias("started"), F.col("finished_at").isNotNull().alias("ended"))


@query("d16_audit_append", f"WITH {P.OPERATIONS} SELECT op, count(*) AS n, max(id) AS last FROM operations WHERE id % 4 > 0 GROUP BY op")
def _(spark, d):
    """Operations appended in three goes and read back."""
    from heliograph.storage import Scratch

    ops, log = P.operations(spark, d), f"{Scratch(spark, 'd16').base}/operations"
    for k in (1, 2, 3):
        audit.append(ops.where(F.col("id") % 4 == k), log)
    return spark.read.parquet(log).groupBy("op").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("t14_show_all", f"WITH {PH} SELECT id, size_bytes FROM photos WHERE status = 'active'")
def _(spark, d):
    return L.show_all(P.photos(spark, d), L.ListSpec(sort="size_desc", limit=5)).select("id", "size_bytes")


@query("a27_layout_total", f"{LAYOUT} SELECT count(*) AS locations, sum(photos)::BIGINT AS total FROM layout")
def _(spark, d):
    return folders.layout_total(folders.library_layout(_dated(spark, d)))


@query("a27_client_sums", f"WITH {PH} SELECT coalesce(sum(size_bytes) FILTER (status = 'active' AND marked_for_deletion), 0)::BIGINT AS marked_bytes, coalesce(sum(size_bytes) FILTER (id % 6 = 1), 0)::BIGINT AS selected_bytes FROM photos")
def _(spark, d):
    p = P.photos(spark, d)
    return stats.client_sums(p, p.where("id % 6 = 1").select("id"))


@query(
    "a26_scan_counters",
    f"WITH {PH}, {P.INDEX}, {GONE} SELECT count_if(class <> 'unseen')::BIGINT AS files_found, count_if(class <> 'unseen')::BIGINT AS files_processed, (count_if(class = 'added') - (SELECT count(*) FROM moves))::BIGINT AS files_added, count_if(class = 'changed')::BIGINT AS files_changed, count_if(class = 'unchanged')::BIGINT AS files_unchanged, "
    "(SELECT count(*) FROM gone) AS files_missing, (SELECT count(*) FROM moves) AS files_moved, count_if(class = 'unreadable')::BIGINT AS error_count FROM classes",
)
def _(spark, d):
    _, _, classes, moves = _scan(spark, d)
    return R.counters(classes, moves)


@query("j21_touched", f"WITH {PH} SELECT id FROM photos WHERE id % 9 = 2 OR id % 4 = 1")
def _(spark, d):
    p = P.photos(spark, d)
    return R.touched_ids(p, p.where("id % 9 = 2").select("id"), p.where("id % 4 = 1").select("path"))


@query("d19_recovered_jobs", f"WITH {P.SCANS} SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status FROM scans")
def _(spark, d):
    return R.recover_interrupted(P.scans(spark, d)).select("id", "status")


@query("t06_recent_scans", f"WITH {P.SCANS} SELECT id, status FROM scans ORDER BY id DESC LIMIT 10")
def _(spark, d):
    return P.scans(spark, d).orderBy(F.desc("id")).limit(10).select("id", "status")


# -- organize ----------------------------------------------------------------------

SPEC = O.OrganizeSpec(("/lib/en", "/lib/fr"), "/lib/en/sorted", "camera")
CLASSED = (
    f"{GR}, own AS (SELECT id, path, filename, size_bytes, captured_at, camera_model FROM photos WHERE status = 'active' AND (starts_with(path, '/lib/en/') OR starts_with(path, '/lib/fr/'))), "
    "copies AS (SELECT DISTINCT photo_id AS id FROM members JOIN groups USING (group_id) WHERE photo_id <> keeper_photo_id), "
    "cand AS (SELECT own.*, id IN (SELECT id FROM copies) AS is_copy, '/lib/en/sorted/' || coalesce(nullif(camera_model, ''), 'Unknown camera') || '/' || name AS candidate FROM (SELECT *, 'img_' || (id % 20) || regexp_extract(filename, '\\.[a-z]+$') AS name FROM own) own), "
    "classed AS (SELECT *, CASE WHEN is_copy THEN 'duplicate' WHEN candidate = path THEN 'in_place' ELSE 'move' END AS class FROM cand)"
)


def _plan(spark, d, spec=SPEC):
    m, g = P.members_and_groups(spark, d)
    p = P.photos(spark, d).withColumn("filename", F.concat(F.lit("img_"), (F.col("id") % 20).cast("string"), F.lit("."), "ext"))
    return O.classified(p, spec, g, m)


DEST = "CASE WHEN k = 0 THEN candidate ELSE regexp_replace(candidate, '\\.[a-z]+$', '') || '_' || CASE WHEN k < 10 THEN '0' ELSE '' END || k || regexp_extract(candidate, '\\.[a-z]+$') END"
NAMED = f"{CLASSED}, named AS (SELECT id, path AS src, {DEST} AS dest, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY path) - 1 AS k FROM classed WHERE class = 'move'))"


@query(
    "a23_organize_counters",
    f"WITH {CLASSED} SELECT count(*) AS total, count_if(is_copy)::BIGINT AS duplicates_in_set, count_if(class = 'duplicate')::BIGINT AS duplicates_skipped, count_if(class = 'in_place')::BIGINT AS already_organized, count_if(class = 'move')::BIGINT AS planned, 0::BIGINT AS undated, coalesce(sum(CASE WHEN class = 'move' THEN size_bytes END), 0)::BIGINT AS est_bytes FROM classed",
)
def _(spark, d):
    return O.plan_counters(_plan(spark, d))


@query("w03_suffix_fast", f"WITH {NAMED} SELECT id, dest FROM named")
def _(spark, d):
    return O.suffixed_fast(_plan(spark, d))


#: Photos of a folder ask for few names, among them ones that suffixing makes of others; some names and suffixes are taken.
WANT = "'/out/' || lang || '/' || source || '/' || CASE WHEN id % 8 < 4 THEN 'IMG.jpg' WHEN id % 8 = 4 THEN 'IMG_01.jpg' WHEN id % 8 = 5 THEN 'IMG_0' || (id % 3 + 2) || '.jpg' WHEN id % 8 = 6 THEN 'IMG_01_01.jpg' ELSE 'plain' END"
THERE = "'/out/' || lang || '/' || source || '/' || CASE WHEN id % 10 = 0 THEN 'IMG_0' || (id % 4 + 1) || '.jpg' ELSE 'plain_01' END"
CROWD = f"""
crowd AS (SELECT id, path, size_bytes, {WANT} AS candidate, {THERE} AS there FROM (SELECT doc_id AS id, lang, source, p.path, p.size_bytes FROM documents JOIN photos p ON p.id = doc_id)),
folders AS (SELECT regexp_replace(candidate, '/[^/]*$', '') AS folder, list(DISTINCT there) FILTER (id % 10 < 2) AS held FROM crowd GROUP BY 1),
queue AS (SELECT *, regexp_replace(candidate, '/[^/]*$', '') AS folder, regexp_replace(candidate, '\\.jpg$', '') AS stem, CASE WHEN ends_with(candidate, '.jpg') THEN '.jpg' ELSE '' END AS ending,
 row_number() OVER (PARTITION BY regexp_replace(candidate, '/[^/]*$', '') ORDER BY path) AS k FROM crowd),
turns AS (SELECT folder, 0::BIGINT AS k, coalesce(held, []) AS held, NULL::BIGINT AS id, NULL::VARCHAR AS src, NULL::VARCHAR AS dest, NULL::BIGINT AS size_bytes FROM folders
 UNION ALL SELECT folder, k, list_append(held, dest), id, path, dest, size_bytes FROM (SELECT t.folder, q.k, t.held, q.id, q.path, q.size_bytes,
  list_filter(list_transform(range(0, len(t.held) + 1), lambda n: CASE WHEN n = 0 THEN q.candidate ELSE q.stem || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || q.ending END), lambda c: NOT list_contains(t.held, c))[1] AS dest
  FROM turns t JOIN queue q ON q.folder = t.folder AND q.k = t.k + 1))"""


@query("w03_suffix_exact", f"WITH RECURSIVE {PH}, {CROWD} SELECT id, src, dest, size_bytes FROM turns WHERE k > 0")
def _(spark, d):
    at = P.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = P.photos(spark, d).select("id", "path", "size_bytes").join(at, "id").withColumn("class", F.lit("move"))
    rows = rows.withColumns({"candidate": F.expr(WANT), "there": F.expr(THERE)})
    return O.planned_moves(rows, rows.where("id % 10 < 2").select(F.col("there").alias("path")), O.OrganizeSpec(("/lib",), "/out"))


@query("w03_suffix_plain", f"WITH {NAMED} SELECT id, src, dest, size_bytes FROM named")
def _(spark, d):
    return O.planned_moves(_plan(spark, d), P.photos(spark, d), SPEC)


@query("w01_example_paths", f"WITH {NAMED} SELECT regexp_replace(dest, '/[^/]*$', '') AS folder, arg_min(dest, src) AS dest FROM named GROUP BY 1 ORDER BY min(src) LIMIT 3")
def _(spark, d):
    return O.example_paths(O.suffixed_fast(_plan(spark, d)).join(_plan(spark, d).select("id", F.col("path").alias("src")), "id"))


@query("w02_rename_example", f"WITH {NAMED} SELECT string_split(min(src), '/')[-1] AS old, string_split(arg_min(dest, src), '/')[-1] AS new FROM named")
def _(spark, d):
    return O.rename_example(O.suffixed_fast(_plan(spark, d)).join(_plan(spark, d).select("id", F.col("path").alias("src")), "id"))


@query("d17_executed", f"WITH {NAMED} SELECT p.id, coalesce(dest, path) AS path FROM photos p LEFT JOIN named USING (id)")
def _(spark, d):
    moves = O.planned_moves(_plan(spark, d), P.photos(spark, d), SPEC)
    return O.executed(P.photos(spark, d), moves)[0].select("id", "path")


# -- geography ---------------------------------------------------------------------

KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(g.latitude) - radians(p.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(g.latitude)) * pow(sin((radians(g.longitude) - radians(p.longitude)) / 2), 2))))"


@query("j16_nearest_place", f"WITH {P.PLACES}, met AS (SELECT p.id, g.*, {KM} AS km FROM points p, places g) SELECT p.id, b.city, b.region, b.country, round_even(b.km, 1)::FLOAT AS place_distance_km FROM points p LEFT JOIN (SELECT id, arg_min({{'city': city, 'region': region, 'country': country, 'km': km}}, (km, city)) AS b FROM met WHERE km <= 1000 GROUP BY id) USING (id)")
def _(spark, d):
    return geo.nearest_place(P.points(spark, d), P.places(spark, d), 1000.0).drop("latitude", "longitude")


@query("a24_backfill_page", f"WITH {PH}, todo AS (SELECT * FROM photos WHERE status = 'active' AND (latitude IS NULL OR city IS NULL)), page AS (SELECT * FROM todo WHERE id > 50 ORDER BY id LIMIT 60) SELECT count(*) AS processed, count_if(latitude IS NOT NULL OR id % 3 = 0)::BIGINT AS updated, CASE WHEN count(*) = 60 THEN max(id) END AS next_after_id, CASE WHEN count(*) = 60 THEN (SELECT count(*) FROM todo WHERE id > (SELECT max(id) FROM page)) ELSE 0 END AS remaining FROM page")
def _(spark, d):
    p = P.photos(spark, d)
    found = p.where("id % 3 = 0").select("id", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return geo.backfill_page(p, found, 50, 60)


# -- marks, quarantine, audit ------------------------------------------------------


@query("d01_mark", f"WITH {PH} SELECT id, CASE WHEN id % 4 = 1 AND status = 'active' THEN true ELSE marked_for_deletion END AS marked_for_deletion FROM photos")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.set_marked(p, p.where("id % 4 = 1").select("id"), True).select("id", "marked_for_deletion")


@query("d01_affected", f"WITH {PH} SELECT count(*) AS affected FROM photos WHERE id % 4 = 1 AND status = 'active'")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.marked_count(p, p.where("id % 4 = 1").select("id"))


@query("d12_quarantine_state", f"WITH {PH} SELECT id, CASE WHEN id % 4 = 1 AND status = 'active' THEN 'quarantined' ELSE status END AS status, CASE WHEN id % 4 = 1 AND status = 'active' THEN false ELSE marked_for_deletion END AS marked_for_deletion FROM photos")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.quarantine(p, P.members_and_groups(spark, d)[0], p.where("id % 4 = 1").select("id"), force=True).select("id", "status", "marked_for_deletion")


@query("a25_batch_summary", f"WITH {PH} SELECT count_if(status = 'active')::BIGINT AS succeeded, (count_if(status <> 'active') + 1)::BIGINT AS failed FROM photos WHERE id % 4 = 1")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.batch_summary(audit.results(p, p.where("id % 4 = 1").select("id").unionByName(spark.createDataFrame([(-5,)], "id long")), "active"))


@query("d13_restore_state", f"WITH {PH} SELECT id, CASE WHEN id % 2 = 0 AND status = 'quarantined' THEN 'active' ELSE status END AS status FROM photos")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.restore(p, p.where("id % 2 = 0").select("id")).select("id", "status")


@query("d14_delete_state", f"WITH {PH} SELECT id, path FROM photos WHERE NOT (id % 2 = 0 AND status = 'quarantined')")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.delete_permanently(p, P.operations(spark, d), p.where("id % 2 = 0").select("id"), True)[0].select("id", "path")


@query("d14_audit_after_delete", f"WITH {PH}, {P.OPERATIONS}, gone AS (SELECT id, path, size_bytes FROM photos WHERE id % 2 = 0 AND status = 'quarantined') SELECT CASE WHEN photo_id IN (SELECT id FROM gone) THEN NULL ELSE photo_id END AS photo_id, op, src_path, size_bytes FROM operations UNION ALL SELECT NULL, 'delete', path, size_bytes FROM gone")
def _(spark, d):
    p = P.photos(spark, d)
    return audit.delete_permanently(p, P.operations(spark, d), p.where("id % 2 = 0").select("id"), True)[1].select("photo_id", "op", "src_path", "size_bytes")


@query("d15_reset_history", f"WITH {P.OPERATIONS} SELECT id FROM operations WHERE photo_id IS NOT NULL")
def _(spark, d):
    return audit.reset_history(P.operations(spark, d)).select("id")


@query("t04_audit_page", f"WITH {P.OPERATIONS} SELECT id, op, photo_id FROM operations ORDER BY id DESC LIMIT 50 OFFSET 100")
def _(spark, d):
    return audit.audit_page(P.operations(spark, d), 50, 100).select("id", "op", "photo_id")


@query("t08_latest_quarantine", f"WITH {P.OPERATIONS} SELECT photo_id, max(id) AS id, arg_max(src_path, id) AS src_path FROM operations WHERE op = 'quarantine' AND photo_id IS NOT NULL GROUP BY photo_id")
def _(spark, d):
    return audit.latest_quarantine(P.operations(spark, d))


@query("u_cascade", f"WITH {GR} SELECT m.group_id, m.photo_id, CASE WHEN keeper_photo_id % 3 <> 0 THEN keeper_photo_id END AS keeper_photo_id FROM members m JOIN groups USING (group_id) WHERE photo_id % 3 <> 0")
def _(spark, d):
    m, g = P.members_and_groups(spark, d)
    rows, _, kept = audit.cascade(P.photos(spark, d).where("id % 3 <> 0"), m, P.decisions(m), g)
    return rows.join(kept.select("group_id", "keeper_photo_id"), "group_id").select("group_id", "photo_id", "keeper_photo_id")


@query("stream_tallies", f"WITH {P.OPERATIONS} SELECT strftime(date_trunc('hour', performed_at), '%Y-%m-%d %H') AS start, op, count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM operations GROUP BY 1, 2")
def _(spark, d):
    from heliograph.streaming.audit import tallies

    return tallies(P.operations(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


# -- jobs and roots ----------------------------------------------------------------

ERRORS = "errors AS (SELECT event_id AS id, user_id AS scan_id, '/lib/op_' || event_id AS path FROM events WHERE event_type = 'error')"


def _errors(spark, d):
    e = P.read(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("scan_id"), F.concat(F.lit("/lib/op_"), F.col("event_id").cast("string")).alias("path"))


@query("t05_errors_page", f"WITH {ERRORS} SELECT * FROM errors WHERE scan_id = 3 ORDER BY id LIMIT 20 OFFSET 2")
def _(spark, d):
    return jobs.errors_page(_errors(spark, d), 3, 20, 2)


@query("a28_error_scans", f"WITH {ERRORS} SELECT scan_id % 10 AS shard, string_agg(DISTINCT scan_id::VARCHAR, ',' ORDER BY scan_id::VARCHAR) AS all_values FROM errors GROUP BY 1")
def _(spark, d):
    e = _errors(spark, d).select((F.col("scan_id") % 10).alias("shard"), F.col("scan_id").cast("string").alias("scan_id"))
    return jobs.distinct_list(e, "shard", "scan_id")


@query("d18_remove_root", f"WITH {PH} SELECT id FROM photos WHERE root_id <> 2")
def _(spark, d):
    return jobs.remove_root(P.roots(spark), P.photos(spark, d), 2)[1].select("id")


@query("t13_recent_imports", f"WITH {PH} SELECT id FROM photos WHERE status = 'active' ORDER BY id DESC LIMIT 18")
def _(spark, d):
    return L.page(P.photos(spark, d), L.ListSpec(sort="added_desc", limit=18)).select("id")


@query("s09_ids_load", f"WITH {PH} SELECT id, sha256 FROM photos WHERE id % 3 = 1")
def _(spark, d):
    p = P.photos(spark, d)
    return p.join(p.where("id % 3 = 1").select("id"), "id", "left_semi").select("id", "sha256")


@query("u05_taken_names", f"WITH {PH} SELECT path FROM photos WHERE starts_with(path, '/lib/es/') UNION SELECT '/lib/es/sorted/' || filename FROM photos WHERE starts_with(path, '/lib/fr/')")
def _(spark, d):
    p = P.photos(spark, d)
    claimed = p.where(L.under("/lib/fr")).select(F.concat(F.lit("/lib/es/sorted/"), "filename").alias("path"))
    return L.paths_under(p, "/lib/es").unionByName(claimed).distinct()
