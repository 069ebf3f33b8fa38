"""Duplicate groups: byte-identical, near-identical, and keeping stored groups up to date.

Derived groups are member rows (kind, key, keeper_photo_id, photo_id, similarity_pct).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.columns import band, hamming, similarity_pct
from heliograph.operators.components import connected_components
from heliograph.operators.library import is_active
from heliograph.schemas import Settings
from heliograph.storage import Scratch

#: Similarity graphs of up to so many links (8 MB) are solved in one task; larger ones in rounds of joins.
ONE_TASK_EDGES = 500_000
#: The columns that groups are derived from.
_NEEDED = ["id", "sha256", "phash", "size_bytes", "width", "height"]
MEMBER = ["kind", "key", "keeper_photo_id", "photo_id", "similarity_pct"]


def keeper_rank() -> Column:
    """Most pixels, then most bytes, then the smallest id."""
    pixels = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0))
    return F.struct(pixels.alias("pixels"), F.col("size_bytes"), (-F.col("id")).alias("first"))


def exact_groups(photos: DataFrame) -> DataFrame:
    """Photos with equal content, two or more."""
    own = photos.where(F.col("sha256").isNotNull())
    keepers = own.groupBy(F.col("sha256").alias("key")).agg(F.count("*").alias("n"), F.max_by("id", keeper_rank()).alias("keeper_photo_id")).where("n > 1").drop("n")
    members = own.select(F.col("sha256").alias("key"), F.col("id").alias("photo_id"))
    return members.join(keepers.hint("merge"), "key").select(F.lit("exact").alias("kind"), "key", "keeper_photo_id", "photo_id", F.lit(100).alias("similarity_pct"))


def _keys(threshold: int) -> Column:
    """The values of column phash at every choice of up to three of the bytes that two hashes within ``threshold`` bits must share.

    ``at`` is the choice and its value in one long; ``skipped`` has the lowest bit of each
    byte below the choice's last that is not of the choice.
    """
    Settings(hamming=threshold)
    chosen = combinations(range(8), min(3, 8 - threshold))
    value = lambda places: sum((F.shiftleft(band("phash", b), 8 * i) for i, b in enumerate(places)), F.lit(sum(1 << b for b in places) << 24))
    skipped = lambda places: F.lit(sum(1 << 8 * b for b in range(places[-1]) if b not in places)).cast("long")
    return F.array(*(F.struct(value(places).cast("long").alias("at"), skipped(places).alias("skipped")) for places in chosen))


def _lists(hashes: DataFrame, threshold: int) -> DataFrame:
    """(phash, at, skipped): a row for each choice of bytes.

    Spark takes the exploded rows for as small as the table they come from, so that it
    must be told not to collect and broadcast them.
    """
    return hashes.select("phash", F.explode(_keys(threshold)).alias("k")).select("phash", "k.at", "k.skipped").hint("merge")


def _met(threshold: int) -> Column:
    """Whether rows a and b of lists are within ``threshold`` bits and meet on the first bytes they share, so that a pair is made once.

    They do if every byte that the choice skipped differs.  The bits of a byte are folded
    into its lowest, which keeps the join's code short enough to compile.
    """
    folded = F.col("a.phash").bitwiseXOR(F.col("b.phash"))
    for n in (4, 2, 1):
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, n))
    return (F.col("a.at") == F.col("b.at")) & (hamming("a.phash", "b.phash") <= threshold) & (folded.bitwiseAND(F.col("a.skipped")) == F.col("a.skipped"))


def hamming_links(hashes: DataFrame, threshold: int) -> DataFrame:
    """(src, dst) of distinct hashes (column phash) within ``threshold`` bits, src > dst.

    Two hashes t bits apart agree on at least 8 - t of their 8 bytes, so they meet on
    some choice of that many bytes: an equality join on up to three bytes at once
    instead of one on single bytes, whose buckets hold 1/256 of all hashes each.
    """
    lists = _lists(hashes, threshold)
    met = lists.alias("a").join(lists.alias("b"), _met(threshold) & (F.col("a.phash") > F.col("b.phash")))
    return met.select(F.col("a.phash").alias("src"), F.col("b.phash").alias("dst"))


def hash_components(photos: DataFrame, threshold: int) -> DataFrame:
    """(phash, component): equal hashes are collapsed first; the component is its smallest hash."""
    distinct = photos.where(F.col("phash").isNotNull()).select("phash").distinct()
    distinct = Scratch(photos.sparkSession, "hashes").table(distinct, "distinct")
    found = connected_components(hamming_links(distinct, threshold), one_task_edges=ONE_TASK_EDGES).withColumnRenamed("node", "phash")
    return distinct.join(found.hint("merge"), "phash", "left").select("phash", F.coalesce("component", "phash").alias("component"))


def similar_groups(photos: DataFrame, threshold: int = 6) -> DataFrame:
    """Components of near-identical hashes with two or more contents; percent is against the keeper."""
    own = photos.select(*_NEEDED).where(F.col("sha256").isNotNull() & F.col("phash").isNotNull())
    return _similar(Scratch(photos.sparkSession, "similar").table(own, "own"), threshold)  # read twice: the six columns are worth writing once


def _similar(own: DataFrame, threshold: int) -> DataFrame:
    """``similar_groups`` of a written table whose photos all have a content and a hash."""
    placed = own.join(hash_components(own, threshold).hint("merge"), "phash")  # a row for each hash is nothing to collect and broadcast
    # the number of contents is over one exactly if the smallest and the largest differ
    heads = placed.groupBy("component").agg(
        F.min("sha256").alias("key"), F.max("sha256").alias("__last"), F.max_by(F.struct("id", "phash"), keeper_rank()).alias("keeper")
    ).where("key <> __last")
    pct = similarity_pct(hamming("phash", "keeper.phash"))
    return placed.join(heads.hint("merge"), "component").select(F.lit("similar").alias("kind"), "key", F.col("keeper.id").alias("keeper_photo_id"), F.col("id").alias("photo_id"), pct.alias("similarity_pct"))


def derive_groups(photos: DataFrame, threshold: int = 6) -> DataFrame:
    """Exact and similar groups of the active photos, which are worked out and written once for both."""
    active = Scratch(photos.sparkSession, "derived").table(photos.where(is_active()).select(*_NEEDED), "active")
    return exact_groups(active).unionByName(_similar(active.where("sha256 is not null and phash is not null"), threshold))


def group_reclaimable(members: DataFrame, groups: DataFrame, photos: DataFrame) -> DataFrame:
    """Bytes to win in each group by keeping its keeper; without one, the largest stays."""
    sized = members.join(photos.select(F.col("id").alias("photo_id"), "size_bytes"), "photo_id").join(groups.select("group_id", "keeper_photo_id"), "group_id")
    kept = F.max(F.when(F.col("photo_id") == F.col("keeper_photo_id"), F.col("size_bytes")))
    return sized.groupBy("group_id").agg(F.greatest(F.lit(0), F.sum("size_bytes") - F.coalesce(kept, F.max("size_bytes"))).cast("long").alias("reclaimable_bytes"))


# -- stored groups -----------------------------------------------------------------


def numbered_after(rows: DataFrame, start: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with new ids after the largest of ``start`` (one row, column top), in order of (kind, key).

    Numbers are given within buckets of the first two characters of the hexadecimal
    key and moved by the buckets before, so no task sorts all rows.
    """
    bucketed = rows.withColumn("__b", F.concat("kind", F.left(key, F.lit(2))))
    sizes = bucketed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy("kind", key))
    return bucketed.withColumn("__rn", within).join(F.broadcast(before), "__b").crossJoin(F.broadcast(start)).withColumn("id", F.coalesce("top", F.lit(0)) + F.col("__before") + F.col("__rn")).drop("__b", "__rn", "__before", "top")


def merge_groups(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """What a full rebuild does to each group: (kind, key, id, action, keeper_photo_id, status).

    ``stored`` has id, kind, key, status, keeper_photo_id.  Groups keep their id by (kind, key).
    """
    heads = derived.groupBy("kind", "key").agg(F.max("keeper_photo_id").alias("new_keeper"))
    both = stored.join(heads, ["kind", "key"], "full_outer")
    known = both.where("id is not null").select(
        "kind", "key", "id", F.when(F.col("new_keeper").isNull(), "delete").otherwise("update").alias("action"), F.coalesce("new_keeper", "keeper_photo_id").alias("keeper_photo_id"), "status"
    )
    fresh = numbered_after(both.where("id is null").select("kind", "key", F.col("new_keeper").alias("keeper_photo_id")), stored.agg(F.max("id").alias("top")))
    return known.unionByName(fresh.select("kind", "key", "id", F.lit("insert").alias("action"), "keeper_photo_id", F.lit("pending").alias("status")))


def sync_members(derived: DataFrame, stored: DataFrame, members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group statuses, surviving decisions) after a rebuild.

    A reviewed group whose members changed is pending again, a dismissed one stays so;
    the decisions of departed members go.
    """
    target = derived.join(stored.select("id", "kind", "key"), ["kind", "key"]).select(F.col("id").alias("group_id"), "photo_id", F.lit(True).alias("is_new"))
    both = members.select("group_id", "photo_id", F.lit(True).alias("is_old")).join(target, ["group_id", "photo_id"], "full_outer")
    changed = both.groupBy("group_id").agg(F.bool_or(F.col("is_old").isNull() | F.col("is_new").isNull()).alias("changed"))
    status = stored.join(changed, stored["id"] == changed["group_id"], "left").select(
        stored["id"].alias("group_id"), F.when((F.col("status") == "reviewed") & F.col("changed"), "pending").otherwise(F.col("status")).alias("status")
    )
    return status, decisions.join(target.select("group_id", "photo_id"), ["group_id", "photo_id"], "left_semi")


def band_neighbours(photos: DataFrame, seeds: DataFrame, threshold: int = 6) -> DataFrame:
    """(seed_id, photo_id, distance): active photos near a seed by hash.

    Distinct hashes are joined by equality on several bytes at once, verified in the join;
    copies of a hash come in afterwards, by its value, so that a pair of photos is made once.
    """
    hashed = lambda df, name: df.where(F.col("phash").isNotNull()).select(F.col("id").alias(name), F.col("phash").alias(f"{name}_hash"))
    s, p = hashed(seeds, "seed_id"), hashed(photos.where(is_active()), "photo_id")
    a, b = (_lists(df.select(F.col(f"{name}_hash").alias("phash")).distinct(), threshold) for df, name in ((s, "seed_id"), (p, "photo_id")))
    near = a.alias("a").join(b.alias("b"), _met(threshold)).select(F.col("a.phash").alias("seed_id_hash"), F.col("b.phash").alias("photo_id_hash"))
    pairs = near.hint("merge").join(s.hint("merge"), "seed_id_hash").hint("merge").join(p.hint("merge"), "photo_id_hash").where("seed_id <> photo_id")
    return pairs.select("seed_id", "photo_id", hamming("seed_id_hash", "photo_id_hash").alias("distance")).distinct()


def sha_mates(photos: DataFrame, seeds: DataFrame) -> DataFrame:
    """Active photos with the content of any seed, seeds included."""
    shas = photos.join(seeds.select("id").hint("merge"), "id", "left_semi").where(F.col("sha256").isNotNull()).select("sha256").distinct()
    return photos.where(is_active()).join(shas.hint("merge"), "sha256", "left_semi").select("id")


def affected(photos: DataFrame, touched: DataFrame, members: DataFrame, threshold: int = 6) -> DataFrame:
    """(id): the closed neighbourhood of the touched photos: near ones, copies, and all members of the groups they are in."""
    seeds = photos.join(touched.hint("merge"), "id", "left_semi")
    near = band_neighbours(photos, seeds, threshold).select(F.col("photo_id").alias("id"))
    mates = sha_mates(photos, touched)
    around = touched.select("id").unionByName(near).unionByName(mates).distinct()
    groups = members.join(around.hint("merge"), F.col("photo_id") == F.col("id"), "left_semi").select("group_id").distinct()
    mine = members.join(groups.hint("merge"), "group_id", "left_semi").select(F.col("photo_id").alias("id"))
    return around.unionByName(mine).distinct()


def bounded_rebuild(photos: DataFrame, touched: DataFrame, stored: DataFrame, members: DataFrame, threshold: int = 6) -> DataFrame:
    """Member rows after re-deriving only around the touched photos; equals a full rebuild if the rest is up to date.

    A stored group is in scope if a member is; one outside that holds an identity about
    to be derived is in scope too.  The scope and the stored groups grow with the library,
    so that none of them is broadcast, however small their files are.
    """
    scratch = Scratch(photos.sparkSession, "bounded")
    scope = scratch.table(affected(photos, touched, members, threshold), "scope")
    fresh = scratch.table(derive_groups(photos.join(scope.hint("merge"), "id", "left_semi"), threshold), "fresh")
    inside = members.join(scope.hint("merge"), F.col("photo_id") == F.col("id"), "left_semi").select("group_id").distinct()
    squatting = stored.join(fresh.select("kind", "key").distinct().hint("merge"), ["kind", "key"], "left_semi").select(F.col("id").alias("group_id"))
    dropped = inside.unionByName(squatting).distinct()
    kept = stored.join(dropped.hint("merge"), stored["id"] == dropped["group_id"], "left_anti").select(F.col("id").alias("group_id"), "kind", "key", "keeper_photo_id")
    rest = members.join(kept.hint("merge"), "group_id").select(*MEMBER)
    return rest.unionByName(fresh.select(*MEMBER))


def full_rebuild_is_better(touched: int, total: int, settings: Settings = Settings()) -> bool:
    return touched == 0 or total == 0 or touched / total > settings.full_rebuild_share


def prune(groups: DataFrame, members: DataFrame, photos: DataFrame, gone: DataFrame) -> DataFrame:
    """(group_id, photo_id, keeper_photo_id) after photos left: groups of fewer than two active members go, a lost keeper is re-elected."""
    left = members.join(gone.select(F.col("id").alias("photo_id")), "photo_id", "left_anti")
    own = photos.where(is_active()).select(F.col("id").alias("photo_id"), F.col("id"), "size_bytes", "width", "height")
    live = left.join(own, "photo_id").join(groups.select("group_id", "keeper_photo_id"), "group_id")
    heads = live.groupBy("group_id").agg(
        F.count("*").alias("n"), F.max_by("id", keeper_rank()).alias("best"), F.max("keeper_photo_id").alias("keeper"), F.bool_or(F.col("id") == F.col("keeper_photo_id")).alias("has")
    ).where("n > 1")
    return left.join(heads, "group_id").select("group_id", "photo_id", F.when(F.col("has"), F.col("keeper")).otherwise(F.col("best")).alias("keeper_photo_id"))


def restore(photos: DataFrame, back: DataFrame) -> DataFrame:
    """Exact groups that returning photos belong to again; near-identical ones wait for a rebuild."""
    active = photos.where(is_active())
    shas = active.join(back.select("id"), "id", "left_semi").select("sha256").distinct()
    return exact_groups(active.join(shas, "sha256", "left_semi"))


def redundant_copies(groups: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """Photos of ``ids`` that are in an exact group and not its keeper."""
    exact = groups.where("kind = 'exact'").select("group_id", "keeper_photo_id")
    return members.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").join(exact, "group_id").where("photo_id <> keeper_photo_id").select("photo_id").distinct()


def groups_touching(members: DataFrame, ids: DataFrame) -> DataFrame:
    return members.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("group_id").distinct()


def fully_covered(members: DataFrame, photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups with active members, every one of them among ``ids`` (relational division)."""
    live = members.join(photos.where(is_active()).select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    hit = live.join(ids.select(F.col("id").alias("photo_id"), F.lit(True).alias("hit")).distinct(), "photo_id", "left")
    return hit.groupBy("group_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_hit")).where("all_hit").select("group_id")


def group_detail(groups: DataFrame, members: DataFrame, decisions: DataFrame, photos: DataFrame) -> DataFrame:
    """One row a group with its members in order of photo id, each with its decision or null."""
    rows = members.join(photos.select(F.col("id").alias("photo_id"), "path", "size_bytes"), "photo_id").join(decisions.select("group_id", "photo_id", "decision"), ["group_id", "photo_id"], "left")
    packed = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("photo_id", "path", "size_bytes", "similarity_pct", "decision"))).alias("members"))
    return groups.join(packed, "group_id")


def list_groups(groups: DataFrame, kind: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = groups if kind is None else groups.where(F.col("kind") == kind)
    out = out if status is None else out.where(F.col("status") == status)
    return out.orderBy("group_id").offset(offset).limit(min(limit, 100))
