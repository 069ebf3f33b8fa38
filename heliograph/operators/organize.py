"""Planning a re-organised library: targets, collision-free names, counters."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.columns import basename, date_folder, dated_name, dirname, sanitize_segment, with_suffix
from heliograph.operators.groups import redundant_copies
from heliograph.operators.library import active_under, under
from heliograph.operators.ranks import numbered
from heliograph.schemas import ORGANIZE_MODE, ValidationFailed
from heliograph.storage import Scratch


@dataclass(frozen=True)
class OrganizeSpec:
    folders: tuple[str, ...]
    destination: str
    mode: str = "date"
    rename: bool = False
    skip_duplicates: bool = True


def top_folders(folders: Sequence[str]) -> list[str]:
    """The selected folders, cleaned; none below another."""
    own = {f.rstrip("/") for f in folders} - {""}
    above = lambda f: {f[:i] for i, c in enumerate(f) if c == "/" and i}
    return sorted(f for f in own if not above(f) & own)


def resolved(path: str) -> str:
    """A path with its links followed as far as it exists."""
    return os.path.realpath(path)


def existing_file(path: str) -> str:
    """The regular file that a path leads to."""
    try:
        real = os.path.realpath(path, strict=True)
    except OSError as e:
        raise ValidationFailed(f"{path} leads nowhere: {e}") from e
    if not os.path.isfile(real):
        raise ValidationFailed(f"{real} is not a regular file")
    return real


def ensure_within(path: str, allowed: Sequence[str], what: str = "the file") -> None:
    """Refuse a resolved path that lies in none of the allowed folders, links followed."""
    if not any(path == base or path.startswith(base.rstrip("/") + "/") for base in map(resolved, allowed)):
        raise ValidationFailed(f"{what} is outside the approved folders: {path}")


def checked_spec(spec: OrganizeSpec, roots: Sequence[str], quarantine: str) -> OrganizeSpec:
    """The cleaned spec; refuses an unknown mode, no folder or root, folders outside the roots and a destination in the quarantine.

    Paths are compared with their links followed; the destination need not exist.
    """
    if spec.mode not in ORGANIZE_MODE:
        raise ValidationFailed(f"unknown mode {spec.mode}")
    folders = top_folders(spec.folders)
    if not folders:
        raise ValidationFailed("no folder is selected")
    if not roots:
        raise ValidationFailed("there is no scan root")
    destination, off_limits = resolved(spec.destination), resolved(quarantine)
    if destination == off_limits or destination.startswith(off_limits + "/"):
        raise ValidationFailed("the destination lies in the quarantine")
    for f in folders:
        ensure_within(resolved(f), roots, f"folder {f}")
    return OrganizeSpec(tuple(folders), destination, spec.mode, spec.rename, spec.skip_duplicates)


def target_folder(spec: OrganizeSpec) -> Column:
    if spec.mode == "date":
        return F.concat(F.lit(spec.destination + "/"), date_folder("captured_at"))
    if spec.mode == "camera":
        return F.concat(F.lit(spec.destination + "/"), sanitize_segment("camera_model"))
    out = F.lit(None).cast("string")
    for f in spec.folders:
        below = F.substr(dirname("path"), F.lit(len(f) + 1))
        out = F.when(under(f), F.concat(F.lit(f"{spec.destination}/{f.rsplit('/', 1)[-1]}"), below)).otherwise(out)
    return out


def classified(photos: DataFrame, spec: OrganizeSpec, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Active photos of the folders with their candidate path and class: duplicate, in_place or move."""
    own = active_under(photos, list(spec.folders)).select("id", "path", "filename", "size_bytes", "captured_at", "camera_model")
    copies = redundant_copies(groups, members, own.select("id")).select(F.col("photo_id").alias("id"), F.lit(True).alias("__copy"))
    rows = own.join(copies, "id", "left").withColumn("is_copy", F.coalesce("__copy", F.lit(False))).drop("__copy")
    name = dated_name("captured_at", "filename") if spec.rename else F.col("filename")
    rows = rows.withColumn("candidate", F.concat(target_folder(spec), F.lit("/"), name))
    kind = F.when(F.col("is_copy") & F.lit(spec.skip_duplicates), "duplicate").when(F.col("candidate") == F.col("path"), "in_place").otherwise("move")
    return rows.withColumn("class", kind).withColumn("undated", (F.col("class") != "duplicate") & F.col("captured_at").isNull() & F.lit(spec.mode == "date"))


def origin(path: Column) -> Column:
    """(name, number): the name that suffixing turns into this one and the number it takes; null for a name that no suffixing makes."""
    end = F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(end))
    digits = F.regexp_extract(stem, r"[^/]_(0[1-9]|[1-9][0-9]+)$", 1)
    number = digits.try_cast("long")
    return F.when(number.isNotNull(), F.struct(F.concat(F.substr(stem, F.lit(1), F.length(stem) - F.length(digits) - 1), end).alias("name"), number.alias("number")))


def _suffixed(candidate: Column, number: Column) -> Column:
    return F.when(number == 0, candidate).otherwise(F.concat(dirname(candidate), F.lit("/"), with_suffix(basename(candidate), number)))


def _contested(contests: DataFrame, gaps: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """(name, number, child, won) of contests (name, number, child, before): whether suffixing takes a name before those who ask for it do.

    The photo of ``name`` whose turn for ``number`` comes is the one with as many before it
    as there are free numbers below; it wins if it stands among the ``before`` photos that
    precede the first asking for ``child``.  Numbers that are lost shift all later turns, so
    a name's contests are decided in order, and a name's after the one over itself.
    """
    schema = "name string, number long, child string, won boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lost, out = int(pdf["shifted"].iloc[0]), []
        for r in pdf.sort_values("number").itertuples():
            if r.child is None:
                lost += 1
            else:
                won = r.number - lost < r.before
                lost += not won
                out.append((r.name, r.number, r.child, won))
        return pd.DataFrame(out, columns=["name", "number", "child", "won"])

    taken = gaps.select("name", "number", F.lit(None).cast("string").alias("child"), F.lit(0).cast("long").alias("before"))
    decided = scratch.spark.createDataFrame([], schema)
    for k in range(max_rounds):
        if contests.isEmpty():
            return decided
        ready = contests.join(contests.select(F.col("child").alias("name")), "name", "left_anti")
        own = ready.unionByName(taken.join(ready.select("name"), "name", "left_semi"))
        shifted = own.join(decided.where("won").select(F.col("child").alias("name"), F.lit(1).alias("shifted")), "name", "left").withColumn("shifted", F.coalesce("shifted", F.lit(0)))
        new = scratch.table(shifted.withColumnRenamed("name", "n").withColumn("name", F.col("n")).groupBy("n").applyInPandas(lambda pdf: fold(pdf.drop(columns="n")), schema), f"decided{k}")
        contests = scratch.table(contests.join(new.select("name"), "name", "left_anti"), f"open{k}")
        decided = decided.unionByName(new)
    raise RuntimeError("suffixes are nested too deeply")


def planned_moves(rows: DataFrame, photos: DataFrame, spec: OrganizeSpec) -> DataFrame:
    """(id, src, dest, size_bytes): destinations that collide with nothing, planned or present, whatever its status.

    In path order every photo takes the name it asks for or the first free suffix.  Photos
    that ask for one name take its free numbers in turn, so the k-th photo's number is its
    place among photos and taken numbers: both are merged by how many free numbers stand
    before them, and a distributed rank numbers the whole.  Only names that suffixing can
    turn into others that are asked for need more, one decision for each (``_contested``).
    """
    scratch = Scratch(rows.sparkSession, "moves")
    moves = scratch.table(rows.where("class = 'move'").select("id", F.col("path").alias("src"), "candidate", "size_bytes"), "moves")
    asked = scratch.table(moves.groupBy(F.col("candidate").alias("name")).agg(F.count("*").alias("n"), F.min("src").alias("first")).withColumn("of", origin(F.col("name"))), "asked")
    taken = photos.where(under(spec.destination)).select(F.col("path").alias("name")).distinct()
    hits = F.filter(F.array(F.struct(F.col("name"), F.lit(0).cast("long").alias("number")), origin(F.col("name"))), lambda x: x.isNotNull())
    gaps = taken.select(F.explode(hits).alias("g")).select("g.name", "g.number").join(asked.select("name"), "name", "left_semi")
    gaps = scratch.table(gaps, "gaps")

    free = asked.where("of is not null").join(gaps.where("number = 0").select("name"), "name", "left_anti")
    free = free.select(F.col("of.name").alias("name"), F.col("of.number").alias("number"), F.col("name").alias("child"), "first")
    over = scratch.table(free.join(asked.select("name"), "name", "left_semi"), "over")
    if not over.isEmpty():
        marks = over.select("name", F.col("first").alias("src"), "child", "number")
        photos_of = moves.join(over.select(F.col("name").alias("candidate")), "candidate", "left_semi").select(F.col("candidate").alias("name"), "src", F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("number"))
        among = numbered(scratch.table(marks.unionByName(photos_of), "marked"), ["name"], ["src", "child"], "both").where("child is not null")
        alone = numbered(over, ["name"], ["first", "child"], "own").select("name", "child", "own")
        contests = among.join(alone, ["name", "child"]).select("name", "number", "child", (F.col("both") - F.col("own")).alias("before"))
        decided = _contested(scratch.table(contests, "contests"), gaps, scratch)
        lost = decided.select(F.when(F.col("won"), F.col("child")).otherwise(F.col("name")).alias("name"), F.when(F.col("won"), F.lit(0).cast("long")).otherwise(F.col("number")).alias("number"))
        gaps = scratch.table(gaps.unionByName(lost), "all_gaps")

    holes = gaps.select(F.col("name").alias("candidate")).distinct()
    busy = asked.where("n > 1").select(F.col("name").alias("candidate")).union(holes).distinct()
    calm = moves.join(busy, "candidate", "left_anti").select("id", "src", F.col("candidate").alias("dest"), "size_bytes")
    crowded = numbered(scratch.table(moves.join(busy, "candidate", "left_semi"), "crowded"), ["candidate"], ["src", "id"], "number")
    if not gaps.isEmpty():
        crowded = scratch.table(crowded, "in_turn")
        order = numbered(gaps, ["name"], ["number"], "i").select(F.col("name").alias("candidate"), (F.col("number") - F.col("i")).alias("free"), F.col("number").alias("tie"), F.lit(0).alias("kind"))
        merged = order.unionByName(crowded.withColumns({"free": F.col("number"), "tie": F.col("number"), "kind": F.lit(1)}).drop("number"), allowMissingColumns=True)
        crowded = numbered(scratch.table(merged, "merged"), ["candidate"], ["free", "kind", "tie"], "number").where("kind = 1")
    return calm.unionByName(crowded.select("id", "src", _suffixed(F.col("candidate"), F.col("number")).alias("dest"), "size_bytes"))


def suffixed_fast(rows: DataFrame) -> DataFrame:
    """(id, dest) where no natural name looks like a suffixed one: the k-th photo of a candidate in path order gets suffix k-1."""
    moves = Scratch(rows.sparkSession, "fast").table(rows.where("class = 'move'").select("id", "path", "candidate"), "moves")
    return numbered(moves, ["candidate"], ["path", "id"], "k").select("id", _suffixed(F.col("candidate"), F.col("k")).alias("dest"))


def plan_counters(rows: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("class") == kind)
    return rows.agg(
        F.count("*").alias("total"), F.count_if("is_copy").alias("duplicates_in_set"), n("duplicate").alias("duplicates_skipped"), n("in_place").alias("already_organized"),
        n("move").alias("planned"), F.count_if("undated").alias("undated"), F.coalesce(F.sum(F.when(F.col("class") == "move", F.col("size_bytes"))), F.lit(0)).cast("long").alias("est_bytes"),
    )


def example_paths(moves: DataFrame, limit: int = 3) -> DataFrame:
    """The first destination of each folder in plan order, the first few folders."""
    first = moves.groupBy(dirname("dest").alias("folder")).agg(F.min(F.struct("src", "dest")).alias("m"))
    return first.select("folder", "m.dest", "m.src").orderBy("src").limit(limit).select("folder", "dest")


def rename_example(moves: DataFrame) -> DataFrame:
    own = moves.where(basename("src") != basename("dest"))
    return own.agg(F.min_by(F.struct(basename("src").alias("old"), basename("dest").alias("new")), "src").alias("r")).select("r.old", "r.new")


def executed(photos: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, failures): moves are applied to photos that still are as planned; others fail."""
    m = moves.select("id", F.col("src").alias("__src"), "dest")
    rows = photos.join(m, "id", "left")
    good = F.col("dest").isNotNull() & (F.col("path") == F.col("__src")) & (F.col("status") == "active")
    path = F.when(good, F.col("dest")).otherwise(F.col("path"))
    new = {"path": path, "filename": basename(path), "directory": dirname(path)}
    state = rows.withColumns({k: v for k, v in new.items() if k in photos.columns}).select(photos.columns)
    lost = m.join(photos.where("status = 'active'").select("id", F.col("path").alias("__src")), ["id", "__src"], "left_anti")
    return state, lost.select("id", F.col("__src").alias("src"), F.lit("photo changed since planning").alias("error"))
