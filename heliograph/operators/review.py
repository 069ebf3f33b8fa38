"""Reviewing groups: decisions, group status, the pair queue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.schemas import ValidationFailed

PAIR = ("ext", "size_bytes", "width", "height", "captured_at", "camera_model")


def apply_decisions(decisions: DataFrame, request: DataFrame) -> DataFrame:
    """(group_id, photo_id, decision) after a request; ``undecided`` takes a decision back."""
    both = decisions.select("group_id", "photo_id", F.col("decision").alias("old")).join(request.select("group_id", "photo_id", F.col("decision").alias("new")), ["group_id", "photo_id"], "full_outer")
    return both.select("group_id", "photo_id", F.coalesce("new", "old").alias("decision")).where("decision <> 'undecided'")


def group_status(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """A group is reviewed once all its members are decided."""
    rows = members.join(decisions.select("group_id", "photo_id", "decision"), ["group_id", "photo_id"], "left")
    return rows.groupBy("group_id").agg(F.when(F.bool_and(F.col("decision").isNotNull()), "reviewed").otherwise("pending").alias("status"))


def checked_request(members: list[int], request: dict[int, str], force: bool = False) -> None:
    """Refuse decisions about strangers, unknown decisions, and removing a whole group at once."""
    if unknown := {d for d in request.values()} - {"keep", "remove", "undecided"}:
        raise ValidationFailed(f"unknown decision {sorted(unknown)[0]}")
    if outside := set(request) - set(members):
        raise ValidationFailed(f"photo {min(outside)} is not in the group")
    if not force and {p for p, d in request.items() if d == "remove"} >= set(members):
        raise ValidationFailed("this would remove every copy")


def dismiss(groups: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id").alias("group_id"), F.lit(True).alias("__hit")).distinct()
    return groups.join(hit, "group_id", "left").withColumn("status", F.when(F.col("__hit"), "dismissed").otherwise(F.col("status"))).drop("__hit")


def reopen(groups: DataFrame, decisions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    hit = ids.select(F.col("id").alias("group_id"), F.lit(True).alias("__hit")).distinct()
    state = groups.join(hit, "group_id", "left").withColumn("status", F.when(F.col("__hit"), "pending").otherwise(F.col("status"))).drop("__hit")
    return state, decisions.join(hit, "group_id", "left_anti")


def review_queue(groups: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group_id, keeper_id, photo_id, position): the undecided non-keepers of pending groups; without a keeper the first member is one."""
    first = members.groupBy("group_id").agg(F.min("photo_id").alias("first_id"))
    pending = groups.where("status = 'pending'").join(first, "group_id").select("group_id", F.coalesce("keeper_photo_id", "first_id").alias("keeper_id"))
    open_rows = members.join(decisions.select("group_id", "photo_id"), ["group_id", "photo_id"], "left_anti").join(pending, "group_id").where("photo_id <> keeper_id")
    return open_rows.select("group_id", "keeper_id", "photo_id", F.row_number().over(Window.partitionBy("group_id").orderBy("photo_id")).alias("position"))


def pair_diff(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """(keeper_id, photo_id, attribute, same): six attributes of each pair, equal or not (nulls are equal)."""
    k, p = photos.alias("k"), photos.alias("p")
    both = pairs.join(k, F.col("keeper_id") == F.col("k.id")).join(p, F.col("photo_id") == F.col("p.id"))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"k.{a}").eqNullSafe(F.col(f"p.{a}")).alias("same")) for a in PAIR))).alias("r")
    return both.select("keeper_id", "photo_id", rows).select("keeper_id", "photo_id", "r.*")


@dataclass
class PairQueue:
    """The interactive fold over a review queue: {group: (keeper, [members left])}, sizes by photo."""

    items: dict[int, tuple[int, list[int]]]
    sizes: dict[int, int] = field(default_factory=dict)
    freed: int = 0
    decisions: list[tuple[int, int, str]] = field(default_factory=list)

    def current(self) -> tuple[int, int, int] | None:
        return next(((g, k, left[0]) for g, (k, left) in self.items.items() if left), None)

    def decide(self, choice: str) -> None:
        """keep_a, keep_b, keep_both or remove_both for the current (keeper, member) pair."""
        at = self.current()
        if at is None:
            raise ValidationFailed("nothing is left to review")
        if choice not in ("keep_a", "keep_b", "keep_both", "remove_both"):
            raise ValidationFailed(f"unknown choice {choice}")
        group, keeper, other = at
        removed = {"keep_a": [other], "keep_b": [keeper], "keep_both": [], "remove_both": [keeper, other]}[choice]
        rest = self.items[group][1][1:]
        self.decisions += [(group, p, "remove" if p in removed else "keep") for p in (keeper, other)]
        self.freed += sum(self.sizes.get(p, 0) for p in removed)
        if choice == "keep_b":
            keeper = other
        elif choice == "remove_both" and rest:
            keeper, rest = rest[0], rest[1:]
        self.items[group] = (keeper, rest)

    def skip(self) -> None:
        """Put the current pair after the others of its group; the last pair of a group goes after all groups."""
        if at := self.current():
            keeper, left = self.items[at[0]]
            if len(left) > 1:
                self.items[at[0]] = (keeper, [*left[1:], left[0]])
            else:
                self.items[at[0]] = self.items.pop(at[0])
