"""Reviews of duplicates as a stream: each reviewer's queue is kept as state and choices turn it into decisions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heliograph.operators.review import PairQueue
from heliograph.schemas import ValidationFailed

#: reviewer, seq (the order of a reviewer's steps), step (start, skip or a choice), queue (of a start, as JSON) and nothing else.
STEPS = "reviewer string, seq long, step string, queue string"
DECISIONS = "reviewer string, seq long, group_id long, photo_id long, decision string, freed long, error string"


def queue_json(items: dict[int, tuple[int, list[int]]], sizes: dict[int, int]) -> str:
    """A review's first queue, {group: (keeper, members left)} in order, and the photos' sizes."""
    return json.dumps([[[g, k, left] for g, (k, left) in items.items()], list(sizes.items()), 0])


def _loaded(text: str) -> PairQueue:
    items, sizes, freed = json.loads(text)
    return PairQueue({g: (k, left) for g, k, left in items}, dict(map(tuple, sizes)), freed)


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A reviewer's new steps in order; a step that makes no sense is a row with an error and changes nothing."""
    steps = pd.concat(list(parts)).sort_values("seq")
    text, last = state.get if state.exists else (queue_json({}, {}), -1)
    queue, out = _loaded(text), []
    for r in steps.itertuples():
        if r.seq <= last:  # sent again
            continue
        last, error = r.seq, None
        queue.decisions = []
        try:
            if r.step == "start":
                queue = _loaded(r.queue)
            elif r.step == "skip":
                queue.skip()
            else:
                queue.decide(r.step)
        except (ValidationFailed, TypeError, ValueError) as e:
            error = str(e)
        out += [(key[0], r.seq, g, p, d, queue.freed, None) for g, p, d in queue.decisions]
        if error is not None:
            out.append((key[0], r.seq, None, None, None, queue.freed, error))
    state.update((json.dumps([[[g, k, left] for g, (k, left) in queue.items.items()], list(queue.sizes.items()), queue.freed]), last))
    columns = [c.split()[0] for c in DECISIONS.split(", ")]
    yield pd.DataFrame(out, columns=columns).astype({"group_id": "Int64", "photo_id": "Int64", "seq": "int64", "freed": "int64"})


def decisions(steps: DataFrame) -> DataFrame:
    """The decisions that a stream of steps leads to, two for each pair, with the bytes freed so far.

    Steps of one reviewer are taken in the order of ``seq`` within a batch and must not come
    in a later batch than greater ones; one that was taken is passed over when it comes again.
    """
    return steps.groupBy("reviewer").applyInPandasWithState(_fold, DECISIONS, "queue string, last long", "append", GroupStateTimeout.NoTimeout)
