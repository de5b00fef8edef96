"""The ledger as a stream: state per entity that a batch fold over the same events would give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline import vocab

#: The fold of each field is associative: it keeps the event that won and that event's number.
STATE = "outcome string, outcome_id long, outcome_rank int, score double, score_id long, sightings long, last_id long"
OUTPUT = "entity string, outcome string, score double, sightings long"


def stream_state(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of events (event_id, entity, outcome, score) -> the state of each entity that a micro-batch touched.

    An elimination outranks any verdict; of equal rank the later event wins; the last score that is not zero stays. Events may
    come in any order and over any number of micro-batches.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome, outcome_id, rank, score, score_id, n, last = state.get if state.exists else ("", -1, 0, 0.0, -1, 0, -1)
        for frame in frames:
            frame = frame.sort_values("event_id")
            ranks = frame.outcome.map(lambda o: 2 if o == "eliminated" else 0 if o in vocab.MECHANICAL else 1)
            best = ranks.max()
            if best and best >= rank:
                won = frame[ranks == best].iloc[-1]
                if best > rank or won.event_id > outcome_id:
                    outcome, outcome_id, rank = won.outcome, int(won.event_id), int(best)
            scored = frame[frame.score != 0]
            if len(scored) and scored.event_id.iloc[-1] > score_id:
                score, score_id = float(scored.score.iloc[-1]), int(scored.event_id.iloc[-1])
            n, last = n + len(frame), max(last, int(frame.event_id.iloc[-1]))
        state.update((outcome, outcome_id, rank, score, score_id, n, last))
        yield pd.DataFrame([(key[0], outcome, score, n)], columns=["entity", "outcome", "score", "sightings"])

    chosen = events.select("event_id", "entity", F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return chosen.groupBy("entity").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def attempt_windows(attempts: DataFrame, *, watermark: str = "2 hours", window: str = "6 hours") -> DataFrame:
    """Counts and cost of attempts per provider and window of event time; late rows within the watermark still count."""
    return (
        attempts.withWatermark("created_at", watermark).groupBy(F.window("created_at", window).alias("w"), "provider")
        .agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "verified").alias("verified"), F.sum("cost").alias("cost"))
        .select(F.col("w.start").alias("start"), "provider", "attempts", "verified", F.round("cost", 6).alias("cost"))
    )
