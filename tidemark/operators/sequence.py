"""Event sequencing: order, dwell and direction of transitions, and removal of impossible ones until none is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between

#: One step back is a legal correction, more is impossible; so is leaving a terminal stage.
STEPS_BACK, MOST_PASSES = 2, 20


def quarantine_before(events: DataFrame, deals: DataFrame, deal: str, at: str, received: str, take: Sequence[str] = ()) -> DataFrame:
    """Events with a reason why they can't be sequenced: no such deal, or earlier than the deal's receipt; null where they can. take: columns of the deal that come along."""
    d = deals.select(F.col(deal).alias("__d"), F.col(received).alias("__received"), *take)
    return events.join(d, F.col(deal) == F.col("__d"), "left").withColumn("reason", F.when(F.col("__d").isNull(), "orphan_deal").when(F.col(at) < F.col("__received"), "before_receipt")).drop("__d", "__received")


def only(events: DataFrame, deal: str, deals: Sequence | None = None) -> DataFrame:
    """Events of some deals; None means all."""
    return events if deals is None else events.filter(F.array_contains(F.lit(list(deals)), F.col(deal)))


def sequence(events: DataFrame, deal: str, at: str, line: str, order: str, terminal: str, stage: str) -> DataFrame:
    """Adds event_seq, from_stage (0 for the first), days_in_prev_stage (time in the stage that is left), is_forward and is_impossible."""
    w = Window.partitionBy(deal).orderBy(at, line)
    before = F.lag(order).over(w)
    return events.withColumns(
        {
            "event_seq": F.row_number().over(w),
            "from_stage": F.coalesce(F.lag(stage).over(w), F.lit(0)),
            "days_in_prev_stage": days_between(F.col(at), F.lag(at).over(w)),
            "is_forward": F.coalesce(F.col(order) > before, F.lit(True)),
            "is_impossible": F.coalesce(F.lag(terminal).over(w), F.lit(False)) | F.coalesce(F.col(order) <= before - STEPS_BACK, F.lit(False)),
        }
    )


def settle(events: DataFrame, deal: str, at: str, line: str, order: str, terminal: str, stage: str, keep) -> tuple[DataFrame, DataFrame, int]:
    """(accepted, removed with their pass, passes): impossible events go and their deals are sequenced again, since a removal can make
    another transition impossible. Only deals that lost an event are looked at again. keep(df) cuts the lineage of a pass.

    Whether a deal lost one is a flag over its own window, so a pass is one shuffle by deal, and none if it is there already.
    """
    columns = events.columns

    def passed(df: DataFrame) -> DataFrame:
        flagged = sequence(df, deal, at, line, order, terminal, stage)
        return keep(flagged.withColumn("__hit", F.max("is_impossible").over(Window.partitionBy(deal))))

    todo = passed(events)
    settled, removed = [], []
    for number in range(1, MOST_PASSES + 1):
        bad = todo.filter("is_impossible").drop("__hit")
        settled.append(todo.filter("not __hit").drop("__hit"))
        if bad.limit(1).count() == 0:
            accepted = settled[0]
            for s in settled[1:]:
                accepted = accepted.unionByName(s)
            gone = removed[0] if removed else bad.withColumn("pass", F.lit(0))
            for r in removed[1:]:
                gone = gone.unionByName(r)
            return accepted.drop("is_impossible"), gone, number
        removed.append(bad.withColumn("pass", F.lit(number)))
        todo = passed(todo.filter("__hit and not is_impossible").select(*columns))
    raise RuntimeError(f"events still contradict each other after {MOST_PASSES} passes")


def milestones(sequenced: DataFrame, deals: DataFrame, deal: str, at: str, stage: str, names: dict[int, str], received: str) -> DataFrame:
    """One row for each deal: first time in each stage, distinct stages, reopenings (not forward), the last stage and time. Deals without events stay."""
    last = F.max(F.struct("event_seq", F.col(stage).alias("stage")))
    per = sequenced.groupBy(F.col(deal).alias("__d")).agg(
        *[F.min(F.when(F.col(stage) == k, F.col(at))).alias(f"{n}_ts") for k, n in names.items()], F.count_distinct(stage).alias("stage_count"), F.count(F.when(~F.col("is_forward"), 1)).alias("reopen_count"), last["stage"].alias("current_stage"), F.max(at).alias("last_event_ts")
    )
    out = deals.join(per, F.col(deal) == F.col("__d"), "left").drop("__d")
    return out.withColumns({"stage_count": F.coalesce("stage_count", F.lit(0)), "reopen_count": F.coalesce("reopen_count", F.lit(0)), "current_stage": F.coalesce("current_stage", F.lit(1)), "last_event_ts": F.coalesce("last_event_ts", F.col(received))})
