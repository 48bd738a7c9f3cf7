"""M4 with M5 in one batch: least-loaded assignment while slots are released again.

Takes (accepted reports) go to the available technician with the least
``(load, TechnicianID)``; releases (completed logs) lower a technician's load
by one, floored at 0.  A release may free the technician of a take of the same
batch, so loads rise and fall and no single ranking of slots gives the result.

The events are numbered and cut into blocks of ``BLOCK``.  A block replays its
events from given loads; which loads it starts from depends on the block
before it.  So all blocks start from a guess (the total load spread evenly),
and blocks are replayed again while the loads at their start, or the technicians
that their releases free, differ from what they were replayed with.  The first block is
right at once, and a block is right one round after its predecessors, so the
result is the replay in order; blocks in which the loads level out are
right no matter where they started, so few rounds are needed.  Only blocks with
changed inputs run again.  A task holds one block and one load per technician.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.operators.ids import global_rank
from ridegrid.session import materialize

BLOCK = 1 << 16


def _replay_block(events: pd.DataFrame, loads: pd.DataFrame) -> pd.DataFrame:
    """One block from its opening loads: the technician of every event and the closing loads."""
    load = dict(zip(loads["TechnicianID"].tolist(), loads["load"].tolist(), strict=True))
    heap = [(load[t], t) for t, free in zip(loads["TechnicianID"].tolist(), loads["free"].tolist(), strict=True) if free]
    takers = {t for _, t in heap}
    heapq.heapify(heap)
    events = events.sort_values("seq")
    given: dict[int, int] = {}
    out = []
    for seq, take, tech, of in zip(events["seq"].tolist(), events["take"].tolist(), events["TechnicianID"].tolist(),
                                   events["of_seq"].tolist(), strict=True):
        if take:
            tech = None
            while heap:
                size, first = heapq.heappop(heap)
                if load[first] == size:  # else a stale entry
                    tech = first
                    load[first] = size + 1
                    heapq.heappush(heap, (size + 1, first))
                    break
            given[seq] = tech
        else:
            if of == of and of in given:
                tech = given[of]
            tech = None if tech is None or tech != tech else int(tech)
            if tech in load and load[tech] > 0:
                load[tech] -= 1
                if tech in takers:
                    heapq.heappush(heap, (load[tech], tech))
        out.append((int(seq), tech, None))
    out += [(None, t, n) for t, n in load.items()]
    got = pd.DataFrame(out, columns=["seq", "TechnicianID", "load"], dtype="object")
    got["block"] = int(events["block"].iloc[0])
    return got


def _even_guess(blocks: DataFrame, technicians: DataFrame) -> DataFrame:
    """Opening loads of every block if the total were spread evenly over the available technicians."""
    total = technicians.where("IsAvailable").agg(F.coalesce(F.sum("ActiveAssignments"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("t"))
    ranked = global_rank(technicians.where("IsAvailable").select("TechnicianID"), ["TechnicianID"], "i")
    each = technicians.join(ranked, "TechnicianID", "left").crossJoin(F.broadcast(total))  # one row
    even = F.greatest(F.col("s") + F.col("net"), F.lit(0))
    spread = F.floor(even / F.col("t")) + F.when(F.col("i") <= even % F.col("t"), 1).otherwise(0)
    load = F.when((F.col("block") == 0) | ~F.col("IsAvailable"), F.col("ActiveAssignments")).otherwise(spread)
    # One row per block and technician: the state every block needs.
    return each.crossJoin(blocks).select("block", "TechnicianID", F.col("IsAvailable").alias("free"), load.cast("long").alias("load"))


def dispatch(events: DataFrame, technicians: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """(RequestID, TechnicianID) of every event, the closing loads, and the number of rounds.

    ``events``: RequestID, take (boolean), TechnicianID (of a release of an earlier
    assignment, else NULL), of (RequestID of the take that a release frees, else NULL).
    """
    spark = events.sparkSession
    technicians = technicians.select("TechnicianID", F.coalesce("IsAvailable", F.lit(False)).alias("IsAvailable"), "ActiveAssignments")
    seq = F.col("seq") - 1
    ranked = global_rank(events.select("RequestID", "take", "TechnicianID", "of"), ["RequestID"], "seq")
    ranked = materialize(ranked.withColumn("block", F.floor(seq / block)), "dispatch-events")
    takes = ranked.where("take").select(F.col("RequestID").alias("of"), F.col("seq").alias("of_seq"), F.col("block").alias("of_block"))
    rows = materialize(ranked.join(takes, "of", "left").select(
        "RequestID", "seq", "block", "take", "TechnicianID", "of_seq", "of_block"), "dispatch-rows")
    per_block = rows.groupBy("block").agg(F.sum(F.when(F.col("take"), 1).otherwise(-1)).alias("own"))
    from pyspark.sql import Window

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = per_block.select("block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("net"))
    opening = materialize(_even_guess(blocks, technicians), "dispatch-opening")
    # What crosses blocks: releases of takes of an earlier block.
    far = materialize(rows.where(F.col("of_block") < F.col("block")).select("seq", "block", "of_seq", "of_block"), "dispatch-far")
    freed = far.select("seq", F.lit(None).cast("int").alias("far_tech")).limit(0)
    fields = "seq long, TechnicianID int, load long, block long"
    done, rounds, dirty = None, 0, blocks.select("block")
    while True:
        rounds += 1
        ready = rows.join(dirty, "block", "left_semi").join(freed, "seq", "left").select(
            "seq", "block", "take", F.coalesce("TechnicianID", "far_tech").alias("TechnicianID"), "of_seq")
        got = ready.groupBy("block").cogroup(opening.join(dirty, "block", "left_semi").groupBy("block")).applyInPandas(_replay_block, fields)
        got = materialize(got, "dispatch-round")
        if done is not None:
            got = materialize(done.join(dirty, "block", "left_anti").unionByName(got), "dispatch-state")
        done = got
        closing = done.where("seq IS NULL").select((F.col("block") + 1).alias("block"), "TechnicianID", "load")
        was = opening
        opening = materialize(was.join(closing.withColumnRenamed("load", "now"), ["block", "TechnicianID"], "left").select(
            "block", "TechnicianID", "free", F.coalesce("now", "load").alias("load")), "dispatch-opening")
        moved = opening.join(was.withColumnRenamed("load", "old"), ["block", "TechnicianID"]).where("load != old").select("block")
        now = done.where("seq IS NOT NULL").select(F.col("seq").alias("of_seq"), F.col("TechnicianID").alias("far_tech"))
        old = freed.withColumnRenamed("far_tech", "old")
        held = materialize(far.join(now, "of_seq").join(old, "seq", "left").select("seq", "block", "far_tech", "old"), "dispatch-far")
        freed = held.select("seq", "far_tech")
        other = held.where(~F.col("far_tech").eqNullSafe(F.col("old"))).select("block")
        dirty = materialize(moved.unionByName(other).distinct(), "dispatch-dirty")
        if dirty.isEmpty():
            break
    assigned = rows.join(done.where("seq IS NOT NULL").select("seq", F.col("TechnicianID").alias("__tech")), "seq", "left").select(
        "RequestID", "take", F.col("__tech").alias("TechnicianID"))
    last = done.where("seq IS NULL").join(per_block.agg(F.max("block").alias("block")), "block").select("TechnicianID", F.col("load").alias("now"))
    loads = technicians.join(last, "TechnicianID", "left").select(
        "TechnicianID", F.coalesce("now", "ActiveAssignments").cast("int").alias("ActiveAssignments"))
    return assigned, loads, rounds
