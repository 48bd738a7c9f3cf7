"""In-order acceptance against a shrinking room, as distributed phases.

Every key (a user) has some room (a balance, or what is left up to the
largest balance) and an ordered list of requests with costs.  A request is
accepted iff its cost fits the room that the accepted ones before it left.
With no negative costs the room never grows: once a cost c did not fit, no
later cost >= c of that key will.  That turns the per-key fold into a few
*phases*, each a block-split prefix sum:

1. requests whose cost reached the key's rejected threshold are rejected;
2. over the rest, in RequestID order, running sums: all requests up to the
   first whose sum exceeds the room are accepted, that one is rejected and its
   cost is the new threshold;
3. the room drops by the accepted sum and the key's other requests go on.

Each phase lowers the threshold, so a key takes at most one phase per distinct
cost, and no key's requests are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators.ids import prefix_sum
from ridegrid.session import materialize

ROOM = "decimal(22,2)"


def accept_in_order(pending: DataFrame) -> DataFrame:
    """(RequestID, UserID, __cost, __room) -> (RequestID, __ok) for every row.

    One materialized frame per phase carries everything the next phase needs
    (the rows after each key's first failure, and that failure's room and cost).
    """
    falls = pending.groupBy("UserID").agg((F.min("__cost") >= 0).alias("__falls"))
    todo = pending.join(falls, "UserID").select(
        "RequestID", "UserID", F.col("__cost").cast(ROOM).alias("__cost"), F.col("__room").cast(ROOM).alias("__room"),
        F.lit(None).cast(ROOM).alias("__thr"), "__falls")
    out = []
    while True:
        too_much = E.holds(F.col("__falls") & (F.col("__cost") >= F.col("__thr")))
        out.append(todo.where(too_much).select("RequestID", F.lit(False).alias("__ok")))
        run = prefix_sum(todo.where(~too_much), ["UserID"], "RequestID", "__cost", "__cum", inclusive=True)
        fails = run.where(F.col("__cum") > F.col("__room")).groupBy("UserID").agg(
            F.min(F.struct("RequestID", "__cost", (F.col("__cum") - F.col("__cost")).alias("before"))).alias("__f"))
        run = materialize(run.join(fails, "UserID", "left"), "ordered-phase")
        fid = F.col("__f.RequestID")
        out.append(run.where(F.col("__f").isNull() | (F.col("RequestID") <= fid))
                   .select("RequestID", (F.col("__f").isNull() | (F.col("RequestID") < fid)).alias("__ok")))
        todo = run.where(F.col("RequestID") > fid).select(
            "RequestID", "UserID", "__cost", (F.col("__room") - F.col("__f.before")).cast(ROOM).alias("__room"),
            F.col("__f.__cost").cast(ROOM).alias("__thr"), "__falls")
        if todo.isEmpty():
            break
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def overflowing(requests: DataFrame) -> DataFrame | None:
    """RequestIDs that do not fit the room of their key; None if every key's requests all fit.

    Only keys whose costs add up to more than their room go through the phases.
    A NULL room is without end.
    """
    adding = F.greatest(F.col("__cost").cast(ROOM), F.lit(0))
    tight = requests.groupBy("UserID").agg(F.sum(adding).alias("__all"), F.min("__room").alias("__least")).where(
        F.col("__all") > F.col("__least")).select("UserID")
    if tight.isEmpty():
        return None
    ok = accept_in_order(requests.join(tight, "UserID", "left_semi"))
    return ok.where(~F.col("__ok")).select("RequestID", F.lit(True).alias("__over"))
