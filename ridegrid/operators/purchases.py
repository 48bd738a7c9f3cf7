"""M8: membership purchases, exactly equal to replaying them per user in order.

A purchase is accepted iff the running balance is at least the plan cost, and
an accepted purchase lowers the balance: ``ordered.accept_in_order`` with the
balance as room.  Its phases are at most one more than the distinct plan costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators.commands import CommandResult, _replace, change_rows, decide, first_failure
from ridegrid.operators.ids import prefix_sum
from ridegrid.operators.ordered import accept_in_order
from ridegrid.schemas import MONEY
from ridegrid.session import materialize

NONE_BALANCE = "float() argument must be a string or a real number, not 'NoneType'"


def purchase_memberships(requests: DataFrame, users: DataFrame, plans: DataFrame) -> CommandResult:
    p = plans.select(F.col("PlanID").alias("__p"), F.col("Cost").alias("__cost"))
    u = users.select(F.col("UserID").alias("__u"), F.col("WalletBalance").alias("__bal0"))
    r = requests.join(p, requests.PlanID == p.__p, "left").join(u, requests.UserID == u.__u, "left")
    static = first_failure(
        (~(E.truthy_id("UserID") & E.truthy_id("PlanID")), "user_id and plan_id are required"),
        (F.col("__p").isNull(), "Plan not found"),
        (F.col("__u").isNull(), "User not found"),
        (F.col("__bal0").isNull(), NONE_BALANCE),
    )
    r = r.withColumn("__static", static)
    r = materialize(r, "purchase-requests")
    ok = accept_in_order(r.where(F.col("__static").isNull()).select(
        "RequestID", "UserID", "__cost", F.col("__bal0").alias("__room")))
    d = decide(r.join(ok, "RequestID", "left"),
               F.coalesce(F.col("__static"), F.when(~F.col("__ok"), F.lit("Insufficient wallet balance"))))
    decisions = d.select("RequestID", "UserID", "PlanID", "Accepted", "Reason")
    return CommandResult(decisions, lambda: _bought(d.where("Accepted"), users))


def _bought(acc: DataFrame, users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    per_user = acc.groupBy("UserID").agg(F.sum("__cost").alias("__spent"), F.max_by("PlanID", "RequestID").alias("__plan"),
                                         F.lit(1).alias("__hit"))
    new_users = _replace(users, per_user, "UserID",
                         WalletBalance=(F.col("WalletBalance") - F.col("__spent")).cast(MONEY),
                         PlanID=F.col("__plan"))
    run = prefix_sum(acc, ["UserID"], "RequestID", "__cost", "__before")
    old = F.col("__bal0") - F.col("__before")
    changes = change_rows(run, 1, "Users", "UPDATE", F.col("UserID"), UserID=F.col("UserID"),
                          OldBalance=old.cast(MONEY), NewBalance=(old - F.col("__cost")).cast(MONEY))
    return {"users": new_users}, changes
