"""M1: ride bookings, exactly equal to replaying them in RequestID order.

An accepted booking takes a vehicle *and* lowers a wallet; a rejected one does
neither, so the decisions couple two keys and no single running sum gives
them.  ``operators.bounds`` decides them in rounds: a vehicle is surely taken once an accepted booking lies before the request,
surely free if none and no possible taker does; a balance lies between what is left if every open
booking before the request is accepted and what is left if none is.  Whatever both bounds agree on is
decided, the earliest open request always.  Requests that can no longer succeed
(unknown user or station, a price above the upper bound) hold up neither vehicle nor wallet.

A price or balance that the money type cannot hold rejects its request alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators.bounds import ID_BLOCK, WIDE
from ridegrid.operators.bounds import decide as decide_by_bounds
from ridegrid.operators.commands import CommandResult, _max_id, _replace, change_rows, decide, union_changes
from ridegrid.operators.ids import global_rank, prefix_sum
from ridegrid.schemas import MONEY, RATE
from ridegrid.session import materialize

SPENT = "decimal(22,2)"


def price_requests(requests: DataFrame, users: DataFrame, vehicles: DataFrame, stations: DataFrame,
                   plans: DataFrame) -> DataFrame:
    """Join every request once with the snapshot: rate, discount, cost and the static flags."""
    v = vehicles.select(F.col("VehicleID").alias("__v"), "RatePerHour", F.col("Status").alias("__vs"))
    u = users.select(F.col("UserID").alias("__u"), F.col("WalletBalance").alias("__bal0"), F.col("PlanID").alias("__plan"))
    p = plans.select(F.col("PlanID").alias("__p"), "PlanName")
    s = stations.select(F.col("StationID").alias("__s"))
    r = (requests.join(v, requests.VehicleID == v.__v, "left")
         .join(u, requests.UserID == u.__u, "left")
         .join(p, F.col("__plan") == F.col("__p"), "left")
         .join(s, requests.StartStationID == s.__s, "left"))
    return r.select(
        "RequestID", "RequestTime", "UserID", "VehicleID", "StartStationID", "DurationHours",
        E.ride_cost("RatePerHour", "DurationHours", E.plan_discount("PlanName")).alias("Cost"),
        F.col("RatePerHour").alias("__rate"), E.plan_discount("PlanName").alias("__disc"),
        E.holds(F.col("__vs") == "available").alias("__free0"),
        F.col("__u").isNotNull().alias("__has_user"),
        F.col("__s").isNotNull().alias("__has_station"),
        F.col("__bal0"),
    )


def decide_bookings(priced: DataFrame, block: int = ID_BLOCK) -> tuple[DataFrame, int]:
    """(RequestID, Reason) of every request and the number of rounds (see ``operators.bounds``)."""
    zero = F.lit(E.NO_DISCOUNT).cast(RATE)
    price = ((F.col("__rate") * F.col("DurationHours")) * (F.lit(1) - F.col("__disc"))).cast(WIDE)
    rows = priced.select(
        "RequestID", F.lit("book").alias("Kind"), F.lit(None).alias("__key"), F.col("UserID").alias("__usr"), F.col("VehicleID").alias("__veh"),
        F.lit(0).alias("__target"), "__bal0", F.coalesce("__disc", zero).alias("__disc0"), "__rate", "DurationHours", "__free0", "__has_user",
        "__has_station", *(F.lit(None).alias(c) for c in ("__amt", "__plandisc", "__then", "__e", "__pair", "__open0", "__counted", "__out", "Reason")),
        F.coalesce(price, F.lit(0)).alias("__lo"), F.coalesce(price, F.lit(0)).alias("__hi"), F.lit(False).alias("__dead"))
    decided, rounds = decide_by_bounds(rows, block, linked=False)
    return decided.select("RequestID", "Reason"), rounds


def book_rides(requests: DataFrame, users: DataFrame, vehicles: DataFrame, stations: DataFrame, plans: DataFrame,
               trips: DataFrame, payments: DataFrame) -> CommandResult:
    priced = materialize(price_requests(requests, users, vehicles, stations, plans), "book-priced")
    reasons, rounds = decide_bookings(priced)
    d = decide(priced.join(reasons, "RequestID", "left"), F.col("Reason"))
    decisions = d.select("RequestID", "UserID", "VehicleID", "Cost", "Accepted", "Reason")
    return CommandResult(decisions, lambda: _booked(d, users, vehicles, trips, payments), rounds=rounds)


def _booked(d: DataFrame, users: DataFrame, vehicles: DataFrame, trips: DataFrame,
            payments: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """New snapshots and change rows of the accepted bookings."""
    acc = global_rank(d.where("Accepted"), ["RequestID"], "__i")
    acc = materialize(
        prefix_sum(acc, ["UserID"], "RequestID", F.col("Cost").cast(SPENT), "__before")
        .withColumn("TripID", (F.coalesce(_max_id(trips, "TripID"), F.lit(0)) + F.col("__i")).cast("int"))
        .withColumn("PaymentID", (F.coalesce(_max_id(payments, "PaymentID"), F.lit(0)) + F.col("__i")).cast("int")),
        "book-accepted")
    new_trips = acc.select("TripID", "UserID", "VehicleID", "StartStationID", F.lit(None).cast("int").alias("EndStationID"),
                           F.col("RequestTime").alias("StartTime"),
                           E.expected_end("RequestTime", "DurationHours").alias("EndTime"), "Cost",
                           F.lit("Ongoing").alias("Status"))
    new_payments = acc.select("PaymentID", "TripID", "UserID", F.col("Cost").alias("Amount"),
                              F.col("RequestTime").alias("Timestamp"), F.lit("Success").alias("Status"))
    per_vehicle = acc.groupBy("VehicleID").agg(F.lit(1).alias("__hit"))
    new_vehicles = _replace(vehicles, per_vehicle, "VehicleID", Status=F.lit("in-use"))
    per_user = acc.groupBy("UserID").agg(F.sum(F.col("Cost").cast(SPENT)).alias("__spent"), F.lit(1).alias("__hit"))
    new_users = _replace(users, per_user, "UserID", WalletBalance=(F.col("WalletBalance") - F.col("__spent")).cast(MONEY))

    t1 = change_rows(acc, 1, "Trips", "INSERT", F.col("TripID"), UserID=F.col("UserID"), VehicleID=F.col("VehicleID"),
                     NewStatus=F.lit("Ongoing"))
    t6 = change_rows(acc, 2, "Vehicles", "UPDATE", F.col("VehicleID"), VehicleID=F.col("VehicleID"),
                     OldStatus=F.lit("available"), NewStatus=F.lit("in-use"))
    old = F.col("__bal0") - F.col("__before")
    t9 = change_rows(acc, 3, "Users", "UPDATE", F.col("UserID"), UserID=F.col("UserID"), OldBalance=old.cast(MONEY),
                     NewBalance=(old - F.col("Cost")).cast(MONEY))
    t4 = change_rows(acc, 4, "Payments", "INSERT", F.col("PaymentID"), UserID=F.col("UserID"), Amount=F.col("Cost"),
                     NewStatus=F.lit("Success"))
    return {
        "trips": trips.unionByName(new_trips), "payments": payments.unionByName(new_payments),
        "vehicles": new_vehicles, "users": new_users, "new_trips": new_trips,
    }, union_changes([t1, t6, t9, t4])
