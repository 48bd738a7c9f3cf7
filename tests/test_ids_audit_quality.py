"""Distributed helpers, the audit operator and data-quality rules."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ridegrid.operators import audit as A
from ridegrid.operators import commands as C
from ridegrid.operators import quality as Q
from ridegrid.operators.ids import assign_ids, global_rank, prefix_sum


def test_global_rank_is_gapless_and_ordered(spark):
    df = spark.range(0, 5000, 7).withColumn("k", (F.col("id") * 37) % 1009)
    ranked = global_rank(df, ["k", "id"], "r").collect()
    assert sorted(r.r for r in ranked) == list(range(1, len(ranked) + 1))
    assert [r.id for r in sorted(ranked, key=lambda r: r.r)] == [r.id for r in sorted(ranked, key=lambda r: (r.k, r.id))]
    ids = assign_ids(df, ["id"], F.lit(41), "NewID").agg(F.min("NewID"), F.max("NewID")).first()
    assert tuple(ids) == (42, 41 + df.count())


def test_prefix_sum_spans_blocks(spark):
    rows = [(i, i % 3, Decimal(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "RequestID long, UserID int, v decimal(10,2)")
    got = {r.RequestID: r.s for r in prefix_sum(df, ["UserID"], "RequestID", "v", "s", block=8).collect()}
    run = {}
    for rid, u, v in rows:
        assert got[rid] == run.get(u, 0)
        run[u] = run.get(u, 0) + v


def _changes(spark, rows):
    base = {n: None for n, _ in C.CHANGE_COLUMNS}
    return spark.createDataFrame([tuple({**base, **r}[n] for n, _ in C.CHANGE_COLUMNS) for r in rows], C.CHANGE_SCHEMA)


def test_audit_messages_and_trigger_conditions(spark):
    ts = datetime.datetime(2024, 1, 1)
    ch = _changes(spark, [
        dict(RequestID=1, Step=1, Sub=0, ChangeTimestamp=ts, TableName="Trips", OperationType="INSERT", RecordID=5,
             UserID=2, VehicleID=3, NewStatus="Ongoing"),
        dict(RequestID=1, Step=2, Sub=0, ChangeTimestamp=ts, TableName="Vehicles", OperationType="UPDATE", RecordID=3,
             OldStatus="available", NewStatus="available"),
        dict(RequestID=1, Step=3, Sub=0, ChangeTimestamp=ts, TableName="Users", OperationType="UPDATE", RecordID=2,
             OldBalance=None, NewBalance=Decimal("1.00")),
        dict(RequestID=2, Step=1, Sub=0, ChangeTimestamp=ts, TableName="Users", OperationType="UPDATE", RecordID=2,
             OldBalance=Decimal("10.00"), NewBalance=Decimal("7.50")),
        dict(RequestID=2, Step=2, Sub=0, ChangeTimestamp=ts, TableName="Payments", OperationType="INSERT", RecordID=9,
             UserID=2, Amount=Decimal("2.50"), NewStatus="Success"),
    ])
    logs = A.audit(ch).orderBy("LogID").collect()
    assert [r.ChangeDescription for r in logs] == [
        "New trip created: UserID=2, VehicleID=3, Status=Ongoing",
        "Wallet balance changed from 10.00 to 7.50",
        "Payment created: Amount=2.50, Status=Success, UserID=2",
    ]
    assert [r.LogID for r in logs] == [1, 2, 3]


def test_snapshot_audit_vehicle_status(spark):
    before = spark.createDataFrame([(1, "available"), (2, "in-use")], "VehicleID int, Status string")
    after = spark.createDataFrame([(1, "in-use"), (2, "in-use"), (3, "available")], "VehicleID int, Status string")
    rows = A.snapshot_audit("Vehicles", before, after, "VehicleID").collect()
    assert sorted((r.RecordID, r.OperationType, r.OldStatus, r.NewStatus) for r in rows) == [
        (1, "UPDATE", "available", "in-use"), (3, "INSERT", None, "available")]


class Dirty:
    """A data set with one violation of every rule family, on top of the clean seed tables."""

    def __init__(self, td):
        self.td, self.spark = td, td.spark

    def table(self, name):
        df = self.td.table(name)
        if name == "stations":
            df = df.union(df.where("StationID = 1"))  # a key twice
        if name == "trips":
            df = df.withColumn("VehicleID", F.when(F.col("TripID") == 2, F.lit(-5)).otherwise(F.col("VehicleID")))
            df = df.withColumn("Status", F.when(F.col("TripID") == 3, F.lit("Lost")).otherwise(F.col("Status")))
        if name == "technicians":
            df = df.withColumn("Name", F.when(F.col("TechnicianID") == 4, F.repeat(F.lit("n"), 101)).otherwise(F.col("Name")))
        if name == "vehicles":
            df = df.withColumn("Model", F.when(F.col("VehicleID") != 6, F.col("Model")))
        return df

    def __getattr__(self, name):
        return getattr(self.td, name)


def test_quality_families_find_each_violation(spark, td):
    clean, dirty = td, Dirty(td)

    def new(family):
        rows = {tuple(r) for r in family(dirty).collect()} - {tuple(r) for r in family(clean).collect()}
        return sorted((r[0], r[1], r[2], r[3]) for r in rows)

    assert new(Q.dq_pk) == [("primary_key", "stations", "StationID=1", "count=2")]
    assert ("foreign_key", "trips", "TripID=2", "VehicleID=-5 not in vehicles.VehicleID") in new(Q.dq_fk)
    assert new(Q.dq_enum) == [("domain", "trips", "TripID=3", "Status=Lost")]
    assert new(Q.dq_length) == [("length", "technicians", "TechnicianID=4", "Name length 101 > 100")]
    assert new(Q.dq_not_null) == [("not_null", "vehicles", "VehicleID=6", "Model")]
    rules = {r[0] for r in new(Q.dq_report)}
    assert rules == {"primary_key", "foreign_key", "domain", "length", "not_null"}


def test_unique_rule_ignores_case(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "A@X"), (3, None)], "UserID int, Email string")
    assert Q.unique_violations("users", users, ("Email",), True).count() == 1


def test_deleted_payment_has_no_trigger(spark):
    before = spark.createDataFrame([(1, "Success"), (2, "Success")], "PaymentID int, Status string")
    after = before.where("PaymentID = 1")
    changes = A.snapshot_audit("Payments", before, after, "PaymentID")
    assert changes.count() == 1 and A.audit(changes).count() == 0


def test_prefix_blocks_are_dealt_by_key_and_block(spark):
    """Also when the input is already dealt by the key alone: a hot user is not one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(100).select(F.col("id").alias("RequestID"), (F.col("id") % 3).alias("UserID"))
        b = spark.range(3).select(F.col("id").alias("UserID"), F.lit(1).alias("v"))
        df = prefix_sum(a.join(b, "UserID"), ["UserID"], "RequestID", "v", "s", block=8)
        plan = df._jdf.queryExecution().executedPlan().toString()
        window = plan.index("windowspecdefinition(UserID#")
        below = plan[window:]
        assert "__blk" in below[below.index("Exchange hashpartitioning"):].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
