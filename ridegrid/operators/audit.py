"""Change-audit operator: the reference's row triggers as one projection.

``audit(changes, logs)`` turns change rows (``CHANGE_COLUMNS``) into audit
log rows.  The nine triggers become one CASE expression over
(TableName, OperationType) and one filter for the conditional ones (vehicle
and maintenance status must differ, wallet balance must differ with plain
``<>`` so a NULL on either side logs nothing).  It is a single narrow scan;
the only shuffle is the range sort that numbers the new LogIDs after the
existing maximum in (RequestID, Step, Sub) order.

``snapshot_audit`` derives the same rows from two snapshots with a full
outer join on the key; it cannot see updates that leave a row unchanged, so
the every-touch triggers (trip / payment updates) are exact only from change
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridegrid.operators.commands import change_rows
from ridegrid.operators.ids import assign_ids

# The reference's audit message templates, per trigger.
#   T1 Trips INSERT             'New trip created: UserID=<u>, VehicleID=<v>, Status=<s>'
#   T2 Trips UPDATE             'Trip updated from Status=<old> to <new>'
#   T3 Trips DELETE             'Trip record deleted'
#   T4 Payments INSERT          'Payment created: Amount=<a>, Status=<s>, UserID=<u>'
#   T5 Payments UPDATE          'Payment status changed from <old> to <new>'
#   T6 Vehicles UPDATE          'Vehicle status changed from <old> to <new>'        (only if different)
#   T7 MaintenanceLogs INSERT   'Maintenance issue reported for VehicleID=<v>, Issue: <issue>'
#   T8 MaintenanceLogs UPDATE   'Maintenance log status changed from <old> to <new>' (only if different)
#   T9 Users UPDATE             'Wallet balance changed from <old> to <new>'         (only if different)


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _is(table: str, op: str) -> Column:
    return (F.col("TableName") == table) & (F.col("OperationType") == op)


def message() -> Column:
    """ChangeDescription of a change row (NULL parts give NULL, as CONCAT does)."""
    return (
        F.when(_is("Trips", "INSERT"), F.concat(F.lit("New trip created: UserID="), _s("UserID"),
                                                F.lit(", VehicleID="), _s("VehicleID"), F.lit(", Status="),
                                                F.col("NewStatus")))
        .when(_is("Trips", "UPDATE"), F.concat(F.lit("Trip updated from Status="), F.col("OldStatus"), F.lit(" to "),
                                               F.col("NewStatus")))
        .when(_is("Trips", "DELETE"), F.lit("Trip record deleted"))
        .when(_is("Payments", "INSERT"), F.concat(F.lit("Payment created: Amount="), _s("Amount"),
                                                  F.lit(", Status="), F.col("NewStatus"), F.lit(", UserID="),
                                                  _s("UserID")))
        .when(_is("Payments", "UPDATE"), F.concat(F.lit("Payment status changed from "), F.col("OldStatus"),
                                                  F.lit(" to "), F.col("NewStatus")))
        .when(_is("Vehicles", "UPDATE"), F.concat(F.lit("Vehicle status changed from "), F.col("OldStatus"),
                                                  F.lit(" to "), F.col("NewStatus")))
        .when(_is("MaintenanceLogs", "INSERT"), F.concat(F.lit("Maintenance issue reported for VehicleID="),
                                                         _s("VehicleID"), F.lit(", Issue: "), F.col("Issue")))
        .when(_is("MaintenanceLogs", "UPDATE"), F.concat(F.lit("Maintenance log status changed from "),
                                                         F.col("OldStatus"), F.lit(" to "), F.col("NewStatus")))
        .when(_is("Users", "UPDATE"), F.concat(F.lit("Wallet balance changed from "), _s("OldBalance"), F.lit(" to "),
                                               _s("NewBalance")))
    )


def fires() -> Column:
    """Whether a change row produces a log row (trigger conditions; NULL comparisons do not fire)."""
    differs_status = F.coalesce(F.col("OldStatus") != F.col("NewStatus"), F.lit(False))
    differs_balance = F.coalesce(F.col("OldBalance") != F.col("NewBalance"), F.lit(False))
    always = (F.col("TableName") == "Trips") | _is("Payments", "INSERT") | _is("Payments", "UPDATE") | _is(
        "MaintenanceLogs", "INSERT")  # a deleted payment has no trigger
    return (
        F.when(_is("Vehicles", "UPDATE") | _is("MaintenanceLogs", "UPDATE"), differs_status)
        .when(_is("Users", "UPDATE"), differs_balance)
        .otherwise(always)
    )


def audit(changes: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Change rows -> new Logs rows; LogIDs continue after ``logs``' maximum."""
    rows = changes.where(fires()).select(
        "RequestID", "Step", "Sub", "TableName", "OperationType", "RecordID",
        F.lit(None).cast("int").alias("ChangedBy"), message().alias("ChangeDescription"), "ChangeTimestamp")
    existing = logs.select(F.max("LogID")).scalar() if logs is not None else F.lit(0)
    out = assign_ids(rows, ["RequestID", "Step", "Sub"], existing, "LogID")
    return out.select("LogID", "TableName", "OperationType", "RecordID", "ChangedBy", "ChangeDescription",
                      "ChangeTimestamp")


def audit_messages(changes: DataFrame) -> DataFrame:
    """E5 on its own: the message of every change row that fires (no id numbering)."""
    return changes.where(fires()).select("RequestID", "Step", "Sub", "TableName", "OperationType", "RecordID",
                                         message().alias("ChangeDescription"))


def snapshot_audit(table: str, before: DataFrame, after: DataFrame, key: str, at: Column | None = None) -> DataFrame:
    """Change rows from two snapshots of one table (full outer join on the key).

    Vehicles / MaintenanceLogs compare ``Status``, Users ``WalletBalance``,
    Trips and Payments give INSERT / DELETE for appearing / disappearing keys
    and UPDATE when the status differs.  ``at`` is the change timestamp.
    """
    value = "WalletBalance" if table == "Users" else "Status"
    b = before.select(F.col(key).alias("__k"), F.col(value).alias("__old"))
    a = after.select(F.col(key).alias("__k2"), F.col(value).alias("__new"), *[c for c in after.columns
                                                                               if c in ("UserID", "VehicleID", "Amount")])
    j = b.join(a, b.__k == a.__k2, "full_outer")
    rec = F.coalesce(F.col("__k2"), F.col("__k"))
    op = F.when(F.col("__k").isNull(), "INSERT").when(F.col("__k2").isNull(), "DELETE").otherwise("UPDATE")
    payload = {}
    if value == "Status":
        payload.update(OldStatus=F.col("__old").cast("string"), NewStatus=F.col("__new").cast("string"))
    else:
        payload.update(OldBalance=F.col("__old"), NewBalance=F.col("__new"))
    for c in ("UserID", "VehicleID", "Amount"):
        if c in after.columns:
            payload[c] = F.col(c)
    j = (j.withColumn("RequestID", rec.cast("long"))
         .withColumn("RequestTime", at if at is not None else F.lit(None).cast("timestamp_ntz"))
         .withColumn("__op", op))
    differs = F.coalesce(F.col("__old") != F.col("__new"), F.lit(False))
    j = j.where((F.col("__op") != "UPDATE") | differs)
    return change_rows(j, 1, table, F.col("__op"), rec, **payload)
