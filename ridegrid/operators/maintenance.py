"""M4: report vehicle issues and assign the least-loaded available technician.

Sequential least-loaded assignment equals ranking *slots*: technician t with
load l offers slots l, l+1, l+2, ...; the i-th accepted report (RequestID
order) takes the i-th smallest slot (value, TechnicianID).  Only slots below
the water level ``L = ceil((n + sum(load)) / T)`` are generated: there are at
least n of them and the n smallest are all below L, so no slot that can be
used is missing and the slot table is O(n + T), never T x n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators.bounds import NOT_YOUR_VEHICLE
from ridegrid.operators.commands import FK_REASON, CommandResult, _max_id, _replace, _with_first, change_rows, decide, \
    first_failure, union_changes
from ridegrid.operators.ids import global_rank
from ridegrid.operators.views import authorised_reports
from ridegrid.session import materialize

# Rejection texts.
BLANK_ISSUE = "Please describe the issue"


SLOT_BLOCK = 4096


def technician_slots(technicians: DataFrame, n: int) -> DataFrame:
    """The n smallest (value, TechnicianID) slots of the available technicians, ranked 1..n
    (fewer only when no technician is available)."""
    avail = technicians.where(F.col("IsAvailable")).select("TechnicianID", "ActiveAssignments")
    stats = avail.agg(F.count(F.lit(1)).alias("t"), F.sum("ActiveAssignments").alias("s")).first()
    if n == 0 or not stats["t"]:
        return avail.select("TechnicianID", F.lit(0).cast("long").alias("SlotRank")).limit(0)
    level = -(-(n + int(stats["s"] or 0)) // int(stats["t"]))  # ceil
    # A technician's slots come out block by block, and the blocks are dealt to tasks before they
    # are opened: the few technician rows do not decide how many tasks make the slots.
    blocks = avail.where(F.col("ActiveAssignments") < level).select(
        "TechnicianID", "ActiveAssignments",
        F.explode(F.sequence(F.lit(0), F.floor((F.lit(level - 1) - F.col("ActiveAssignments")) / SLOT_BLOCK))).alias("__block"))
    first = F.col("ActiveAssignments") + F.col("__block") * SLOT_BLOCK
    slots = blocks.repartition("TechnicianID", "__block").select(
        "TechnicianID", F.explode(F.sequence(first, F.least(first + SLOT_BLOCK - 1, F.lit(level - 1)))).alias("SlotValue"))
    ranked = global_rank(slots, ["SlotValue", "TechnicianID"], "SlotRank")
    return ranked.where(F.col("SlotRank") <= n).select("TechnicianID", "SlotRank")


def report_and_assign(requests: DataFrame, trips: DataFrame, vehicles: DataFrame, technicians: DataFrame,
                      logs: DataFrame, assignments: DataFrame) -> CommandResult:
    v = vehicles.select(F.col("VehicleID").alias("__v"), F.col("Status").alias("__vs"))
    r = authorised_reports(requests, trips).join(v, F.col("VehicleID") == F.col("__v"), "left")
    d = decide(r, first_failure(
        (F.col("IssueReported").isNotNull() & ~E.non_blank("IssueReported"), BLANK_ISSUE),
        (~E.truthy_id("UserID"), "User ID required"),
        (~F.col("Authorised"), NOT_YOUR_VEHICLE),
        (F.col("IssueReported").isNull(), "Column 'IssueReported' cannot be null"),
        (F.col("__v").isNull(), FK_REASON.format("VehicleID")),
    ))
    acc = global_rank(d.where("Accepted"), ["RequestID"], "__i")
    n = acc.count()
    slots = technician_slots(technicians, n)
    acc = (acc.join(slots, acc.__i == slots.SlotRank, "left")
           .withColumn("LogID", (F.coalesce(_max_id(logs, "LogID"), F.lit(0)) + F.col("__i")).cast("int"))
           .withColumn("AssignmentID", F.when(F.col("TechnicianID").isNotNull(),
                                              (F.coalesce(_max_id(assignments, "AssignmentID"), F.lit(0))
                                               + F.col("__i")).cast("int"))))
    acc = materialize(_with_first(acc, "VehicleID"), "report-accepted")
    decisions = d.join(acc.select("RequestID", "LogID", "TechnicianID"), "RequestID", "left").select(
        "RequestID", "VehicleID", "Accepted", "Reason", "LogID", "TechnicianID")

    new_logs = acc.select("LogID", "VehicleID", "IssueReported", F.col("RequestTime").cast("date").alias("ReportedDate"),
                          F.when(F.col("TechnicianID").isNotNull(), "In-Progress").otherwise("Pending").alias("Status"))
    new_asg = acc.where(F.col("TechnicianID").isNotNull()).select("AssignmentID", "LogID", "TechnicianID")
    loads = new_asg.groupBy("TechnicianID").agg(F.count(F.lit(1)).alias("__n"), F.lit(1).alias("__hit"))
    new_tech = _replace(technicians, loads, "TechnicianID",
                        ActiveAssignments=(F.col("ActiveAssignments") + F.col("__n")).cast("int"))
    to_maint = acc.where((F.col("RequestID") == F.col("__first_VehicleID")) & (F.col("__vs") == "available"))
    hits = to_maint.select("VehicleID", F.lit(1).alias("__hit"))
    new_vehicles = _replace(vehicles, hits, "VehicleID", Status=F.lit("under-maintenance"))

    t6 = change_rows(to_maint, 1, "Vehicles", "UPDATE", F.col("VehicleID"), VehicleID=F.col("VehicleID"),
                     OldStatus=F.lit("available"), NewStatus=F.lit("under-maintenance"))
    t7 = change_rows(acc, 2, "MaintenanceLogs", "INSERT", F.col("LogID"), VehicleID=F.col("VehicleID"),
                     Issue=F.col("IssueReported"), NewStatus=F.lit("Pending"))
    t8 = change_rows(acc.where(F.col("TechnicianID").isNotNull()), 3, "MaintenanceLogs", "UPDATE", F.col("LogID"),
                     OldStatus=F.lit("Pending"), NewStatus=F.lit("In-Progress"))
    return CommandResult(decisions, {
        "maintenance_logs": logs.unionByName(new_logs), "technician_assignments": assignments.unionByName(new_asg),
        "technicians": new_tech, "vehicles": new_vehicles, "new_logs": new_logs,
    }, union_changes([t6, t7, t8]))
