"""Registered streaming queries; each equals its batch counterpart, so the
oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.operators import booking, purchases
from ridegrid.operators import commands as C
from ridegrid.plans import q_commands as QC
from ridegrid.plans.registry import register, register_raw
from ridegrid.sources.testdata import TestData
from ridegrid.streaming import streams as S


@register("stream_audit", """
SELECT RequestID, Step, Sub, TableName, OperationType, CAST(RecordID AS INT) AS RecordID, msg AS ChangeDescription,
       ts AS ChangeTimestamp
FROM ch WHERE fire""", QC.CANCEL_CTES + [("ch", QC.CANCEL_CH)])
def stream_audit(td: TestData):
    """Cancellation change rows streamed through the audit projection."""
    return S.stream_audit(td.spark, QC._cancel(td).changes)


@register("stream_topups_balances", """
SELECT u.UserID, CASE WHEN s.UserID IS NULL THEN u.WalletBalance
                      ELSE CAST(u.WalletBalance + s.added AS DECIMAL(10,2)) END AS WalletBalance
FROM users u LEFT JOIN (SELECT UserID, sum(amount_value) AS added FROM d WHERE Reason IS NULL GROUP BY UserID) s
  ON s.UserID = u.UserID""", [("d", QC.TOPUP_D)])
def stream_topups_balances(td: TestData):
    """Top-ups applied per micro-batch give the batch balances."""
    return S.stream_topups(td.spark, td.topup_requests(), td.users()).select("UserID", "WalletBalance")


def _oracle(key: str) -> str:
    """The batch key's oracle: a stream of commands must leave the same tables."""
    from ridegrid.plans.registry import ORACLES
    return ORACLES[key]


def _streamed(td: TestData, feed: DataFrame, names: tuple[str, ...], apply) -> dict[str, DataFrame]:
    return S.stream_commands(td.spark, S.in_arrivals(feed), {n: td.table(n) for n in names}, apply)


@register_raw("stream_book_rides_users", _oracle("book_rides_users"))
def stream_book_rides_users(td: TestData):
    """S2 with M1: wallets after bookings that arrive in two parts."""
    out = _streamed(td, td.booking_requests(), ("users", "vehicles", "trips", "payments"), lambda batch, now: booking.book_rides(
        batch, now["users"], now["vehicles"], td.stations(), td.membership_plans(), now["trips"], now["payments"]).tables)
    return out["users"].select("UserID", "WalletBalance")


@register_raw("stream_end_rides_vehicles", _oracle("end_rides_vehicles"))
def stream_end_rides_vehicles(td: TestData):
    """S2 with M2: vehicles after rides that end in two parts."""
    out = _streamed(td, td.end_requests(), ("trips", "vehicles"), lambda batch, now: C.end_rides(
        batch, now["trips"], now["vehicles"], td.stations()).tables)
    return out["vehicles"].select("VehicleID", "Status", "CurrentStationID")


@register_raw("stream_cancel_trips_balances", _oracle("cancel_trips_balances"))
def stream_cancel_trips_balances(td: TestData):
    """S2 with M3: wallets after cancellations that arrive in two parts."""
    out = _streamed(td, td.cancel_requests(), ("trips", "vehicles", "users", "payments"), lambda batch, now: C.cancel_trips(
        batch, now["trips"], now["vehicles"], now["users"], now["payments"]).tables)
    return out["users"].select("UserID", "WalletBalance")


@register_raw("stream_purchases_users", _oracle("purchase_memberships_users"))
def stream_purchases_users(td: TestData):
    """S2 with M8: wallets and plans after purchases that arrive in two parts."""
    out = _streamed(td, td.purchase_requests(), ("users",), lambda batch, now: purchases.purchase_memberships(
        batch, now["users"], td.membership_plans()).tables)
    return out["users"].select("UserID", "WalletBalance", "PlanID")


def decided_vehicle_events(td: TestData) -> DataFrame:
    """Accepted / applied requests of every vehicle-changing command as events."""
    ev = "VehicleID", "RequestID", "RequestTime", "Kind", "StationID"
    trips = td.trips().select(F.col("TripID").alias("__t"), F.col("VehicleID").alias("__tv"),
                              F.col("StartStationID").alias("__tss"))
    end = C.end_rides(td.end_requests(), td.trips(), td.vehicles(), td.stations()).decisions.where("Applied")
    end = end.join(td.end_requests().select("RequestID", "RequestTime"), "RequestID").join(
        trips, F.col("TripID") == F.col("__t")).select(
        F.col("__tv").alias("VehicleID"), "RequestID", "RequestTime", F.lit("end").alias("Kind"),
        F.col("EndStationID").alias("StationID"))
    cancel = QC._cancel(td).decisions.where("Applied").join(td.cancel_requests().select("RequestID", "RequestTime"),
                                                           "RequestID")
    cancel = cancel.join(trips, F.col("TripID") == F.col("__t")).select(
        F.col("__tv").alias("VehicleID"), "RequestID", "RequestTime", F.lit("cancel").alias("Kind"),
        F.col("__tss").alias("StationID"))
    rep = QC._report(td).decisions.where("Accepted").join(td.report_requests().select("RequestID", "RequestTime"),
                                                         "RequestID")
    rep = rep.select("VehicleID", "RequestID", "RequestTime", F.lit("report").alias("Kind"),
                     F.lit(None).cast("int").alias("StationID"))
    logs = td.maintenance_logs().select(F.col("LogID").alias("__l"), F.col("VehicleID").alias("__lv"))
    comp = QC._complete(td).decisions.where("Accepted").join(
        td.complete_requests().select("RequestID", "RequestTime"), "RequestID").join(logs, F.col("LogID") == F.col("__l"))
    comp = comp.select(F.col("__lv").alias("VehicleID"), "RequestID", "RequestTime", F.lit("complete").alias("Kind"),
                       F.lit(None).cast("int").alias("StationID"))
    dec = C.decommission_vehicles(td.decommission_requests(), td.vehicles()).decisions.where("Accepted").join(
        td.decommission_requests().select("RequestID", "RequestTime"), "RequestID")
    dec = dec.select("VehicleID", "RequestID", "RequestTime", F.lit("decommission").alias("Kind"),
                     F.lit(None).cast("int").alias("StationID"))
    book = QC._book(td).decisions.where("Accepted").join(td.booking_requests().select("RequestID", "RequestTime"),
                                                         "RequestID")
    book = book.select("VehicleID", "RequestID", "RequestTime", F.lit("book").alias("Kind"),
                       F.lit(None).cast("int").alias("StationID"))
    out = end
    for part in (cancel, rep, comp, dec, book):
        out = out.unionByName(part.select(*ev))
    return out.select(*ev)


STATE_CTES = QC.BOOK_CTES + [
    ("end_d", QC.END_D), ("cancel_d", QC.CANCEL_D), ("report_d", QC.REPORT_D), ("complete_d", QC.COMPLETE_D),
    ("decom_d", QC.DECOM_D),
]
STATE_BODY = QC.BOOK_WALK + """,
ev AS (
  SELECT tv AS VehicleID, RequestID, RequestTime, 'end' AS Kind, EndStationID AS StationID
  FROM end_d WHERE Reason IS NULL AND t_id IS NOT NULL
  UNION ALL SELECT tv, RequestID, RequestTime, 'cancel', tss FROM cancel_d WHERE Reason IS NULL AND t_id IS NOT NULL
  UNION ALL SELECT VehicleID, RequestID, RequestTime, 'report', NULL FROM report_d WHERE Reason IS NULL
  UNION ALL SELECT mv, RequestID, RequestTime, 'complete', NULL FROM complete_d WHERE Reason IS NULL
  UNION ALL SELECT VehicleID, RequestID, RequestTime, 'decommission', NULL FROM decom_d WHERE Reason IS NULL
  UNION ALL SELECT q.VehicleID, q.RequestID, q.RequestTime, 'book', NULL FROM q JOIN walk w ON w.i = q.i
            WHERE w.i > 0 AND w.Reason IS NULL),
evk AS (
  SELECT *, CASE Kind WHEN 'book' THEN 1 WHEN 'end' THEN 2 WHEN 'cancel' THEN 3 WHEN 'report' THEN 4
                      WHEN 'complete' THEN 5 ELSE 6 END AS k FROM ev),
last_set AS (
  SELECT VehicleID, RequestID, RequestTime, k,
         CASE Kind WHEN 'book' THEN 'in-use' WHEN 'decommission' THEN 'decommissioned' ELSE 'available' END AS st
  FROM (SELECT *, row_number() OVER (PARTITION BY VehicleID ORDER BY RequestTime DESC, RequestID DESC, k DESC) AS rn
        FROM evk WHERE Kind <> 'report') x WHERE rn = 1),
last_station AS (
  SELECT VehicleID, StationID FROM (
    SELECT *, row_number() OVER (PARTITION BY VehicleID ORDER BY RequestTime DESC, RequestID DESC, k DESC) AS rn
    FROM evk WHERE Kind IN ('end', 'cancel')) x WHERE rn = 1),
base AS (
  SELECT v.VehicleID, coalesce(l.st, v.Status) AS st,
         EXISTS (SELECT 1 FROM evk r WHERE r.Kind = 'report' AND r.VehicleID = v.VehicleID
                 AND (l.VehicleID IS NULL OR r.RequestTime > l.RequestTime
                      OR (r.RequestTime = l.RequestTime AND r.RequestID > l.RequestID)
                      OR (r.RequestTime = l.RequestTime AND r.RequestID = l.RequestID AND r.k > l.k))) AS reported_after,
         CASE WHEN s.VehicleID IS NULL THEN v.CurrentStationID ELSE s.StationID END AS station
  FROM vehicles v LEFT JOIN last_set l ON l.VehicleID = v.VehicleID LEFT JOIN last_station s ON s.VehicleID = v.VehicleID)
SELECT VehicleID, CASE WHEN st = 'available' AND reported_after THEN 'under-maintenance' ELSE st END AS Status,
       station AS CurrentStationID
FROM base"""


@register("stream_vehicle_state", STATE_BODY, STATE_CTES)
def stream_vehicle_state(td: TestData):
    """S3: per-vehicle status and station from the decided command events (stateful stream)."""
    events = S.vehicle_events(td.vehicles(), decided_vehicle_events(td))
    return S.stream_vehicle_state(td.spark, events)
