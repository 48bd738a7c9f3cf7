"""Registered command queries: decisions, new table snapshots and audit rows.

The oracle side re-derives each result with window functions (or a recursive
CTE for bookings and purchases) in DuckDB, i.e. a sequential definition of
the same semantics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegrid.operators import audit as A
from ridegrid.operators import booking, commands as C, maintenance, purchases
from ridegrid.plans.registry import register
from ridegrid.sources.testdata import TestData

FK = C.FK_REASON.format("")
ADMIN = "coalesce(user_role, 'user') = 'admin'"


def _txt(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _audit_sql(changes_cte: str) -> str:
    """Oracle audit numbering over a CTE ``ch(RequestID, Step, Sub, TableName, OperationType, RecordID, msg, ts, fire)``."""
    return changes_cte + """
SELECT CAST((SELECT max(LogID) FROM logs) + row_number() OVER (ORDER BY RequestID, Step, Sub) AS INT) AS LogID,
       TableName, OperationType, CAST(RecordID AS INT) AS RecordID, CAST(NULL AS INT) AS ChangedBy,
       msg AS ChangeDescription, ts AS ChangeTimestamp
FROM ch WHERE fire"""


# =============================================================================== M7 top-ups
TOPUP_D = f"""
SELECT r.RequestID, r.RequestTime, r.UserID, r.amount_value, u.WalletBalance AS bal0,
  CASE WHEN r.amount IS NULL THEN {_txt("Missing 'amount' field")}
       WHEN r.amount_value IS NULL THEN 'Invalid amount'
       WHEN r.amount_value <= 0 THEN 'Amount must be positive'
       WHEN u.UserID IS NULL THEN 'User not found' END AS Reason
FROM (SELECT *, TRY_CAST(TRY_CAST(trim(amount) AS DOUBLE) AS DECIMAL(10,2)) AS amount_value FROM topup_requests) r
LEFT JOIN users u ON u.UserID = r.UserID"""


@register("wallet_topups", "SELECT RequestID, UserID, amount_value AS Amount, Reason IS NULL AS Accepted, Reason FROM d",
          [("d", TOPUP_D)])
def wallet_topups(td: TestData):
    """M7 decisions."""
    return C.wallet_topups(td.topup_requests(), td.users()).decisions


@register("wallet_topups_balances", """
SELECT u.UserID, CASE WHEN s.UserID IS NULL THEN u.WalletBalance
                      ELSE CAST(u.WalletBalance + s.added AS DECIMAL(10,2)) END AS WalletBalance
FROM users u LEFT JOIN (SELECT UserID, sum(amount_value) AS added FROM d WHERE Reason IS NULL GROUP BY UserID) s
  ON s.UserID = u.UserID""", [("d", TOPUP_D)])
def wallet_topups_balances(td: TestData):
    """M7 new wallet balances."""
    return C.wallet_topups(td.topup_requests(), td.users()).tables["users"].select("UserID", "WalletBalance")


@register("audit_wallet_topups", _audit_sql(""), [("d", TOPUP_D), ("ch", """
SELECT RequestID, 1 AS Step, 0 AS Sub, 'Users' AS TableName, 'UPDATE' AS OperationType, UserID AS RecordID,
  'Wallet balance changed from ' || CAST(CAST(old AS DECIMAL(10,2)) AS VARCHAR) || ' to '
    || CAST(CAST(old + amount_value AS DECIMAL(10,2)) AS VARCHAR) AS msg, RequestTime AS ts,
  coalesce(CAST(old AS DECIMAL(10,2)) <> CAST(old + amount_value AS DECIMAL(10,2)), false) AS fire
FROM (SELECT *, bal0 + coalesce(sum(amount_value) OVER (PARTITION BY UserID ORDER BY RequestID
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM d WHERE Reason IS NULL) x""")])
def audit_wallet_topups(td: TestData):
    """T9 rows of the top-ups."""
    return A.audit(C.wallet_topups(td.topup_requests(), td.users()).changes, td.logs())


# =============================================================================== M9 reviews
REVIEW_S = f"""
SELECT q.*, TRY_CAST(trim(q.rating) AS INT) AS rating_value, t.TripID AS t_id, t.UserID AS tu, t.VehicleID AS tv,
  CASE WHEN TRY_CAST(trim(q.rating) AS INT) IS NULL THEN {_txt("Invalid or missing 'rating'")}
       WHEN NOT (TRY_CAST(trim(q.rating) AS INT) BETWEEN 1 AND 5) THEN 'Rating must be between 1 and 5'
       WHEN t.TripID IS NULL THEN 'Trip not found'
       WHEN t.Status <> 'Completed' THEN 'Can only review completed trips' END AS static
FROM review_requests q LEFT JOIN trips t ON t.TripID = q.TripID"""
REVIEW_D = """
SELECT s.*, coalesce(s.static, CASE WHEN EXISTS (SELECT 1 FROM reviews v WHERE v.UserID = s.tu AND v.TripID = s.TripID)
    OR s.RequestID <> f.first THEN 'A review for this trip already exists' END) AS Reason
FROM s LEFT JOIN (SELECT tu, TripID, min(RequestID) AS first FROM s WHERE static IS NULL GROUP BY tu, TripID) f
  ON f.tu = s.tu AND f.TripID = s.TripID"""


@register("submit_reviews", "SELECT RequestID, TripID, rating_value AS Rating, Reason IS NULL AS Accepted, Reason FROM d",
          [("s", REVIEW_S), ("d", REVIEW_D)])
def submit_reviews(td: TestData):
    """M9 decisions."""
    return C.submit_reviews(td.review_requests(), td.trips(), td.reviews()).decisions


@register("submit_reviews_new", """
SELECT CAST((SELECT max(ReviewID) FROM reviews) + row_number() OVER (ORDER BY RequestID) AS INT) AS ReviewID,
       RequestID, TripID, tu AS UserID, tv AS VehicleID, rating_value AS Rating, coalesce(comment, '') AS Comment, CAST(RequestTime AS DATE) AS ReviewDate
FROM d WHERE Reason IS NULL""", [("s", REVIEW_S), ("d", REVIEW_D)])
def submit_reviews_new(td: TestData):
    """M9 new review rows with ids continuing after the existing maximum."""
    return C.submit_reviews(td.review_requests(), td.trips(), td.reviews()).tables["new_reviews"]


# =============================================================================== M6 registration
REG_S = f"""
SELECT q.*, lower(q.email) AS e,
  CASE WHEN q.password IS NULL THEN {_txt("'NoneType' object has no attribute 'encode'")}
       WHEN q.name IS NULL OR q.email IS NULL THEN 'Email already registered' END AS static
FROM register_requests q"""
REG_D = """
SELECT s.*, coalesce(s.static, CASE WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.Email) = s.e)
    OR s.RequestID <> f.first THEN 'Email already registered' END) AS Reason
FROM s LEFT JOIN (SELECT e, min(RequestID) AS first FROM s WHERE static IS NULL GROUP BY e) f ON f.e = s.e"""


@register("register_users", "SELECT RequestID, email AS Email, Reason IS NULL AS Accepted, Reason FROM d",
          [("s", REG_S), ("d", REG_D)])
def register_users(td: TestData):
    """M6 decisions."""
    return C.register_users(td.register_requests(), td.users()).decisions


@register("register_users_new", """
SELECT CAST((SELECT max(UserID) FROM users) + row_number() OVER (ORDER BY RequestID) AS INT) AS UserID, RequestID,
       name AS Name, email AS Email, sha256(password) AS Password, 'user' AS Role,
       CAST(0.00 AS DECIMAL(10,2)) AS WalletBalance, CAST(RequestTime AS DATE) AS JoinDate, CAST(NULL AS INT) AS PlanID
FROM d WHERE Reason IS NULL""", [("s", REG_S), ("d", REG_D)])
def register_users_new(td: TestData):
    """M6 new user rows."""
    return C.register_users(td.register_requests(), td.users()).tables["new_users"]


# =============================================================================== M2 end rides
END_D = f"""
SELECT r.*, t.TripID AS t_id, t.VehicleID AS tv, t.Status AS ts,
  CASE WHEN t.TripID IS NOT NULL AND r.EndStationID IS NOT NULL AND s.StationID IS NULL
       THEN '{FK}EndStationID' END AS Reason
FROM end_requests r LEFT JOIN trips t ON t.TripID = r.TripID LEFT JOIN stations s ON s.StationID = r.EndStationID"""


@register("end_rides", """
SELECT RequestID, TripID, EndStationID, Reason IS NULL AS Accepted, Reason, Reason IS NULL AND t_id IS NOT NULL AS Applied
FROM d""", [("d", END_D)])
def end_rides(td: TestData):
    """M2 decisions."""
    return C.end_rides(td.end_requests(), td.trips(), td.vehicles(), td.stations()).decisions


@register("end_rides_vehicles", """
SELECT v.VehicleID, CASE WHEN l.tv IS NULL THEN v.Status ELSE 'available' END AS Status,
       CASE WHEN l.tv IS NULL THEN v.CurrentStationID ELSE l.EndStationID END AS CurrentStationID
FROM vehicles v LEFT JOIN (SELECT tv, arg_max(EndStationID, RequestID) AS EndStationID FROM d
                           WHERE Reason IS NULL AND t_id IS NOT NULL GROUP BY tv) l ON l.tv = v.VehicleID""",
          [("d", END_D)])
def end_rides_vehicles(td: TestData):
    """M2 new vehicle snapshot (status and station)."""
    res = C.end_rides(td.end_requests(), td.trips(), td.vehicles(), td.stations())
    return res.tables["vehicles"].select("VehicleID", "Status", "CurrentStationID")


@register("end_rides_trips", """
SELECT t.TripID, CASE WHEN l.TripID IS NULL THEN t.Status ELSE 'Completed' END AS Status,
       CASE WHEN l.TripID IS NULL THEN t.EndTime ELSE l.RequestTime END AS EndTime,
       CASE WHEN l.TripID IS NULL THEN t.EndStationID ELSE l.EndStationID END AS EndStationID
FROM trips t LEFT JOIN (SELECT TripID, arg_max(EndStationID, RequestID) AS EndStationID,
                               arg_max(RequestTime, RequestID) AS RequestTime
                        FROM d WHERE Reason IS NULL AND t_id IS NOT NULL GROUP BY TripID) l ON l.TripID = t.TripID""",
          [("d", END_D)])
def end_rides_trips(td: TestData):
    """M2 new trip snapshot (status, end time, end station)."""
    res = C.end_rides(td.end_requests(), td.trips(), td.vehicles(), td.stations())
    return res.tables["trips"].select("TripID", "Status", "EndTime", "EndStationID")


@register("audit_end_rides", _audit_sql(""), [("d", END_D), ("ap", "SELECT * FROM d WHERE Reason IS NULL AND t_id IS NOT NULL"), ("ch", """
SELECT ap.RequestID, 1 AS Step, 0 AS Sub, 'Trips' AS TableName, 'UPDATE' AS OperationType, ap.TripID AS RecordID,
  'Trip updated from Status=' || CASE WHEN ap.RequestID = ft.f THEN ap.ts ELSE 'Completed' END || ' to Completed' AS msg,
  ap.RequestTime AS ts, true AS fire
FROM ap JOIN (SELECT TripID, min(RequestID) AS f FROM ap GROUP BY TripID) ft ON ft.TripID = ap.TripID
UNION ALL
SELECT ap.RequestID, 2, 0, 'Vehicles', 'UPDATE', ap.tv,
  'Vehicle status changed from ' || v.Status || ' to available', ap.RequestTime,
  ap.RequestID = fv.f AND v.Status <> 'available'
FROM ap JOIN (SELECT tv, min(RequestID) AS f FROM ap GROUP BY tv) fv ON fv.tv = ap.tv
JOIN vehicles v ON v.VehicleID = ap.tv""")])
def audit_end_rides(td: TestData):
    """T2/T6 rows of ending rides."""
    res = C.end_rides(td.end_requests(), td.trips(), td.vehicles(), td.stations())
    return A.audit(res.changes, td.logs())


# =============================================================================== M3 cancel
CANCEL_D = """
SELECT r.*, t.TripID AS t_id, t.UserID AS tu, t.VehicleID AS tv, t.StartStationID AS tss, t.Cost AS tc, t.Status AS ts,
  CASE WHEN t.TripID IS NOT NULL AND (t.Status <> 'Ongoing' OR r.RequestID <> f.first)
       THEN 'Only ongoing trips can be cancelled' END AS Reason
FROM cancel_requests r LEFT JOIN trips t ON t.TripID = r.TripID
LEFT JOIN (SELECT c.TripID, min(c.RequestID) AS first FROM cancel_requests c JOIN trips t2 ON t2.TripID = c.TripID
           WHERE t2.Status = 'Ongoing' GROUP BY c.TripID) f ON f.TripID = r.TripID"""
CANCEL_CTES = [("d", CANCEL_D), ("ap", "SELECT * FROM d WHERE Reason IS NULL AND t_id IS NOT NULL")]


@register("cancel_trips", """
SELECT RequestID, TripID, Reason IS NULL AS Accepted, Reason, Reason IS NULL AND t_id IS NOT NULL AS Applied FROM d""",
          CANCEL_CTES)
def cancel_trips(td: TestData):
    """M3 decisions."""
    return _cancel(td).decisions


def _cancel(td: TestData):
    return C.cancel_trips(td.cancel_requests(), td.trips(), td.vehicles(), td.users(), td.payments())


@register("cancel_trips_balances", """
SELECT u.UserID, CASE WHEN s.tu IS NULL THEN u.WalletBalance
                      ELSE CAST(u.WalletBalance + s.refund AS DECIMAL(10,2)) END AS WalletBalance
FROM users u LEFT JOIN (SELECT tu, sum(tc) AS refund FROM ap GROUP BY tu) s ON s.tu = u.UserID""", CANCEL_CTES)
def cancel_trips_balances(td: TestData):
    """M3 wallets after refunds."""
    return _cancel(td).tables["users"].select("UserID", "WalletBalance")


@register("cancel_trips_payments", """
SELECT p.PaymentID, CASE WHEN EXISTS (SELECT 1 FROM ap WHERE ap.TripID = p.TripID AND ap.tu = p.UserID)
                         THEN 'Refunded' ELSE p.Status END AS Status
FROM payments p""", CANCEL_CTES)
def cancel_trips_payments(td: TestData):
    """M3 payment statuses after refunds."""
    return _cancel(td).tables["payments"].select("PaymentID", "Status")


@register("cancel_trips_trips", """
SELECT t.TripID, CASE WHEN ap.TripID IS NULL THEN t.Status ELSE 'Cancelled' END AS Status,
       CASE WHEN ap.TripID IS NULL THEN t.EndTime ELSE ap.RequestTime END AS EndTime
FROM trips t LEFT JOIN ap ON ap.TripID = t.TripID""", CANCEL_CTES)
def cancel_trips_trips(td: TestData):
    """M3 trips afterwards."""
    return _cancel(td).tables["trips"].select("TripID", "Status", "EndTime")


@register("cancel_trips_vehicles", """
SELECT v.VehicleID, CASE WHEN l.tv IS NULL THEN v.Status ELSE 'available' END AS Status,
       CASE WHEN l.tv IS NULL THEN v.CurrentStationID ELSE l.st END AS CurrentStationID
FROM vehicles v LEFT JOIN (SELECT tv, arg_max(tss, RequestID) AS st FROM ap GROUP BY tv) l ON l.tv = v.VehicleID""",
          CANCEL_CTES)
def cancel_trips_vehicles(td: TestData):
    """M3/J7 vehicles afterwards: back at the trip's start station."""
    return _cancel(td).tables["vehicles"].select("VehicleID", "Status", "CurrentStationID")


CANCEL_CH = """
SELECT RequestID, 1 AS Step, 0 AS Sub, 'Trips' AS TableName, 'UPDATE' AS OperationType, TripID AS RecordID,
  'Trip updated from Status=' || ts || ' to Cancelled' AS msg, RequestTime AS ts, true AS fire FROM ap
UNION ALL
SELECT ap.RequestID, 2, 0, 'Vehicles', 'UPDATE', ap.tv, 'Vehicle status changed from ' || v.Status || ' to available',
  ap.RequestTime, ap.RequestID = fv.f AND v.Status <> 'available'
FROM ap JOIN (SELECT tv, min(RequestID) AS f FROM ap GROUP BY tv) fv ON fv.tv = ap.tv JOIN vehicles v ON v.VehicleID = ap.tv
UNION ALL
SELECT RequestID, 3, 0, 'Users', 'UPDATE', tu,
  'Wallet balance changed from ' || CAST(CAST(old AS DECIMAL(10,2)) AS VARCHAR) || ' to '
    || CAST(CAST(old + tc AS DECIMAL(10,2)) AS VARCHAR), RequestTime,
  coalesce(CAST(old AS DECIMAL(10,2)) <> CAST(old + tc AS DECIMAL(10,2)), false)
FROM (SELECT ap.*, u.WalletBalance + coalesce(sum(ap.tc) OVER (PARTITION BY ap.tu ORDER BY ap.RequestID
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old
      FROM ap JOIN users u ON u.UserID = ap.tu) x
UNION ALL
SELECT ap.RequestID, 4, p.PaymentID, 'Payments', 'UPDATE', p.PaymentID,
  'Payment status changed from ' || p.Status || ' to Refunded', ap.RequestTime, true
FROM ap JOIN payments p ON p.TripID = ap.TripID AND p.UserID = ap.tu"""


@register("audit_cancel_trips", _audit_sql(""), CANCEL_CTES + [("ch", CANCEL_CH)])
def audit_cancel_trips(td: TestData):
    """T2/T6/T9/T5 rows of cancellations."""
    return A.audit(_cancel(td).changes, td.logs())


# =============================================================================== M5 complete maintenance
COMPLETE_D = f"""
SELECT r.*, a.TechnicianID, ml.VehicleID AS mv, ml.Status AS ms,
  CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
       WHEN a.LogID IS NULL OR ml.LogID IS NULL THEN 'Assignment not found'
       WHEN ml.Status = 'Completed' OR r.RequestID <> f.first THEN 'Maintenance log already completed' END AS Reason
FROM complete_requests r
LEFT JOIN (SELECT LogID, arg_min(TechnicianID, AssignmentID) AS TechnicianID FROM technician_assignments GROUP BY LogID) a
  ON a.LogID = r.LogID
LEFT JOIN maintenance_logs ml ON ml.LogID = r.LogID
LEFT JOIN (SELECT c.LogID, min(c.RequestID) AS first FROM complete_requests c
           JOIN technician_assignments ta ON ta.LogID = c.LogID JOIN maintenance_logs m ON m.LogID = c.LogID
           WHERE coalesce(c.user_role, 'user') = 'admin' AND m.Status <> 'Completed' GROUP BY c.LogID) f
  ON f.LogID = r.LogID"""
COMPLETE_CTES = [("d", COMPLETE_D), ("ap", "SELECT * FROM d WHERE Reason IS NULL")]


def _complete(td: TestData):
    return C.complete_maintenance(td.complete_requests(), td.technician_assignments(), td.maintenance_logs(),
                                  td.technicians(), td.vehicles())


@register("complete_maintenance", "SELECT RequestID, LogID, TechnicianID, Reason IS NULL AS Accepted, Reason FROM d",
          COMPLETE_CTES)
def complete_maintenance(td: TestData):
    """M5 decisions."""
    return _complete(td).decisions


@register("complete_maintenance_technicians", """
SELECT t.TechnicianID, CASE WHEN n.k IS NULL THEN t.ActiveAssignments
                            ELSE CAST(greatest(t.ActiveAssignments - n.k, 0) AS INT) END AS ActiveAssignments
FROM technicians t LEFT JOIN (SELECT TechnicianID, count(*) AS k FROM ap GROUP BY TechnicianID) n
  ON n.TechnicianID = t.TechnicianID""", COMPLETE_CTES)
def complete_maintenance_technicians(td: TestData):
    """M5 technician loads after completions (floored at 0)."""
    return _complete(td).tables["technicians"].select("TechnicianID", "ActiveAssignments")


@register("complete_maintenance_logs", """
SELECT m.LogID, CASE WHEN EXISTS (SELECT 1 FROM ap WHERE ap.LogID = m.LogID) THEN 'Completed' ELSE m.Status END AS Status
FROM maintenance_logs m""", COMPLETE_CTES)
def complete_maintenance_logs(td: TestData):
    """M5 logs afterwards."""
    return _complete(td).tables["maintenance_logs"].select("LogID", "Status")


@register("complete_maintenance_vehicles", """
SELECT v.VehicleID, CASE WHEN v.VehicleID IN (SELECT mv FROM ap) THEN 'available' ELSE v.Status END AS Status
FROM vehicles v""", COMPLETE_CTES)
def complete_maintenance_vehicles(td: TestData):
    """M5/J8 vehicles afterwards."""
    return _complete(td).tables["vehicles"].select("VehicleID", "Status")


@register("audit_complete_maintenance", _audit_sql(""), COMPLETE_CTES + [("ch", """
SELECT RequestID, 1 AS Step, 0 AS Sub, 'MaintenanceLogs' AS TableName, 'UPDATE' AS OperationType, LogID AS RecordID,
  'Maintenance log status changed from ' || ms || ' to Completed' AS msg, RequestTime AS ts, ms <> 'Completed' AS fire
FROM ap
UNION ALL
SELECT ap.RequestID, 2, 0, 'Vehicles', 'UPDATE', ap.mv, 'Vehicle status changed from ' || v.Status || ' to available',
  ap.RequestTime, ap.RequestID = fv.f AND v.Status <> 'available'
FROM ap JOIN (SELECT mv, min(RequestID) AS f FROM ap GROUP BY mv) fv ON fv.mv = ap.mv JOIN vehicles v ON v.VehicleID = ap.mv""")])
def audit_complete_maintenance(td: TestData):
    """T8/T6 rows of completions."""
    return A.audit(_complete(td).changes, td.logs())


# =============================================================================== M4 report and assign
REPORT_D = f"""
SELECT q.*, v.Status AS vs,
  CASE WHEN trim(q.IssueReported) = '' THEN {_txt(maintenance.BLANK_ISSUE)}
       WHEN q.UserID IS NULL OR q.UserID = 0 THEN 'User ID required'
       WHEN NOT (coalesce(q.user_role, 'user') = 'admin' OR EXISTS (SELECT 1 FROM trips t WHERE t.Status = 'Ongoing'
                 AND t.UserID = q.UserID AND t.VehicleID = q.VehicleID))
         THEN {_txt(maintenance.NOT_YOUR_VEHICLE)}
       WHEN q.IssueReported IS NULL THEN {_txt("Column 'IssueReported' cannot be null")}
       WHEN v.VehicleID IS NULL THEN '{FK}VehicleID' END AS Reason
FROM report_requests q LEFT JOIN vehicles v ON v.VehicleID = q.VehicleID"""
REPORT_CTES = [
    ("d", REPORT_D),
    ("acc", "SELECT *, row_number() OVER (ORDER BY RequestID) AS i FROM d WHERE Reason IS NULL"),
    ("slots", """
SELECT t.TechnicianID, row_number() OVER (ORDER BY t.ActiveAssignments + g.i - 1, t.TechnicianID) AS j
FROM technicians t JOIN acc g ON true WHERE t.IsAvailable"""),
    ("asg", """
SELECT acc.*, CAST((SELECT max(LogID) FROM maintenance_logs) + acc.i AS INT) AS LogID, s.TechnicianID,
       CASE WHEN s.TechnicianID IS NOT NULL THEN CAST((SELECT max(AssignmentID) FROM technician_assignments) + acc.i AS INT) END
         AS AssignmentID
FROM acc LEFT JOIN slots s ON s.j = acc.i"""),
]


def _report(td: TestData):
    return maintenance.report_and_assign(td.report_requests(), td.trips(), td.vehicles(), td.technicians(),
                                         td.maintenance_logs(), td.technician_assignments())


@register("report_and_assign", """
SELECT d.RequestID, d.VehicleID, d.Reason IS NULL AS Accepted, d.Reason, a.LogID, a.TechnicianID
FROM d LEFT JOIN asg a ON a.RequestID = d.RequestID""", REPORT_CTES)
def report_and_assign(td: TestData):
    """M4 decisions with the new log and the assigned technician."""
    return _report(td).decisions


@register("report_and_assign_technicians", """
SELECT t.TechnicianID, CAST(t.ActiveAssignments + coalesce(n.k, 0) AS INT) AS ActiveAssignments
FROM technicians t LEFT JOIN (SELECT TechnicianID, count(*) AS k FROM asg GROUP BY TechnicianID) n
  ON n.TechnicianID = t.TechnicianID""", REPORT_CTES)
def report_and_assign_technicians(td: TestData):
    """M4 technician loads after assignment."""
    return _report(td).tables["technicians"].select("TechnicianID", "ActiveAssignments")


@register("report_and_assign_logs", """
SELECT LogID, VehicleID, IssueReported, ReportedDate, Status FROM maintenance_logs
UNION ALL
SELECT LogID, VehicleID, IssueReported, CAST(RequestTime AS DATE),
       CASE WHEN TechnicianID IS NULL THEN 'Pending' ELSE 'In-Progress' END FROM asg""", REPORT_CTES)
def report_and_assign_logs(td: TestData):
    """M4 maintenance logs afterwards."""
    return _report(td).tables["maintenance_logs"]


@register("report_and_assign_assignments", """
SELECT AssignmentID, LogID, TechnicianID FROM technician_assignments
UNION ALL SELECT AssignmentID, LogID, TechnicianID FROM asg WHERE TechnicianID IS NOT NULL""", REPORT_CTES)
def report_and_assign_assignments(td: TestData):
    """M4 assignments afterwards."""
    return _report(td).tables["technician_assignments"]


@register("report_and_assign_vehicles", """
SELECT v.VehicleID, CASE WHEN v.Status = 'available' AND v.VehicleID IN (SELECT VehicleID FROM asg)
                         THEN 'under-maintenance' ELSE v.Status END AS Status
FROM vehicles v""", REPORT_CTES)
def report_and_assign_vehicles(td: TestData):
    """M4 vehicles afterwards."""
    return _report(td).tables["vehicles"].select("VehicleID", "Status")


@register("audit_report_and_assign", _audit_sql(""), REPORT_CTES + [("ch", """
SELECT a.RequestID, 1 AS Step, 0 AS Sub, 'Vehicles' AS TableName, 'UPDATE' AS OperationType, a.VehicleID AS RecordID,
  'Vehicle status changed from available to under-maintenance' AS msg, a.RequestTime AS ts,
  a.vs = 'available' AND a.RequestID = fv.f AS fire
FROM asg a JOIN (SELECT VehicleID, min(RequestID) AS f FROM asg GROUP BY VehicleID) fv ON fv.VehicleID = a.VehicleID
UNION ALL
SELECT RequestID, 2, 0, 'MaintenanceLogs', 'INSERT', LogID,
  'Maintenance issue reported for VehicleID=' || CAST(VehicleID AS VARCHAR) || ', Issue: ' || IssueReported,
  RequestTime, true FROM asg
UNION ALL
SELECT RequestID, 3, 0, 'MaintenanceLogs', 'UPDATE', LogID,
  'Maintenance log status changed from Pending to In-Progress', RequestTime, TechnicianID IS NOT NULL FROM asg""")])
def audit_report_and_assign(td: TestData):
    """T6/T7/T8 rows of reports."""
    return A.audit(_report(td).changes, td.logs())


# =============================================================================== M8 purchases
PURCHASE_CTES = [
    ("pr", f"""
SELECT r.RequestID, r.RequestTime, r.UserID, r.PlanID, p.Cost, u.WalletBalance AS bal0,
  CASE WHEN r.UserID IS NULL OR r.UserID = 0 OR r.PlanID IS NULL OR r.PlanID = 0 THEN 'user_id and plan_id are required'
       WHEN p.PlanID IS NULL THEN 'Plan not found'
       WHEN u.UserID IS NULL THEN 'User not found'
       WHEN u.WalletBalance IS NULL THEN {_txt(purchases.NONE_BALANCE)} END AS static
FROM purchase_requests r LEFT JOIN membership_plans p ON p.PlanID = r.PlanID LEFT JOIN users u ON u.UserID = r.UserID"""),
    ("dyn", "SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY RequestID) AS k FROM pr WHERE static IS NULL"),
]
PURCHASE_WALK = """
WITH RECURSIVE walk(UserID, k, RequestID, ok, bal) AS (
  SELECT UserID, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(min(bal0) AS DECIMAL(20,2))
  FROM dyn GROUP BY UserID
  UNION ALL
  SELECT d.UserID, d.k, d.RequestID, NOT (w.bal < d.Cost),
         CAST(CASE WHEN w.bal < d.Cost THEN w.bal ELSE w.bal - d.Cost END AS DECIMAL(20,2))
  FROM walk w JOIN dyn d ON d.UserID = w.UserID AND d.k = w.k + 1)"""


@register("purchase_memberships", PURCHASE_WALK + """
SELECT pr.RequestID, pr.UserID, pr.PlanID, pr.static IS NULL AND w.ok AS Accepted,
       coalesce(pr.static, CASE WHEN NOT w.ok THEN 'Insufficient wallet balance' END) AS Reason
FROM pr LEFT JOIN (SELECT RequestID, ok FROM walk WHERE k > 0) w ON w.RequestID = pr.RequestID""", PURCHASE_CTES)
def purchase_memberships(td: TestData):
    """M8 decisions (sequential per user, computed in bounded phases)."""
    return purchases.purchase_memberships(td.purchase_requests(), td.users(), td.membership_plans()).decisions


@register("purchase_memberships_users", PURCHASE_WALK + """
SELECT u.UserID, CASE WHEN s.UserID IS NULL THEN u.WalletBalance ELSE CAST(u.WalletBalance - s.spent AS DECIMAL(10,2)) END
         AS WalletBalance,
       CASE WHEN s.UserID IS NULL THEN u.PlanID ELSE s.plan END AS PlanID
FROM users u LEFT JOIN (SELECT d.UserID, sum(d.Cost) AS spent, arg_max(d.PlanID, d.RequestID) AS plan
                        FROM walk w JOIN dyn d ON d.RequestID = w.RequestID WHERE w.k > 0 AND w.ok GROUP BY d.UserID) s
  ON s.UserID = u.UserID""", PURCHASE_CTES)
def purchase_memberships_users(td: TestData):
    """M8 wallets and plans after purchases."""
    res = purchases.purchase_memberships(td.purchase_requests(), td.users(), td.membership_plans())
    return res.tables["users"].select("UserID", "WalletBalance", "PlanID")


# =============================================================================== M1 bookings
BOOK_CTES = [("q", """
SELECT row_number() OVER (ORDER BY b.RequestID) AS i, b.RequestID, b.UserID, b.VehicleID, b.RequestTime,
       coalesce(v.Status = 'available', false) AS free0, u.UserID IS NOT NULL AS has_user,
       s.StationID IS NOT NULL AS has_station, u.WalletBalance AS bal0,
       CAST((v.RatePerHour * b.DurationHours) * (1 - CASE WHEN mp.PlanName = 'Basic Plan' THEN 0.05
            WHEN mp.PlanName = 'Premium Plan' THEN 0.10 WHEN mp.PlanName = 'Annual Plan' THEN 0.15 ELSE 0.00 END)
            AS DECIMAL(10,2)) AS Cost
FROM booking_requests b LEFT JOIN vehicles v ON v.VehicleID = b.VehicleID LEFT JOIN users u ON u.UserID = b.UserID
LEFT JOIN membership_plans mp ON mp.PlanID = u.PlanID LEFT JOIN stations s ON s.StationID = b.StartStationID""")]
BOOK_WALK = f"""
WITH RECURSIVE walk(i, RequestID, Reason, taken, spent) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS INT[]),
         CAST(MAP {{}} AS MAP(INT, DECIMAL(22,2)))
  UNION ALL
  SELECT i, RequestID, Reason,
         CASE WHEN Reason IS NULL THEN list_append(taken, VehicleID) ELSE taken END,
         CASE WHEN Reason IS NULL AND bal0 IS NOT NULL
              THEN map_concat(spent, MAP {{UserID: CAST(coalesce(spent[UserID], 0) + Cost AS DECIMAL(22,2))}})
              ELSE spent END
  FROM (SELECT q.*, w.taken, w.spent,
          CASE WHEN NOT q.free0 OR list_contains(w.taken, q.VehicleID) THEN 'Vehicle not available'
               WHEN q.bal0 - coalesce(w.spent[q.UserID], 0) < q.Cost THEN 'Insufficient balance'
               WHEN NOT q.has_user THEN '{FK}UserID'
               WHEN NOT q.has_station THEN '{FK}StartStationID' END AS Reason
        FROM walk w JOIN q ON q.i = w.i + 1) x)"""


def _book(td: TestData):
    return booking.book_rides(td.booking_requests(), td.users(), td.vehicles(), td.stations(), td.membership_plans(),
                              td.trips(), td.payments())


@register("book_rides", BOOK_WALK + """
SELECT q.RequestID, q.UserID, q.VehicleID, q.Cost, w.Reason IS NULL AS Accepted, w.Reason
FROM q JOIN walk w ON w.i = q.i""", BOOK_CTES)
def book_rides(td: TestData):
    """M1 decisions (rounds of decidable requests, equal to sequential replay)."""
    return _book(td).decisions


BOOK_ACC = """,
acc AS (SELECT q.*, row_number() OVER (ORDER BY q.RequestID) AS n FROM q JOIN walk w ON w.i = q.i
        WHERE w.i > 0 AND w.Reason IS NULL)"""


@register("book_rides_trips", BOOK_WALK + BOOK_ACC + """
SELECT TripID, UserID, VehicleID, StartStationID, EndStationID, StartTime, EndTime, Cost, Status FROM trips
UNION ALL
SELECT CAST((SELECT max(TripID) FROM trips) + acc.n AS INT), acc.UserID, acc.VehicleID, b.StartStationID, NULL,
       b.RequestTime, b.RequestTime + INTERVAL '1' HOUR * CAST(round(b.DurationHours) AS INT), acc.Cost, 'Ongoing'
FROM acc JOIN booking_requests b ON b.RequestID = acc.RequestID""", BOOK_CTES)
def book_rides_trips(td: TestData):
    """M1 trips afterwards."""
    return _book(td).tables["trips"]


@register("book_rides_payments", BOOK_WALK + BOOK_ACC + """
SELECT PaymentID, TripID, UserID, Amount, Timestamp, Status FROM payments
UNION ALL
SELECT CAST((SELECT max(PaymentID) FROM payments) + n AS INT), CAST((SELECT max(TripID) FROM trips) + n AS INT), UserID,
       Cost, RequestTime, 'Success' FROM acc""", BOOK_CTES)
def book_rides_payments(td: TestData):
    """M1 payments afterwards."""
    return _book(td).tables["payments"]


@register("book_rides_vehicles", BOOK_WALK + BOOK_ACC + """
SELECT v.VehicleID, CASE WHEN v.VehicleID IN (SELECT VehicleID FROM acc) THEN 'in-use' ELSE v.Status END AS Status
FROM vehicles v""", BOOK_CTES)
def book_rides_vehicles(td: TestData):
    """M1 vehicles afterwards."""
    return _book(td).tables["vehicles"].select("VehicleID", "Status")


@register("book_rides_users", BOOK_WALK + BOOK_ACC + """
SELECT u.UserID, CAST(u.WalletBalance - coalesce(s.spent, 0) AS DECIMAL(10,2)) AS WalletBalance
FROM users u LEFT JOIN (SELECT UserID, sum(Cost) AS spent FROM acc GROUP BY UserID) s ON s.UserID = u.UserID""", BOOK_CTES)
def book_rides_users(td: TestData):
    """M1 wallets afterwards."""
    return _book(td).tables["users"].select("UserID", "WalletBalance")


@register("audit_book_rides", BOOK_WALK + """,
acc AS (SELECT q.*, row_number() OVER (ORDER BY q.RequestID) AS n,
               q.bal0 - coalesce(sum(q.Cost) OVER (PARTITION BY q.UserID ORDER BY q.RequestID
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old
        FROM q JOIN walk w ON w.i = q.i WHERE w.i > 0 AND w.Reason IS NULL),
ch AS (
  SELECT RequestID, 1 AS Step, 0 AS Sub, 'Trips' AS TableName, 'INSERT' AS OperationType,
    (SELECT max(TripID) FROM trips) + n AS RecordID,
    'New trip created: UserID=' || CAST(UserID AS VARCHAR) || ', VehicleID=' || CAST(VehicleID AS VARCHAR)
      || ', Status=Ongoing' AS msg, RequestTime AS ts, true AS fire FROM acc
  UNION ALL
  SELECT RequestID, 2, 0, 'Vehicles', 'UPDATE', VehicleID, 'Vehicle status changed from available to in-use',
    RequestTime, true FROM acc
  UNION ALL
  SELECT RequestID, 3, 0, 'Users', 'UPDATE', UserID,
    'Wallet balance changed from ' || CAST(CAST(old AS DECIMAL(10,2)) AS VARCHAR) || ' to '
      || CAST(CAST(old - Cost AS DECIMAL(10,2)) AS VARCHAR), RequestTime,
    coalesce(CAST(old AS DECIMAL(10,2)) <> CAST(old - Cost AS DECIMAL(10,2)), false) FROM acc
  UNION ALL
  SELECT RequestID, 4, 0, 'Payments', 'INSERT', (SELECT max(PaymentID) FROM payments) + n,
    'Payment created: Amount=' || CAST(Cost AS VARCHAR) || ', Status=Success, UserID=' || CAST(UserID AS VARCHAR),
    RequestTime, true FROM acc)
SELECT CAST((SELECT max(LogID) FROM logs) + row_number() OVER (ORDER BY RequestID, Step, Sub) AS INT) AS LogID,
       TableName, OperationType, CAST(RecordID AS INT) AS RecordID, CAST(NULL AS INT) AS ChangedBy,
       msg AS ChangeDescription, ts AS ChangeTimestamp
FROM ch WHERE fire""", BOOK_CTES)
def audit_book_rides(td: TestData):
    """T1/T6/T9/T4 rows of accepted bookings."""
    return A.audit(_book(td).changes, td.logs())


# =============================================================================== M10-M17
@register("update_profiles", """
SELECT r.RequestID, r.UserID, NOT ((coalesce(r.name <> '', false) OR coalesce(r.password <> '', false)) AND u.UserID IS NULL)
         AS Accepted,
       CASE WHEN (coalesce(r.name <> '', false) OR coalesce(r.password <> '', false)) AND u.UserID IS NULL
            THEN 'User not found' END AS Reason
FROM profile_requests r LEFT JOIN users u ON u.UserID = r.UserID""")
def update_profiles(td: TestData):
    """M10 decisions."""
    return C.update_profiles(td.profile_requests(), td.users()).decisions


@register("update_profiles_users", """
SELECT u.UserID, coalesce(n.name, u.Name) AS Name, coalesce(sha256(p.password), u.Password) AS Password
FROM users u
LEFT JOIN (SELECT UserID, arg_max(name, RequestID) AS name FROM profile_requests WHERE coalesce(name <> '', false)
           GROUP BY UserID) n ON n.UserID = u.UserID
LEFT JOIN (SELECT UserID, arg_max(password, RequestID) AS password FROM profile_requests
           WHERE coalesce(password <> '', false) GROUP BY UserID) p ON p.UserID = u.UserID""")
def update_profiles_users(td: TestData):
    """M10 names and password digests after updates."""
    return C.update_profiles(td.profile_requests(), td.users()).tables["users"].select("UserID", "Name", "Password")


STATION_ADD = f"""
SELECT *, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
  WHEN NOT (coalesce(name <> '', false) AND coalesce(location <> '', false) AND coalesce(capacity <> 0, false))
  THEN 'Name, location, and capacity are required' END AS Reason FROM station_requests"""


@register("add_stations", "SELECT RequestID, Reason IS NULL AS Accepted, Reason FROM d", [("d", STATION_ADD)])
def add_stations(td: TestData):
    """M11 decisions."""
    return C.add_stations(td.station_requests(), td.stations()).decisions


@register("add_stations_new", """
SELECT CAST((SELECT max(StationID) FROM stations) + row_number() OVER (ORDER BY RequestID) AS INT) AS StationID,
       RequestID, name AS Name, location AS Location, CAST(capacity AS INT) AS Capacity, true AS IsActive
FROM d WHERE Reason IS NULL""", [("d", STATION_ADD)])
def add_stations_new(td: TestData):
    """M11 new station rows."""
    return C.add_stations(td.station_requests(), td.stations()).tables["new_stations"]


@register("deactivate_stations", f"""
SELECT r.RequestID, r.StationID, Reason IS NULL AS Accepted, Reason FROM (
  SELECT r.*, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
                   WHEN s.StationID IS NULL THEN 'Station not found' END AS Reason
  FROM deactivate_requests r LEFT JOIN stations s ON s.StationID = r.StationID) r""")
def deactivate_stations(td: TestData):
    """M12 decisions."""
    return C.deactivate_stations(td.deactivate_requests(), td.stations()).decisions


@register("deactivate_stations_active", f"""
SELECT s.StationID, s.IsActive AND NOT EXISTS (SELECT 1 FROM deactivate_requests r WHERE r.StationID = s.StationID
                                                AND {ADMIN}) AS IsActive
FROM stations s""")
def deactivate_stations_active(td: TestData):
    """M12 station activity afterwards."""
    return C.deactivate_stations(td.deactivate_requests(), td.stations()).tables["stations"].select("StationID", "IsActive")


VEHICLE_ADD = f"""
SELECT r.*, lower(r.registration_number) AS reg,
  r.station_id IS NOT NULL AND s.StationID IS NULL AS fk_bad,
  CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
       WHEN NOT (coalesce(r.type <> '', false) AND coalesce(r.model <> '', false) AND coalesce(r.manufacturer <> '', false)
                 AND coalesce(r.rate_per_hour <> 0, false) AND coalesce(r.registration_number <> '', false))
       THEN 'Type, model, manufacturer, rate_per_hour, and registration_number are required' END AS static
FROM vehicle_add_requests r LEFT JOIN stations s ON s.StationID = r.station_id"""
VEHICLE_ADD_D = f"""
SELECT a.*, coalesce(a.static,
  CASE WHEN EXISTS (SELECT 1 FROM vehicles v WHERE lower(v.RegistrationNumber) = a.reg) OR coalesce(f.first < a.RequestID, false)
       THEN 'Duplicate entry for key RegistrationNumber'
       WHEN a.fk_bad THEN '{FK}CurrentStationID' END) AS Reason
FROM a LEFT JOIN (SELECT reg, min(RequestID) AS first FROM a WHERE static IS NULL AND NOT fk_bad GROUP BY reg) f
  ON f.reg = a.reg"""


@register("add_vehicles", """
SELECT RequestID, registration_number AS RegistrationNumber, Reason IS NULL AS Accepted, Reason FROM d""",
          [("a", VEHICLE_ADD), ("d", VEHICLE_ADD_D)])
def add_vehicles(td: TestData):
    """M13 decisions."""
    return C.add_vehicles(td.vehicle_add_requests(), td.vehicles(), td.stations()).decisions


@register("add_vehicles_new", """
SELECT CAST((SELECT max(VehicleID) FROM vehicles) + row_number() OVER (ORDER BY RequestID) AS INT) AS VehicleID,
       RequestID, registration_number AS RegistrationNumber, type AS Type, model AS Model, manufacturer AS Manufacturer,
       CAST(rate_per_hour AS DECIMAL(10,2)) AS RatePerHour, 'available' AS Status, CAST(station_id AS INT) AS CurrentStationID
FROM d WHERE Reason IS NULL""", [("a", VEHICLE_ADD), ("d", VEHICLE_ADD_D)])
def add_vehicles_new(td: TestData):
    """M13 new vehicle rows."""
    return C.add_vehicles(td.vehicle_add_requests(), td.vehicles(), td.stations()).tables["new_vehicles"]


DECOM_D = f"""
SELECT r.*, v.Status AS vs, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
                                 WHEN v.VehicleID IS NULL THEN 'Vehicle not found' END AS Reason
FROM decommission_requests r LEFT JOIN vehicles v ON v.VehicleID = r.VehicleID"""


@register("decommission_vehicles", "SELECT RequestID, VehicleID, Reason IS NULL AS Accepted, Reason FROM d",
          [("d", DECOM_D)])
def decommission_vehicles(td: TestData):
    """M14 decisions."""
    return C.decommission_vehicles(td.decommission_requests(), td.vehicles()).decisions


@register("decommission_vehicles_status", """
SELECT v.VehicleID, CASE WHEN v.VehicleID IN (SELECT VehicleID FROM d WHERE Reason IS NULL) THEN 'decommissioned'
                         ELSE v.Status END AS Status FROM vehicles v""", [("d", DECOM_D)])
def decommission_vehicles_status(td: TestData):
    """M14 vehicles afterwards."""
    res = C.decommission_vehicles(td.decommission_requests(), td.vehicles())
    return res.tables["vehicles"].select("VehicleID", "Status")


@register("audit_decommission_vehicles", _audit_sql(""), [("d", DECOM_D), ("ch", """
SELECT d.RequestID, 1 AS Step, 0 AS Sub, 'Vehicles' AS TableName, 'UPDATE' AS OperationType, d.VehicleID AS RecordID,
  'Vehicle status changed from ' || d.vs || ' to decommissioned' AS msg, d.RequestTime AS ts,
  d.RequestID = f.first AND d.vs <> 'decommissioned' AS fire
FROM d JOIN (SELECT VehicleID, min(RequestID) AS first FROM d WHERE Reason IS NULL GROUP BY VehicleID) f
  ON f.VehicleID = d.VehicleID WHERE d.Reason IS NULL""")])
def audit_decommission_vehicles(td: TestData):
    """T6 rows of decommissioning."""
    return A.audit(C.decommission_vehicles(td.decommission_requests(), td.vehicles()).changes, td.logs())


TECH_ADD = f"""
SELECT *, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
  WHEN NOT (coalesce(name <> '', false) AND coalesce(specialization <> '', false))
  THEN 'Name and specialization are required' END AS Reason FROM technician_add_requests"""


@register("add_technicians", "SELECT RequestID, Reason IS NULL AS Accepted, Reason FROM d", [("d", TECH_ADD)])
def add_technicians(td: TestData):
    """M15 decisions."""
    return C.add_technicians(td.technician_add_requests(), td.technicians()).decisions


@register("add_technicians_new", """
SELECT CAST((SELECT max(TechnicianID) FROM technicians) + row_number() OVER (ORDER BY RequestID) AS INT) AS TechnicianID,
       RequestID, name AS Name, specialization AS Specialization, true AS IsAvailable, 0 AS ActiveAssignments
FROM d WHERE Reason IS NULL""", [("d", TECH_ADD)])
def add_technicians_new(td: TestData):
    """M15 new technician rows."""
    return C.add_technicians(td.technician_add_requests(), td.technicians()).tables["new_technicians"]


TECH_UPD = f"""
SELECT r.*, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
  WHEN NOT (coalesce(r.name <> '', false) OR coalesce(r.specialization <> '', false) OR r.is_available IS NOT NULL)
    THEN 'No fields to update'
  WHEN t.TechnicianID IS NULL THEN 'Technician not found' END AS Reason
FROM technician_update_requests r LEFT JOIN technicians t ON t.TechnicianID = r.TechnicianID"""


@register("update_technicians", "SELECT RequestID, TechnicianID, Reason IS NULL AS Accepted, Reason FROM d",
          [("d", TECH_UPD)])
def update_technicians(td: TestData):
    """M16 decisions."""
    return C.update_technicians(td.technician_update_requests(), td.technicians()).decisions


@register("update_technicians_rows", """
SELECT t.TechnicianID, coalesce(n.v, t.Name) AS Name, coalesce(s.v, t.Specialization) AS Specialization,
       coalesce(a.v, t.IsAvailable) AS IsAvailable
FROM technicians t
LEFT JOIN (SELECT TechnicianID, arg_max(name, RequestID) AS v FROM d WHERE Reason IS NULL AND coalesce(name <> '', false)
           GROUP BY TechnicianID) n ON n.TechnicianID = t.TechnicianID
LEFT JOIN (SELECT TechnicianID, arg_max(specialization, RequestID) AS v FROM d
           WHERE Reason IS NULL AND coalesce(specialization <> '', false) GROUP BY TechnicianID) s
  ON s.TechnicianID = t.TechnicianID
LEFT JOIN (SELECT TechnicianID, arg_max(is_available, RequestID) AS v FROM d
           WHERE Reason IS NULL AND is_available IS NOT NULL GROUP BY TechnicianID) a ON a.TechnicianID = t.TechnicianID""",
          [("d", TECH_UPD)])
def update_technicians_rows(td: TestData):
    """M16 technician rows afterwards."""
    res = C.update_technicians(td.technician_update_requests(), td.technicians())
    return res.tables["technicians"].select("TechnicianID", "Name", "Specialization", "IsAvailable")


TECH_DEL = f"""
SELECT r.*, CASE WHEN NOT ({ADMIN}) THEN 'Admin access required'
    WHEN t.TechnicianID IS NULL OR coalesce(f.first < r.RequestID, false) THEN 'Technician not found'
    WHEN t.ActiveAssignments > 0 THEN 'Cannot delete technician with active assignments'
    WHEN EXISTS (SELECT 1 FROM technician_assignments a WHERE a.TechnicianID = r.TechnicianID) THEN '{FK}TechnicianID'
    END AS Reason
FROM technician_delete_requests r LEFT JOIN technicians t ON t.TechnicianID = r.TechnicianID
LEFT JOIN (SELECT q.TechnicianID, min(q.RequestID) AS first FROM technician_delete_requests q
           JOIN technicians t2 ON t2.TechnicianID = q.TechnicianID
           WHERE coalesce(q.user_role, 'user') = 'admin' AND NOT coalesce(t2.ActiveAssignments > 0, false)
             AND NOT EXISTS (SELECT 1 FROM technician_assignments a WHERE a.TechnicianID = q.TechnicianID)
           GROUP BY q.TechnicianID) f ON f.TechnicianID = r.TechnicianID"""


@register("delete_technicians", "SELECT RequestID, TechnicianID, Reason IS NULL AS Accepted, Reason FROM d",
          [("d", TECH_DEL)])
def delete_technicians(td: TestData):
    """M17 decisions."""
    return C.delete_technicians(td.technician_delete_requests(), td.technicians(), td.technician_assignments()).decisions


@register("delete_technicians_rows", """
SELECT * FROM technicians WHERE TechnicianID NOT IN (SELECT TechnicianID FROM d WHERE Reason IS NULL)""", [("d", TECH_DEL)])
def delete_technicians_rows(td: TestData):
    """M17 technicians afterwards."""
    res = C.delete_technicians(td.technician_delete_requests(), td.technicians(), td.technician_assignments())
    return res.tables["technicians"]


# =============================================================================== T3
@register("audit_trip_deletes", """
SELECT CAST((SELECT max(LogID) FROM logs) + row_number() OVER (ORDER BY TripID) AS INT) AS LogID, 'Trips' AS TableName,
       'DELETE' AS OperationType, TripID AS RecordID, CAST(NULL AS INT) AS ChangedBy,
       'Trip record deleted' AS ChangeDescription, TIMESTAMP '2025-01-01 00:00:00' AS ChangeTimestamp
FROM trips WHERE Status = 'Cancelled'""")
def audit_trip_deletes(td: TestData):
    """Audit rows of a purge of cancelled trips, from the two snapshots."""
    kept = td.trips().where(F.col("Status") != "Cancelled")
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return A.audit(A.snapshot_audit("Trips", td.trips(), kept, "TripID", at), td.logs())


# =============================================================================== M18 onboarding
ONBOARD_CTES = [
    ("o0", """
SELECT q.*, p.Cost, TRY_CAST(TRY_CAST(trim(q.topup) AS DOUBLE) AS DECIMAL(10,2)) AS top_value
FROM onboard_requests q LEFT JOIN membership_plans p ON p.PlanID = q.PlanID"""),
    ("o", """
SELECT o0.*, CASE WHEN top_value IS NULL OR top_value <= 0 THEN 'Please enter a valid top-up amount'
   WHEN PlanID IS NULL OR PlanID = 0 THEN 'Please select a membership plan'
   WHEN Cost IS NULL THEN 'Invalid plan selected'
   WHEN top_value < Cost THEN 'Top-up amount must be at least ₹' || CAST(Cost AS VARCHAR) || ' to purchase the selected plan'
   END AS pre
FROM o0"""),
    ("s", REG_S.replace("FROM register_requests q", "FROM o q WHERE q.pre IS NULL")),
    ("d", REG_D),
    ("acc", "SELECT d.*, row_number() OVER (ORDER BY RequestID) AS n FROM d WHERE Reason IS NULL"),
]


@register("onboard_users", """
SELECT o.RequestID, o.email AS Email, coalesce(o.pre, d.Reason) IS NULL AS Accepted, coalesce(o.pre, d.Reason) AS Reason,
       CAST((SELECT max(UserID) FROM users) + acc.n AS INT) AS UserID,
       CAST(acc.top_value - acc.Cost AS DECIMAL(10,2)) AS WalletBalance, acc.PlanID
FROM o LEFT JOIN d ON d.RequestID = o.RequestID LEFT JOIN acc ON acc.RequestID = o.RequestID""", ONBOARD_CTES)
def onboard_users(td: TestData):
    """Register -> top up -> buy plan, with the page's own checks first."""
    return C.onboard_users(td.onboard_requests(), td.users(), td.membership_plans()).decisions


@register("onboard_users_rows", """
SELECT UserID, Email, WalletBalance, PlanID FROM users
UNION ALL
SELECT CAST((SELECT max(UserID) FROM users) + n AS INT), email, CAST(top_value - Cost AS DECIMAL(10,2)), PlanID FROM acc""",
          ONBOARD_CTES)
def onboard_users_rows(td: TestData):
    """M18 users afterwards."""
    res = C.onboard_users(td.onboard_requests(), td.users(), td.membership_plans())
    return res.tables["users"].select("UserID", "Email", "WalletBalance", "PlanID")
