"""Mixed command batches (M1 to M9 in one table) and their oracle: a recursive CTE that takes one request per step.

The walk carries the changed state as maps (balances, plans, vehicle and trip
status, logs, loads), i.e. it is the sequential definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions.exprs import PLAN_DISCOUNTS
from ridegrid.operators import bounds as B
from ridegrid.operators import commands as C
from ridegrid.operators import maintenance as M
from ridegrid.operators import replay as R
from ridegrid.plans.registry import register
from ridegrid.sources.testdata import TestData

TABLES = ("users", "vehicles", "stations", "trips", "payments", "technicians", "maintenance_logs", "technician_assignments", "reviews",
          "membership_plans")


def _txt(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FK = C.FK_REASON.format("")
TOP = "99999999.99"
DISCOUNT = "CASE PlanName " + " ".join(f"WHEN {_txt(n)} THEN {d}" for n, d in PLAN_DISCOUNTS) + " ELSE 0.00 END"

CTES = [("mixed", f"""
SELECT row_number() OVER (ORDER BY r.RequestID) AS i, r.*,
  CASE WHEN t.TripID IS NOT NULL OR l.LogID IS NOT NULL THEN 2 WHEN c.RequestID IS NOT NULL THEN 1 ELSE 0 END AS target,
  CASE WHEN r.Kind IN ('book', 'report') THEN 'N' || r.RequestID WHEN c.RequestID IS NOT NULL THEN 'N' || r.Ref
       WHEN t.TripID IS NOT NULL THEN 'T' || t.TripID WHEN l.LogID IS NOT NULL THEN 'L' || l.LogID END AS k,
  CASE WHEN r.Kind IN ('end', 'cancel', 'review') THEN coalesce(t.UserID, c.UserID) ELSE r.UserID END AS who,
  CASE WHEN r.Kind IN ('end', 'cancel', 'review') THEN coalesce(t.VehicleID, c.VehicleID)
       WHEN r.Kind = 'complete' THEN coalesce(l.VehicleID, c.VehicleID) ELSE r.VehicleID END AS veh,
  coalesce(t.StartStationID, c.StationID) AS start, t.Cost AS tc, t.Status AS tstatus, l.Status AS lstatus, l.tech AS ltech,
  TRY_CAST(TRY_CAST(trim(r.amount) AS DOUBLE) AS DECIMAL(10,2)) AS amount_value
FROM mixed_requests r
LEFT JOIN mixed_requests c ON c.RequestID = r.Ref AND c.RequestID < r.RequestID
  AND c.Kind = CASE WHEN r.Kind = 'complete' THEN 'report' WHEN r.Kind IN ('end', 'cancel', 'review') THEN 'book' END
  AND (r.Kind <> 'complete' OR (SELECT count_if(IsAvailable) > 0 FROM technicians))
LEFT JOIN trips t ON t.TripID = r.TripID AND r.Ref IS NULL AND r.Kind IN ('end', 'cancel', 'review')
LEFT JOIN (SELECT m.LogID, m.VehicleID, m.Status, a.tech FROM maintenance_logs m
           JOIN (SELECT LogID, arg_min(TechnicianID, AssignmentID) AS tech FROM technician_assignments GROUP BY LogID) a ON a.LogID = m.LogID) l
  ON l.LogID = r.LogID AND r.Ref IS NULL AND r.Kind = 'complete'"""),
    ("plan_discounts", f"SELECT map(list(PlanID), list(CAST({DISCOUNT} AS DECIMAL(5,2)))) AS discounts FROM membership_plans"),
    ("staff", "SELECT map(list(TechnicianID), list(ActiveAssignments)) AS loads, list(TechnicianID) FILTER (IsAvailable) AS free FROM technicians"),
    ("q", """
SELECT m.*, u.UserID IS NOT NULL AS has_user, u.WalletBalance AS bal0, u.PlanID AS plan0, v.VehicleID IS NOT NULL AS has_vehicle,
  v.Status AS vstatus, v.RatePerHour AS rate, s.StationID IS NOT NULL AS has_station, p.PlanID IS NOT NULL AS has_plan, p.Cost AS plan_cost,
  coalesce(o.n, 0) AS open0, d.discounts, f.free, who || ':' || veh AS pair
FROM mixed m LEFT JOIN users u ON u.UserID = m.who LEFT JOIN vehicles v ON v.VehicleID = m.veh
LEFT JOIN stations s ON s.StationID = m.StationID LEFT JOIN membership_plans p ON p.PlanID = m.PlanID
LEFT JOIN (SELECT UserID, VehicleID, count(*) AS n FROM trips WHERE Status = 'Ongoing' GROUP BY ALL) o
  ON o.UserID = m.who AND o.VehicleID = m.veh, plan_discounts d, staff f""")]

WALK = f"""
WITH RECURSIVE walk(i, RequestID, Reason, Applied, Cost, tech, tstat, bal, plan, vs, ts, fare, lt, done, loads, opens) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), false, CAST(NULL AS DECIMAL(22,2)), CAST(NULL AS INT),
    CAST(NULL AS VARCHAR), CAST(MAP {{}} AS MAP(INT, DECIMAL(22,2))), CAST(MAP {{}} AS MAP(INT, INT)), CAST(MAP {{}} AS MAP(INT, VARCHAR)),
    CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST(MAP {{}} AS MAP(VARCHAR, DECIMAL(22,2))), CAST(MAP {{}} AS MAP(VARCHAR, INT)),
    CAST(MAP {{}} AS MAP(VARCHAR, BOOLEAN)), CAST(loads AS MAP(INT, INT)), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) FROM staff
  UNION ALL
  SELECT i, RequestID, Reason, Applied, CASE WHEN Kind = 'book' AND Applied THEN price END, tech, trip_now,
    CASE WHEN Applied AND bal0 IS NOT NULL AND Kind IN ('book', 'cancel', 'topup', 'purchase') THEN map_concat(bal, MAP {{who: CAST(
      coalesce(bal[who], 0) + CASE Kind WHEN 'book' THEN -price WHEN 'cancel' THEN refund WHEN 'topup' THEN amount_value ELSE -plan_cost END
      AS DECIMAL(22,2))}}) ELSE bal END,
    CASE WHEN Applied AND Kind = 'purchase' THEN map_concat(plan, MAP {{who: PlanID}}) ELSE plan END,
    CASE WHEN NOT Applied THEN vs WHEN Kind IN ('end', 'cancel', 'complete') THEN map_concat(vs, MAP {{veh: 'available'}})
      WHEN Kind = 'book' THEN map_concat(vs, MAP {{veh: 'in-use'}})
      WHEN Kind = 'report' AND veh_now = 'available' THEN map_concat(vs, MAP {{veh: 'under-maintenance'}}) ELSE vs END,
    CASE WHEN Applied AND Kind IN ('book', 'end', 'cancel')
      THEN map_concat(ts, MAP {{k: CASE Kind WHEN 'book' THEN 'Ongoing' WHEN 'end' THEN 'Completed' ELSE 'Cancelled' END}}) ELSE ts END,
    CASE WHEN Applied AND Kind = 'book' THEN map_concat(fare, MAP {{k: price}}) ELSE fare END,
    CASE WHEN Applied AND Kind = 'report' AND tech IS NOT NULL THEN map_concat(lt, MAP {{k: tech}}) ELSE lt END,
    CASE WHEN Applied AND Kind = 'complete' THEN map_concat(done, MAP {{k: true}}) ELSE done END,
    CASE WHEN NOT Applied OR tech IS NULL OR loads[tech] IS NULL THEN loads
      WHEN Kind = 'report' THEN map_concat(loads, MAP {{tech: loads[tech] + 1}})
      WHEN Kind = 'complete' THEN map_concat(loads, MAP {{tech: greatest(loads[tech] - 1, 0)}}) ELSE loads END,
    CASE WHEN Applied AND Kind = 'book' THEN map_concat(opens, MAP {{pair: coalesce(opens[pair], 0) + 1}})
      WHEN Applied AND Kind IN ('end', 'cancel') AND trip_now = 'Ongoing' THEN map_concat(opens, MAP {{pair: coalesce(opens[pair], 0) - 1}})
      ELSE opens END
  FROM (
    SELECT *, Reason IS NULL AND CASE WHEN Kind IN ('end', 'cancel') THEN trip_now IS NOT NULL ELSE Kind NOT IN ('review', 'register') END AS Applied,
      CASE WHEN Reason IS NOT NULL THEN NULL
        WHEN Kind = 'report' THEN list_min([{{'l': e.value, 't': e.key}} FOR e IN map_entries(loads) IF list_contains(free, e.key)]).t
        WHEN Kind = 'complete' THEN coalesce(ltech, lt[k]) END AS tech
    FROM (
      SELECT *, CASE Kind
        WHEN 'book' THEN CASE WHEN veh_now IS NULL OR veh_now <> 'available' THEN {_txt(B.NOT_AVAILABLE)}
          WHEN abs(price) > {TOP} THEN {_txt(C.OUT_OF_RANGE)} WHEN purse < price THEN {_txt(B.NO_BALANCE)}
          WHEN purse - price > {TOP} THEN {_txt(C.OUT_OF_RANGE)} WHEN NOT has_user THEN '{FK}UserID'
          WHEN NOT has_station THEN '{FK}StartStationID' END
        WHEN 'end' THEN CASE WHEN trip_now IS NOT NULL AND StationID IS NOT NULL AND NOT has_station THEN '{FK}EndStationID' END
        WHEN 'cancel' THEN CASE WHEN trip_now <> 'Ongoing' THEN {_txt(C.NOT_ONGOING)} WHEN purse + refund > {TOP} THEN {_txt(C.OUT_OF_RANGE)} END
        WHEN 'topup' THEN CASE WHEN amount IS NULL THEN {_txt("Missing 'amount' field")} WHEN amount_value IS NULL THEN 'Invalid amount'
          WHEN amount_value <= 0 THEN 'Amount must be positive' WHEN NOT has_user THEN 'User not found'
          WHEN purse + amount_value > {TOP} THEN {_txt(C.OUT_OF_RANGE)} END
        WHEN 'purchase' THEN CASE WHEN coalesce(UserID, 0) = 0 OR coalesce(PlanID, 0) = 0 THEN 'user_id and plan_id are required'
          WHEN NOT has_plan THEN 'Plan not found' WHEN NOT has_user THEN 'User not found' WHEN purse < plan_cost THEN {_txt(B.NO_FUNDS)} END
        WHEN 'report' THEN CASE WHEN trim(IssueReported) = '' THEN {_txt(M.BLANK_ISSUE)} WHEN coalesce(UserID, 0) = 0 THEN 'User ID required'
          WHEN coalesce(user_role, 'user') <> 'admin' AND open0 + coalesce(opens[pair], 0) <= 0 THEN {_txt(M.NOT_YOUR_VEHICLE)}
          WHEN NOT has_vehicle THEN '{FK}VehicleID' END
        WHEN 'complete' THEN CASE WHEN coalesce(user_role, 'user') <> 'admin' THEN {_txt(C.ADMIN_REQUIRED)}
          WHEN target = 0 OR (target = 1 AND lt[k] IS NULL) THEN {_txt(B.NO_ASSIGNMENT)}
          WHEN coalesce(done[k], lstatus = 'Completed', false) THEN {_txt(R.LOG_DONE)} END END AS Reason
      FROM (
        SELECT q.*, w.bal, w.plan, w.vs, w.ts, w.fare, w.lt, w.done, w.loads, w.opens,
          coalesce(w.vs[q.veh], q.vstatus) AS veh_now, coalesce(w.ts[q.k], q.tstatus) AS trip_now,
          CAST(q.bal0 + coalesce(w.bal[q.who], 0) AS DECIMAL(22,2)) AS purse, coalesce(q.tc, w.fare[q.k]) AS refund,
          CAST((q.rate * q.DurationHours) * (1 - coalesce(q.discounts[coalesce(w.plan[q.who], q.plan0)], 0.00)) AS DECIMAL(22,2)) AS price
        FROM walk w JOIN q ON q.i = w.i + 1) a) b) c),
d AS (
  SELECT q.RequestID, q.Kind, w.Applied, w.Cost, w.tech, w.tstat, w.Reason AS why, q.k, q.who, q.email, q.TripID, q.rating, q.password, q.name,
    TRY_CAST(q.rating AS INT) AS stars
  FROM walk w JOIN q ON q.i = w.i),
s AS (
  SELECT *, CASE WHEN Kind = 'review' THEN CASE WHEN stars IS NULL THEN {_txt("Invalid or missing 'rating'")}
      WHEN stars NOT BETWEEN 1 AND 5 THEN 'Rating must be between 1 and 5' WHEN tstat IS NULL THEN {_txt(R.NO_TRIP)}
      WHEN tstat <> 'Completed' THEN {_txt(R.NOT_REVIEWABLE)} END
    WHEN Kind = 'register' THEN CASE WHEN password IS NULL THEN {_txt("'NoneType' object has no attribute 'encode'")}
      WHEN name IS NULL OR email IS NULL THEN {_txt(R.EMAIL_TAKEN)} END ELSE why END AS static
  FROM d),
f AS (
  SELECT *, CASE WHEN static IS NOT NULL OR Kind NOT IN ('review', 'register') THEN static
    WHEN Kind = 'review' AND (row_number() OVER first > 1 OR EXISTS (SELECT 1 FROM reviews v WHERE 'T' || v.TripID = s.k AND v.UserID = s.who))
      THEN {_txt(R.REVIEWED)}
    WHEN Kind = 'register' AND (row_number() OVER first > 1 OR EXISTS (SELECT 1 FROM users u WHERE lower(u.Email) = lower(s.email)))
      THEN {_txt(R.EMAIL_TAKEN)} END AS Reason
  FROM s WINDOW first AS (PARTITION BY Kind, static, CASE Kind WHEN 'review' THEN k WHEN 'register' THEN lower(email) END ORDER BY RequestID)),
final AS (SELECT *, Reason IS NULL AND (Applied OR Kind IN ('review', 'register')) AS Done FROM f)"""


LAST = "(SELECT * FROM walk ORDER BY i DESC LIMIT 1)"


def _replay(td: TestData) -> R.Replay:
    return R.replay_commands(td.mixed_requests(), {name: td.table(name) for name in TABLES})


@register("replay_commands", WALK + """
SELECT RequestID, Kind, Reason IS NULL AS Accepted, Reason, Done AS Applied, CAST(Cost AS DECIMAL(10,2)) AS Cost, tech AS TechnicianID,
  CASE WHEN Kind = 'book' AND Done THEN CAST((SELECT max(TripID) FROM trips)
    + row_number() OVER (PARTITION BY Kind = 'book' AND Done ORDER BY RequestID) AS INT) END AS NewTripID
FROM final""", CTES)
def replay_commands(td: TestData):
    """Decisions of a mixed batch, in RequestID order over all kinds."""
    return _replay(td).decisions


@register("replay_commands_state", WALK + f""",
moved AS (
  SELECT q.veh, arg_max(CASE WHEN q.Kind = 'end' THEN {{'at': q.StationID}} ELSE {{'at': q.start}} END, q.RequestID).at AS at
  FROM final JOIN q ON q.RequestID = final.RequestID WHERE Done AND q.Kind IN ('end', 'cancel') GROUP BY q.veh)
SELECT 'users' AS TableName, u.UserID AS Key, CAST(CAST(u.WalletBalance + coalesce(w.bal[u.UserID], 0) AS DECIMAL(10,2)) AS VARCHAR) AS Value,
  CAST(coalesce(w.plan[u.UserID], u.PlanID) AS VARCHAR) AS Other
FROM users u, {LAST} w
UNION ALL
SELECT 'vehicles', v.VehicleID, coalesce(w.vs[v.VehicleID], v.Status),
  CAST(CASE WHEN m.veh IS NOT NULL THEN m.at ELSE v.CurrentStationID END AS VARCHAR)
FROM vehicles v LEFT JOIN moved m ON m.veh = v.VehicleID, {LAST} w
UNION ALL
SELECT 'technicians', t.TechnicianID, CAST(coalesce(w.loads[t.TechnicianID], t.ActiveAssignments) AS VARCHAR), CAST(t.IsAvailable AS VARCHAR)
FROM technicians t, {LAST} w
UNION ALL
SELECT 'trips', t.TripID, coalesce(w.ts['T' || t.TripID], t.Status), CAST(t.Cost AS VARCHAR) FROM trips t, {LAST} w
UNION ALL
SELECT 'trips', CAST((SELECT max(TripID) FROM trips) + row_number() OVER (ORDER BY f.RequestID) AS INT), w.ts[f.k], CAST(CAST(f.Cost AS DECIMAL(10,2)) AS VARCHAR)
FROM final f, {LAST} w WHERE f.Kind = 'book' AND f.Done""", CTES)
def replay_commands_state(td: TestData):
    """Wallets and plans, vehicles, technicians' loads and trips after a mixed batch."""
    tables = _replay(td).tables
    rows = [("users", "UserID", "WalletBalance", "PlanID"), ("vehicles", "VehicleID", "Status", "CurrentStationID"),
            ("technicians", "TechnicianID", "ActiveAssignments", "IsAvailable"), ("trips", "TripID", "Status", "Cost")]
    parts = [tables[t].select(F.lit(t).alias("TableName"), F.col(key).alias("Key"), F.col(value).cast("string").alias("Value"),
                              F.col(other).cast("string").alias("Other")) for t, key, value, other in rows]
    return reduce(DataFrame.unionByName, parts)
