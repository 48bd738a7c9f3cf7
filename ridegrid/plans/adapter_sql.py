"""The test-data adapter in SQL (DuckDB dialect), used by the oracle queries.

It is an independent second implementation of ``ridegrid.sources.testdata``:
the Spark side is written with the DataFrame API, this side in SQL, and the
driver compares their results.
"""

from __future__ import annotations

import re

from ridegrid.sources.seed import MEMBERSHIP_PLANS

# Name -> SELECT text.  Order matters: later entries refer to earlier ones.
ADAPTER_CTES: dict[str, str] = {
    "membership_plans": "SELECT * FROM (VALUES\n" + ",\n".join(
        f" ({i}, '{name}', CAST({cost} AS DECIMAL(10,2)), {months}, '{benefits}')"
        for i, name, cost, months, benefits in MEMBERSHIP_PLANS
    ) + "\n) AS p(PlanID, PlanName, Cost, DurationMonths, Benefits)",
    "stations": """
SELECT CAST(s_suppkey+1 AS INT) AS StationID, s_name AS Name, n_name AS Location,
 CAST(15+s_suppkey%16 AS INT) AS Capacity, s_suppkey%10<>4 AS IsActive
FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
    "users": """
SELECT CAST(c_custkey+1 AS INT) AS UserID, c_name AS Name,
 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email, c_name AS Password,
 CASE WHEN c_custkey%50=0 THEN 'admin' ELSE 'user' END AS Role,
 CAST(c_acctbal AS DECIMAL(10,2)) AS WalletBalance,
 CAST(TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey%365 AS INT) AS DATE) AS JoinDate,
 CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS INT) AS PlanID
FROM customer""",
    "vehicles": """
SELECT CAST(p_partkey+1 AS INT) AS VehicleID, 'KA-' || lpad(CAST(p_partkey AS VARCHAR),8,'0') AS RegistrationNumber,
 p_type AS Type, p_name AS Model, p_brand AS Manufacturer, CAST(p_retailprice AS DECIMAL(10,2)) AS RatePerHour,
 CASE WHEN p_partkey%10<6 THEN 'available' WHEN p_partkey%10<8 THEN 'in-use'
      WHEN p_partkey%10=8 THEN 'under-maintenance' ELSE 'decommissioned' END AS Status,
 CASE WHEN p_partkey%17<>0 THEN CAST(1+(p_partkey*7+CAST(floor(p_partkey/11) AS BIGINT))%(SELECT count(*)-1 FROM supplier) AS INT) END AS CurrentStationID
FROM part""",
    "trips": """
SELECT CAST(o_orderkey+1 AS INT) AS TripID, CAST(o_custkey+1 AS INT) AS UserID,
 CAST(1+o_orderkey%(SELECT count(*) FROM part) AS INT) AS VehicleID,
 CAST(1+o_orderkey%(SELECT count(*) FROM supplier) AS INT) AS StartStationID,
 CASE WHEN o_orderstatus='F' THEN CAST(1+(o_orderkey*3)%(SELECT count(*) FROM supplier) AS INT) END AS EndStationID,
 o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey%24 AS INT) AS StartTime,
 CASE WHEN NOT (o_orderstatus='P' AND o_orderkey%2=1) THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey%24+1+o_orderkey%8 AS INT) END AS EndTime,
 CAST(o_totalprice AS DECIMAL(10,2)) AS Cost,
 CASE WHEN o_orderstatus='F' THEN 'Completed' WHEN o_orderstatus='O' THEN 'Ongoing'
      WHEN o_orderkey%2=0 THEN 'Cancelled' ELSE 'Upcoming' END AS Status
FROM orders""",
    "payments": """
SELECT TripID AS PaymentID, TripID, UserID, Cost AS Amount, StartTime AS Timestamp,
 CASE WHEN Status='Cancelled' THEN 'Refunded' ELSE 'Success' END AS Status
FROM trips WHERE Status<>'Upcoming'""",
    "technicians": """
SELECT CAST(n_nationkey+1 AS INT) AS TechnicianID, n_name AS Name, r_name AS Specialization,
 n_nationkey%4<>3 AS IsAvailable, CAST(n_nationkey%5 AS INT) AS ActiveAssignments
FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "maintenance_logs": """
SELECT CAST(event_id+1 AS INT) AS LogID, CAST(1+event_id%(SELECT count(*) FROM part) AS INT) AS VehicleID,
 'fault ' || props AS IssueReported, CAST(ts AS DATE) AS ReportedDate,
 CASE WHEN event_id%3=0 THEN 'Pending' WHEN event_id%3=1 THEN 'In-Progress' ELSE 'Completed' END AS Status
FROM events WHERE event_type='error'""",
    "technician_assignments": """
SELECT LogID AS AssignmentID, LogID, CAST(1+LogID%20 AS INT) AS TechnicianID
FROM maintenance_logs WHERE Status<>'Pending'""",
    "reviews": """
SELECT TripID AS ReviewID, TripID, UserID, VehicleID, CAST(1+TripID%5 AS INT) AS Rating, '' AS Comment,
 CAST(EndTime AS DATE) AS ReviewDate
FROM trips WHERE Status='Completed' AND TripID%3=0""",
    "logs": """
SELECT CAST(event_id+1 AS INT) AS LogID,
 CASE event_type WHEN 'purchase' THEN 'Trips' WHEN 'click' THEN 'Payments' WHEN 'view' THEN 'Vehicles'
      WHEN 'error' THEN 'MaintenanceLogs' ELSE 'Users' END AS TableName,
 CASE WHEN event_id%3=0 THEN 'INSERT' ELSE 'UPDATE' END AS OperationType,
 CAST(user_id+1 AS INT) AS RecordID, CAST(NULL AS INT) AS ChangedBy, props AS ChangeDescription,
 ts AS ChangeTimestamp
FROM events""",
    # request feeds
    "booking_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CAST(user_id+1 AS INT) AS UserID,
 CAST(1+(event_id*13)%(SELECT count(*) FROM part) AS INT) AS VehicleID,
 CAST(1+event_id%(SELECT count(*) FROM supplier) AS INT) AS StartStationID,
 CAST(0.25*(1+event_id%16) AS DECIMAL(5,2)) AS DurationHours
FROM events WHERE event_type='purchase'""",
    "end_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CAST(1+(event_id*7)%(SELECT count(*)+50 FROM orders) AS INT) AS TripID,
 CAST(1+event_id%(SELECT count(*)+1 FROM supplier) AS INT) AS EndStationID
FROM events WHERE event_type='view'""",
    "cancel_requests": """
SELECT event_id AS RequestID, ts AS RequestTime,
 CAST(1+(event_id*11)%(SELECT count(*)+50 FROM orders) AS INT) AS TripID
FROM events WHERE event_type='signup'""",
    "topup_requests": """
SELECT event_id AS RequestID, ts AS RequestTime,
 CAST(user_id+CASE WHEN event_id%50=3 THEN 1000000000 ELSE 1 END AS INT) AS UserID,
 CASE WHEN event_id%20=0 THEN 'abc' WHEN event_id%20=1 THEN '-5' WHEN event_id%20=2 THEN NULL
      ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END AS amount
FROM events WHERE event_type='click'""",
    "report_requests": """
SELECT e.event_id AS RequestID, e.ts AS RequestTime,
 CAST(CASE WHEN e.event_id%10=0 THEN NULL WHEN o.o_orderkey IS NULL THEN e.user_id+1 ELSE o.o_custkey+1 END AS INT) AS UserID,
 CASE WHEN e.event_id%5=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+COALESCE(o.o_orderkey, e.event_id)%(SELECT count(*) FROM part) AS INT) AS VehicleID,
 CASE WHEN e.event_id%40=7 THEN '   ' ELSE 'fault ' || e.props END AS IssueReported
FROM events e LEFT JOIN orders o ON o.o_orderkey=e.event_id AND e.event_id%5=0
WHERE e.event_type='error'""",
    "register_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, 'New User ' || CAST(event_id AS VARCHAR) AS name,
 CASE WHEN event_id%2=0 THEN 'USER' ELSE 'user' END
   || CAST((event_id*3)%(SELECT 2*count(*) FROM customer) AS VARCHAR) || '@example.com' AS email,
 props AS password
FROM events WHERE event_type='signup'""",
    "purchase_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CAST(user_id+1 AS INT) AS UserID, CAST(1+event_id%4 AS INT) AS PlanID
FROM events WHERE event_type='purchase'""",
    "review_requests": """
SELECT event_id AS RequestID, ts AS RequestTime,
 CAST(1+(event_id*5)%(SELECT count(*)+50 FROM orders) AS INT) AS TripID,
 CASE WHEN event_id%25=0 THEN 'x' ELSE CAST(event_id%7 AS VARCHAR) END AS rating, props AS comment
FROM events WHERE event_type='view'""",
    "complete_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%8=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+event_id AS INT) AS LogID
FROM events WHERE event_type='error'""",
    # feeds of the admin / profile commands
    "profile_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CAST(1+(event_id*3)%(SELECT count(*)+10 FROM customer) AS INT) AS UserID,
 CASE WHEN event_id%3=0 THEN '' ELSE 'Renamed ' || CAST(event_id AS VARCHAR) END AS name,
 CASE WHEN event_id%4=0 THEN NULL ELSE props END AS password
FROM events WHERE event_type='view'""",
    "station_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%7=0 THEN 'user' ELSE 'admin' END AS user_role,
 'Station ' || CAST(event_id AS VARCHAR) AS name,
 CASE WHEN event_id%11=0 THEN '' ELSE 'Zone ' || CAST(event_id%50 AS VARCHAR) END AS location,
 CAST(event_id%40 AS INT) AS capacity
FROM events WHERE event_type='signup'""",
    "deactivate_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%9=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+(event_id*7)%(SELECT count(*)+6 FROM supplier) AS INT) AS StationID
FROM events WHERE event_type='click'""",
    "vehicle_add_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%8=0 THEN 'user' ELSE 'admin' END AS user_role,
 CASE WHEN event_id%13=0 THEN '' ELSE 'Scooter' END AS type, 'Model ' || CAST(event_id%97 AS VARCHAR) AS model,
 'Maker ' || CAST(event_id%11 AS VARCHAR) AS manufacturer, CAST(value AS DECIMAL(10,2)) AS rate_per_hour,
 CASE WHEN event_id%10=0 THEN 'ka-' || lpad(CAST(event_id%(SELECT count(*) FROM part) AS VARCHAR),8,'0')
      ELSE 'KA-NEW-' || CAST(event_id%700 AS VARCHAR) END AS registration_number,
 CASE WHEN event_id%9=0 THEN NULL ELSE CAST(1+event_id%(SELECT count(*)+3 FROM supplier) AS INT) END AS station_id
FROM events WHERE event_type='purchase'""",
    "decommission_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%6=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+(event_id*3)%(SELECT count(*)+20 FROM part) AS INT) AS VehicleID
FROM events WHERE event_type='error'""",
    "technician_add_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%5=0 THEN 'user' ELSE 'admin' END AS user_role,
 'Tech ' || CAST(event_id AS VARCHAR) AS name,
 CASE WHEN event_id%4=0 THEN '' ELSE 'Spec ' || CAST(event_id%6 AS VARCHAR) END AS specialization
FROM events WHERE event_type='view'""",
    "technician_update_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%10=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+event_id%30 AS INT) AS TechnicianID,
 CASE WHEN event_id%3=0 THEN 'Tech ' || CAST(event_id AS VARCHAR) END AS name,
 CASE WHEN event_id%5=0 THEN 'Spec ' || CAST(event_id%6 AS VARCHAR) ELSE '' END AS specialization,
 CASE WHEN event_id%4=0 THEN event_id%8=0 END AS is_available
FROM events WHERE event_type='click'""",
    "onboard_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, 'Onboard ' || CAST(event_id AS VARCHAR) AS name,
 CASE WHEN event_id%6=0 THEN 'user' || CAST(event_id%(SELECT count(*) FROM customer) AS VARCHAR)
      ELSE 'new' || CAST((event_id*7)%(SELECT 2*count(*) FROM customer) AS VARCHAR) END || '@example.com' AS email,
 props AS password,
 CASE WHEN event_id%9=0 THEN '0' WHEN event_id%9=1 THEN 'abc'
      ELSE CAST(CAST(CAST(value AS DECIMAL(10,2))*100 AS DECIMAL(10,2)) AS VARCHAR) END AS topup,
 CASE WHEN event_id%7=0 THEN NULL ELSE CAST(1+event_id%4 AS INT) END AS PlanID
FROM events WHERE event_type='signup'""",
    "mixed_events": """
SELECT *, last_value(CASE WHEN Kind='book' THEN {'r': RequestID, 'u': u, 'v': v} END IGNORE NULLS) OVER near AS booked,
 last_value(CASE WHEN Kind='report' THEN RequestID END IGNORE NULLS) OVER near AS reported
FROM (SELECT event_id AS RequestID, ts AS RequestTime, value, props, CAST(user_id+1 AS INT) AS u,
 CAST(1+(event_id*13)%greatest((SELECT count(*) FROM part)//10, 1) AS INT) AS v,
 CASE event_type WHEN 'purchase' THEN 'book' WHEN 'view' THEN CASE WHEN event_id%3<2 THEN 'end' ELSE 'review' END
  WHEN 'signup' THEN CASE WHEN event_id%2=0 THEN 'cancel' ELSE 'register' END
  WHEN 'click' THEN CASE WHEN event_id%3<2 THEN 'topup' ELSE 'purchase' END
  ELSE CASE WHEN event_id%2=0 THEN 'report' ELSE 'complete' END END AS Kind FROM events)
WINDOW near AS (PARTITION BY RequestID//64 ORDER BY RequestID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "mixed_requests": """
SELECT RequestID, RequestTime, Kind, CASE WHEN Kind='report' AND RequestID%5=0 THEN booked.u ELSE u END AS UserID,
 CASE WHEN RequestID%5=0 THEN 'user' ELSE 'admin' END AS user_role,
 CASE WHEN Kind='report' AND RequestID%5=0 THEN booked.v ELSE v END AS VehicleID,
 CAST(1+RequestID%(SELECT count(*)+1 FROM supplier) AS INT) AS StationID, CAST(0.25*(1+RequestID%16) AS DECIMAL(5,2)) AS DurationHours,
 CAST(1+(RequestID*7)%(SELECT count(*)+50 FROM orders) AS INT) AS TripID, CAST(1+RequestID-RequestID%8 AS INT) AS LogID,
 CAST(1+RequestID%4 AS INT) AS PlanID,
 CASE WHEN Kind IN ('end','cancel','review') AND RequestID%4<>0 THEN booked.r
      WHEN Kind='complete' AND RequestID%4<>1 THEN reported END AS Ref,
 CASE WHEN RequestID%20=0 THEN 'abc' WHEN RequestID%20=1 THEN '-5' WHEN RequestID%20=2 THEN NULL
      ELSE CAST(CAST(value*20 AS DECIMAL(10,2)) AS VARCHAR) END AS amount,
 CASE WHEN RequestID%40=6 THEN '   ' ELSE 'fault ' || props END AS IssueReported,
 CASE WHEN RequestID%25=0 THEN 'x' ELSE CAST(RequestID%7 AS VARCHAR) END AS rating, props AS comment,
 'New User ' || CAST(RequestID AS VARCHAR) AS name,
 CASE WHEN RequestID%4=1 THEN 'USER' ELSE 'user' END || CAST((RequestID*3)%(SELECT 2*count(*) FROM customer) AS VARCHAR) || '@example.com' AS email,
 props AS password
FROM mixed_events""",
    # dirty copies
    "redelivered_requests": """
SELECT RequestID, UserID FROM booking_requests
UNION ALL SELECT RequestID, UserID FROM booking_requests WHERE RequestID%25=4""",
    "imported_users": """
SELECT UserID, CASE WHEN UserID%40=7 THEN Name || ' ' || repeat('x', 100) ELSE Name END AS Name,
 CASE WHEN UserID%40<>9 THEN Email END AS Email, CASE WHEN UserID%40=11 THEN 'root' ELSE Role END AS Role
FROM users""",
    "technician_delete_requests": """
SELECT event_id AS RequestID, ts AS RequestTime, CASE WHEN event_id%7=0 THEN 'user' ELSE 'admin' END AS user_role,
 CAST(1+event_id%30 AS INT) AS TechnicianID
FROM events WHERE event_type='error'""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _refs(text: str) -> set[str]:
    return {w for w in _WORD.findall(text) if w in ADAPTER_CTES}


def with_tables(body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the adapter CTEs it uses (transitively), in order.

    ``extra_ctes`` are query-specific CTEs placed after the adapter ones; they
    are materialized (DuckDB then evaluates them once even when a recursive
    CTE reads them on every step).  A body starting with ``WITH RECURSIVE``
    is merged into the same WITH clause.
    """
    extra_ctes = extra_ctes or []
    need: set[str] = set()
    todo = _refs(body)
    for _, text in extra_ctes:
        todo |= _refs(text)
    while todo:
        name = todo.pop()
        if name in need:
            continue
        need.add(name)
        todo |= _refs(ADAPTER_CTES[name]) - need
    parts = [f"{n} AS ({ADAPTER_CTES[n].strip()})" for n in ADAPTER_CTES if n in need]
    parts += [f"{n} AS MATERIALIZED ({t.strip()})" for n, t in extra_ctes]
    body = body.strip()
    head = "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        head = "WITH RECURSIVE "
        body = body[len("WITH RECURSIVE "):]
        return head + ",\n".join(parts + [body]) if parts else head + body
    if not parts:
        return body
    return head + ",\n".join(parts) + "\n" + body
