"""Registered reporting queries (joins, filters, aggregates, top-n, expressions)."""

from __future__ import annotations

from ridegrid.functions import exprs as E
from ridegrid.operators import views as V
from ridegrid.plans.registry import register
from ridegrid.sources.testdata import TestData

# Oracles look values up one by one (scalar subqueries) where the views join, and keep a row
# only if every required lookup finds something.
DISCOUNT_SQL = "CAST(CASE {p} " + " ".join(
    f"WHEN '{plan}' THEN {pct}" for plan, pct in E.PLAN_DISCOUNTS) + f" ELSE {E.NO_DISCOUNT} END AS DECIMAL(5,2))"

HISTORY_SQL = """
SELECT * EXCLUDE (has_vehicle) FROM (
  SELECT trips.TripID, trips.UserID,
         (SELECT Name FROM users WHERE UserID = trips.UserID) AS UserName,
         (SELECT Type FROM vehicles WHERE VehicleID = trips.VehicleID) AS VehicleType,
         (SELECT Name FROM stations WHERE StationID = trips.StartStationID) AS StartStation,
         (SELECT Name FROM stations WHERE StationID = trips.EndStationID) AS EndStation,
         trips.StartTime, trips.EndTime, trips.Cost, trips.Status,
         trips.VehicleID IN (SELECT VehicleID FROM vehicles) AS has_vehicle
  FROM trips) looked_up
WHERE has_vehicle AND UserName IS NOT NULL AND StartStation IS NOT NULL"""

DETAILS_SQL = """
SELECT VehicleID, RegistrationNumber, Type, Model, Manufacturer, RatePerHour, Status,
       (SELECT Name FROM stations WHERE StationID = vehicles.CurrentStationID) AS CurrentStationName
FROM vehicles WHERE NOT (Status = 'decommissioned')"""

ASSIGNMENTS_SQL = """
SELECT AssignmentID, LogID, TechnicianID, tech.Name AS TechnicianName, tech.Specialization AS Specialization,
       tech.IsAvailable AS IsAvailable, tech.ActiveAssignments AS ActiveAssignments, log.VehicleID AS VehicleID,
       veh.RegistrationNumber AS RegistrationNumber, veh.Model AS VehicleModel, veh.Type AS VehicleType,
       log.IssueReported AS IssueReported, log.ReportedDate AS ReportedDate, log.Status AS LogStatus
FROM (SELECT *, (SELECT one FROM vehicles AS one WHERE one.VehicleID = log.VehicleID) AS veh
      FROM (SELECT *, (SELECT one FROM technicians AS one WHERE one.TechnicianID = given.TechnicianID) AS tech,
                   (SELECT one FROM maintenance_logs AS one WHERE one.LogID = given.LogID) AS log
            FROM technician_assignments AS given) two) three
WHERE tech IS NOT NULL AND log IS NOT NULL AND veh IS NOT NULL"""

PROFILE_SQL = f"""
SELECT *, {DISCOUNT_SQL.format(p='PlanName')} AS PlanDiscount
FROM (SELECT UserID, Name, Email, WalletBalance, JoinDate, Role, PlanID,
             (SELECT PlanName FROM membership_plans WHERE PlanID = users.PlanID) AS PlanName FROM users) looked_up"""


def history(td: TestData):
    return V.trip_history(td.trips(), td.users(), td.vehicles(), td.stations())


def details(td: TestData):
    return V.vehicle_details(td.vehicles(), td.stations())


def assignments_view(td: TestData):
    return V.technician_assignments(td.technician_assignments(), td.technicians(), td.maintenance_logs(),
                                    td.vehicles())


@register("station_availability", """
SELECT StationID, Name, Location, Capacity,
       (SELECT count(*) FROM vehicles WHERE CurrentStationID = stations.StationID AND Status = 'available') AS AvailableVehicles
FROM stations WHERE IsActive""")
def station_availability(td: TestData):
    """J1/A1/F4 (flagship): available vehicles per active station."""
    return V.station_availability(td.stations(), td.vehicles())


@register("vehicle_details", DETAILS_SQL)
def vehicle_details(td: TestData):
    """J2/F3."""
    return details(td)


@register("trip_history", HISTORY_SQL)
def trip_history(td: TestData):
    """J3."""
    return history(td)


@register("technician_assignments", ASSIGNMENTS_SQL)
def technician_assignments(td: TestData):
    """J4."""
    return assignments_view(td)


@register("user_profiles", PROFILE_SQL)
def user_profiles(td: TestData):
    """J5/E1."""
    return V.user_profiles(td.users(), td.membership_plans())


@register("assignment_status", """
SELECT * FROM (SELECT AssignmentID, LogID, TechnicianID,
                     (SELECT Status FROM maintenance_logs WHERE LogID = technician_assignments.LogID) AS Status
               FROM technician_assignments) x WHERE Status IS NOT NULL""")
def assignment_status(td: TestData):
    """J6."""
    return V.assignment_status(td.technician_assignments(), td.maintenance_logs())


@register("vehicles_at_station", """
SELECT CurrentStationID, VehicleID, Type, Model, Manufacturer, RatePerHour, Status
FROM vehicles WHERE CurrentStationID IS NOT NULL AND Status = 'available'""")
def vehicles_at_station(td: TestData):
    """F1 for every station."""
    return V.vehicles_at_station(td.vehicles())


@register("vehicles_at_station_by_name", f"""
SELECT s.StationID, d.VehicleID, d.RegistrationNumber, d.Type, d.Model, d.Manufacturer, d.RatePerHour, d.Status,
       d.CurrentStationName
FROM stations s JOIN ({DETAILS_SQL}) d ON d.CurrentStationName = s.Name
WHERE d.Status = 'available'""")
def vehicles_at_station_by_name(td: TestData):
    """F2 for every station."""
    return V.vehicles_at_station_by_name(details(td), td.stations())


@register("user_rides", f"""
SELECT * FROM ({HISTORY_SQL}) h WHERE lower(h.Status) = lower('completed')""")
def user_rides(td: TestData):
    """F5/O1 with the status filter given in lower case (collation is case-insensitive)."""
    return V.user_rides(history(td), status="completed")


@register("reports_with_ongoing_trip", """
SELECT r.*, (coalesce(r.user_role, 'user') = 'admin'
             OR EXISTS (SELECT 1 FROM trips t WHERE t.Status = 'Ongoing' AND t.UserID = r.UserID
                        AND t.VehicleID = r.VehicleID)) AS Authorised
FROM report_requests r""")
def reports_with_ongoing_trip(td: TestData):
    """F6."""
    return V.authorised_reports(td.report_requests(), td.trips())


@register("user_by_email", f"""
SELECT r.email AS LookupEmail, p.*
FROM register_requests r JOIN ({PROFILE_SQL}) p ON lower(r.email) = lower(p.Email)""")
def user_by_email(td: TestData):
    """look up every registration e-mail among existing users (login's data half)."""
    return V.users_by_email(td.users(), td.membership_plans(), td.register_requests())


@register("reviewable_trips", "SELECT * FROM trips WHERE Status = 'Completed'")
def reviewable_trips(td: TestData):
    """F8."""
    return V.reviewable_trips(td.trips())


@register("active_trip", f"""
SELECT TripID, UserID, UserName, VehicleType, StartStation, EndStation, StartTime, EndTime, Cost, Status
FROM (SELECT h.*, row_number() OVER (PARTITION BY UserID ORDER BY StartTime DESC, TripID DESC) AS rn
      FROM ({HISTORY_SQL}) h WHERE h.Status = 'Ongoing') x
WHERE rn = 1""")
def active_trip(td: TestData):
    """F10."""
    return V.active_trip(history(td))


@register("open_assignments", f"SELECT * FROM ({ASSIGNMENTS_SQL}) a WHERE a.LogStatus != 'Completed'")
def open_assignments(td: TestData):
    """F11."""
    return V.open_assignments(assignments_view(td))


@register("decommissionable_vehicles", f"SELECT * FROM ({DETAILS_SQL}) d WHERE d.Status = 'available'")
def decommissionable_vehicles(td: TestData):
    """F12."""
    return V.decommissionable_vehicles(details(td))


@register("deletable_technicians", """
SELECT t.* FROM technicians t
WHERE NOT (t.ActiveAssignments > 0)
  AND NOT EXISTS (SELECT 1 FROM technician_assignments a WHERE a.TechnicianID = t.TechnicianID)""")
def deletable_technicians(td: TestData):
    """F13."""
    return V.deletable_technicians(td.technicians(), td.technician_assignments())


@register("affordable_plans", """
SELECT u.UserID, u.WalletBalance, p.PlanID, p.PlanName, p.Cost AS PlanCost
FROM users u JOIN membership_plans p ON NOT (u.WalletBalance < p.Cost)""")
def affordable_plans(td: TestData):
    """F14."""
    return V.affordable_plans(td.users(), td.membership_plans())


@register("users_without_plan", "SELECT UserID, Name, Email, WalletBalance FROM users WHERE PlanID IS NULL")
def users_without_plan(td: TestData):
    """F15."""
    return V.users_without_plan(td.users())


@register("ride_counts_by_user", f"""
SELECT UserID, count(*) AS TotalRides FROM ({HISTORY_SQL}) h GROUP BY UserID""")
def ride_counts_by_user(td: TestData):
    """A3."""
    return V.ride_counts(td.trips(), td.users(), td.vehicles(), td.stations())


@register("fleet_available_count", f"""
SELECT (SELECT count(*) FROM stations WHERE IsActive) AS TotalStations,
       (SELECT count(*) FROM ({DETAILS_SQL}) d) AS TotalVehicles,
       (SELECT count(*) FROM ({DETAILS_SQL}) d WHERE d.Status = 'available') AS AvailableVehicles""")
def fleet_available_count(td: TestData):
    """A4 (+ the other two global tiles)."""
    return V.fleet_counts(td.stations(), td.vehicles())


@register("dashboard_kpis", f"""
SELECT u.UserID,
       (SELECT count(*) FROM stations WHERE IsActive) AS TotalStations,
       (SELECT count(*) FROM ({DETAILS_SQL}) d) AS TotalVehicles,
       (SELECT count(*) FROM ({DETAILS_SQL}) d WHERE d.Status = 'available') AS AvailableVehicles,
       coalesce(r.n, 0) AS TotalRides
FROM users u LEFT JOIN (SELECT UserID, count(*) AS n FROM ({HISTORY_SQL}) h GROUP BY UserID) r
  ON u.UserID = r.UserID""")
def dashboard_kpis(td: TestData):
    """A2."""
    return V.dashboard_kpis(td.stations(), td.vehicles(), td.trips(), td.users())


@register("technician_roster", "SELECT * FROM technicians ORDER BY lower(Name), TechnicianID")
def technician_roster(td: TestData):
    """O3."""
    return V.technician_roster(td.technicians())


@register("assignments_by_date", f"""
SELECT * FROM ({ASSIGNMENTS_SQL}) a ORDER BY ReportedDate DESC, AssignmentID DESC""")
def assignments_by_date(td: TestData):
    """O4."""
    return V.assignments_by_date(assignments_view(td))


LOGS_COLS = "LogID, TableName, OperationType, RecordID, ChangedBy, ChangeDescription, ChangeTimestamp"


@register("recent_logs", f"""
SELECT {LOGS_COLS} FROM logs ORDER BY ChangeTimestamp DESC, LogID DESC LIMIT 100""")
def recent_logs(td: TestData):
    """Newest 100 audit rows (the listing's default page)."""
    return V.recent_logs(td.logs())


@register("logs_by_table", f"""
SELECT {LOGS_COLS} FROM logs WHERE lower(TableName) = 'trips'
ORDER BY ChangeTimestamp DESC, LogID DESC LIMIT 500""")
def logs_by_table(td: TestData):
    """One table's newest audit rows, table named in lower case, largest page."""
    return V.recent_logs(td.logs(), table="trips", limit=500)


@register("least_loaded_technician", """
SELECT * FROM technicians WHERE IsAvailable ORDER BY ActiveAssignments, TechnicianID LIMIT 1""")
def least_loaded_technician(td: TestData):
    """O6."""
    return V.least_loaded_technician(td.technicians())


@register("booking_quotes", f"""
SELECT b.RequestID, b.UserID, b.VehicleID, b.DurationHours,
       coalesce(p.PlanDiscount, CAST(0.00 AS DECIMAL(5,2))) AS Discount,
       CAST((v.RatePerHour * b.DurationHours) * (1 - coalesce(p.PlanDiscount, CAST(0.00 AS DECIMAL(5,2))))
            AS DECIMAL(10,2)) AS Cost,
       b.RequestTime + INTERVAL '1' HOUR * CAST(round(b.DurationHours) AS INT) AS ExpectedEnd,
       NOT coalesce(p.WalletBalance < CAST((v.RatePerHour * b.DurationHours)
            * (1 - coalesce(p.PlanDiscount, CAST(0.00 AS DECIMAL(5,2)))) AS DECIMAL(10,2)), false) AS Affordable
FROM booking_requests b LEFT JOIN vehicles v ON b.VehicleID = v.VehicleID
LEFT JOIN ({PROFILE_SQL}) p ON b.UserID = p.UserID""")
def booking_quotes(td: TestData):
    """Price, expected end and affordability of every booking request."""
    return V.booking_quotes(td.booking_requests(), td.vehicles(), td.users(), td.membership_plans())


@register("vehicle_labels", f"""
SELECT VehicleID, coalesce(Manufacturer, '') || ' • ' || coalesce(Type, '') AS MakeAndType,
       coalesce(nullif(Model, ''), 'N/A') AS ModelLabel,
       coalesce(nullif(CurrentStationName, ''), 'N/A') AS StationLabel
FROM ({DETAILS_SQL}) d""")
def vehicle_labels(td: TestData):
    """E11."""
    return V.vehicle_labels(details(td))


@register("money_text", """
SELECT UserID, coalesce(CAST(CAST(WalletBalance AS DECIMAL(10,2)) AS VARCHAR), '0.00') AS WalletText FROM users""")
def money_text(td: TestData):
    """E12."""
    return V.wallet_texts(td.users())


@register("password_digest", "SELECT UserID, sha256(Password) AS PasswordDigest FROM users")
def password_digest(td: TestData):
    """E6."""
    return V.password_digests(td.users())


@register("assignment_vehicle_label", f"""
SELECT AssignmentID, VehicleModel || ' (' || RegistrationNumber || ')' AS VehicleLabel
FROM ({ASSIGNMENTS_SQL}) a""")
def assignment_vehicle_label(td: TestData):
    """E15."""
    return V.assignment_labels(assignments_view(td))


@register("trip_history_json", f"""
SELECT CAST(json_object(
  'TripID', TripID, 'UserID', UserID, 'UserName', UserName, 'VehicleType', VehicleType, 'StartStation', StartStation,
  'EndStation', EndStation, 'StartTime', strftime(StartTime, '%Y-%m-%d %H:%M:%S'),
  'EndTime', strftime(EndTime, '%Y-%m-%d %H:%M:%S'), 'Cost', CAST(Cost AS VARCHAR), 'Status', Status) AS VARCHAR) AS json
FROM ({HISTORY_SQL}) h""")
def trip_history_json(td: TestData):
    """SNK1: trip history as JSON objects, with nulls written out."""
    from ridegrid.sources.sinks import to_json_rows
    return to_json_rows(history(td))
