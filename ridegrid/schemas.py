"""Table schemas and declared constraints of the rental data model.

The constraint catalogues below drive the data-quality operators
(``ridegrid.operators.quality``) and the typed loaders.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
MONEY_MAX = Decimal("99999999.99")  # largest value of MONEY
RATE = T.DecimalType(5, 2)  # discounts and durations


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


I, S, D, B, DT, TS = T.IntegerType(), T.StringType(), MONEY, T.BooleanType(), T.DateType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    "membership_plans": _s(("PlanID", I, False), ("PlanName", S, False), ("Cost", D, False),
                           ("DurationMonths", I, False), ("Benefits", S, True)),
    "users": _s(("UserID", I, False), ("Name", S, False), ("Email", S, False), ("Password", S, False),
                ("Role", S, False), ("WalletBalance", D, True), ("JoinDate", DT, False), ("PlanID", I, True)),
    "stations": _s(("StationID", I, False), ("Name", S, False), ("Location", S, False),
                   ("Capacity", I, False), ("IsActive", B, False)),
    "vehicles": _s(("VehicleID", I, False), ("RegistrationNumber", S, False), ("Type", S, False),
                   ("Model", S, False), ("Manufacturer", S, False), ("RatePerHour", D, False),
                   ("Status", S, False), ("CurrentStationID", I, True)),
    "trips": _s(("TripID", I, False), ("UserID", I, False), ("VehicleID", I, False),
                ("StartStationID", I, False), ("EndStationID", I, True), ("StartTime", TS, False),
                ("EndTime", TS, True), ("Cost", D, False), ("Status", S, False)),
    "payments": _s(("PaymentID", I, False), ("TripID", I, True), ("UserID", I, False), ("Amount", D, False),
                   ("Timestamp", TS, True), ("Status", S, False)),
    "technicians": _s(("TechnicianID", I, False), ("Name", S, False), ("Specialization", S, False),
                      ("IsAvailable", B, False), ("ActiveAssignments", I, False)),
    "maintenance_logs": _s(("LogID", I, False), ("VehicleID", I, False), ("IssueReported", S, False),
                           ("ReportedDate", DT, False), ("Status", S, False)),
    "technician_assignments": _s(("AssignmentID", I, False), ("LogID", I, False), ("TechnicianID", I, False)),
    "reviews": _s(("ReviewID", I, False), ("TripID", I, False), ("UserID", I, False), ("VehicleID", I, False),
                  ("Rating", I, False), ("Comment", S, True), ("ReviewDate", DT, False)),
    "logs": _s(("LogID", I, False), ("TableName", S, False), ("OperationType", S, False), ("RecordID", I, True),
               ("ChangedBy", I, True), ("ChangeDescription", S, True), ("ChangeTimestamp", TS, True)),
}

TABLES = tuple(SCHEMAS)

# Fixed values of the data model (must equal the reference's DDL).
PRIMARY_KEYS = {
    "membership_plans": "PlanID", "users": "UserID", "stations": "StationID", "vehicles": "VehicleID",
    "trips": "TripID", "payments": "PaymentID", "technicians": "TechnicianID", "maintenance_logs": "LogID",
    "technician_assignments": "AssignmentID", "reviews": "ReviewID", "logs": "LogID",
}

# (table, columns, case_insensitive)
UNIQUE_KEYS = [
    ("users", ("Email",), True),
    ("vehicles", ("RegistrationNumber",), True),
    ("technician_assignments", ("LogID", "TechnicianID"), False),
    ("reviews", ("UserID", "TripID"), False),
]

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("users", "PlanID", "membership_plans", "PlanID"),
    ("vehicles", "CurrentStationID", "stations", "StationID"),
    ("trips", "UserID", "users", "UserID"),
    ("trips", "VehicleID", "vehicles", "VehicleID"),
    ("trips", "StartStationID", "stations", "StationID"),
    ("trips", "EndStationID", "stations", "StationID"),
    ("payments", "TripID", "trips", "TripID"),
    ("payments", "UserID", "users", "UserID"),
    ("maintenance_logs", "VehicleID", "vehicles", "VehicleID"),
    ("technician_assignments", "LogID", "maintenance_logs", "LogID"),
    ("technician_assignments", "TechnicianID", "technicians", "TechnicianID"),
    ("reviews", "TripID", "trips", "TripID"),
    ("reviews", "UserID", "users", "UserID"),
    ("reviews", "VehicleID", "vehicles", "VehicleID"),
]

# Enumerated domains (ENUM columns) and the two conventional ones.
ENUM_DOMAINS = {
    ("users", "Role"): ("user", "admin"),
    ("vehicles", "Status"): ("available", "in-use", "under-maintenance", "decommissioned"),
    ("trips", "Status"): ("Upcoming", "Ongoing", "Completed", "Cancelled"),
    ("logs", "OperationType"): ("INSERT", "UPDATE", "DELETE"),
}
CONVENTIONAL_DOMAINS = {
    ("maintenance_logs", "Status"): ("Pending", "In-Progress", "Completed"),
    ("payments", "Status"): ("Success", "Refunded"),
}

# VARCHAR(n) limits.
MAX_LENGTHS = {
    ("membership_plans", "PlanName"): 50,
    ("users", "Name"): 100, ("users", "Email"): 100, ("users", "Password"): 100,
    ("stations", "Name"): 100, ("stations", "Location"): 255,
    ("vehicles", "RegistrationNumber"): 20, ("vehicles", "Type"): 50, ("vehicles", "Model"): 50,
    ("vehicles", "Manufacturer"): 50,
    ("payments", "Status"): 20,
    ("technicians", "Name"): 100, ("technicians", "Specialization"): 100,
    ("maintenance_logs", "Status"): 50,
    ("logs", "TableName"): 50,
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
