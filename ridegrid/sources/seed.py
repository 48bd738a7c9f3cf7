"""Seed rows of the rental system, as inline tables.

Membership plans are the one dimension every pricing operator joins; the
other seed tables are golden fixtures for unit tests.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridegrid.schemas import SCHEMAS

# ---------------------------------------------------------------------------
# The reference's seed rows, in the order it inserts them.
# Ids are the AUTO_INCREMENT values they receive (1, 2, ...).
# ---------------------------------------------------------------------------
MEMBERSHIP_PLANS = [
    (1, "Basic Plan", Decimal("499.00"), 1, "Standard access to all vehicles, 5% discount on rides"),
    (2, "Premium Plan", Decimal("1299.00"), 3, "Priority booking, 10% discount on rides, free cancellation"),
    (3, "Annual Plan", Decimal("3999.00"), 12, "Maximum discount 15%, free vehicle maintenance report, priority support"),
]

STATIONS = [
    (1, "MG Road Station", "MG Road, Bengaluru, Karnataka 560001", 25, True),
    (2, "Indiranagar Station", "Indiranagar, Bengaluru, Karnataka 560038", 20, True),
    (3, "Koramangala Station", "Koramangala, Bengaluru, Karnataka 560095", 30, True),
    (4, "Whitefield Station", "Whitefield, Bengaluru, Karnataka 560066", 18, True),
    (5, "Electronic City Station", "Electronic City, Bengaluru, Karnataka 560100", 22, True),
    (6, "Hebbal Station", "Hebbal, Bengaluru, Karnataka 560024", 15, True),
    (7, "Jayanagar Station", "Jayanagar, Bengaluru, Karnataka 560011", 20, True),
    (8, "Marathahalli Station", "Marathahalli, Bengaluru, Karnataka 560037", 25, True),
    (9, "BTM Layout Station", "BTM Layout, Bengaluru, Karnataka 560076", 20, True),
    (10, "HSR Layout Station", "HSR Layout, Bengaluru, Karnataka 560102", 18, True),
]

# (RegistrationNumber, Type, Model, Manufacturer, RatePerHour, Status, CurrentStationID)
VEHICLES = [
    ("KA-01-AB-1234", "Scooter", "iQube", "TVS", "150.00", "available", 1),
    ("KA-01-CD-5678", "Scooter", "Aether", "Ather", "180.00", "available", 1),
    ("KA-01-EF-9012", "Bike", "Ola S1", "Ola Electric", "200.00", "available", 2),
    ("KA-01-GH-3456", "Bike", "Simple One", "Simple Energy", "190.00", "available", 2),
    ("KA-02-IJ-7890", "Scooter", "iQube S", "TVS", "160.00", "available", 3),
    ("KA-02-KL-2468", "Bike", "Ather 450X", "Ather", "220.00", "available", 3),
    ("KA-02-MN-1357", "Scooter", "Ola S1 Pro", "Ola Electric", "210.00", "available", 4),
    ("KA-03-OP-9753", "Bike", "Revolt RV400", "Revolt Motors", "195.00", "available", 4),
    ("KA-03-QR-8642", "Scooter", "iQube ST", "TVS", "155.00", "available", 5),
    ("KA-03-ST-7531", "Bike", "Ather 450X Pro", "Ather", "230.00", "available", 5),
    ("KA-04-UV-6420", "Scooter", "Ola S1 Air", "Ola Electric", "170.00", "available", 6),
    ("KA-04-WX-5319", "Bike", "Simple One Pro", "Simple Energy", "200.00", "available", 6),
    ("KA-05-YZ-4208", "Scooter", "iQube", "TVS", "150.00", "available", 7),
    ("KA-05-AA-3197", "Bike", "Ather 450", "Ather", "210.00", "available", 7),
    ("KA-05-BB-2086", "Scooter", "Ola S1", "Ola Electric", "200.00", "available", 8),
    ("KA-06-CC-1975", "Bike", "Revolt RV300", "Revolt Motors", "180.00", "available", 8),
    ("KA-06-DD-0864", "Scooter", "Aether 450", "Ather", "175.00", "available", 9),
    ("KA-06-EE-9753", "Bike", "Ola S1 Pro", "Ola Electric", "210.00", "available", 9),
    ("KA-07-FF-8642", "Scooter", "iQube S", "TVS", "160.00", "available", 10),
    ("KA-07-GG-7531", "Bike", "Ather 450X", "Ather", "220.00", "available", 10),
    ("KA-08-HH-6420", "Scooter", "Simple One", "Simple Energy", "190.00", "available", 1),
    ("KA-08-II-5319", "Bike", "Revolt RV400", "Revolt Motors", "195.00", "available", 2),
    ("KA-09-JJ-4208", "Scooter", "Ola S1 Air", "Ola Electric", "170.00", "available", 3),
    ("KA-09-KK-3197", "Bike", "Ather 450", "Ather", "210.00", "available", 4),
    ("KA-10-LL-2086", "Scooter", "iQube ST", "TVS", "155.00", "available", 5),
    ("KA-20-AA-1001", "Car", "Nexon EV", "Tata", "400.00", "available", 1),
    ("KA-20-AA-1002", "Car", "Tiago EV", "Tata", "300.00", "available", 2),
    ("KA-20-AA-1003", "Car", "MG ZS EV", "MG", "450.00", "available", 3),
    ("KA-20-AA-1004", "Car", "XUV400", "Mahindra", "420.00", "available", 4),
    ("KA-20-AA-1005", "Car", "Kona Electric", "Hyundai", "430.00", "available", 5),
    ("KA-20-AA-1006", "Car", "Ioniq 5", "Hyundai", "550.00", "available", 6),
    ("KA-20-AA-1007", "Car", "MG Comet", "MG", "280.00", "available", 7),
    ("KA-20-AA-1008", "Car", "Citroen eC3", "Citroen", "320.00", "available", 8),
    ("KA-20-AA-1009", "Car", "BYD Atto 3", "BYD", "500.00", "available", 9),
    ("KA-20-AA-1010", "Car", "Nexon EV", "Tata", "400.00", "available", 10),
    ("KA-20-BB-2001", "Car", "Tiago EV", "Tata", "300.00", "available", 1),
    ("KA-20-BB-2002", "Car", "MG ZS EV", "MG", "450.00", "available", 2),
    ("KA-20-BB-2003", "Car", "XUV400", "Mahindra", "420.00", "available", 3),
    ("KA-20-BB-2004", "Car", "Kona Electric", "Hyundai", "430.00", "available", 4),
    ("KA-20-BB-2005", "Car", "Ioniq 5", "Hyundai", "550.00", "available", 5),
    ("KA-20-BB-2006", "Car", "MG Comet", "MG", "280.00", "available", 6),
    ("KA-20-BB-2007", "Car", "Citroen eC3", "Citroen", "320.00", "available", 7),
    ("KA-20-BB-2008", "Car", "BYD Atto 3", "BYD", "500.00", "available", 8),
    ("KA-20-BB-2009", "Car", "Nexon EV", "Tata", "400.00", "available", 9),
    ("KA-20-BB-2010", "Car", "Tiago EV", "Tata", "300.00", "available", 10),
    ("KA-21-CC-3001", "Car", "MG ZS EV", "MG", "450.00", "available", 1),
    ("KA-21-CC-3002", "Car", "XUV400", "Mahindra", "420.00", "available", 2),
    ("KA-21-CC-3003", "Car", "Kona Electric", "Hyundai", "430.00", "available", 3),
    ("KA-21-CC-3004", "Car", "Ioniq 5", "Hyundai", "550.00", "available", 4),
    ("KA-21-CC-3005", "Car", "MG Comet", "MG", "280.00", "available", 5),
    ("KA-21-CC-3006", "Car", "Citroen eC3", "Citroen", "320.00", "available", 6),
    ("KA-21-CC-3007", "Car", "BYD Atto 3", "BYD", "500.00", "available", 7),
    ("KA-21-CC-3008", "Car", "Nexon EV", "Tata", "400.00", "available", 8),
    ("KA-21-CC-3009", "Car", "Tiago EV", "Tata", "300.00", "available", 9),
    ("KA-21-CC-3010", "Car", "MG ZS EV", "MG", "450.00", "available", 10),
    ("KA-21-DD-4001", "Car", "XUV400", "Mahindra", "420.00", "available", 1),
    ("KA-21-DD-4002", "Car", "Kona Electric", "Hyundai", "430.00", "available", 2),
    ("KA-21-DD-4003", "Car", "Ioniq 5", "Hyundai", "550.00", "available", 3),
    ("KA-21-DD-4004", "Car", "MG Comet", "MG", "280.00", "available", 4),
    ("KA-21-DD-4005", "Car", "Citroen eC3", "Citroen", "320.00", "available", 5),
    ("KA-21-DD-4006", "Car", "BYD Atto 3", "BYD", "500.00", "available", 6),
    ("KA-21-DD-4007", "Car", "Nexon EV", "Tata", "400.00", "available", 7),
    ("KA-21-DD-4008", "Car", "Tiago EV", "Tata", "300.00", "available", 8),
    ("KA-21-DD-4009", "Car", "MG ZS EV", "MG", "450.00", "available", 9),
    ("KA-21-DD-4010", "Car", "XUV400", "Mahindra", "420.00", "available", 10),
]

TECHNICIANS = [
    (1, "Rajesh Kumar", "Electric Vehicle Battery Systems", True, 0),
    (2, "Priya Sharma", "Motor and Controller Repair", True, 0),
    (3, "Anil Reddy", "Chassis and Bodywork", True, 0),
    (4, "Sneha Patel", "Software and Electronics", True, 0),
    (5, "Mohammed Ali", "Battery Management Systems", True, 0),
    (6, "Kavitha Nair", "General Maintenance", True, 0),
    (7, "Suresh Iyer", "Charging Infrastructure", True, 0),
    (8, "Deepa Menon", "Motor Diagnostics", True, 0),
]
# ---------------------------------------------------------------------------


def _literal_table(spark: SparkSession, rows: list[tuple], table: str) -> DataFrame:
    """A JVM-side inline table (LocalTableScan), typed by the table's schema."""
    schema = SCHEMAS[table]
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def membership_plans(spark: SparkSession) -> DataFrame:
    """The three plans as an inline table (a fixed-size broadcast dimension)."""
    return _literal_table(spark, MEMBERSHIP_PLANS, "membership_plans")


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """All seed tables; the row-less tables are returned empty."""
    vehicles = [
        (i, reg, typ, model, make, Decimal(rate), status, station)
        for i, (reg, typ, model, make, rate, status, station) in enumerate(VEHICLES, start=1)
    ]
    out = {
        "membership_plans": membership_plans(spark),
        "stations": spark.createDataFrame(STATIONS, SCHEMAS["stations"]),
        "vehicles": spark.createDataFrame(vehicles, SCHEMAS["vehicles"]),
        "technicians": spark.createDataFrame(TECHNICIANS, SCHEMAS["technicians"]),
    }
    for name in ("users", "trips", "payments", "maintenance_logs", "technician_assignments", "reviews", "logs"):
        out[name] = spark.createDataFrame([], SCHEMAS[name])
    return out
