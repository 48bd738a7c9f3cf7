"""Seed goldens (FIXTURES §2) and small view fixtures."""

import datetime
from decimal import Decimal

from ridegrid.operators import views as V
from ridegrid.sources.seed import seed


def test_seed_station_availability(spark):
    t = seed(spark)
    got = {r.StationID: r.AvailableVehicles for r in V.station_availability(t["stations"], t["vehicles"]).collect()}
    assert got == {**{i: 7 for i in range(1, 6)}, **{i: 6 for i in range(6, 11)}}


def test_seed_vehicles_and_plans(spark):
    t = seed(spark)
    v = t["vehicles"]
    assert v.count() == 65 and v.select("RegistrationNumber").distinct().count() == 65
    by_type = {r.Type: r["count"] for r in v.groupBy("Type").count().collect()}
    assert by_type == {"Car": 40, "Scooter": 13, "Bike": 12}
    assert [r.PlanName for r in V.membership_plans_list(t["membership_plans"]).collect()] == [
        "Basic Plan", "Premium Plan", "Annual Plan"]
    assert V.least_loaded_technician(t["technicians"]).first().TechnicianID == 1
    assert V.trip_history(t["trips"], t["users"], t["vehicles"], t["stations"]).count() == 0


def test_station_without_vehicles_counts_zero(spark):
    stations = spark.createDataFrame([(1, "a", "x", 5, True), (2, "b", "y", 5, True), (3, "c", "z", 5, False)],
                                     "StationID int, Name string, Location string, Capacity int, IsActive boolean")
    vehicles = spark.createDataFrame([(1, "available", 1), (2, "in-use", 2), (3, "available", 3)],
                                     "VehicleID int, Status string, CurrentStationID int")
    got = {r.StationID: r.AvailableVehicles for r in V.station_availability(stations, vehicles).collect()}
    assert got == {1: 1, 2: 0}


def test_user_rides_order_and_case_insensitive_status(spark):
    h = spark.createDataFrame(
        [(1, 7, datetime.datetime(2024, 1, 1), "Completed"), (2, 7, datetime.datetime(2024, 1, 3), "Ongoing"),
         (3, 7, datetime.datetime(2024, 1, 3), "Completed"), (4, 8, datetime.datetime(2024, 1, 2), "Completed")],
        "TripID int, UserID int, StartTime timestamp_ntz, Status string")
    assert [r.TripID for r in V.user_rides(h, user_id=7).collect()] == [3, 2, 1]
    assert [r.TripID for r in V.user_rides(h, user_id=7, status="completed").collect()] == [3, 1]
    assert [r.TripID for r in V.user_rides(h, user_id=7, status="").collect()] == [3, 2, 1]


def test_recent_logs_limit_clamp(spark):
    logs = spark.range(700).selectExpr(
        "CAST(id AS INT) AS LogID", "IF(id % 2 = 0, 'Trips', 'Users') AS TableName", "'UPDATE' AS OperationType",
        "CAST(id AS INT) AS RecordID", "CAST(NULL AS INT) AS ChangedBy", "'x' AS ChangeDescription",
        "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 10 AS INT), 0) AS TIMESTAMP_NTZ)"
        " AS ChangeTimestamp")
    assert V.recent_logs(logs).count() == 100
    assert V.recent_logs(logs, limit="abc").count() == 100
    assert V.recent_logs(logs, limit=10_000).count() == 500
    assert V.recent_logs(logs, limit=-3).count() == 1
    top = V.recent_logs(logs, table="TRIPS", limit=3).collect()
    assert [r.LogID for r in top] == [698, 688, 678] and all(r.TableName == "Trips" for r in top)


def test_booking_quote_rounding(spark):
    from ridegrid.functions import exprs as E
    row = spark.createDataFrame([(Decimal("150.25"), Decimal("1.50"))], "r decimal(10,2), h decimal(5,2)").select(
        E.ride_cost("r", "h", E.plan_discount(__import__("pyspark.sql.functions", fromlist=["lit"]).lit("Basic Plan")))
        .alias("c"), E.expected_end(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(
            datetime.datetime(2024, 1, 1)), "h").alias("e")).first()
    assert row.c == Decimal("214.11")
    assert row.e == datetime.datetime(2024, 1, 1, 2)


def test_expression_edge_cases(spark):
    from pyspark.sql import functions as F

    from ridegrid.functions import exprs as E
    df = spark.createDataFrame([(None, None, "", 0, None), (Decimal("5.5"), "Tata", "Nexon", 7, "x")],
                               "amt decimal(10,2), make string, model string, id int, txt string")
    rows = df.select(E.money_text("amt").alias("m"), E.vehicle_label("make", F.lit("Car")).alias("l"),
                     E.or_na("model").alias("n"), E.truthy_id("id").alias("i"), E.truthy_text("txt").alias("t"),
                     E.plan_discount(F.lit(None).cast("string")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [
        ("0.00", " • Car", "N/A", False, False, Decimal("0.00")),
        ("5.50", "Tata • Car", "Nexon", True, True, Decimal("0.00")),
    ]
    assert [E.clamp_limit(x) for x in (None, "7", "abc", 0, 9999)] == [100, 7, 100, 100, 500]
