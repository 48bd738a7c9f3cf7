"""M1's odd inputs and M2, M3, M5, M6, M7, M9: set-based operators == sequential replay on random inputs."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import models
import pytest

from ridegrid.operators import booking, maintenance
from ridegrid.operators import commands as C
from ridegrid.operators import views as V
from ridegrid.schemas import SCHEMAS
from ridegrid.sources.seed import MEMBERSHIP_PLANS, membership_plans

PLANS = [dict(zip(["PlanID", "PlanName", "Cost", "DurationMonths", "Benefits"], p)) for p in MEMBERSHIP_PLANS]
T0 = datetime(2024, 1, 1)


def df(spark, table, rows):
    cols = SCHEMAS[table].fieldNames()
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMAS[table])


def feed(spark, rows, schema):
    cols = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)


def reasons(result):
    return {r.RequestID: r.Reason for r in result.decisions.collect()}


class World:
    def __init__(self, seed):
        rng = self.rng = random.Random(seed)
        self.stations = [dict(StationID=i, Name=f"s{i}", Location="L", Capacity=5, IsActive=True) for i in range(1, 4)]
        self.users = [dict(UserID=i, Name=f"u{i}", Email=f"U{i}@x", Password="p", Role="user",
                           WalletBalance=rng.choice([None, Decimal("12.50"), Decimal("300.00"), Decimal("99999990.00")]),
                           JoinDate=date(2024, 1, 1), PlanID=rng.choice([None, 1, 2, 3])) for i in range(1, 9)]
        self.vehicles = [dict(VehicleID=i, RegistrationNumber=f"R{i}", Type="Car", Model="M", Manufacturer="X",
                              RatePerHour=Decimal(rng.randint(100, 9000)) / 100,
                              Status=rng.choice(["available", "in-use", "under-maintenance"]), CurrentStationID=1)
                         for i in range(1, 9)]
        self.trips = [dict(TripID=i, UserID=rng.randint(1, 8), VehicleID=rng.randint(1, 8), StartStationID=rng.randint(1, 3),
                           EndStationID=None, StartTime=T0, EndTime=None, Cost=Decimal(rng.randint(100, 900)) / 100,
                           Status=rng.choice(["Ongoing", "Ongoing", "Completed", "Upcoming"])) for i in range(1, 25)]
        self.payments = [dict(PaymentID=i, TripID=rng.randint(1, 24), UserID=rng.randint(1, 8), Amount=Decimal("1.00"),
                              Timestamp=T0, Status="Success") for i in range(1, 40)]

    def requests(self, n, **cols):
        ids = self.rng.sample(range(10 * n), n)
        return [dict(RequestID=i, RequestTime=T0 + timedelta(minutes=i), **{k: f(self.rng) for k, f in cols.items()}) for i in ids]


@pytest.mark.parametrize("seed", [1, 2])
def test_topups(spark, seed):
    w = World(seed)
    w.users[0]["WalletBalance"] = Decimal("99999990.00")
    amounts = ["5", "abc", None, "-3", "0", "4.25", " 9 ", "9.99", "10.00"]
    reqs = w.requests(60, UserID=lambda r: r.randint(1, 9), amount=lambda r: r.choice(amounts))
    res = C.wallet_topups(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, UserID int, amount string"), df(spark, "users", w.users))
    expected, bal = models.replay_topups(reqs, w.users)
    assert reasons(res) == expected
    assert models.OUT_OF_RANGE in expected.values() and None in expected.values()
    assert {r.UserID: r.WalletBalance for r in res.tables["users"].collect()} == bal


@pytest.mark.parametrize("seed", [3, 4])
def test_end_rides(spark, seed):
    w = World(seed)
    reqs = w.requests(50, TripID=lambda r: r.randint(1, 28), EndStationID=lambda r: r.choice([None, 1, 2, 3, 9]))
    res = C.end_rides(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, TripID int, EndStationID int"),
                      df(spark, "trips", w.trips), df(spark, "vehicles", w.vehicles), df(spark, "stations", w.stations))
    expected, trip, veh = models.replay_ends(reqs, w.trips, w.vehicles, w.stations)
    assert reasons(res) == expected
    assert {r.TripID: (r.Status, r.EndTime, r.EndStationID) for r in res.tables["trips"].collect()} == {
        k: (t["Status"], t["EndTime"], t["EndStationID"]) for k, t in trip.items()}
    assert {r.VehicleID: (r.Status, r.CurrentStationID) for r in res.tables["vehicles"].collect()} == {
        k: (v["Status"], v["CurrentStationID"]) for k, v in veh.items()}


@pytest.mark.parametrize("seed", [5, 6])
def test_cancels(spark, seed):
    w = World(seed)
    reqs = w.requests(60, TripID=lambda r: r.randint(1, 28))
    res = C.cancel_trips(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, TripID int"), df(spark, "trips", w.trips),
                         df(spark, "vehicles", w.vehicles), df(spark, "users", w.users), df(spark, "payments", w.payments))
    expected, trip, veh, bal, pay = models.replay_cancels(reqs, w.trips, w.vehicles, w.users, w.payments)
    assert reasons(res) == expected
    assert {r.TripID: (r.Status, r.EndTime) for r in res.tables["trips"].collect()} == {k: (t["Status"], t["EndTime"]) for k, t in trip.items()}
    assert {r.VehicleID: (r.Status, r.CurrentStationID) for r in res.tables["vehicles"].collect()} == {
        k: (v["Status"], v["CurrentStationID"]) for k, v in veh.items()}
    assert {r.UserID: r.WalletBalance for r in res.tables["users"].collect()} == bal
    assert {r.PaymentID: r.Status for r in res.tables["payments"].collect()} == {k: p["Status"] for k, p in pay.items()}
    scans = res.changes._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 10, scans


def test_refund_overflow_rejects_one_request(spark):
    w = World(7)
    w.users[0]["WalletBalance"] = Decimal("99999999.00")
    for t, cost in zip(w.trips[:3], ("0.90", "0.50", "0.05"), strict=True):
        t.update(UserID=1, Status="Ongoing", Cost=Decimal(cost))
    reqs = [dict(RequestID=i, RequestTime=T0, TripID=t) for i, t in enumerate([1, 2, 3, 2])]
    res = C.cancel_trips(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, TripID int"), df(spark, "trips", w.trips),
                         df(spark, "vehicles", w.vehicles), df(spark, "users", w.users), df(spark, "payments", w.payments))
    assert reasons(res) == {0: None, 1: C.OUT_OF_RANGE, 2: None, 3: C.OUT_OF_RANGE}
    assert {r.UserID: r.WalletBalance for r in res.tables["users"].collect()}[1] == Decimal("99999999.95")


@pytest.mark.parametrize("seed", [8])
def test_completions(spark, seed):
    w = World(seed)
    rng = w.rng
    logs = [dict(LogID=i, VehicleID=rng.randint(1, 8), IssueReported="x", ReportedDate=date(2024, 1, 1),
                 Status=rng.choice(["Pending", "In-Progress", "Completed"])) for i in range(1, 20)]
    techs = [dict(TechnicianID=i, Name="t", Specialization="s", IsAvailable=True, ActiveAssignments=rng.randint(0, 2)) for i in range(1, 5)]
    asg = [dict(AssignmentID=i, LogID=rng.randint(1, 22), TechnicianID=rng.randint(1, 4)) for i in range(1, 25)]
    reqs = w.requests(50, user_role=lambda r: r.choice(["admin", "admin", "user", None]), LogID=lambda r: r.randint(1, 23))
    res = C.complete_maintenance(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, user_role string, LogID int"),
                                 df(spark, "technician_assignments", asg), df(spark, "maintenance_logs", logs),
                                 df(spark, "technicians", techs), df(spark, "vehicles", w.vehicles))
    expected, log, load, status = models.replay_completions(reqs, asg, logs, techs, w.vehicles)
    assert reasons(res) == expected
    assert {r.LogID: r.Status for r in res.tables["maintenance_logs"].collect()} == log
    assert {r.TechnicianID: r.ActiveAssignments for r in res.tables["technicians"].collect()} == load
    assert {r.VehicleID: r.Status for r in res.tables["vehicles"].collect()} == status


def test_registrations_and_reviews(spark):
    w = World(9)
    reqs = w.requests(50, name=lambda r: r.choice(["n", None, "m"]), email=lambda r: r.choice([None, "u1@X", "a@b", "A@B", "c@d"]),
                      password=lambda r: r.choice(["p", None]))
    res = C.register_users(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, name string, email string, password string"),
                           df(spark, "users", w.users))
    assert reasons(res) == models.replay_registrations(reqs, w.users)
    reviews = [dict(ReviewID=1, TripID=w.trips[0]["TripID"], UserID=w.trips[0]["UserID"], VehicleID=1, Rating=3, Comment="", ReviewDate=date(2024, 1, 1))]
    reqs = w.requests(60, TripID=lambda r: r.randint(1, 27), rating=lambda r: r.choice(["1", "5", "6", "x", None]), comment=lambda r: r.choice([None, "c"]))
    res = C.submit_reviews(feed(spark, reqs, "RequestID long, RequestTime timestamp_ntz, TripID int, rating string, comment string"),
                           df(spark, "trips", w.trips), df(spark, "reviews", reviews))
    expected, comments = models.replay_reviews(reqs, w.trips, reviews)
    assert reasons(res) == expected
    assert {r.RequestID: r.Comment for r in res.tables["new_reviews"].collect()} == comments


def test_bookings_with_odd_inputs(spark):
    """NULL balances, unknown users, stations and vehicles, negative hours, a long chain on one vehicle."""
    rng = random.Random(21)
    users = [dict(UserID=i, Name="u", Email=f"{i}", Password="p", Role="user", JoinDate=date(2024, 1, 1), PlanID=rng.choice([None, 2]),
                  WalletBalance=None if i % 4 == 0 else Decimal(rng.randint(0, 60))) for i in range(1, 13)]
    vehicles = [dict(VehicleID=i, RegistrationNumber=f"{i}", Type="t", Model="m", Manufacturer="x", RatePerHour=Decimal("20.00"),
                     Status="available" if i < 6 else "in-use", CurrentStationID=1) for i in range(1, 8)]
    stations = [dict(StationID=1, Name="s", Location="L", Capacity=1, IsActive=True)]
    reqs = [dict(RequestID=i, UserID=rng.randint(1, 14), VehicleID=1 if i % 2 else rng.randint(1, 9),
                 StartStationID=rng.choice([1, 1, 1, 5]), DurationHours=Decimal(rng.choice([-4, 2, 8, 8, 12])) / 4) for i in range(120)]
    for r in reqs[:60]:  # nobody with money, or no station: a long chain before vehicle 1 goes
        if r["VehicleID"] == 1:
            r.update(StartStationID=5) if rng.random() < 0.5 else r.update(UserID=3, DurationHours=Decimal("900.00"))
    expected, _ = models.replay_bookings(reqs, users, vehicles, stations, PLANS)
    rows = spark.createDataFrame(
        [(r["RequestID"], T0, r["UserID"], r["VehicleID"], r["StartStationID"], r["DurationHours"]) for r in reqs],
        "RequestID long, RequestTime timestamp_ntz, UserID int, VehicleID int, StartStationID int, DurationHours decimal(5,2)")
    priced = booking.price_requests(rows, df(spark, "users", users), df(spark, "vehicles", vehicles), df(spark, "stations", stations), membership_plans(spark))
    got, _ = booking.decide_bookings(priced)
    assert {r.RequestID: r.Reason for r in got.collect()} == expected


def test_price_overflow_rejects_one_booking(spark):
    w = World(11)
    for u in w.users:
        u.update(WalletBalance=None, PlanID=None)
    w.vehicles[0].update(RatePerHour=Decimal("99999999.99"), Status="available")
    w.vehicles[1].update(Status="available")
    rows = spark.createDataFrame([(1, T0, 1, 1, 1, Decimal("2.00")), (2, T0, 1, 2, 1, Decimal("1.00")), (3, T0, 2, 1, 1, Decimal("0.50"))],
                                 "RequestID long, RequestTime timestamp_ntz, UserID int, VehicleID int, StartStationID int, DurationHours decimal(5,2)")
    res = booking.book_rides(rows, df(spark, "users", w.users), df(spark, "vehicles", w.vehicles), df(spark, "stations", w.stations),
                             membership_plans(spark), df(spark, "trips", w.trips), df(spark, "payments", w.payments))
    assert reasons(res) == {1: C.OUT_OF_RANGE, 2: None, 3: None}
    assert res.tables["trips"].count() == len(w.trips) + 2


def test_blank_issue_is_rejected(spark):
    w = World(12)
    rows = spark.createDataFrame([(1, T0, 1, "admin", 1, "  \t "), (2, T0, 1, "admin", 1, "flat"), (3, T0, 1, "admin", 1, None)],
                                 "RequestID long, RequestTime timestamp_ntz, UserID int, user_role string, VehicleID int, IssueReported string")
    res = maintenance.report_and_assign(rows, df(spark, "trips", w.trips), df(spark, "vehicles", w.vehicles), df(spark, "technicians", []),
                                        df(spark, "maintenance_logs", []), df(spark, "technician_assignments", []))
    assert reasons(res) == {1: maintenance.BLANK_ISSUE, 2: None, 3: "Column 'IssueReported' cannot be null"}


def test_listing_orders(spark, td):
    names = [(r.Name.lower(), r.TechnicianID) for r in V.technician_roster(td.technicians()).collect()]
    assert names == sorted(names) and len(names) == 25
    view = V.technician_assignments(td.technician_assignments(), td.technicians(), td.maintenance_logs(), td.vehicles())
    keys = [(r.ReportedDate, r.AssignmentID) for r in V.assignments_by_date(view).collect()]
    assert keys == sorted(keys, reverse=True) and len(keys) > 50
