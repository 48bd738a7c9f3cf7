"""Set-based command operators == sequential replay on random inputs."""

import random
from decimal import Decimal

import pytest
from models import replay_assignments, replay_bookings, replay_purchases

from ridegrid.operators import booking, maintenance, purchases
from ridegrid.schemas import SCHEMAS
from ridegrid.sources.seed import MEMBERSHIP_PLANS, membership_plans

PLANS = [dict(zip(["PlanID", "PlanName", "Cost", "DurationMonths", "Benefits"], p)) for p in MEMBERSHIP_PLANS]


def _df(spark, table, rows):
    cols = SCHEMAS[table].fieldNames()
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMAS[table])


def _world(rng, n_users, n_vehicles, n_stations):
    users = [dict(UserID=i, Name=f"u{i}", Email=f"u{i}@x", Password="p", Role="user",
                  WalletBalance=None if rng.random() < 0.1 else Decimal(rng.randint(-50, 3000)) / 2,
                  JoinDate=__import__("datetime").date(2024, 1, 1), PlanID=rng.choice([None, 1, 2, 3]))
             for i in range(1, n_users + 1)]
    vehicles = [dict(VehicleID=i, RegistrationNumber=f"R{i}", Type="Car", Model="M", Manufacturer="X",
                     RatePerHour=Decimal(rng.randint(100, 90000)) / 100,
                     Status=rng.choice(["available", "available", "available", "in-use", "decommissioned"]),
                     CurrentStationID=1) for i in range(1, n_vehicles + 1)]
    stations = [dict(StationID=i, Name=f"s{i}", Location="L", Capacity=10, IsActive=True)
                for i in range(1, n_stations + 1)]
    return users, vehicles, stations


@pytest.mark.parametrize("seed", [1, 2, 3, 6])
def test_bookings_equal_replay(spark, seed):
    rng = random.Random(seed)
    users, vehicles, stations = _world(rng, 8, 10, 3)
    reqs = [dict(RequestID=rid, UserID=rng.randint(1, 10), VehicleID=rng.randint(1, 11),
                 StartStationID=rng.randint(1, 4), DurationHours=Decimal(rng.randint(-2, 40)) / 4)
            for rid in rng.sample(range(1000), 60)]
    expected, _ = replay_bookings(reqs, users, vehicles, stations, PLANS)
    rdf = spark.createDataFrame(
        [(r["RequestID"], __import__("datetime").datetime(2024, 1, 1), r["UserID"], r["VehicleID"],
          r["StartStationID"], r["DurationHours"]) for r in reqs],
        "RequestID long, RequestTime timestamp_ntz, UserID int, VehicleID int, StartStationID int, "
        "DurationHours decimal(5,2)")
    priced = booking.price_requests(rdf, _df(spark, "users", users), _df(spark, "vehicles", vehicles),
                                    _df(spark, "stations", stations), membership_plans(spark))
    reasons, rounds = booking.decide_bookings(priced)
    got = {r.RequestID: r.Reason for r in reasons.collect()}
    assert got == expected
    assert rounds >= 1
    assert "Python" not in reasons._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [4, 5])
def test_purchases_equal_replay(spark, seed):
    rng = random.Random(seed)
    users, _, _ = _world(rng, 6, 1, 1)
    reqs = [dict(RequestID=rid, UserID=rng.choice([0, 1, 2, 3, 4, 5, 6, 7]), PlanID=rng.choice([0, 1, 2, 3, 3, 4]))
            for rid in rng.sample(range(500), 50)]
    for u in users:  # enough money for a few purchases
        if u["WalletBalance"] is not None:
            u["WalletBalance"] = Decimal(rng.randint(0, 12000))
    expected, bal, plan = replay_purchases(reqs, users, PLANS)
    rdf = spark.createDataFrame([(r["RequestID"], __import__("datetime").datetime(2024, 1, 1), r["UserID"], r["PlanID"])
                                 for r in reqs], "RequestID long, RequestTime timestamp_ntz, UserID int, PlanID int")
    res = purchases.purchase_memberships(rdf, _df(spark, "users", users), membership_plans(spark))
    got = {r.RequestID: r.Reason for r in res.decisions.collect()}
    assert got == expected
    new = {r.UserID: (r.WalletBalance, r.PlanID) for r in res.tables["users"].collect()}
    assert new == {u: (bal[u], plan[u]) for u in bal}


@pytest.mark.parametrize("n_reports,loads", [(7, [0, 3, 1, 1]), (25, [5, 0, 2]), (3, [])])
def test_slot_ranking_equals_greedy(spark, n_reports, loads):
    techs = [dict(TechnicianID=i + 1, Name=f"t{i}", Specialization="s", IsAvailable=True, ActiveAssignments=l)
             for i, l in enumerate(loads)]
    techs.append(dict(TechnicianID=99, Name="off", Specialization="s", IsAvailable=False, ActiveAssignments=0))
    expected = replay_assignments(range(n_reports), techs)
    slots = maintenance.technician_slots(_df(spark, "technicians", techs), n_reports)
    got = dict((r.SlotRank, r.TechnicianID) for r in slots.collect())
    assert [got.get(i + 1) for i in range(n_reports)] == expected


def test_hot_user_and_hot_vehicle_need_few_rounds(spark):
    """One user holds a third of the requests (mostly unaffordable), one vehicle is wanted by many."""
    rng = random.Random(11)
    users, vehicles, stations = _world(rng, 10, 40, 2)
    for v in vehicles:
        v["Status"] = "available"
    users[0]["WalletBalance"] = Decimal("900.00")  # the hot user can afford only a few rides
    reqs = []
    for i, rid in enumerate(rng.sample(range(10_000), 150)):
        hot_user = i % 3 == 0
        reqs.append(dict(RequestID=rid, UserID=1 if hot_user else rng.randint(2, 10),
                         VehicleID=rng.randint(2, 40) if hot_user else (1 if i % 3 == 1 else rng.randint(2, 40)),
                         StartStationID=1, DurationHours=Decimal(rng.randint(1, 16)) / 4))
    expected, _ = replay_bookings(reqs, users, vehicles, stations, PLANS)
    rdf = spark.createDataFrame(
        [(r["RequestID"], __import__("datetime").datetime(2024, 1, 1), r["UserID"], r["VehicleID"],
          r["StartStationID"], r["DurationHours"]) for r in reqs],
        "RequestID long, RequestTime timestamp_ntz, UserID int, VehicleID int, StartStationID int, "
        "DurationHours decimal(5,2)")
    priced = booking.price_requests(rdf, _df(spark, "users", users), _df(spark, "vehicles", vehicles),
                                    _df(spark, "stations", stations), membership_plans(spark))
    reasons, rounds = booking.decide_bookings(priced)
    assert {r.RequestID: r.Reason for r in reasons.collect()} == expected
    assert rounds <= 25, rounds


def test_broke_crowd_on_one_vehicle_is_settled_in_few_rounds(spark):
    """A third of the requests target one vehicle from users who cannot pay; then one who can."""
    users = [dict(UserID=i, Name=f"u{i}", Email=f"u{i}@x", Password="p", Role="user",
                  WalletBalance=Decimal("1.00") if i > 1 else Decimal("100000.00"),
                  JoinDate=__import__("datetime").date(2024, 1, 1), PlanID=None) for i in range(1, 31)]
    vehicles = [dict(VehicleID=i, RegistrationNumber=f"R{i}", Type="Car", Model="M", Manufacturer="X",
                     RatePerHour=Decimal("50.00"), Status="available", CurrentStationID=1) for i in range(1, 61)]
    stations = [dict(StationID=1, Name="s", Location="L", Capacity=10, IsActive=True)]
    reqs = [dict(RequestID=i, UserID=2 + i % 29, VehicleID=1, StartStationID=1, DurationHours=Decimal("1.00"))
            for i in range(40)]                                   # broke crowd on vehicle 1
    reqs += [dict(RequestID=100 + i, UserID=2, VehicleID=2 + i, StartStationID=1, DurationHours=Decimal("1.00"))
             for i in range(40)]                                  # one broke user everywhere
    reqs += [dict(RequestID=500, UserID=1, VehicleID=1, StartStationID=1, DurationHours=Decimal("2.00"))]
    expected, _ = replay_bookings(reqs, users, vehicles, stations, PLANS)
    rdf = spark.createDataFrame(
        [(r["RequestID"], __import__("datetime").datetime(2024, 1, 1), r["UserID"], r["VehicleID"],
          r["StartStationID"], r["DurationHours"]) for r in reqs],
        "RequestID long, RequestTime timestamp_ntz, UserID int, VehicleID int, StartStationID int, "
        "DurationHours decimal(5,2)")
    priced = booking.price_requests(rdf, _df(spark, "users", users), _df(spark, "vehicles", vehicles),
                                    _df(spark, "stations", stations), membership_plans(spark))
    reasons, rounds = booking.decide_bookings(priced)
    assert {r.RequestID: r.Reason for r in reasons.collect()} == expected
    assert rounds <= 2, rounds
