"""Mixed command batches == sequential replay; technicians with releases == heap replay."""

import datetime
import heapq
import random
from collections import Counter
from decimal import Decimal

import pytest
from models import replay_mixed
from test_commands_replay import PLANS, _df, _world

from ridegrid.operators.dispatch import dispatch
from ridegrid.operators.replay import KINDS, replay_commands
from ridegrid.schemas import SCHEMAS
from ridegrid.sources.seed import membership_plans

NOW = datetime.datetime(2024, 1, 1)
FEED = ("RequestID long, RequestTime timestamp_ntz, Kind string, UserID int, user_role string, VehicleID int, StationID int, "
        "DurationHours decimal(5,2), TripID int, LogID int, PlanID int, Ref long, amount string, IssueReported string, rating string, "
        "comment string, name string, email string, password string")
COLUMNS = [x.split()[0] for x in FEED.split(", ")]


def mixed_world(rng):
    users, vehicles, stations = _world(rng, 6, 5, 3)
    for u in users:
        if rng.random() < 0.15:
            u["WalletBalance"] = Decimal("99999000.00")
        elif u["WalletBalance"] is not None:
            u["WalletBalance"] = Decimal(rng.randint(0, 4000))
    trips = [dict(TripID=i, UserID=rng.randint(1, 6), VehicleID=rng.randint(1, 5), StartStationID=rng.randint(1, 3), EndStationID=None,
                  StartTime=NOW, EndTime=None, Cost=Decimal(rng.randint(1, 900)), Status=rng.choice(["Ongoing", "Ongoing", "Completed", "Upcoming"]))
             for i in range(1, 7)]
    pays = [dict(PaymentID=t["TripID"], TripID=t["TripID"], UserID=t["UserID"], Amount=t["Cost"], Timestamp=NOW, Status="Success") for t in trips]
    techs = [dict(TechnicianID=i, Name=f"t{i}", Specialization="s", IsAvailable=rng.random() < 0.7, ActiveAssignments=rng.randint(0, 3))
             for i in range(1, 4)]
    logs = [dict(LogID=i, VehicleID=rng.randint(1, 5), IssueReported="x", ReportedDate=NOW.date(), Status=rng.choice(["Pending", "In-Progress", "Completed"]))
            for i in range(1, 6)]
    asg = [dict(AssignmentID=m["LogID"], LogID=m["LogID"], TechnicianID=rng.randint(1, 3)) for m in logs if m["Status"] != "Pending"]
    reviews = [dict(ReviewID=1, TripID=1, UserID=trips[0]["UserID"], VehicleID=1, Rating=3, Comment="", ReviewDate=NOW.date())]
    return dict(users=users, vehicles=vehicles, stations=stations, trips=trips, payments=pays, technicians=techs, logs=logs, assignments=asg,
                reviews=reviews, plans=PLANS)


def mixed_requests(rng, n):
    out, made = [], {"book": [], "report": []}
    for rid in sorted(rng.sample(range(1000), n)):
        kind = rng.choice([*KINDS, "book", "book", "end", "end", "cancel"])
        source = made["report" if kind == "complete" else "book"]
        ref = rng.choice(source[-3:]) if source and rng.random() < 0.7 else None
        if rng.random() < 0.03:
            ref = rid + rng.randint(-5, 5)
        r = dict.fromkeys(COLUMNS)
        r.update(
            RequestID=rid, RequestTime=NOW + datetime.timedelta(minutes=rid), Kind=kind, UserID=rng.choice([0, 1, 2, 3, 4, 5, 6, 7, None]),
            user_role=rng.choice(["admin", "user", None]), VehicleID=rng.randint(1, 6), StationID=rng.choice([1, 2, 3, 3, 4, None]),
            DurationHours=Decimal(rng.randint(-1, 20)) / 4, TripID=rng.randint(1, 8), LogID=rng.randint(1, 7), PlanID=rng.choice([0, 1, 2, 3, 4]),
            Ref=ref, amount=rng.choice([None, "abc", "-5", "10", "250.55", "900"]), IssueReported=rng.choice([None, " ", "flat", "flat"]),
            rating=rng.choice([None, "x", "3", "5", "6"]), comment=rng.choice([None, "ok"]), name="n", email=f"E{rng.randint(1, 9)}@x",
            password=rng.choice([None, "p"]))
        out.append(r)
        if kind in made:
            made[kind].append(rid)
    return out


def tables_of(spark, world):
    names = {"logs": "maintenance_logs", "assignments": "technician_assignments"}
    out = {}
    for k, rows in world.items():
        if k != "plans":
            table = names.get(k, k)
            out[table] = _df(spark, table, rows) if rows else spark.createDataFrame([], SCHEMAS[table])
    return out | {"membership_plans": membership_plans(spark)}


def check_mixed(spark, requests, world, block, id_block=1 << 20):
    expected, state = replay_mixed(requests, world)
    feed = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in requests], FEED)
    got = replay_commands(feed, tables_of(spark, world), block=block, id_block=id_block)
    found = {r.RequestID: (r.Reason, r.Applied, r.Cost, r.TechnicianID) for r in got.decisions.collect()}
    assert found == expected
    t = {k: df.collect() for k, df in got.tables.items()}
    assert {r.UserID: (r.WalletBalance, r.PlanID) for r in t["users"]} == {
        k: (u["WalletBalance"], u["PlanID"]) for k, u in state["users"].items()}
    assert {r.VehicleID: (r.Status, r.CurrentStationID) for r in t["vehicles"]} == {
        k: (v["Status"], v["CurrentStationID"]) for k, v in state["vehicles"].items()}
    ended = [(x["UserID"], x["VehicleID"], x["StartStationID"], x["Cost"], x["Status"], x["EndStationID"]) for x in state["trips"].values()]
    assert Counter((r.UserID, r.VehicleID, r.StartStationID, r.Cost, r.Status, r.EndStationID) for r in t["trips"]) == Counter(ended)
    assert len({r.TripID for r in t["trips"]}) == len(ended)
    assert Counter((r.UserID, r.Amount, r.Status) for r in t["payments"]) == Counter(
        (p["UserID"], p["Amount"], p["Status"]) for p in state["payments"])
    assert Counter((r.VehicleID, r.Status) for r in t["maintenance_logs"]) == Counter(
        (m["VehicleID"], m["Status"]) for m in state["logs"].values())
    assert {r.TechnicianID: r.ActiveAssignments for r in t["technicians"]} == {
        k: x["ActiveAssignments"] for k, x in state["technicians"].items()}
    assert Counter((r.UserID, r.VehicleID, r.Rating, r.Comment) for r in t["reviews"]) == Counter(
        [*state["reviews"], *((v["UserID"], v["VehicleID"], v["Rating"], v["Comment"]) for v in world["reviews"])])
    return got


@pytest.mark.parametrize("seed,id_block", [(1, 1 << 20), (2, 128)])
def test_mixed_batch_equals_replay(spark, seed, id_block):
    """Also over several blocks of ids, where totals are carried from block to block."""
    rng = random.Random(seed)
    world = mixed_world(rng)
    requests = mixed_requests(rng, 70)
    got = check_mixed(spark, requests, world, block=8, id_block=id_block)
    assert got.rounds <= 40


def test_mixed_batch_books_ends_and_books_again(spark):
    """One vehicle through many hands: each ride is ended before the next booking, and money comes back."""
    rng = random.Random(9)
    world = mixed_world(rng)
    for v in world["vehicles"]:
        v["Status"] = "available"
    requests = []
    for i in range(8):
        base = dict.fromkeys(COLUMNS) | dict(RequestTime=NOW, VehicleID=1, StationID=1, DurationHours=Decimal("0.25"), UserID=1 + i % 6)
        requests.append(base | dict(RequestID=3 * i, Kind="book"))
        requests.append(base | dict(RequestID=3 * i + 1, Kind="cancel" if i % 3 == 0 else "end", Ref=3 * i))
        requests.append(base | dict(RequestID=3 * i + 2, Kind="review", Ref=3 * i, rating="4"))
    check_mixed(spark, requests, world, block=8)


def test_mixed_batch_without_requests(spark):
    world = mixed_world(random.Random(4))
    got = replay_commands(spark.createDataFrame([], FEED), tables_of(spark, world))
    assert got.decisions.count() == 0 and got.rounds == 0
    assert got.tables["trips"].count() == len(world["trips"])


@pytest.mark.parametrize("seed,block", [(1, 16), (3, 1000)])
def test_dispatch_with_releases_equals_heap(spark, seed, block):
    rng = random.Random(seed)
    techs = [(i, rng.random() < 0.8, rng.randint(0, 6)) for i in range(1, 8)]
    load, heap = {t: n for t, _, n in techs}, []
    free = {t for t, ok, _ in techs if ok}
    rows, takes, expected = [], [], {}
    for rid in sorted(rng.sample(range(10_000), 150)):
        if not takes or rng.random() < 0.55:
            rows.append((rid, True, None, None))
            heap = [(load[t], t) for t in free]
            heapq.heapify(heap)
            t = heap[0][1] if heap else None
            if t:
                load[t] += 1
            takes.append(rid)
            expected[rid] = t
        else:
            of = rng.choice(takes) if rng.random() < 0.6 else None
            t = expected[of] if of is not None else rng.randint(1, 7)
            rows.append((rid, False, None if of is not None else t, of))
            if t:
                load[t] = max(0, load[t] - 1)
            expected[rid] = t
    events = spark.createDataFrame(rows, "RequestID long, take boolean, TechnicianID int, of long")
    tech = spark.createDataFrame(techs, "TechnicianID int, IsAvailable boolean, ActiveAssignments int")
    assigned, loads, rounds = dispatch(events, tech, block)
    assert {r.RequestID: r.TechnicianID for r in assigned.collect()} == expected
    assert {r.TechnicianID: r.ActiveAssignments for r in loads.collect()} == load
    assert rounds <= 2 + 150 // block
