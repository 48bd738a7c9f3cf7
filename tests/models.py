"""Plain-Python sequential models: replay requests one by one in RequestID order.

The set-based Spark operators must give exactly these results.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

CENT = Decimal("0.01")
DISCOUNT = {"Basic Plan": Decimal("0.05"), "Premium Plan": Decimal("0.10"), "Annual Plan": Decimal("0.15")}
FK = "Foreign key constraint fails: "


def money(x: Decimal) -> Decimal:
    return x.quantize(CENT, rounding=ROUND_HALF_UP)


def replay_bookings(requests, users, vehicles, stations, plans):
    """requests: dicts with RequestID, UserID, VehicleID, StartStationID, DurationHours."""
    status = {v["VehicleID"]: v["Status"] for v in vehicles}
    rate = {v["VehicleID"]: v["RatePerHour"] for v in vehicles}
    bal = {u["UserID"]: u["WalletBalance"] for u in users}
    plan_of = {u["UserID"]: u["PlanID"] for u in users}
    plan_name = {p["PlanID"]: p["PlanName"] for p in plans}
    station_ids = {s["StationID"] for s in stations}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        v = r["VehicleID"]
        if status.get(v) != "available":
            out[r["RequestID"]] = "Vehicle not available"
            continue
        disc = DISCOUNT.get(plan_name.get(plan_of.get(r["UserID"])), Decimal("0.00"))
        cost = money((rate[v] * r["DurationHours"]) * (1 - disc))
        has_user = r["UserID"] in bal
        b = bal.get(r["UserID"])
        if b is not None and b < cost:
            out[r["RequestID"]] = "Insufficient balance"
        elif not has_user:
            out[r["RequestID"]] = FK + "UserID"
        elif r["StartStationID"] not in station_ids:
            out[r["RequestID"]] = FK + "StartStationID"
        else:
            out[r["RequestID"]] = None
            status[v] = "in-use"
            if b is not None:
                bal[r["UserID"]] = b - cost
    return out, bal


def replay_purchases(requests, users, plans):
    cost = {p["PlanID"]: p["Cost"] for p in plans}
    bal = {u["UserID"]: u["WalletBalance"] for u in users}
    plan = {u["UserID"]: u["PlanID"] for u in users}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        u, p = r["UserID"], r["PlanID"]
        if not u or not p:
            out[r["RequestID"]] = "user_id and plan_id are required"
        elif p not in cost:
            out[r["RequestID"]] = "Plan not found"
        elif u not in bal:
            out[r["RequestID"]] = "User not found"
        elif bal[u] is None:
            out[r["RequestID"]] = "float() argument must be a string or a real number, not 'NoneType'"
        elif bal[u] < cost[p]:
            out[r["RequestID"]] = "Insufficient wallet balance"
        else:
            out[r["RequestID"]] = None
            bal[u] -= cost[p]
            plan[u] = p
    return out, bal, plan


def replay_assignments(reports_accepted_in_order, technicians):
    """Greedy least-loaded assignment with the TechnicianID tie-break."""
    load = {t["TechnicianID"]: t["ActiveAssignments"] for t in technicians if t["IsAvailable"]}
    out = []
    for _ in reports_accepted_in_order:
        if not load:
            out.append(None)
            continue
        tid = min(load, key=lambda k: (load[k], k))
        load[tid] += 1
        out.append(tid)
    return out


MAX_MONEY = Decimal("99999999.99")
OUT_OF_RANGE = "Out of range value for a money column"


def replay_topups(requests, users):
    bal = {u["UserID"]: u["WalletBalance"] for u in users}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        text = r["amount"]
        try:
            amount = None if text is None else money(Decimal(text.strip()))
        except ArithmeticError:
            amount = None
        if text is None:
            out[r["RequestID"]] = "Missing 'amount' field"
        elif amount is None:
            out[r["RequestID"]] = "Invalid amount"
        elif amount <= 0:
            out[r["RequestID"]] = "Amount must be positive"
        elif r["UserID"] not in bal:
            out[r["RequestID"]] = "User not found"
        elif bal[r["UserID"]] is not None and bal[r["UserID"]] + amount > MAX_MONEY:
            out[r["RequestID"]] = OUT_OF_RANGE
        else:
            out[r["RequestID"]] = None
            if bal[r["UserID"]] is not None:
                bal[r["UserID"]] += amount
    return out, bal


def replay_ends(requests, trips, vehicles, stations):
    trip = {t["TripID"]: dict(t) for t in trips}
    veh = {v["VehicleID"]: dict(v) for v in vehicles}
    known = {s["StationID"] for s in stations}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        t = trip.get(r["TripID"])
        if t is not None and r["EndStationID"] is not None and r["EndStationID"] not in known:
            out[r["RequestID"]] = FK + "EndStationID"
            continue
        out[r["RequestID"]] = None
        if t is not None:
            t.update(Status="Completed", EndTime=r["RequestTime"], EndStationID=r["EndStationID"])
            veh[t["VehicleID"]].update(Status="available", CurrentStationID=r["EndStationID"])
    return out, trip, veh


def replay_cancels(requests, trips, vehicles, users, payments):
    trip = {t["TripID"]: dict(t) for t in trips}
    veh = {v["VehicleID"]: dict(v) for v in vehicles}
    bal = {u["UserID"]: u["WalletBalance"] for u in users}
    pay = {p["PaymentID"]: dict(p) for p in payments}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        t = trip.get(r["TripID"])
        if t is None:
            out[r["RequestID"]] = None
        elif t["Status"] != "Ongoing":
            out[r["RequestID"]] = "Only ongoing trips can be cancelled"
        elif bal[t["UserID"]] is not None and bal[t["UserID"]] + t["Cost"] > MAX_MONEY:
            out[r["RequestID"]] = OUT_OF_RANGE
        else:
            out[r["RequestID"]] = None
            t.update(Status="Cancelled", EndTime=r["RequestTime"])
            veh[t["VehicleID"]].update(Status="available", CurrentStationID=t["StartStationID"])
            if bal[t["UserID"]] is not None:
                bal[t["UserID"]] += t["Cost"]
            for p in pay.values():
                if p["TripID"] == t["TripID"] and p["UserID"] == t["UserID"]:
                    p["Status"] = "Refunded"
    return out, trip, veh, bal, pay


def replay_completions(requests, assignments, logs, technicians, vehicles):
    log = {m["LogID"]: dict(m) for m in logs}
    load = {t["TechnicianID"]: t["ActiveAssignments"] for t in technicians}
    status = {v["VehicleID"]: v["Status"] for v in vehicles}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        mine = sorted((a["AssignmentID"], a["TechnicianID"]) for a in assignments if a["LogID"] == r["LogID"])
        if (r["user_role"] or "user") != "admin":
            out[r["RequestID"]] = "Admin access required"
        elif not mine or r["LogID"] not in log:
            out[r["RequestID"]] = "Assignment not found"
        elif log[r["LogID"]]["Status"] == "Completed":
            out[r["RequestID"]] = "Maintenance log already completed"
        else:
            out[r["RequestID"]] = None
            log[r["LogID"]]["Status"] = "Completed"
            load[mine[0][1]] = max(0, load[mine[0][1]] - 1)
            status[log[r["LogID"]]["VehicleID"]] = "available"
    return out, {k: m["Status"] for k, m in log.items()}, load, status


def replay_registrations(requests, users):
    known = {u["Email"].lower() for u in users}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        if r["password"] is None:
            out[r["RequestID"]] = "'NoneType' object has no attribute 'encode'"
        elif r["name"] is None or r["email"] is None or r["email"].lower() in known:
            out[r["RequestID"]] = "Email already registered"
        else:
            out[r["RequestID"]] = None
            known.add(r["email"].lower())
    return out


def replay_reviews(requests, trips, reviews):
    trip = {t["TripID"]: t for t in trips}
    done = {(v["UserID"], v["TripID"]) for v in reviews}
    out, comments = {}, {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        try:
            rating = int(r["rating"])
        except (TypeError, ValueError):
            rating = None
        t = trip.get(r["TripID"])
        if rating is None:
            out[r["RequestID"]] = "Invalid or missing 'rating'"
        elif not 1 <= rating <= 5:
            out[r["RequestID"]] = "Rating must be between 1 and 5"
        elif t is None:
            out[r["RequestID"]] = "Trip not found"
        elif t["Status"] != "Completed":
            out[r["RequestID"]] = "Can only review completed trips"
        elif (t["UserID"], r["TripID"]) in done:
            out[r["RequestID"]] = "A review for this trip already exists"
        else:
            out[r["RequestID"]] = None
            done.add((t["UserID"], r["TripID"]))
            comments[r["RequestID"]] = r["comment"] or ""
    return out, comments


def replay_mixed(requests, world):
    """All kinds in one batch, one request after the other.  ``world``: lists of dicts per table.

    Returns (RequestID -> (Reason, Applied, Cost, technician), final state).
    """
    users = {u["UserID"]: dict(u) for u in world["users"]}
    vehicles = {v["VehicleID"]: dict(v) for v in world["vehicles"]}
    stations = {s["StationID"] for s in world["stations"]}
    plans = {p["PlanID"]: p for p in world["plans"]}
    trips = {("T", t["TripID"]): dict(t) for t in world["trips"]}
    pays = [dict(p, key=("T", p["TripID"])) for p in world["payments"]]
    logs = {("L", m["LogID"]): dict(m) for m in world["logs"]}
    for a in sorted(world["assignments"], key=lambda a: -a["AssignmentID"]):
        if ("L", a["LogID"]) in logs:
            logs[("L", a["LogID"])]["tech"] = a["TechnicianID"]
    techs = {t["TechnicianID"]: dict(t) for t in world["technicians"]}
    reviewed = {(v["UserID"], ("T", v["TripID"])) for v in world["reviews"]}
    emails = {u["Email"].lower() for u in world["users"]}
    reviews = []
    kinds = {r["RequestID"]: r["Kind"] for r in requests}
    out = {}
    for r in sorted(requests, key=lambda r: r["RequestID"]):
        rid, kind, why, applied, cost, tech = r["RequestID"], r["Kind"], None, True, None, None
        ref = r["Ref"] if r["Ref"] is not None and r["Ref"] < rid else None
        if r["Ref"] is None:
            trip, log = trips.get(("T", r["TripID"])), logs.get(("L", r["LogID"]))
            tkey, lkey = ("T", r["TripID"]), ("L", r["LogID"])
        else:
            trip = trips.get(("B", ref)) if kinds.get(ref) == "book" else None
            log = logs.get(("R", ref)) if kinds.get(ref) == "report" else None
            tkey, lkey = ("B", ref), ("R", ref)
        user = users.get(r["UserID"])
        if kind == "book":
            v = vehicles.get(r["VehicleID"])
            bal = user["WalletBalance"] if user else None
            if v is None or v["Status"] != "available":
                why = "Vehicle not available"
            else:
                plan = plans.get(user["PlanID"]) if user else None
                disc = DISCOUNT.get(plan["PlanName"] if plan else None, Decimal("0.00"))
                cost = money(v["RatePerHour"] * r["DurationHours"] * (1 - disc))
                if abs(cost) > MAX_MONEY:
                    why = OUT_OF_RANGE
                elif bal is not None and bal < cost:
                    why = "Insufficient balance"
                elif bal is not None and bal - cost > MAX_MONEY:
                    why = OUT_OF_RANGE
                elif user is None:
                    why = FK + "UserID"
                elif r["StationID"] not in stations:
                    why = FK + "StartStationID"
                else:
                    v["Status"] = "in-use"
                    if bal is not None:
                        user["WalletBalance"] = bal - cost
                    trips[("B", rid)] = dict(UserID=r["UserID"], VehicleID=r["VehicleID"], StartStationID=r["StationID"], Cost=cost,
                                             Status="Ongoing", EndStationID=None)
                    pays.append(dict(key=("B", rid), UserID=r["UserID"], Status="Success", Amount=cost))
            if why:
                cost = None
        elif kind == "end":
            if trip is None:
                applied = False
            elif r["StationID"] is not None and r["StationID"] not in stations:
                why = FK + "EndStationID"
            else:
                trip.update(Status="Completed", EndStationID=r["StationID"], EndTime=r["RequestTime"])
                vehicles[trip["VehicleID"]].update(Status="available", CurrentStationID=r["StationID"])
        elif kind == "cancel":
            if trip is None:
                applied = False
            elif trip["Status"] != "Ongoing":
                why = "Only ongoing trips can be cancelled"
            else:
                owner = users[trip["UserID"]]
                bal = owner["WalletBalance"]
                if bal is not None and bal + trip["Cost"] > MAX_MONEY:
                    why = OUT_OF_RANGE
                else:
                    if bal is not None:
                        owner["WalletBalance"] = bal + trip["Cost"]
                    trip.update(Status="Cancelled", EndTime=r["RequestTime"])
                    vehicles[trip["VehicleID"]].update(Status="available", CurrentStationID=trip["StartStationID"])
                    for p in pays:
                        if p["key"] == tkey and p["UserID"] == trip["UserID"]:
                            p["Status"] = "Refunded"
        elif kind == "topup":
            why = replay_topups([r], list(users.values()))[0][rid]
            if why is None and user["WalletBalance"] is not None:
                user["WalletBalance"] += money(Decimal(r["amount"].strip()))
        elif kind == "purchase":
            why = replay_purchases([r], list(users.values()), world["plans"])[0][rid]
            if why is None:
                user["WalletBalance"] -= plans[r["PlanID"]]["Cost"]
                user["PlanID"] = r["PlanID"]
        elif kind == "report":
            issue = r["IssueReported"]
            holds = any(t["UserID"] == r["UserID"] and t["VehicleID"] == r["VehicleID"] and t["Status"] == "Ongoing" for t in trips.values())
            if issue is not None and not issue.strip():
                why = "Please describe the issue"
            elif not r["UserID"]:
                why = "User ID required"
            elif (r["user_role"] or "user") != "admin" and not holds:
                why = "You can only report issues for vehicles you have an ongoing ride with"
            elif issue is None:
                why = "Column 'IssueReported' cannot be null"
            elif r["VehicleID"] not in vehicles:
                why = FK + "VehicleID"
            else:
                if vehicles[r["VehicleID"]]["Status"] == "available":
                    vehicles[r["VehicleID"]]["Status"] = "under-maintenance"
                free = [(t["ActiveAssignments"], k) for k, t in techs.items() if t["IsAvailable"]]
                logs[("R", rid)] = dict(VehicleID=r["VehicleID"], Status="Pending")
                if free:
                    tech = min(free)[1]
                    techs[tech]["ActiveAssignments"] += 1
                    logs[("R", rid)].update(Status="In-Progress", tech=tech)
        elif kind == "complete":
            if (r["user_role"] or "user") != "admin":
                why = "Admin access required"
            elif log is None or "tech" not in log:
                why = "Assignment not found"
            elif log["Status"] == "Completed":
                why = "Maintenance log already completed"
            else:
                log["Status"] = "Completed"
                tech = log["tech"]
                if tech in techs:
                    techs[tech]["ActiveAssignments"] = max(0, techs[tech]["ActiveAssignments"] - 1)
                vehicles[log["VehicleID"]]["Status"] = "available"
        elif kind == "review":
            try:
                rating = int(r["rating"])
            except (TypeError, ValueError):
                rating = None
            if rating is None:
                why = "Invalid or missing 'rating'"
            elif not 1 <= rating <= 5:
                why = "Rating must be between 1 and 5"
            elif trip is None:
                why = "Trip not found"
            elif trip["Status"] != "Completed":
                why = "Can only review completed trips"
            elif (trip["UserID"], tkey) in reviewed:
                why = "A review for this trip already exists"
            else:
                reviewed.add((trip["UserID"], tkey))
                reviews.append((trip["UserID"], trip["VehicleID"], rating, r["comment"] or ""))
        else:
            if r["password"] is None:
                why = "'NoneType' object has no attribute 'encode'"
            elif r["name"] is None or r["email"] is None or r["email"].lower() in emails:
                why = "Email already registered"
            else:
                emails.add(r["email"].lower())
        out[rid] = (why, applied and why is None, cost, tech)
    return out, dict(users=users, vehicles=vehicles, trips=trips, payments=pays, logs=logs, technicians=techs, reviews=reviews)
