"""Mixed command batches: all kinds M1 to M9 in one request table, equal to replaying them in RequestID order.

A booking creates the trip that later requests end, cancel or review, takes a
vehicle that a later end frees again, and is paid from a wallet that top-ups and
refunds fill and purchases empty; a purchase changes the discount of later
bookings; a report creates the log that a later completion closes.  ``Ref`` names
the request of the same batch whose trip or log is meant (its id is not known before
the batch is decided), ``TripID`` / ``LogID`` name rows of the snapshot.

Three key spaces are coupled: users (balance, plan), vehicles (status), trips and
logs (existence, status).  ``operators.bounds`` decides the requests in rounds from two-sided bounds;
a sure event on a vehicle makes everything before it irrelevant, so chains of book, end, book again do not wait for
their beginning.  The number of rounds is the length of the longest chain of requests whose outcomes really hinge on each other.

Technicians are then dispatched over the accepted reports and completions (``operators.dispatch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators import maintenance as M
from ridegrid.operators.bounds import ID_BLOCK, NO_ASSIGNMENT, WIDE, decide
from ridegrid.operators.commands import ADMIN_REQUIRED, FK_REASON, NOT_ONGOING, _max_id, _replace, first_failure, first_per
from ridegrid.operators.dispatch import BLOCK, dispatch
from ridegrid.operators.ids import global_rank, prefix_aggs
from ridegrid.operators.purchases import NONE_BALANCE
from ridegrid.schemas import MONEY, RATE
from ridegrid.session import materialize, wide_rows

KINDS = ("book", "end", "cancel", "topup", "purchase", "report", "complete", "register", "review")
MOST_DISCOUNT = max(pct for _, pct in E.PLAN_DISCOUNTS)

# Rejection texts.
LOG_DONE = "Maintenance log already completed"
NOT_REVIEWABLE = "Can only review completed trips"
REVIEWED = "A review for this trip already exists"
NO_TRIP = "Trip not found"
EMAIL_TAKEN = "Email already registered"

_FIRST = -(1 << 60)  # before every RequestID
#: Columns that are only read at the end: carried as one struct, so that joins copy them as one piece.
_UNREAD = ("RequestTime", "rating", "comment", "name", "email", "password")
_LATER = (*_UNREAD, "TripID", "LogID", "PlanID", "amount", "IssueReported")


class Replay:
    """Decisions, new snapshots and the number of rounds of a mixed batch."""

    def __init__(self, decisions: DataFrame, tables: dict[str, DataFrame], rounds: int, dispatch_rounds: int):
        self.decisions, self.tables, self.rounds, self.dispatch_rounds = decisions, tables, rounds, dispatch_rounds


def _is(*kinds: str) -> Column:
    return F.col("Kind").isin(*kinds)


def _wide(x: Column) -> Column:
    return x.cast(WIDE)


def _price(discount: Column) -> Column:
    """Price before the money type's range is checked (rounded as it is)."""
    return F.coalesce(_wide((F.col("__rate") * F.col("DurationHours")) * (F.lit(1) - discount)), _wide(F.lit(0)))


def prepare(requests: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Every request with its target (trip or log), keys and what the snapshot says about them; ``_LATER`` in ``__q``."""
    requests = requests.select(*(c for c in requests.columns if c not in _UNREAD), F.struct(*_UNREAD).alias("__q"))
    own = requests.select(F.col("RequestID").alias("__c"), F.col("Kind").alias("__ckind"), F.col("UserID").alias("__cu"),
                          F.col("VehicleID").alias("__cv"), F.col("StationID").alias("__cs"))
    trips = t["trips"].select(F.col("TripID").alias("__t"), F.col("UserID").alias("__tu"), F.col("VehicleID").alias("__tv"),
                              F.col("StartStationID").alias("__ts"), F.col("Cost").alias("__tc"), F.col("Status").alias("__tstatus"))
    assigned = t["technician_assignments"].groupBy("LogID").agg(F.min(F.struct("AssignmentID", "TechnicianID")).alias("__a"))
    logs = t["maintenance_logs"].select(F.col("LogID").alias("__l"), F.col("VehicleID").alias("__lv"), F.col("Status").alias("__lstatus"))
    logs = logs.join(assigned, F.col("__l") == F.col("LogID")).select("__l", "__lv", "__lstatus", F.col("__a.TechnicianID").alias("__ltech"))
    anyone = t["technicians"].select(F.count_if(F.col("IsAvailable")) > 0).scalar()

    on_trip = _is("end", "cancel", "review")
    wants = F.when(on_trip, "book").when(_is("complete"), "report")
    r = requests.join(own, (F.col("Ref") == F.col("__c")) & (F.col("__c") < F.col("RequestID")), "left")
    by_id = F.col("Ref").isNull()
    r = r.join(trips, F.when(on_trip & by_id, F.col("TripID")) == F.col("__t"), "left")
    r = r.join(logs, F.when(_is("complete") & by_id, F.col("LogID")) == F.col("__l"), "left")
    made_here = E.holds((F.col("__ckind") == wants) & (on_trip | anyone))
    target = F.when(F.col("__t").isNotNull() | F.col("__l").isNotNull(), 2).when(made_here, 1).otherwise(0)
    key = (F.when(_is("book", "report"), F.concat(F.lit("N"), F.col("RequestID").cast("string")))
           .when(made_here, F.concat(F.lit("N"), F.col("Ref").cast("string")))
           .when(F.col("__t").isNotNull(), F.concat(F.lit("T"), F.col("TripID").cast("string")))
           .when(F.col("__l").isNotNull(), F.concat(F.lit("L"), F.col("LogID").cast("string"))))
    user = (F.when(on_trip, F.coalesce("__tu", F.when(made_here, F.col("__cu"))))
            .when(_is("book", "topup", "purchase", "report"), F.col("UserID")))
    vehicle = (F.when(on_trip, F.coalesce("__tv", F.when(made_here, F.col("__cv"))))
               .when(_is("complete"), F.coalesce("__lv", F.when(made_here, F.col("__cv"))))
               .when(_is("book", "report"), F.col("VehicleID")))
    r = r.select(
        *requests.columns, target.alias("__target"), key.alias("__key"), user.alias("__usr"), vehicle.alias("__veh"),
        F.coalesce("__ts", F.when(made_here, F.col("__cs"))).alias("__start"), F.col("__tc"), F.col("__tstatus"),
        F.col("__lstatus"), F.col("__ltech"))

    u = t["users"].join(t["membership_plans"].select("PlanID", "PlanName"), "PlanID", "left").select(
        F.col("UserID").alias("__u"), F.col("WalletBalance").alias("__bal0"), E.plan_discount("PlanName").alias("__disc0"))
    v = t["vehicles"].select(F.col("VehicleID").alias("__v"), F.col("RatePerHour").alias("__rate"), (F.col("Status") == "available").alias("__free0"))
    s = t["stations"].select(F.col("StationID").alias("__s"))
    p = t["membership_plans"].select(F.col("PlanID").alias("__p"), F.col("Cost").alias("__plancost"), E.plan_discount("PlanName").alias("__plandisc"))
    # The rate of a cancelled trip's vehicle bounds the refund of a booking of this batch.
    r = r.join(u, F.col("__usr") == F.col("__u"), "left").join(v, F.col("__veh") == F.col("__v"), "left").join(
        s, F.when(_is("book", "end"), F.col("StationID")) == F.col("__s"), "left").join(
        p, F.when(_is("purchase"), F.col("PlanID")) == F.col("__p"), "left")
    has_user, has_station, has_vehicle = F.col("__u").isNotNull(), F.col("__s").isNotNull(), F.col("__v").isNotNull()
    amount = E.parse_amount("amount")
    static = (
        F.when(_is("topup"), first_failure(
            (F.col("amount").isNull(), "Missing 'amount' field"), (amount.isNull(), "Invalid amount"),
            (amount <= 0, "Amount must be positive"), (~has_user, "User not found")))
        .when(_is("purchase"), first_failure(
            (~(E.truthy_id("UserID") & E.truthy_id("PlanID")), "user_id and plan_id are required"),
            (F.col("__p").isNull(), "Plan not found"), (~has_user, "User not found"), (F.col("__bal0").isNull(), NONE_BALANCE)))
        .when(_is("report"), first_failure(
            (F.col("IssueReported").isNotNull() & ~E.non_blank("IssueReported"), M.BLANK_ISSUE), (~E.truthy_id("UserID"), "User ID required")))
        .when(_is("complete"), first_failure(
            (~E.is_admin("user_role"), ADMIN_REQUIRED), (F.col("__target") == 0, NO_ASSIGNMENT), (F.col("__lstatus") == "Completed", LOG_DONE)))
        .when(_is("cancel"), first_failure(((F.col("__target") == 2) & (F.col("__tstatus") != "Ongoing"), NOT_ONGOING))))
    then = F.when(_is("report"), first_failure(
        (F.col("IssueReported").isNull(), "Column 'IssueReported' cannot be null"), (~has_vehicle, FK_REASON.format("VehicleID"))))
    amt = F.when(_is("topup"), amount).when(_is("purchase"), F.col("__plancost")).when(_is("cancel"), F.col("__tc"))
    later = F.struct(*(F.col(f"__q.{c}") if c in _UNREAD else F.col(c) for c in _LATER))
    return r.select(
        *(c for c in requests.columns if c not in (*_LATER, "__q")), later.alias("__q"),
        "__target", "__key", "__usr", "__veh", "__start", "__tstatus", "__ltech", "__bal0",
        F.coalesce("__disc0", F.lit(E.NO_DISCOUNT).cast(RATE)).alias("__disc0"), "__rate", E.holds(F.col("__free0")).alias("__free0"),
        has_user.alias("__has_user"), has_station.alias("__has_station"), _wide(amt).alias("__amt"), "__plandisc",
        static.alias("__static"), then.alias("__then"))


def _loop_rows(all_: DataFrame, trips: DataFrame) -> DataFrame:
    """The requests whose outcome needs rounds, or changes what others find."""
    ends = all_.where(_is("end") & F.col("__has_station") & (F.col("__target") > 0)).groupBy("__key").agg(F.min("RequestID").alias("__e"))
    completes = all_.where(_is("complete") & F.col("__static").isNull()).groupBy("__key").agg(F.min("RequestID").alias("__m0"))
    reports = all_.where(_is("report") & F.col("__static").isNull() & ~E.is_admin("user_role")).select(
        F.col("UserID").alias("__pu"), F.col("VehicleID").alias("__pv")).distinct()
    open0 = trips.where(F.col("Status") == "Ongoing").groupBy(F.col("UserID").alias("__pu"), F.col("VehicleID").alias("__pv")).agg(
        F.count(F.lit(1)).alias("__open0"))
    pairs = reports.join(open0, ["__pu", "__pv"], "left")
    r = all_.where("__static IS NULL").join(ends, "__key", "left").join(completes, "__key", "left").join(
        pairs, (F.col("__usr") == F.col("__pu")) & (F.col("__veh") == F.col("__pv")), "left")
    keep = (_is("book", "topup", "purchase", "report") | (_is("end") & F.col("__has_station") & (F.col("__target") > 0))
            | (_is("cancel") & (F.col("__target") > 0) & F.coalesce(F.col("RequestID") < F.col("__e"), F.lit(True)))
            | (_is("complete") & (F.col("RequestID") == F.col("__m0"))))
    sure = F.col("__target") == 2
    out = F.when((_is("end", "complete") & sure) | (_is("topup") & F.col("__bal0").isNull())
                 | (_is("report") & E.is_admin("user_role") & F.col("__then").isNull()), True)
    denied = _is("report") & E.is_admin("user_role") & F.col("__then").isNotNull()
    zero, most = _price(F.lit(E.NO_DISCOUNT).cast(RATE)), _price(F.lit(MOST_DISCOUNT).cast(RATE))
    is_ride = _is("book", "cancel")
    low = F.when(_is("cancel") & sure, F.col("__amt")).when(is_ride, F.least(zero, most)).otherwise(_wide(F.lit(0)))
    high = F.when(_is("cancel") & sure, F.col("__amt")).when(is_ride, F.greatest(zero, most)).otherwise(_wide(F.lit(0)))
    pair = F.when(F.col("__pu").isNotNull() & ~(_is("report") & E.is_admin("user_role")) & _is("book", "end", "cancel", "report"),
                  F.shiftleft(F.col("__pu").cast("bigint"), 32).bitwiseOR(F.col("__pv").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))))
    counted = (F.col("__target") == 1) | E.holds(F.col("__tstatus") == "Ongoing")
    return r.where(keep).select(
        "RequestID", "Kind", "__key", "__usr", "__veh", "__target", "__bal0", "__disc0", "__rate", "DurationHours", "__free0", "__has_user",
        "__has_station", "__amt", "__plandisc", "__then", "__e", pair.alias("__pair"), F.coalesce("__open0", F.lit(0)).alias("__open0"),
        counted.alias("__counted"), F.when(denied, False).otherwise(out).alias("__out"), F.when(denied, F.col("__then")).alias("Reason"),
        low.alias("__lo"), high.alias("__hi"), F.lit(False).alias("__dead"))


_FREES, _TAKES = ("end", "cancel", "complete"), ("book", "report")


def _late_reasons(all_: DataFrame, decided: DataFrame) -> DataFrame:
    """Outcome and reason of every state request, also of those that needed no round."""
    made = decided.where(_is("book", "report")).select("__key", F.col("__out").alias("__maker"))
    r = all_.join(decided.select("RequestID", "__out", "Reason", "__price"), "RequestID", "left").join(made, "__key", "left")
    exists = (F.col("__target") == 2) | ((F.col("__target") == 1) & E.holds(F.col("__maker")))
    looped = F.col("__out").isNotNull()
    reason = F.coalesce("__static", F.when(looped, F.col("Reason")).otherwise(
        F.when(_is("end"), F.when(exists & F.col("StationID").isNotNull() & ~F.col("__has_station"), FK_REASON.format("EndStationID")))
        .when(_is("cancel"), F.when(exists, NOT_ONGOING))
        .when(_is("complete"), F.when(exists, LOG_DONE).otherwise(NO_ASSIGNMENT))))
    applied = F.col("__static").isNull() & F.when(looped, F.col("__out")).otherwise(
        _is("end") & exists & F.col("StationID").isNull())
    return r.withColumn("Reason", reason).withColumn("Applied", applied).withColumn("__exists", exists).drop("__out", "__maker")


def _reviews(r: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reasons of the reviews, once the ends are known."""
    ends = r.where(_is("end") & F.col("Applied")).groupBy("__key").agg(F.min("RequestID").alias("__end1"))
    mine = r.where(_is("review")).join(ends, "__key", "left").withColumn("__rating", E.parse_int("__q.rating"))
    done = E.holds(F.col("__tstatus") == "Completed") | E.holds(F.col("__end1") < F.col("RequestID"))
    mine = mine.withColumn("__s", first_failure(
        (F.col("__rating").isNull(), "Invalid or missing 'rating'"), (~F.col("__rating").between(1, 5), "Rating must be between 1 and 5"),
        (~F.col("__exists"), NO_TRIP), (~done, NOT_REVIEWABLE)))
    firsts = first_per(mine.where("__s IS NULL"), ["__key"])
    old = reviews.select(F.concat(F.lit("T"), F.col("TripID").cast("string")).alias("__key"), F.col("UserID").alias("__usr")).distinct().withColumn("__old", F.lit(True))
    mine = mine.join(firsts, "__key", "left").join(old, ["__key", "__usr"], "left")
    again = F.coalesce("__old", F.lit(False)) | (F.col("RequestID") != F.col("__first"))
    return mine.select("RequestID", F.coalesce("__s", F.when(again, REVIEWED)).alias("__why"))


def _registrations(r: DataFrame, users: DataFrame) -> DataFrame:
    mine = r.where(_is("register")).withColumn("__e1", F.lower("__q.email")).withColumn("__s", first_failure(
        (F.col("__q.password").isNull(), "'NoneType' object has no attribute 'encode'"),
        (F.col("__q.name").isNull() | F.col("__q.email").isNull(), EMAIL_TAKEN)))
    firsts = first_per(mine.where("__s IS NULL"), ["__e1"])
    old = users.select(F.lower("Email").alias("__e1")).distinct().withColumn("__old", F.lit(True))
    mine = mine.join(firsts, "__e1", "left").join(old, "__e1", "left")
    again = F.coalesce("__old", F.lit(False)) | (F.col("RequestID") != F.col("__first"))
    return mine.select("RequestID", F.coalesce("__s", F.when(again, EMAIL_TAKEN)).alias("__why"))


def replay_commands(requests: DataFrame, tables: dict[str, DataFrame], block: int = BLOCK, id_block: int = ID_BLOCK) -> Replay:
    """Decide a mixed batch; see the module text.

    ``requests``: RequestID (unique), RequestTime, Kind, UserID, user_role, VehicleID, StationID, DurationHours,
    TripID, LogID, PlanID, Ref, amount, IssueReported, rating, comment, name, email, password.
    """
    with wide_rows(requests.sparkSession):
        return _replayed(requests, tables, block, id_block)


def _replayed(requests: DataFrame, tables: dict[str, DataFrame], block: int, id_block: int) -> Replay:
    all_ = materialize(prepare(requests, tables), "replay-requests")
    decided, rounds = decide(_loop_rows(all_.where(~_is("register", "review")), tables["trips"]), id_block)
    r = materialize(_late_reasons(all_, decided), "replay-reasons")
    late = _reviews(r, tables["reviews"]).unionByName(_registrations(r, tables["users"]))
    r = r.join(late, "RequestID", "left").withColumn("Reason", F.coalesce("Reason", "__why")).withColumn(
        "Applied", F.when(_is("review", "register"), F.col("Reason").isNull()).otherwise(F.col("Applied"))).drop("__why")

    on_logs = r.where(_is("report", "complete") & F.col("Applied")).select(
        "RequestID", _is("report").alias("take"), F.col("__ltech").alias("TechnicianID"),
        F.when(_is("complete") & (F.col("__target") == 1), F.col("Ref")).alias("of"))
    assigned, loads, dispatch_rounds = dispatch(on_logs, tables["technicians"], block)
    r = r.join(assigned.select("RequestID", "TechnicianID"), "RequestID", "left")
    book_rank = global_rank(r.where(_is("book") & F.col("Applied")).select("RequestID"), ["RequestID"], "__i")
    new_trip = (F.coalesce(_max_id(tables["trips"], "TripID"), F.lit(0)) + F.col("__i")).cast("int")
    r = materialize(r.join(book_rank, "RequestID", "left").select("*", "__q.*", new_trip.alias("NewTripID")).drop("__q"), "replay-decided")
    decisions = r.select(
        "RequestID", "Kind", F.col("Reason").isNull().alias("Accepted"), "Reason", F.coalesce("Applied", F.lit(False)).alias("Applied"),
        F.when(_is("book") & F.col("Applied"), F.col("__price").cast(MONEY)).alias("Cost"), "NewTripID", "TechnicianID")
    return Replay(decisions, _snapshots(r, tables, loads), rounds, dispatch_rounds)


def _snapshots(r: DataFrame, t: dict[str, DataFrame], loads: DataFrame) -> dict[str, DataFrame]:
    """New users, vehicles, trips, payments, logs, assignments, technicians and reviews."""
    done = r.where("Applied")
    booked = done.where(_is("book")).select(
        "__key", F.col("NewTripID").alias("TripID"), "UserID", "VehicleID", F.col("StationID").alias("StartStationID"),
        F.col("RequestTime").alias("StartTime"), E.expected_end("RequestTime", "DurationHours").alias("EndTime"),
        F.col("__price").cast(MONEY).alias("Cost"))
    fares = booked.select("__key", F.col("Cost").alias("__fare"))

    # Wallets: all that was applied, in one sum.
    money = done.where(_is("book", "cancel", "topup", "purchase")).join(fares, "__key", "left")
    change = (F.when(_is("book"), -F.col("__fare")).when(_is("cancel"), F.coalesce("__amt", "__fare"))
              .when(_is("topup"), F.col("__amt")).otherwise(-F.col("__amt")))
    per_user = money.groupBy(F.col("__usr").alias("UserID")).agg(
        F.sum(change).alias("__sum"), F.max_by("PlanID", F.when(_is("purchase"), F.col("RequestID"))).alias("__new_plan"), F.lit(1).alias("__hit"))
    users = _replace(t["users"], per_user, "UserID", WalletBalance=(F.col("WalletBalance") + F.col("__sum")).cast(MONEY),
                     PlanID=F.coalesce("__new_plan", "PlanID"))

    # Vehicles: the last event that sets the status.  A report only does so on an available vehicle, that is
    # when the last other event before it freed the vehicle (or none came and it was free) and no report came between.
    on_vehicle = done.where(_is(*_FREES, *_TAKES)).select("RequestID", "Kind", "__veh", "__free0", "__start", "StationID")
    seen = prefix_aggs(on_vehicle, ["__veh"], "RequestID", {
        "__freed": ("max", F.when(_is(*_FREES), F.col("RequestID"))), "__took": ("max", F.when(_is(*_TAKES), F.col("RequestID")))})
    first = F.lit(_FIRST)
    was_free = F.coalesce("__freed", F.when(F.col("__free0"), first).otherwise(first - 1)) > F.coalesce(
        "__took", F.when(F.col("__free0"), first - 1).otherwise(first))
    status = F.when(_is(*_FREES), "available").when(_is("book"), "in-use").when(was_free, "under-maintenance")
    moved = F.when(_is("end", "cancel"), F.struct("RequestID", F.when(_is("end"), F.col("StationID")).otherwise(F.col("__start")).alias("at")))
    per_vehicle = seen.withColumn("__set", status).groupBy(F.col("__veh").alias("VehicleID")).agg(
        F.max(F.when(F.col("__set").isNotNull(), F.struct("RequestID", "__set"))).alias("__last"), F.max(moved).alias("__moved"), F.lit(1).alias("__hit"))
    vehicles = _replace(t["vehicles"], per_vehicle, "VehicleID", Status=F.coalesce("__last.__set", "Status"),
                        CurrentStationID=F.when(F.col("__moved").isNotNull(), F.col("__moved.at")).otherwise(F.col("CurrentStationID")))

    # Trips: the last applied end or cancellation gives status and end time, the last end the station.
    closing = done.where(_is("end", "cancel")).groupBy("__key").agg(
        F.max(F.struct("RequestID", F.when(_is("end"), "Completed").otherwise("Cancelled").alias("to"), F.col("RequestTime").alias("at"))).alias("__c"),
        F.max(F.when(_is("end"), F.struct("RequestID", F.col("StationID").alias("at")))).alias("__s"),
        F.max(_is("cancel")).alias("__cancelled"), F.max("__usr").alias("__cu"), F.lit(1).alias("__hit"))
    old_trips = t["trips"].withColumn("__key", F.concat(F.lit("T"), F.col("TripID").cast("string")))
    both = old_trips.unionByName(booked.select(
        *(F.lit(None).cast("int").alias(c) if c == "EndStationID" else F.lit("Ongoing").alias(c) if c == "Status" else F.col(c) for c in old_trips.columns)))
    trips = _replace(both, closing, "__key", Status=F.col("__c.to"), EndTime=F.col("__c.at"),
                     EndStationID=F.when(F.col("__s").isNotNull(), F.col("__s.at")).otherwise(F.col("EndStationID"))).drop("__key")

    rank = F.coalesce(_max_id(t["payments"], "PaymentID"), F.lit(0))
    first_new = F.coalesce(_max_id(t["trips"], "TripID"), F.lit(0))
    paid = booked.select((rank + F.col("TripID") - first_new).cast("int").alias("PaymentID"), "TripID", "UserID", F.col("Cost").alias("Amount"),
                         F.col("StartTime").alias("Timestamp"), F.lit("Success").alias("Status"), "__key")
    refunded = closing.where("__cancelled").select("__key", F.col("__cu").alias("__ru"))
    pays = t["payments"].withColumn("__key", F.concat(F.lit("T"), F.col("TripID").cast("string"))).unionByName(paid)
    payments = pays.join(refunded, "__key", "left").select(*[
        F.when(E.holds(F.col("UserID") == F.col("__ru")), "Refunded").otherwise(F.col("Status")).alias("Status") if c == "Status" else F.col(c)
        for c in t["payments"].columns])

    # Maintenance: new logs and assignments, completed ones, loads.
    made = global_rank(done.where(_is("report")).select("RequestID", "RequestTime", "__key", "VehicleID", "IssueReported", "TechnicianID"), ["RequestID"], "__i")
    made = made.withColumn("LogID", (F.coalesce(_max_id(t["maintenance_logs"], "LogID"), F.lit(0)) + F.col("__i")).cast("int"))
    finished = done.where(_is("complete")).select("__key", F.lit(1).alias("__hit"))
    logs = t["maintenance_logs"].withColumn("__key", F.concat(F.lit("L"), F.col("LogID").cast("string"))).unionByName(made.select(
        "LogID", "VehicleID", "IssueReported", F.col("RequestTime").cast("date").alias("ReportedDate"),
        F.when(F.col("TechnicianID").isNotNull(), "In-Progress").otherwise("Pending").alias("Status"), "__key"))
    logs = _replace(logs, finished, "__key", Status=F.lit("Completed")).drop("__key")
    new_assignments = made.where(F.col("TechnicianID").isNotNull()).select(
        (F.coalesce(_max_id(t["technician_assignments"], "AssignmentID"), F.lit(0)) + F.col("__i")).cast("int").alias("AssignmentID"), "LogID", "TechnicianID")
    technicians = t["technicians"].drop("ActiveAssignments").join(loads, "TechnicianID", "left").select(*t["technicians"].columns)

    reviewed = done.where(_is("review")).join(fares.join(booked.select("__key", "TripID"), "__key").select("__key", F.col("TripID").alias("__new_trip")), "__key", "left")
    ranked = global_rank(reviewed.select("RequestID", "RequestTime", F.coalesce("__new_trip", "TripID").alias("TripID"), "__usr", "__veh", "rating", "comment"),
                         ["RequestID"], "__i")
    reviews = t["reviews"].unionByName(ranked.select(
        (F.coalesce(_max_id(t["reviews"], "ReviewID"), F.lit(0)) + F.col("__i")).cast("int").alias("ReviewID"), "TripID", F.col("__usr").alias("UserID"),
        F.col("__veh").alias("VehicleID"), E.parse_int("rating").alias("Rating"), F.coalesce("comment", F.lit("")).alias("Comment"),
        F.col("RequestTime").cast("date").alias("ReviewDate")))
    return {"users": users, "vehicles": vehicles, "trips": trips, "payments": payments, "maintenance_logs": logs,
            "technician_assignments": t["technician_assignments"].unionByName(new_assignments), "technicians": technicians, "reviews": reviews}
