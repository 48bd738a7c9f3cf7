"""Set-based command operators: a DataFrame of requests + table snapshots in,
decisions + new snapshots + change rows out, equal to replaying the requests
one by one in ``RequestID`` order.

Shape of every operator::

    op(requests, **tables) -> CommandResult(decisions, tables, changes)

* ``decisions``: one row per request, ``Accepted`` and the first failing
  check as ``Reason`` (checks are applied in the reference's order);
* ``tables``: new snapshots of the tables the command writes;
* ``changes``: one row per touched row (``CHANGE_COLUMNS``), input of
  ``ridegrid.operators.audit``.

"First request per key wins" is computed with ``min``/``max_by`` aggregates
(map-side combined) joined back, never with a window over the key, so a key
holding a third of the requests is not one task.  Running balances use the
block-split ``prefix_sum``.  Request time replaces NOW()/CURDATE().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridegrid.functions import exprs as E
from ridegrid.operators.ids import assign_ids, prefix_sum
from ridegrid.operators.ordered import overflowing
from ridegrid.schemas import MONEY, MONEY_MAX
from ridegrid.session import materialize

# Rejection texts of the reference.
ADMIN_REQUIRED = "Admin access required"
FK_REASON = "Foreign key constraint fails: {}"
DUPLICATE_REASON = "Duplicate entry for key {}"
OUT_OF_RANGE = "Out of range value for a money column"
NOT_ONGOING = "Only ongoing trips can be cancelled"

CHANGE_COLUMNS: list[tuple[str, T.DataType]] = [
    ("RequestID", T.LongType()),
    ("Step", T.IntegerType()),
    ("Sub", T.LongType()),
    ("ChangeTimestamp", T.TimestampNTZType()),
    ("TableName", T.StringType()),
    ("OperationType", T.StringType()),
    ("RecordID", T.IntegerType()),
    ("UserID", T.IntegerType()),
    ("VehicleID", T.IntegerType()),
    ("OldStatus", T.StringType()),
    ("NewStatus", T.StringType()),
    ("Amount", MONEY),
    ("Issue", T.StringType()),
    ("OldBalance", MONEY),
    ("NewBalance", MONEY),
]
CHANGE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in CHANGE_COLUMNS])


class CommandResult:
    """Decisions at once; new snapshots and change rows when first asked for.

    ``tables`` are the snapshots (with ``changes``), or a function returning
    (tables, changes), which may materialize the decided rows: a caller that only
    needs the decisions does not pay for it.
    """

    def __init__(self, decisions: DataFrame, tables: dict[str, DataFrame] | Callable, changes: DataFrame | None = None,
                 rounds: int | None = None):
        self.decisions, self.rounds = decisions, rounds
        self._effects = tables if callable(tables) else lambda: (tables, changes)
        self._made: tuple[dict[str, DataFrame], DataFrame | None] | None = None

    def _get(self) -> tuple[dict[str, DataFrame], DataFrame | None]:
        if self._made is None:
            self._made = self._effects()
        return self._made

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self._get()[0]

    @property
    def changes(self) -> DataFrame | None:
        return self._get()[1]


# ----------------------------------------------------------------------------- helpers
def first_failure(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check whose condition holds (NULL conditions do not)."""
    expr = None
    for cond, reason in checks:
        c = E.holds(cond)
        expr = F.when(c, F.lit(reason)) if expr is None else expr.when(c, F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


def decide(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("Reason", reason).withColumn("Accepted", F.col("Reason").isNull())


def change_rows(df: DataFrame, step: int, table: str, op: str | Column, record: Column, sub: Column | None = None,
                **payload: Column) -> DataFrame:
    """Project rows of ``df`` (which has RequestID, RequestTime) to the change schema."""
    cols = {
        "RequestID": F.col("RequestID"),
        "Step": F.lit(step),
        "Sub": sub if sub is not None else F.lit(0),
        "ChangeTimestamp": F.col("RequestTime"),
        "TableName": F.lit(table),
        "OperationType": F.lit(op) if isinstance(op, str) else op,
        "RecordID": record,
    }
    unknown = set(payload) - {n for n, _ in CHANGE_COLUMNS}
    if unknown:
        raise ValueError(f"unknown change columns {unknown}")
    out = []
    for name, dtype in CHANGE_COLUMNS:
        value = cols.get(name, payload.get(name, F.lit(None)))
        out.append(value.cast(dtype).alias(name))
    return df.select(*out)


def exploded_changes(df: DataFrame, events: list[dict]) -> DataFrame:
    """Several change rows per row of ``df`` with one pass over it.

    Each event has ``step``, ``table``, ``op``, ``record`` and payload columns.
    """
    rows = []
    for event in events:
        cols = {"Step": F.lit(event["step"]), "Sub": F.lit(0), "TableName": F.lit(event["table"]),
                "OperationType": F.lit(event["op"]), "RecordID": event["record"]} | event
        rows.append(F.struct(*[cols.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in CHANGE_COLUMNS
                               if name not in ("RequestID", "ChangeTimestamp")]))
    out = df.select("RequestID", F.col("RequestTime").alias("ChangeTimestamp"), F.explode(F.array(*rows)).alias("__c"))
    return out.select(*[F.col(name if name in ("RequestID", "ChangeTimestamp") else f"__c.{name}").cast(dtype).alias(name)
                        for name, dtype in CHANGE_COLUMNS])


def union_changes(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_per(df: DataFrame, keys: list[str], out: str = "__first") -> DataFrame:
    """Smallest RequestID per key (an aggregate, combined map-side)."""
    return df.groupBy(*keys).agg(F.min("RequestID").alias(out))


def _max_id(df: DataFrame, col: str) -> Column:
    return df.select(F.max(col)).scalar()


def _replace(df: DataFrame, updates: DataFrame, key: str, **new_values: Column) -> DataFrame:
    """Left-join ``updates`` (unique per ``key``) and overwrite columns where a row matched.

    ``updates`` must carry a ``__hit`` column; ``new_values`` are expressions
    over the joined row.
    """
    joined = df.join(updates, key, "left")
    hit = F.col("__hit").isNotNull()
    cols = [F.when(hit, new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in df.columns]
    return joined.select(*cols)


def _headroom(balance: str) -> Column:
    """What a balance can still take in before it leaves the money type."""
    return (F.lit(MONEY_MAX) - F.col(balance)).alias("__room")


def _marked(r: DataFrame, over: DataFrame | None) -> DataFrame:
    """Add ``__over``: TRUE for the requests in ``over``."""
    if over is None:
        return r.withColumn("__over", F.lit(False))
    return r.join(over, "RequestID", "left")


def _status_transitions(key: str, original: str, new_status: str) -> Column:
    """Old status seen by each applied request: the original for the first request
    per key, ``new_status`` for later ones (the key is already in that state)."""
    return F.when(F.col("RequestID") == F.col(f"__first_{key}"), F.col(original)).otherwise(F.lit(new_status))


def _with_first(df: DataFrame, key: str) -> DataFrame:
    firsts = df.groupBy(key).agg(F.min("RequestID").alias(f"__first_{key}"))
    return df.join(firsts, key)


# ----------------------------------------------------------------------------- M7
def wallet_topups(requests: DataFrame, users: DataFrame) -> CommandResult:
    """M7: validate and add top-ups; balances change by the sum of accepted amounts."""
    u = users.select(F.col("UserID").alias("__u"), F.col("WalletBalance").alias("__bal0"))
    # the parsed value must not be called "Amount": column names resolve case-insensitively
    r = requests.join(u, requests.UserID == u.__u, "left").withColumn("__amt", E.parse_amount("amount"))
    r = r.withColumn("__static", first_failure(
        (F.col("amount").isNull(), "Missing 'amount' field"),
        (F.col("__amt").isNull(), "Invalid amount"),
        (F.col("__amt") <= 0, "Amount must be positive"),
        (F.col("__u").isNull(), "User not found"),
    ))
    # A top-up that would lift the balance over the money type is rejected alone.
    over = overflowing(r.where(F.col("__static").isNull()).select(
        "RequestID", "UserID", F.col("__amt").alias("__cost"), _headroom("__bal0")))
    d = decide(_marked(r, over), F.coalesce(F.col("__static"), F.when(F.col("__over"), F.lit(OUT_OF_RANGE))))
    decisions = d.select("RequestID", "UserID", F.col("__amt").alias("Amount"), "Accepted", "Reason")

    def effects():
        acc = materialize(prefix_sum(d.where("Accepted").select("RequestID", "RequestTime", "UserID", "__amt", "__bal0"),
                                     ["UserID"], "RequestID", "__amt", "__before"), "topups")
        totals = acc.groupBy("UserID").agg(F.sum("__amt").alias("__add"), F.lit(1).alias("__hit"))
        new_users = _replace(users, totals, "UserID",
                             WalletBalance=(F.col("WalletBalance") + F.col("__add")).cast(MONEY))
        old = F.col("__bal0") + F.col("__before")
        changes = change_rows(acc, 1, "Users", "UPDATE", F.col("UserID"), UserID=F.col("UserID"),
                              OldBalance=old.cast(MONEY), NewBalance=(old + F.col("__amt")).cast(MONEY))
        return {"users": new_users}, changes

    return CommandResult(decisions, effects)


# ----------------------------------------------------------------------------- M9
def submit_reviews(requests: DataFrame, trips: DataFrame, reviews: DataFrame) -> CommandResult:
    """M9: validity checks first, then the first valid request per (user, trip) wins
    unless a review already exists."""
    t = trips.select(F.col("TripID").alias("__t"), F.col("UserID").alias("__tu"), F.col("VehicleID").alias("__tv"),
                     F.col("Status").alias("__ts"))
    r = requests.join(t, requests.TripID == t.__t, "left").withColumn("__rating", E.parse_int("rating"))
    static = first_failure(
        (F.col("__rating").isNull(), "Invalid or missing 'rating'"),
        (~F.col("__rating").between(1, 5), "Rating must be between 1 and 5"),
        (F.col("__t").isNull(), "Trip not found"),
        (F.col("__ts") != "Completed", "Can only review completed trips"),
    )
    r = r.withColumn("__static", static)
    firsts = first_per(r.where(F.col("__static").isNull()), ["__tu", "TripID"])
    existing = reviews.select(F.col("UserID").alias("__tu"), "TripID").distinct().withColumn("__exists", F.lit(True))
    r = r.join(firsts, ["__tu", "TripID"], "left").join(existing, ["__tu", "TripID"], "left")
    dup = F.coalesce(F.col("__exists"), F.lit(False)) | (F.col("RequestID") != F.col("__first"))
    d = decide(r, F.coalesce(F.col("__static"), F.when(dup, F.lit("A review for this trip already exists"))))
    decisions = d.select("RequestID", "TripID", F.col("__rating").alias("Rating"), "Accepted", "Reason")
    acc = d.where("Accepted").select(
        "RequestID", "TripID", F.col("__tu").alias("UserID"), F.col("__tv").alias("VehicleID"),
        F.col("__rating").alias("Rating"),
        F.coalesce(F.col("comment"), F.lit("")).alias("Comment"), F.col("RequestTime").cast("date").alias("ReviewDate"))
    new = assign_ids(acc, ["RequestID"], _max_id(reviews, "ReviewID"), "ReviewID")
    new_reviews = reviews.unionByName(new.select(*reviews.columns))
    return CommandResult(decisions, lambda: ({"reviews": new_reviews, "new_reviews": new}, None))


# ----------------------------------------------------------------------------- M6
def register_users(requests: DataFrame, users: DataFrame) -> CommandResult:
    """M6: the first request per (case-insensitive) new e-mail registers a user."""
    existing = users.select(F.lower("Email").alias("__e")).distinct().withColumn("__exists", F.lit(True))
    r = requests.withColumn("__e", F.lower("email"))
    static = first_failure(
        (F.col("password").isNull(), "'NoneType' object has no attribute 'encode'"),
        (F.col("name").isNull() | F.col("email").isNull(), "Email already registered"),
    )
    r = r.withColumn("__static", static)
    firsts = first_per(r.where(F.col("__static").isNull()), ["__e"])
    r = r.join(firsts, "__e", "left").join(existing, "__e", "left")
    dup = F.coalesce(F.col("__exists"), F.lit(False)) | (F.col("RequestID") != F.col("__first"))
    d = decide(r, F.coalesce(F.col("__static"), F.when(dup, F.lit("Email already registered"))))
    decisions = d.select("RequestID", F.col("email").alias("Email"), "Accepted", "Reason")
    acc = d.where("Accepted").select(
        "RequestID", F.col("name").alias("Name"), F.col("email").alias("Email"),
        E.digest("password").alias("Password"), F.lit("user").alias("Role"),
        F.lit("0.00").cast(MONEY).alias("WalletBalance"), F.col("RequestTime").cast("date").alias("JoinDate"),
        F.lit(None).cast("int").alias("PlanID"))
    new = assign_ids(acc, ["RequestID"], _max_id(users, "UserID"), "UserID")
    return CommandResult(decisions, lambda: ({"users": users.unionByName(new.select(*users.columns)), "new_users": new}, None))


# ----------------------------------------------------------------------------- M2
def end_rides(requests: DataFrame, trips: DataFrame, vehicles: DataFrame, stations: DataFrame) -> CommandResult:
    """M2: no status check; unknown trip = silent success; unknown end station = FK failure."""
    t = trips.select(F.col("TripID").alias("__t"), F.col("VehicleID").alias("__tv"), F.col("Status").alias("__ts"))
    s = stations.select(F.col("StationID").alias("__s"))
    r = requests.join(t, requests.TripID == t.__t, "left").join(s, requests.EndStationID == s.__s, "left")
    d = decide(r, first_failure(
        (F.col("__t").isNotNull() & F.col("EndStationID").isNotNull() & F.col("__s").isNull(),
         FK_REASON.format("EndStationID")),
    )).withColumn("Applied", F.col("Accepted") & F.col("__t").isNotNull())
    decisions = d.select("RequestID", "TripID", "EndStationID", "Accepted", "Reason", "Applied")
    return CommandResult(decisions, lambda: _ended(d.where("Applied"), trips, vehicles))


def _ended(applied: DataFrame, trips: DataFrame, vehicles: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    vs = vehicles.select(F.col("VehicleID").alias("__tv"), F.col("Status").alias("__vs"))
    applied = materialize(_with_first(_with_first(applied, "TripID").join(vs, "__tv", "left"), "__tv"), "end-applied")
    last = F.max_by(F.struct("RequestTime", "EndStationID"), "RequestID")
    per_trip = applied.groupBy("TripID").agg(last.alias("__l"), F.lit(1).alias("__hit"))
    new_trips = _replace(trips, per_trip, "TripID", Status=F.lit("Completed"), EndTime=F.col("__l.RequestTime"),
                         EndStationID=F.col("__l.EndStationID"))
    per_vehicle = applied.groupBy(F.col("__tv").alias("VehicleID")).agg(last.alias("__l"), F.lit(1).alias("__hit"))
    new_vehicles = _replace(vehicles, per_vehicle, "VehicleID", Status=F.lit("available"),
                            CurrentStationID=F.col("__l.EndStationID"))
    # change rows: T2 for every applied request, T6 candidates per vehicle
    changes = exploded_changes(applied, [
        dict(step=1, table="Trips", op="UPDATE", record=F.col("TripID"),
             OldStatus=_status_transitions("TripID", "__ts", "Completed"), NewStatus=F.lit("Completed")),
        dict(step=2, table="Vehicles", op="UPDATE", record=F.col("__tv"), VehicleID=F.col("__tv"),
             OldStatus=_status_transitions("__tv", "__vs", "available"), NewStatus=F.lit("available")),
    ])
    return {"trips": new_trips, "vehicles": new_vehicles}, changes


# ----------------------------------------------------------------------------- M3
def cancel_trips(requests: DataFrame, trips: DataFrame, vehicles: DataFrame, users: DataFrame,
                 payments: DataFrame) -> CommandResult:
    """M3: only Ongoing trips; the first request per trip cancels it and refunds the cost."""
    t = trips.select(F.col("TripID").alias("__t"), F.col("UserID").alias("__tu"), F.col("VehicleID").alias("__tv"),
                     F.col("StartStationID").alias("__tss"), F.col("Cost").alias("__tc"), F.col("Status").alias("__ts"))
    bal = users.select(F.col("UserID").alias("__tu"), F.col("WalletBalance").alias("__bal0"))
    r = requests.join(t, requests.TripID == t.__t, "left").join(bal, "__tu", "left")
    firsts = first_per(r.where(F.col("__ts") == "Ongoing"), ["TripID"])
    r = r.join(firsts, "TripID", "left")
    # A refund that would lift the balance over the money type fails (C8); the trip stays ongoing, and
    # as refunds only raise the balance, every later cancellation of it fails the same way.
    over = overflowing(r.where((F.col("__ts") == "Ongoing") & (F.col("RequestID") == F.col("__first"))).select(
        "RequestID", F.col("__tu").alias("UserID"), F.col("__tc").alias("__cost"), _headroom("__bal0")))
    marked = r.withColumn("__over", F.lit(False)) if over is None else r.join(
        over.withColumnRenamed("RequestID", "__first"), "__first", "left")
    d = decide(marked, first_failure(
        (F.col("__t").isNotNull() & (F.col("__ts") != "Ongoing"), NOT_ONGOING),
        (F.col("__over"), OUT_OF_RANGE),
        (F.col("__t").isNotNull() & (F.col("RequestID") != F.col("__first")), NOT_ONGOING),
    )).withColumn("Applied", F.col("Accepted") & F.col("__t").isNotNull())
    decisions = d.select("RequestID", "TripID", "Accepted", "Reason", "Applied")
    return CommandResult(decisions, lambda: _cancelled(d.where("Applied"), trips, vehicles, users, payments))


def _cancelled(applied: DataFrame, trips: DataFrame, vehicles: DataFrame, users: DataFrame,
               payments: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Effects of the applied cancellations (at most one per trip)."""
    vs = vehicles.select(F.col("VehicleID").alias("__tv"), F.col("Status").alias("__vs"))
    applied = materialize(
        prefix_sum(_with_first(applied.join(vs, "__tv", "left"), "__tv"), ["__tu"], "RequestID", "__tc", "__before"),
        "cancel-applied")
    per_trip = applied.select("TripID", F.col("RequestTime").alias("__rt"), F.lit(1).alias("__hit"))
    new_trips = _replace(trips, per_trip, "TripID", Status=F.lit("Cancelled"), EndTime=F.col("__rt"))
    last = F.max_by(F.col("__tss"), "RequestID")
    per_vehicle = applied.groupBy(F.col("__tv").alias("VehicleID")).agg(last.alias("__st"), F.lit(1).alias("__hit"))
    new_vehicles = _replace(vehicles, per_vehicle, "VehicleID", Status=F.lit("available"),
                            CurrentStationID=F.col("__st"))
    refunds = applied.groupBy(F.col("__tu").alias("UserID")).agg(F.sum("__tc").alias("__add"), F.lit(1).alias("__hit"))
    new_users = _replace(users, refunds, "UserID", WalletBalance=(F.col("WalletBalance") + F.col("__add")).cast(MONEY))
    refunded = applied.select(F.col("TripID").alias("__rtrip"), F.col("__tu").alias("__ruser")).withColumn("__r", F.lit(1))
    p = payments.join(refunded, (payments.TripID == refunded.__rtrip) & (payments.UserID == refunded.__ruser), "left")
    new_payments = p.select(*[F.when(F.col("__r").isNotNull(), F.lit("Refunded")).otherwise(F.col("Status")).alias("Status")
                              if c == "Status" else F.col(c) for c in payments.columns])

    old = F.col("__bal0") + F.col("__before")
    rows = exploded_changes(applied, [
        dict(step=1, table="Trips", op="UPDATE", record=F.col("TripID"), OldStatus=F.col("__ts"),
             NewStatus=F.lit("Cancelled")),
        dict(step=2, table="Vehicles", op="UPDATE", record=F.col("__tv"), VehicleID=F.col("__tv"),
             OldStatus=_status_transitions("__tv", "__vs", "available"), NewStatus=F.lit("available")),
        dict(step=3, table="Users", op="UPDATE", record=F.col("__tu"), UserID=F.col("__tu"), OldBalance=old.cast(MONEY),
             NewBalance=(old + F.col("__tc")).cast(MONEY)),
    ])
    pays = payments.select(F.col("PaymentID").alias("__p"), F.col("TripID").alias("__pt"), F.col("UserID").alias("__pu"),
                           F.col("Status").alias("__ps"))
    touched = applied.join(pays, (applied.TripID == pays.__pt) & (applied.__tu == pays.__pu))
    t5 = change_rows(touched, 4, "Payments", "UPDATE", F.col("__p"), sub=F.col("__p"), OldStatus=F.col("__ps"),
                     NewStatus=F.lit("Refunded"))
    return {"trips": new_trips, "vehicles": new_vehicles, "users": new_users,
            "payments": new_payments}, union_changes([rows, t5])


# ----------------------------------------------------------------------------- M5
def complete_maintenance(requests: DataFrame, assignments: DataFrame, logs: DataFrame, technicians: DataFrame,
                         vehicles: DataFrame) -> CommandResult:
    """M5: admin only; the log's (lowest-id) assignment must exist and the log not be completed."""
    asg = assignments.groupBy("LogID").agg(F.min(F.struct("AssignmentID", "TechnicianID")).alias("__a"))
    ml = logs.select(F.col("LogID").alias("__m"), F.col("VehicleID").alias("__mv"), F.col("Status").alias("__ms"))
    r = requests.join(asg, "LogID", "left").join(ml, F.col("LogID") == F.col("__m"), "left")
    found = F.col("__a").isNotNull() & F.col("__m").isNotNull()
    firsts = first_per(r.where(E.is_admin("user_role") & found & (F.col("__ms") != "Completed")), ["LogID"])
    r = r.join(firsts, "LogID", "left")
    d = decide(r, first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (~found, "Assignment not found"),
        ((F.col("__ms") == "Completed") | (F.col("RequestID") != F.col("__first")), "Maintenance log already completed"),
    ))
    decisions = d.select("RequestID", "LogID", F.col("__a.TechnicianID").alias("TechnicianID"), "Accepted", "Reason")
    return CommandResult(decisions, lambda: _completed(d.where("Accepted"), logs, technicians, vehicles))


def _completed(acc: DataFrame, logs: DataFrame, technicians: DataFrame,
               vehicles: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    vs = vehicles.select(F.col("VehicleID").alias("__mv"), F.col("Status").alias("__vs"))
    acc = materialize(
        _with_first(acc.withColumn("__tech", F.col("__a.TechnicianID")).join(vs, "__mv", "left"), "__mv"), "completed")
    done = acc.select("LogID", F.lit(1).alias("__hit"))
    new_logs = _replace(logs, done, "LogID", Status=F.lit("Completed"))
    per_tech = acc.groupBy(F.col("__tech").alias("TechnicianID")).agg(F.count(F.lit(1)).alias("__n"), F.lit(1).alias("__hit"))
    new_tech = _replace(technicians, per_tech, "TechnicianID",
                        ActiveAssignments=F.greatest(F.col("ActiveAssignments") - F.col("__n"), F.lit(0)).cast("int"))
    per_vehicle = acc.groupBy(F.col("__mv").alias("VehicleID")).agg(F.lit(1).alias("__hit"))
    new_vehicles = _replace(vehicles, per_vehicle, "VehicleID", Status=F.lit("available"))
    changes = exploded_changes(acc, [
        dict(step=1, table="MaintenanceLogs", op="UPDATE", record=F.col("LogID"), OldStatus=F.col("__ms"),
             NewStatus=F.lit("Completed")),
        dict(step=2, table="Vehicles", op="UPDATE", record=F.col("__mv"), VehicleID=F.col("__mv"),
             OldStatus=_status_transitions("__mv", "__vs", "available"), NewStatus=F.lit("available")),
    ])
    return {"maintenance_logs": new_logs, "technicians": new_tech, "vehicles": new_vehicles}, changes


# ----------------------------------------------------------------------------- M10
def update_profiles(requests: DataFrame, users: DataFrame) -> CommandResult:
    """Set name and/or password when supplied non-empty; the last supplied value wins."""
    u = users.select(F.col("UserID").alias("__u"))
    r = requests.join(u, requests.UserID == u.__u, "left")
    anything = E.truthy_text("name") | E.truthy_text("password")
    d = decide(r, first_failure((anything & F.col("__u").isNull(), "User not found")))
    decisions = d.select("RequestID", "UserID", "Accepted", "Reason")
    acc = d.where("Accepted")
    last_name = F.max(F.when(E.truthy_text("name"), F.struct("RequestID", "name")))
    last_pw = F.max(F.when(E.truthy_text("password"), F.struct("RequestID", "password")))
    per_user = acc.groupBy("UserID").agg(last_name.alias("__n"), last_pw.alias("__p"), F.lit(1).alias("__hit"))
    new_users = _replace(users, per_user, "UserID", Name=F.coalesce(F.col("__n.name"), F.col("Name")),
                         Password=F.coalesce(E.digest(F.col("__p.password")), F.col("Password")))
    return CommandResult(decisions, {"users": new_users}, None)


# ----------------------------------------------------------------------------- M11 / M12
def add_stations(requests: DataFrame, stations: DataFrame) -> CommandResult:
    """Admin; name, location and capacity all present; duplicate names allowed."""
    d = decide(requests, first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (~(E.truthy_text("name") & E.truthy_text("location") & E.truthy_id("capacity")),
         "Name, location, and capacity are required"),
    ))
    decisions = d.select("RequestID", "Accepted", "Reason")
    acc = d.where("Accepted").select("RequestID", F.col("name").alias("Name"), F.col("location").alias("Location"),
                                     F.col("capacity").cast("int").alias("Capacity"), F.lit(True).alias("IsActive"))
    new = assign_ids(acc, ["RequestID"], _max_id(stations, "StationID"), "StationID")
    return CommandResult(decisions, {"stations": stations.unionByName(new.select(*stations.columns)),
                                     "new_stations": new}, None)


def deactivate_stations(requests: DataFrame, stations: DataFrame) -> CommandResult:
    """Admin; station must exist; IsActive := FALSE (vehicles are not moved)."""
    s = stations.select(F.col("StationID").alias("__s"))
    r = requests.join(s, requests.StationID == s.__s, "left")
    d = decide(r, first_failure((~E.is_admin("user_role"), ADMIN_REQUIRED), (F.col("__s").isNull(), "Station not found")))
    decisions = d.select("RequestID", "StationID", "Accepted", "Reason")
    hits = d.where("Accepted").groupBy("StationID").agg(F.lit(1).alias("__hit"))
    return CommandResult(decisions, {"stations": _replace(stations, hits, "StationID", IsActive=F.lit(False))}, None)


# ----------------------------------------------------------------------------- M13 / M14
def add_vehicles(requests: DataFrame, vehicles: DataFrame, stations: DataFrame) -> CommandResult:
    """Admin; five fields present; registration unique (case-insensitive); station FK."""
    existing = vehicles.select(F.lower("RegistrationNumber").alias("__reg")).distinct().withColumn("__exists", F.lit(True))
    s = stations.select(F.col("StationID").alias("__s"))
    r = (requests.withColumn("__reg", F.lower("registration_number"))
         .join(s, F.col("station_id") == F.col("__s"), "left"))
    fk_bad = F.col("station_id").isNotNull() & F.col("__s").isNull()
    static = first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (~(E.truthy_text("type") & E.truthy_text("model") & E.truthy_text("manufacturer")
           & E.holds(F.col("rate_per_hour") != 0) & E.truthy_text("registration_number")),
         "Type, model, manufacturer, rate_per_hour, and registration_number are required"),
    )
    r = r.withColumn("__static", static)
    firsts = first_per(r.where(F.col("__static").isNull() & ~fk_bad), ["__reg"])
    r = r.join(firsts, "__reg", "left").join(existing, "__reg", "left")
    dup = F.coalesce(F.col("__exists"), F.lit(False)) | E.holds(F.col("__first") < F.col("RequestID"))
    d = decide(r, F.coalesce(F.col("__static"), first_failure(
        (dup, DUPLICATE_REASON.format("RegistrationNumber")),
        (fk_bad, FK_REASON.format("CurrentStationID")),
    )))
    decisions = d.select("RequestID", F.col("registration_number").alias("RegistrationNumber"), "Accepted", "Reason")
    acc = d.where("Accepted").select(
        "RequestID", F.col("registration_number").alias("RegistrationNumber"), F.col("type").alias("Type"),
        F.col("model").alias("Model"), F.col("manufacturer").alias("Manufacturer"),
        F.col("rate_per_hour").cast(MONEY).alias("RatePerHour"), F.lit("available").alias("Status"),
        F.col("station_id").cast("int").alias("CurrentStationID"))
    new = assign_ids(acc, ["RequestID"], _max_id(vehicles, "VehicleID"), "VehicleID")
    return CommandResult(decisions, {"vehicles": vehicles.unionByName(new.select(*vehicles.columns)),
                                     "new_vehicles": new}, None)


def decommission_vehicles(requests: DataFrame, vehicles: DataFrame) -> CommandResult:
    """Admin; any status -> decommissioned."""
    v = vehicles.select(F.col("VehicleID").alias("__v"), F.col("Status").alias("__vs"))
    r = requests.join(v, requests.VehicleID == v.__v, "left")
    d = decide(r, first_failure((~E.is_admin("user_role"), ADMIN_REQUIRED), (F.col("__v").isNull(), "Vehicle not found")))
    decisions = d.select("RequestID", "VehicleID", "Accepted", "Reason")
    def effects():
        acc = materialize(_with_first(d.where("Accepted"), "VehicleID"), "decommissioned")
        hits = acc.groupBy("VehicleID").agg(F.lit(1).alias("__hit"))
        t6 = change_rows(acc, 1, "Vehicles", "UPDATE", F.col("VehicleID"), VehicleID=F.col("VehicleID"),
                         OldStatus=_status_transitions("VehicleID", "__vs", "decommissioned"),
                         NewStatus=F.lit("decommissioned"))
        return {"vehicles": _replace(vehicles, hits, "VehicleID", Status=F.lit("decommissioned"))}, t6

    return CommandResult(decisions, effects)


# ----------------------------------------------------------------------------- M15 / M16 / M17
def add_technicians(requests: DataFrame, technicians: DataFrame) -> CommandResult:
    """Admin; name and specialization present; available with no load."""
    d = decide(requests, first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (~(E.truthy_text("name") & E.truthy_text("specialization")), "Name and specialization are required"),
    ))
    decisions = d.select("RequestID", "Accepted", "Reason")
    acc = d.where("Accepted").select("RequestID", F.col("name").alias("Name"),
                                     F.col("specialization").alias("Specialization"), F.lit(True).alias("IsAvailable"),
                                     F.lit(0).alias("ActiveAssignments"))
    new = assign_ids(acc, ["RequestID"], _max_id(technicians, "TechnicianID"), "TechnicianID")
    return CommandResult(decisions, {"technicians": technicians.unionByName(new.select(*technicians.columns)),
                                     "new_technicians": new}, None)


def update_technicians(requests: DataFrame, technicians: DataFrame) -> CommandResult:
    """Admin; at least one field; technician must exist; last value per field wins."""
    t = technicians.select(F.col("TechnicianID").alias("__t"))
    r = requests.join(t, requests.TechnicianID == t.__t, "left")
    anything = E.truthy_text("name") | E.truthy_text("specialization") | F.col("is_available").isNotNull()
    d = decide(r, first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (~anything, "No fields to update"),
        (F.col("__t").isNull(), "Technician not found"),
    ))
    decisions = d.select("RequestID", "TechnicianID", "Accepted", "Reason")
    acc = d.where("Accepted")
    per_tech = acc.groupBy("TechnicianID").agg(
        F.max(F.when(E.truthy_text("name"), F.struct("RequestID", "name"))).alias("__n"),
        F.max(F.when(E.truthy_text("specialization"), F.struct("RequestID", "specialization"))).alias("__s"),
        F.max(F.when(F.col("is_available").isNotNull(), F.struct("RequestID", "is_available"))).alias("__a"),
        F.lit(1).alias("__hit"))
    new = _replace(technicians, per_tech, "TechnicianID",
                   Name=F.coalesce(F.col("__n.name"), F.col("Name")),
                   Specialization=F.coalesce(F.col("__s.specialization"), F.col("Specialization")),
                   IsAvailable=F.coalesce(F.col("__a.is_available"), F.col("IsAvailable")))
    return CommandResult(decisions, {"technicians": new}, None)


def delete_technicians(requests: DataFrame, technicians: DataFrame, assignments: DataFrame) -> CommandResult:
    """Admin; must exist; no active load; no assignment rows (FK); first delete wins."""
    t = technicians.select(F.col("TechnicianID").alias("__t"), F.col("ActiveAssignments").alias("__load"))
    used = assignments.select(F.col("TechnicianID").alias("__ut")).distinct().withColumn("__used", F.lit(True))
    r = requests.join(t, requests.TechnicianID == t.__t, "left").join(used, F.col("TechnicianID") == F.col("__ut"), "left")
    ok = (E.is_admin("user_role") & F.col("__t").isNotNull() & ~E.holds(F.col("__load") > 0)
          & F.col("__used").isNull())
    firsts = first_per(r.where(ok), ["TechnicianID"])
    r = r.join(firsts, "TechnicianID", "left")
    d = decide(r, first_failure(
        (~E.is_admin("user_role"), ADMIN_REQUIRED),
        (F.col("__t").isNull() | E.holds(F.col("__first") < F.col("RequestID")), "Technician not found"),
        (F.col("__load") > 0, "Cannot delete technician with active assignments"),
        (F.col("__used").isNotNull(), FK_REASON.format("TechnicianID")),
    ))
    decisions = d.select("RequestID", "TechnicianID", "Accepted", "Reason")
    gone = d.where("Accepted").select("TechnicianID")
    return CommandResult(decisions, {"technicians": technicians.join(gone, "TechnicianID", "left_anti")}, None)


# ----------------------------------------------------------------------------- M18
def onboard_users(requests: DataFrame, users: DataFrame, plans: DataFrame) -> CommandResult:
    """The registration page's flow: checks, then register -> top up -> buy the plan.

    Requests: RequestID, RequestTime, name, email, password, topup (text), PlanID.
    The three steps are the M6, M7 and M8 operators applied in turn.
    """
    from ridegrid.operators.purchases import purchase_memberships

    p = plans.select(F.col("PlanID").alias("__p"), F.col("Cost").alias("__cost"))
    r = requests.join(p, requests.PlanID == p.__p, "left").withColumn("__top", E.parse_amount("topup"))
    checks = [
        (F.col("__top").isNull() | (F.col("__top") <= 0), F.lit("Please enter a valid top-up amount")),
        (~E.truthy_id("PlanID"), F.lit("Please select a membership plan")),
        (F.col("__p").isNull(), F.lit("Invalid plan selected")),
        (F.col("__top") < F.col("__cost"), F.concat(F.lit("Top-up amount must be at least ₹"),
                                                   F.col("__cost").cast("string"),
                                                   F.lit(" to purchase the selected plan"))),
    ]
    reason = None
    for cond, text in checks:
        reason = F.when(E.holds(cond), text) if reason is None else reason.when(E.holds(cond), text)
    r = r.withColumn("__pre", reason.otherwise(F.lit(None).cast("string")))
    ok = r.where(F.col("__pre").isNull())
    reg = register_users(ok.select("RequestID", "RequestTime", "name", "email", "password"), users)
    new = reg.tables["new_users"]
    steps = new.select("UserID", "RequestID").join(ok.select("RequestID", "RequestTime", "__top", "PlanID"), "RequestID")
    topped = wallet_topups(steps.select("RequestID", "RequestTime", "UserID",
                                        F.col("__top").cast("string").alias("amount")),
                           new.select(*users.columns))
    bought = purchase_memberships(steps.select("RequestID", "RequestTime", "UserID", "PlanID"),
                                  topped.tables["users"], plans)
    final = bought.tables["users"]
    d = (r.join(reg.decisions.select("RequestID", F.col("Reason").alias("__reg")), "RequestID", "left")
         .join(bought.decisions.select("RequestID", F.col("Reason").alias("__buy")), "RequestID", "left")
         .join(new.select("RequestID", "UserID"), "RequestID", "left"))
    d = decide(d, F.coalesce(F.col("__pre"), F.col("__reg"), F.col("__buy")))
    decisions = d.join(final.select(F.col("UserID").alias("__u"), "WalletBalance", F.col("PlanID").alias("__plan")),
                       F.col("UserID") == F.col("__u"), "left").select(
        "RequestID", F.col("email").alias("Email"), "Accepted", "Reason",
        F.when(F.col("Accepted"), F.col("UserID")).alias("UserID"),
        F.when(F.col("Accepted"), F.col("WalletBalance")).alias("WalletBalance"),
        F.when(F.col("Accepted"), F.col("__plan")).alias("PlanID"))
    return CommandResult(decisions, {"users": users.unionByName(final.select(*users.columns))},
                         union_changes([topped.changes, bought.changes]))
