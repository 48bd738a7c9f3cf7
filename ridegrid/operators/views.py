"""Reporting views and list queries, answered for every key.

Single-key parameters of the reference (``WHERE UserID = ?``) are optional
keyword filters; without them an operator answers for all keys at once.

Plan notes (checked with ``explain``):

* every input is projected to the columns it needs before a join, so the
  parquet scans read only those columns;
* counts are pre-aggregated (partial + final hash aggregate) before they are
  joined to a dimension, so a hot station or user never reaches a join as a
  third of the rows;
* dimension joins are plain equi-joins: AQE turns them into broadcast joins
  when the runtime size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
  and keeps sort-merge (with skew splitting) otherwise.  Only the three-row
  plan table is joined without an equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.functions import exprs as E
from ridegrid.operators.ids import global_rank, running_count


def _ci_equals(col: str, value: str) -> F.Column:
    """Case-insensitive string match (the reference's default collation)."""
    return F.lower(F.col(col)) == F.lower(F.lit(value))


# --------------------------------------------------------------------------- joins
def station_availability(stations: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Active stations with their count of available vehicles (0 when none)."""
    counts = (
        vehicles.where((F.col("Status") == "available") & F.col("CurrentStationID").isNotNull())
        .groupBy("CurrentStationID")
        .agg(F.count("VehicleID").alias("AvailableVehicles"))
    )
    active = stations.where(F.col("IsActive")).select("StationID", "Name", "Location", "Capacity")
    return active.join(counts, active.StationID == counts.CurrentStationID, "left").select(
        "StationID", "Name", "Location", "Capacity",
        F.coalesce(F.col("AvailableVehicles"), F.lit(0).cast("bigint")).alias("AvailableVehicles"),
    )


def vehicle_details(vehicles: DataFrame, stations: DataFrame) -> DataFrame:
    """Non-decommissioned vehicles with their station name (NULL kept)."""
    v = vehicles.where(F.col("Status") != "decommissioned").select(
        "VehicleID", "RegistrationNumber", "Type", "Model", "Manufacturer", "RatePerHour", "Status",
        "CurrentStationID",
    )
    s = stations.select("StationID", F.col("Name").alias("CurrentStationName"))
    return v.join(s, v.CurrentStationID == s.StationID, "left").select(
        "VehicleID", "RegistrationNumber", "Type", "Model", "Manufacturer", "RatePerHour", "Status",
        "CurrentStationName",
    )


def trip_history(trips: DataFrame, users: DataFrame, vehicles: DataFrame, stations: DataFrame) -> DataFrame:
    """Trips with user name, vehicle type and both station names."""
    t = trips.select("TripID", "UserID", "VehicleID", "StartStationID", "EndStationID",
                     "StartTime", "EndTime", "Cost", "Status")
    u = users.select(F.col("UserID").alias("u_id"), F.col("Name").alias("UserName"))
    v = vehicles.select(F.col("VehicleID").alias("v_id"), F.col("Type").alias("VehicleType"))
    s1 = stations.select(F.col("StationID").alias("s1_id"), F.col("Name").alias("StartStation"))
    s2 = stations.select(F.col("StationID").alias("s2_id"), F.col("Name").alias("EndStation"))
    return (
        t.join(u, t.UserID == u.u_id)
        .join(v, t.VehicleID == v.v_id)
        .join(s1, t.StartStationID == s1.s1_id)
        .join(s2, t.EndStationID == s2.s2_id, "left")
        .select("TripID", "UserID", "UserName", "VehicleType", "StartStation", "EndStation",
                "StartTime", "EndTime", "Cost", "Status")
    )


def technician_assignments(assignments: DataFrame, technicians: DataFrame, logs: DataFrame,
                           vehicles: DataFrame) -> DataFrame:
    """Assignment rows with technician, log and vehicle details (14 columns)."""
    ta = assignments.select("AssignmentID", "LogID", "TechnicianID")
    t = technicians.select(F.col("TechnicianID").alias("t_id"), F.col("Name").alias("TechnicianName"),
                           "Specialization", "IsAvailable", "ActiveAssignments")
    ml = logs.select(F.col("LogID").alias("ml_id"), "VehicleID", "IssueReported", "ReportedDate",
                     F.col("Status").alias("LogStatus"))
    v = vehicles.select(F.col("VehicleID").alias("v_id"), "RegistrationNumber",
                        F.col("Model").alias("VehicleModel"), F.col("Type").alias("VehicleType"))
    return (
        ta.join(t, ta.TechnicianID == t.t_id)
        .join(ml, ta.LogID == ml.ml_id)
        .join(v, F.col("VehicleID") == v.v_id)
        .select("AssignmentID", "LogID", "TechnicianID", "TechnicianName", "Specialization", "IsAvailable",
                "ActiveAssignments", "VehicleID", "RegistrationNumber", "VehicleModel", "VehicleType",
                "IssueReported", "ReportedDate", "LogStatus")
    )


def user_profiles(users: DataFrame, plans: DataFrame, user_id: int | None = None) -> DataFrame:
    """Users with plan name and discount; ``Password`` is never selected."""
    u = users.select("UserID", "Name", "Email", "WalletBalance", "JoinDate", "Role", "PlanID")
    if user_id is not None:
        u = u.where(F.col("UserID") == user_id)
    p = plans.select(F.col("PlanID").alias("p_id"), "PlanName")
    return u.join(p, u.PlanID == p.p_id, "left").select(
        "UserID", "Name", "Email", "WalletBalance", "JoinDate", "Role", "PlanID", "PlanName",
        E.plan_discount("PlanName").alias("PlanDiscount"),
    )


def assignment_status(assignments: DataFrame, logs: DataFrame) -> DataFrame:
    """Per assignment, the technician and the current status of its log."""
    ml = logs.select(F.col("LogID").alias("ml_id"), "Status")
    return assignments.join(ml, assignments.LogID == ml.ml_id).select(
        "AssignmentID", "LogID", "TechnicianID", "Status"
    )


# --------------------------------------------------------------------------- filters
def vehicles_at_station(vehicles: DataFrame, station_id: int | None = None) -> DataFrame:
    """available vehicles at a station (all stations when no id is given)."""
    v = vehicles.where((F.col("Status") == "available") & F.col("CurrentStationID").isNotNull())
    if station_id is not None:
        v = v.where(F.col("CurrentStationID") == station_id)
    return v.select("CurrentStationID", "VehicleID", "Type", "Model", "Manufacturer", "RatePerHour", "Status")


def vehicles_at_station_by_name(details: DataFrame, stations: DataFrame,
                                station_id: int | None = None) -> DataFrame:
    """the by-name variant: view rows whose station name equals the station's name.

    Names are not unique, so a vehicle can match several stations of the same
    name; the join keeps every match (the reference's scalar subquery would
    fail on more than one row instead).
    """
    s = stations.select("StationID", F.col("Name").alias("s_name"))
    if station_id is not None:
        s = s.where(F.col("StationID") == station_id)
    d = details.where(F.col("Status") == "available")
    return s.join(d, s.s_name == d.CurrentStationName).select(
        "StationID", "VehicleID", "RegistrationNumber", "Type", "Model", "Manufacturer", "RatePerHour",
        "Status", "CurrentStationName",
    )


def user_rides(history: DataFrame, user_id: int | None = None, status: str | None = None,
               ordered: bool = True) -> DataFrame:
    """A user's trips, optional case-insensitive status filter, newest first."""
    h = history
    if user_id is not None:
        h = h.where(F.col("UserID") == user_id)
    if status:  # empty string means no filter
        h = h.where(_ci_equals("Status", status))
    if ordered:
        h = h.orderBy(F.col("StartTime").desc(), F.col("TripID").desc())
    return h


def authorised_reports(reports: DataFrame, trips: DataFrame) -> DataFrame:
    """flag reports that may proceed: admin, or the user holds an Ongoing trip on the vehicle."""
    ongoing = (
        trips.where(F.col("Status") == "Ongoing")
        .select(F.col("UserID").alias("o_user"), F.col("VehicleID").alias("o_vehicle"))
        .distinct()
        .withColumn("has_ongoing", F.lit(True))
    )
    r = reports.join(ongoing, (reports.UserID == ongoing.o_user) & (reports.VehicleID == ongoing.o_vehicle), "left")
    return r.select(
        *[reports[c] for c in reports.columns],
        (E.is_admin("user_role") | F.coalesce(F.col("has_ongoing"), F.lit(False))).alias("Authorised"),
    )


def users_by_email(users: DataFrame, plans: DataFrame, emails: DataFrame, email_col: str = "email") -> DataFrame:
    """the data half of login: user, plan and discount by (case-insensitive) email."""
    prof = user_profiles(users, plans)
    e = emails.select(F.col(email_col).alias("LookupEmail"))
    return e.join(prof, F.lower(e.LookupEmail) == F.lower(prof.Email)).select("LookupEmail", *prof.columns)


def reviewable_trips(trips: DataFrame) -> DataFrame:
    """F8: trips that may be reviewed."""
    return trips.where(F.col("Status") == "Completed")


def active_trip(history: DataFrame) -> DataFrame:
    """per user, the newest Ongoing trip (StartTime desc, TripID desc).

    Written as an aggregate (``max`` of a struct) rather than a window, so the
    choice is combined map-side and a user with a huge history is no hot task.
    """
    best = F.max(F.struct("StartTime", "TripID", "UserName", "VehicleType", "StartStation", "EndStation",
                          "EndTime", "Cost", "Status"))
    picked = history.where(F.col("Status") == "Ongoing").groupBy("UserID").agg(best.alias("t"))
    return picked.select("t.TripID", "UserID", "t.UserName", "t.VehicleType", "t.StartStation", "t.EndStation",
                         "t.StartTime", "t.EndTime", "t.Cost", "t.Status")


def open_assignments(assignments_view: DataFrame) -> DataFrame:
    """assignments whose maintenance log is not completed."""
    return assignments_view.where(F.col("LogStatus") != "Completed")


def decommissionable_vehicles(details: DataFrame) -> DataFrame:
    """vehicles that may be decommissioned (status available)."""
    return details.where(F.col("Status") == "available")


def deletable_technicians(technicians: DataFrame, assignments: DataFrame) -> DataFrame:
    """no active load and no assignment rows (the FK would block the delete)."""
    used = assignments.select("TechnicianID").distinct()
    return technicians.where(~(F.col("ActiveAssignments") > 0)).join(used, "TechnicianID", "left_anti")


PLAN_BLOCK = 1024


def affordable_plans(users: DataFrame, plans: DataFrame) -> DataFrame:
    """(user, plan) pairs where NOT(balance < cost); equality passes, a NULL balance gives no pair.

    A range join by sorted thresholds, for any number of plans: plans are ranked by cost; one sorted pass over plans and
    balances together tells how many plans each user can pay.  Those are the ranks up to that
    count, so the pairs come from equi joins on the rank.  A user's ranks are opened block by block.
    """
    u = users.where(F.col("WalletBalance").isNotNull()).select("UserID", "WalletBalance")
    p = plans.where(F.col("Cost").isNotNull()).select("PlanID", "PlanName", F.col("Cost").alias("PlanCost"))
    ranked = global_rank(p, ["PlanCost", "PlanID"], "__rank")
    both = u.select(F.col("WalletBalance").alias("__at"), F.lit(1).alias("__kind"), F.col("UserID").alias("__id")).unionByName(
        p.select(F.col("PlanCost").alias("__at"), F.lit(0).alias("__kind"), F.col("PlanID").alias("__id")))
    can = running_count(both, ["__at", "__kind", "__id"], F.col("__kind") == 0, "__can").where("__kind = 1 AND __can > 0")
    blocks = can.select(F.col("__id").alias("UserID"), F.col("__at").alias("WalletBalance"), "__can", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("__can") - 1) / PLAN_BLOCK))).alias("__block"))
    first = F.col("__block") * PLAN_BLOCK + 1
    ranks = blocks.repartition("UserID", "__block").select("UserID", "WalletBalance", F.explode(
        F.sequence(first, F.least(first + PLAN_BLOCK - 1, "__can"))).alias("__rank"))
    return ranks.join(ranked, "__rank").select("UserID", "WalletBalance", "PlanID", "PlanName", "PlanCost")


def users_without_plan(users: DataFrame) -> DataFrame:
    """users without a plan (sent to the membership page)."""
    return users.where(F.col("PlanID").isNull()).select("UserID", "Name", "Email", "WalletBalance")


# --------------------------------------------------------------------------- aggregates
def ride_counts(trips: DataFrame, users: DataFrame, vehicles: DataFrame, stations: DataFrame) -> DataFrame:
    """A3: rides per user (users with at least one ride), as many as the history (J3) lists.

    Only keys are read: the history's three inner joins become semi joins and its
    left join, which cannot change a count, goes.
    """
    def keys(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.select(F.col(col).alias(name))

    return (
        trips.select("UserID", "VehicleID", "StartStationID")
        .join(keys(users, "UserID", "UserID"), "UserID", "left_semi")
        .join(keys(vehicles, "VehicleID", "VehicleID"), "VehicleID", "left_semi")
        .join(keys(stations, "StationID", "StartStationID"), "StartStationID", "left_semi")
        .groupBy("UserID").agg(F.count(F.lit(1)).alias("TotalRides"))
    )


def _listed_vehicles(vehicles: DataFrame) -> DataFrame:
    """The rows of the vehicle list (J2) for counting: the station join cannot change
    the count (StationID is a key), so it is left out."""
    return vehicles.where(F.col("Status") != "decommissioned").select("Status")


def fleet_counts(stations: DataFrame, vehicles: DataFrame) -> DataFrame:
    """A2/A4: the dashboard's global figures as one row."""
    n_stations = stations.where(F.col("IsActive")).select(F.count(F.lit(1)).alias("TotalStations"))
    fleet = _listed_vehicles(vehicles).select(
        F.count(F.lit(1)).alias("TotalVehicles"),
        F.count_if(F.col("Status") == "available").alias("AvailableVehicles"),
    )
    return n_stations.select("TotalStations", fleet.select("TotalVehicles").scalar().alias("TotalVehicles"),
                             fleet.select("AvailableVehicles").scalar().alias("AvailableVehicles"))


def dashboard_kpis(stations: DataFrame, vehicles: DataFrame, trips: DataFrame, users: DataFrame) -> DataFrame:
    """A2: per user, the dashboard tiles; rides count is 0 for users without rides.

    The three global figures enter as scalar subqueries (computed once,
    broadcast as literals); rides are pre-aggregated per user before the join.
    """
    n_stations = stations.where(F.col("IsActive")).select(F.count(F.lit(1))).scalar()
    n_vehicles = _listed_vehicles(vehicles).select(F.count(F.lit(1))).scalar()
    n_available = _listed_vehicles(vehicles).select(F.count_if(F.col("Status") == "available")).scalar()
    rides = ride_counts(trips, users, vehicles, stations).withColumnRenamed("UserID", "r_user")
    u = users.select("UserID")
    return u.join(rides, u.UserID == rides.r_user, "left").select(
        "UserID",
        n_stations.alias("TotalStations"),
        n_vehicles.alias("TotalVehicles"),
        n_available.alias("AvailableVehicles"),
        F.coalesce(F.col("TotalRides"), F.lit(0).cast("bigint")).alias("TotalRides"),
    )


# --------------------------------------------------------------------------- order / top-n
def membership_plans_list(plans: DataFrame) -> DataFrame:
    """O2: plans by cost."""
    return plans.select("PlanID", "PlanName", "Cost", "DurationMonths", "Benefits").orderBy("Cost", "PlanID")


def technician_roster(technicians: DataFrame) -> DataFrame:
    """O3: technicians by name (case-insensitive), id as tie-break."""
    return technicians.orderBy(F.lower(F.col("Name")), F.col("TechnicianID"))


def assignments_by_date(assignments_view: DataFrame) -> DataFrame:
    """Assignment view, newest report first."""
    return assignments_view.orderBy(F.col("ReportedDate").desc(), F.col("AssignmentID").desc())


def recent_logs(logs: DataFrame, table: str | None = None, limit=None) -> DataFrame:
    """Newest audit rows, optionally of one table (case-insensitive).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each partition
    keeps its own top n, so only n rows per partition reach the final merge.
    """
    n = E.clamp_limit(limit)
    l = logs.select("LogID", "TableName", "OperationType", "RecordID", "ChangedBy", "ChangeDescription",
                    "ChangeTimestamp")
    if table:
        l = l.where(_ci_equals("TableName", table))
    return l.orderBy(F.col("ChangeTimestamp").desc(), F.col("LogID").desc()).limit(n)


def least_loaded_technician(technicians: DataFrame) -> DataFrame:
    """The available technician with the fewest assignments (id breaks ties)."""
    return (technicians.where(F.col("IsAvailable"))
            .orderBy(F.col("ActiveAssignments"), F.col("TechnicianID")).limit(1))


# --------------------------------------------------------------------------- scalar reports
def booking_quotes(requests: DataFrame, vehicles: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """Price every booking request against the current snapshot (no state change).

    Unknown vehicles have no rate (NULL cost); unknown users get no discount
    and no balance, so ``Affordable`` is NULL-safe false only when a balance exists.
    """
    v = vehicles.select(F.col("VehicleID").alias("v_id"), "RatePerHour", F.col("Status").alias("VehicleStatus"))
    prof = user_profiles(users, plans).select(F.col("UserID").alias("u_id"), "WalletBalance", "PlanDiscount")
    r = requests.join(v, requests.VehicleID == v.v_id, "left").join(prof, requests.UserID == prof.u_id, "left")
    discount = F.coalesce(F.col("PlanDiscount"), F.lit(E.NO_DISCOUNT).cast("decimal(5,2)"))
    cost = E.ride_cost("RatePerHour", "DurationHours", discount)
    return r.select(
        "RequestID", "UserID", "VehicleID", "DurationHours",
        discount.alias("Discount"),
        cost.alias("Cost"),
        E.expected_end("RequestTime", "DurationHours").alias("ExpectedEnd"),
        (~E.holds(F.col("WalletBalance") < cost)).alias("Affordable"),
    )


def vehicle_labels(details: DataFrame) -> DataFrame:
    """Display labels of the vehicle list."""
    return details.select(
        "VehicleID",
        E.vehicle_label("Manufacturer", "Type").alias("MakeAndType"),
        E.or_na("Model").alias("ModelLabel"),
        E.or_na("CurrentStationName").alias("StationLabel"),
    )


def wallet_texts(users: DataFrame) -> DataFrame:
    """Wallet balance as two-decimal text ('0.00' when missing)."""
    return users.select("UserID", E.money_text("WalletBalance").alias("WalletText"))


def password_digests(users: DataFrame) -> DataFrame:
    """SHA-256 hex digest of each stored password text."""
    return users.select("UserID", E.digest("Password").alias("PasswordDigest"))


def assignment_labels(assignments_view: DataFrame) -> DataFrame:
    """E15: 'Model (Registration)' label per assignment."""
    return assignments_view.select(
        "AssignmentID", E.assignment_vehicle_label("VehicleModel", "RegistrationNumber").alias("VehicleLabel")
    )
