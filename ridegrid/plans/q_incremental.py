"""Reports kept up from change batches; their oracles compute the same report from scratch on the final tables.

Two batches of changes are derived from the tables: the first breaks rules (parents go, values turn
invalid, keys collide), the second takes some of that back and moves vehicles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.operators import incremental as I
from ridegrid.plans import q_quality as QQ
from ridegrid.plans.registry import register
from ridegrid.schemas import CONVENTIONAL_DOMAINS, ENUM_DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, UNIQUE_KEYS, not_null_columns
from ridegrid.session import ensure_checkpoint_dir, remember
from ridegrid.sources.testdata import TestData

#: (table, rows concerned, column -> new value; None: the row goes) of the first batch, as SQL of both engines.
FIRST = [
    ("stations", "StationID % 13 = 4", None),
    ("users", "UserID % 40 = 9", {"Email": "NULL"}),
    ("vehicles", "VehicleID % 25 = 3", {"RegistrationNumber": "'KA-DUP'"}),
    ("vehicles", "VehicleID % 25 = 7", {"Status": "'parked'"}),
    ("trips", "TripID % 97 = 5", {"Status": "'Lost'"}),
    ("technicians", "TechnicianID % 6 = 1", None),
]
#: What the second batch takes back, and what it moves.
BACK = [("stations", "StationID % 26 = 4"), ("users", "UserID % 80 = 9"), ("vehicles", "VehicleID % 50 = 3"), ("trips", "TripID % 194 = 5")]
MOVED = ("vehicles", "VehicleID % 25 = 12", {"Status": "'available'", "CurrentStationID": "CAST(1 + VehicleID % 7 AS INT)"})


def _set(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(values[c]).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def batches(td: TestData, tables: list[str]) -> list[dict[str, DataFrame]]:
    """Change rows per batch: the tables themselves, then ``FIRST``, then ``BACK`` and ``MOVED``."""
    first: dict[str, DataFrame] = {}
    second: dict[str, DataFrame] = {}

    def put(batch: dict[str, DataFrame], table: str, rows: DataFrame) -> None:
        batch[table] = batch[table].unionByName(rows) if table in batch else rows

    for table, which, values in FIRST:
        old = td.table(table).where(which)
        put(first, table, I.going(old) if values is None else I.updated(old, _set(old, values)))
    changed = {(t, w): v for t, w, v in FIRST}
    for table, which in BACK:
        values = next(v for (t, w), v in changed.items() if t == table)
        old = td.table(table).where(which)
        put(second, table, I.appearing(old) if values is None else I.updated(_set(old, values), old))
    table, which, values = MOVED
    old = td.table(table).where(which)
    put(second, table, I.updated(old, _set(old, values)))
    opening = {t: I.appearing(td.table(t)) for t in tables}
    return [opening, *({t: df for t, df in b.items() if t in tables} for b in (first, second))]


def _workdir(td: TestData, label: str) -> str:
    return remember(f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/ridegrid-{label}-{uuid.uuid4().hex}")


def _now(table: str) -> str:
    """The table after both batches, in SQL."""
    cases: dict[str, list[str]] = {}
    goes = []
    for t, which, values in FIRST:
        if t != table:
            continue
        back = next((w for bt, w in BACK if bt == t and w.split(" = ")[1] == which.split(" = ")[1]), "false")
        if values is None:
            goes.append(f"({which} AND NOT ({back}))")
        for c, v in (values or {}).items():
            cases.setdefault(c, []).append(f"WHEN {which} AND NOT ({back}) THEN {v}")
    if table == MOVED[0]:
        for c, v in MOVED[2].items():
            cases.setdefault(c, []).append(f"WHEN {MOVED[1]} THEN {v}")
    replaced = ", ".join(f"CASE {' '.join(w)} ELSE {c} END AS {c}" for c, w in cases.items())
    return (f"SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM {table}"
            + (f" WHERE NOT ({' OR '.join(goes)})" if goes else ""))


ALL = list(PRIMARY_KEYS)
RULES_SQL = QQ._u(
    [QQ._pk_sql(t, pk) for t, pk in PRIMARY_KEYS.items()] + [QQ._unique_sql(t, t, cols, ci) for t, cols, ci in UNIQUE_KEYS]
    + [QQ._nn_sql(t, not_null_columns(t), PRIMARY_KEYS[t]) for t in PRIMARY_KEYS]
    + [QQ._fk_sql(c, cc, p, pc, PRIMARY_KEYS[c]) for c, cc, p, pc in FOREIGN_KEYS]
    + [QQ._domain_sql(t, c, d, PRIMARY_KEYS[t]) for (t, c), d in {**ENUM_DOMAINS, **CONVENTIONAL_DOMAINS}.items()]
    + [QQ._length_sql(t, c, n, PRIMARY_KEYS[t]) for (t, c), n in MAX_LENGTHS.items()])


def _after(tables: list[str], body: str) -> tuple[str, list[tuple[str, str]]]:
    """``body`` over the tables after both batches."""
    own = ", ".join(f"{t} AS (SELECT * FROM {t}_now)" for t in tables)
    return f"SELECT * FROM (WITH {own} {body}) x", [(f"{t}_now", _now(t)) for t in tables]


@register("dq_incremental", *_after(ALL, RULES_SQL))
def dq_incremental(td: TestData):
    """Violations of the declared constraints, kept up over three batches of change rows."""
    kept = I.IncrementalQuality(td.spark, _workdir(td, "dq"))
    for i, changes in enumerate(batches(td, ALL)):
        kept.apply(changes, i)
    return kept.report()


VIEWED = ["stations", "vehicles", "trips", "users"]


def _views(td: TestData) -> I.IncrementalViews:
    kept = I.IncrementalViews(td.spark, _workdir(td, "views"))
    for i, changes in enumerate(batches(td, VIEWED)):
        kept.apply(changes, i)
    return kept


@register("station_availability_incremental", *_after(VIEWED, """
SELECT StationID, Name, Location, Capacity,
  (SELECT count(*) FROM vehicles WHERE CurrentStationID = stations.StationID AND Status = 'available') AS AvailableVehicles
FROM stations WHERE IsActive"""))
def station_availability_incremental(td: TestData):
    """J1 kept up from change rows of stations and vehicles."""
    return _views(td).station_availability()


@register("dashboard_kpis_incremental", *_after(VIEWED, """
SELECT u.UserID, (SELECT count(*) FROM stations WHERE IsActive) AS TotalStations,
  (SELECT count(*) FROM vehicles WHERE Status <> 'decommissioned') AS TotalVehicles,
  (SELECT count(*) FROM vehicles WHERE Status = 'available') AS AvailableVehicles, coalesce(t.n, 0) AS TotalRides
FROM users u LEFT JOIN (SELECT UserID, count(*) AS n FROM trips GROUP BY UserID) t ON t.UserID = u.UserID"""))
def dashboard_kpis_incremental(td: TestData):
    """A2/A3 kept up from change rows of stations, vehicles, trips and users."""
    return _views(td).dashboard()
