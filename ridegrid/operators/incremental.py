"""Reports kept up from change rows: counted key state with retractions.

A change batch of a table is its rows with a ``Sign``: +1 for a row that
appears, -1 for one that goes; an update is both.  ``CountStore`` keeps how often
each key occurs.  A batch writes only the keys whose count it changes, under its own
version (a replayed batch rewrites its own version and nothing else);
readers take the newest count per key; ``fold`` rewrites the store as one base version.

* ``IncrementalQuality``: the declared constraints.  Primary and unique keys are counts above one.
  Row rules (not null, domain, length) are counted violation rows.  References are kept from both
  sides, as counts of children and of parents per value; only values that a batch
  touches are judged again, so a deleted parent makes its children orphans and a new one clears them.
* ``IncrementalViews``: station availability and the dashboard's figures as counts; a vehicle that
  moves leaves one station's count and joins another's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridegrid.operators import quality as Q
from ridegrid.schemas import CONVENTIONAL_DOMAINS, ENUM_DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, UNIQUE_KEYS, not_null_columns
from ridegrid.session import materialize
from ridegrid.sources.sinks import VERSION, drop_snapshots, write_snapshot

SIGN = "Sign"


def appearing(df: DataFrame) -> DataFrame:
    return df.withColumn(SIGN, F.lit(1))


def going(df: DataFrame) -> DataFrame:
    return df.withColumn(SIGN, F.lit(-1))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows of an update: the rows as they were and as they are."""
    return going(old).unionByName(appearing(new))


class CountStore:
    """How often each key occurs; one Parquet folder of changed keys per batch."""

    def __init__(self, spark: SparkSession, path: str, keys: str):
        """``keys``: columns and types, as in a schema string."""
        self.spark, self.path, self.schema = spark, path, f"{keys}, n long"
        self.keys = [c.strip().split()[0] for c in keys.split(",")]

    def _rows(self, before: int | None = None) -> DataFrame:
        from ridegrid.streaming.streams import _exists

        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{self.schema}, {VERSION} long")
        rows = self.spark.read.schema(f"{self.schema}, {VERSION} long").parquet(self.path)
        return rows if before is None else rows.where(F.col(VERSION) < before)

    def _begun(self, before: int) -> bool:
        """Whether there is a version under ``before``."""
        from ridegrid.streaming.streams import _exists

        return _exists(self.spark, self.path) and not self._rows(before).isEmpty()

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.max_by("n", VERSION).alias("n")).where("n <> 0")

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """Keys and counts; with ``of`` only those of these keys."""
        rows = self._rows()
        return self._newest(rows if of is None else self._only(rows, of))

    def _only(self, rows: DataFrame, of: DataFrame) -> DataFrame:
        shared = [c for c in self.keys if c in of.columns]
        some = of.select(*(F.col(c).alias(f"__{c}") for c in shared)).distinct()
        match = None
        for c in shared:
            one = F.col(c).eqNullSafe(F.col(f"__{c}"))
            match = one if match is None else match & one
        return rows.join(some, match, "left_semi")

    def add(self, deltas: DataFrame, batch: int) -> DataFrame:
        """Apply ``deltas`` (keys and Sign) as a batch; returns the keys whose count changed, with ``n`` and ``was``."""
        moved = deltas.groupBy(*self.keys).agg(F.sum(SIGN).alias("d")).where("d <> 0")
        if not self._begun(batch):  # no counts before: the deltas are the counts, written once
            write_snapshot(moved.withColumnRenamed("d", "n"), self.path, batch)
            return self._rows().where(F.col(VERSION) == batch).select(*self.keys, "n", F.lit(0).cast("long").alias("was"))
        moved = materialize(moved, "count-deltas")
        old = self._newest(self._only(self._rows(batch), moved)).select(*(F.col(c).alias(f"__{c}") for c in self.keys), F.col("n").alias("was"))
        match = None
        for c in self.keys:
            one = F.col(c).eqNullSafe(F.col(f"__{c}"))
            match = one if match is None else match & one
        now = materialize(moved.join(old, match, "left").select(
            *self.keys, (F.coalesce("was", F.lit(0)) + F.col("d")).alias("n"), F.coalesce("was", F.lit(0)).alias("was")), "count-changed")
        write_snapshot(now.drop("was"), self.path, batch)
        return now

    def fold(self, batch: int) -> None:
        """Rewrite the store, as of ``batch``, as its one version."""
        whole = materialize(self._newest(self._rows(batch + 1)), "count-folded")
        write_snapshot(whole, self.path, batch)
        drop_snapshots(self.spark, self.path, batch)


def _record(key: str):
    return F.concat(F.lit(f"{key}="), F.col(key).cast("string"))


class IncrementalQuality:
    """Violations of the declared constraints, kept up batch by batch under ``workdir``."""

    def __init__(self, spark: SparkSession, workdir: str):
        def store(name: str, keys: str) -> CountStore:
            return CountStore(spark, f"{workdir}/{name}", keys)

        self.keys = store("keys", "Rule string, TableName string, RecordKey string")
        self.rows = store("rows", "Rule string, TableName string, RecordKey string, Detail string")
        self.children = store("children", "Parent string, Value long, TableName string, RecordKey string, Detail string")
        self.parents = store("parents", "Parent string, Value long")
        self.orphans = store("orphans", "Parent string, Value long")

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @staticmethod
    def _keys_of(table: str, rows: DataFrame) -> list[DataFrame]:
        key = PRIMARY_KEYS[table]
        out = [rows.select(F.lit("primary_key").alias("Rule"), F.lit(table).alias("TableName"), _record(key).alias("RecordKey"), SIGN)]
        for name, cols, loose in UNIQUE_KEYS:
            if name == table:
                present = rows.dropna(subset=list(cols))
                text = [F.concat(F.lit(f"{c}="), (F.lower(c) if loose else F.col(c)).cast("string")) for c in cols]
                out.append(present.select(F.lit("unique").alias("Rule"), F.lit(table).alias("TableName"), F.concat_ws(",", *text).alias("RecordKey"), SIGN))
        return out

    @staticmethod
    def _broken_rows(table: str, rows: DataFrame) -> DataFrame:
        domains = {**ENUM_DOMAINS, **CONVENTIONAL_DOMAINS}
        rules = {"not_null": not_null_columns(table), "domains": {c: d for (t, c), d in domains.items() if t == table},
                 "lengths": {c: n for (t, c), n in MAX_LENGTHS.items() if t == table}}
        parts = [Q.row_violations(table, rows.where(F.col(SIGN) == sign), PRIMARY_KEYS[table], **rules).withColumn(SIGN, F.lit(sign))
                 for sign in (1, -1)]
        return parts[0].unionByName(parts[1])

    @staticmethod
    def _references(table: str, rows: DataFrame) -> DataFrame | None:
        own = [(col, parent, pcol) for child, col, parent, pcol in FOREIGN_KEYS if child == table]
        if not own:
            return None
        each = F.explode(F.array(*[F.struct(
            F.lit(parent).alias("Parent"), F.col(col).cast("long").alias("Value"),
            F.concat(F.lit(f"{col}="), F.col(col).cast("string"), F.lit(f" not in {parent}.{pcol}")).alias("Detail")) for col, parent, pcol in own]))
        refs = rows.select(F.lit(table).alias("TableName"), _record(PRIMARY_KEYS[table]).alias("RecordKey"), SIGN, each.alias("r"))
        return refs.select("r.Parent", "r.Value", "TableName", "RecordKey", "r.Detail", SIGN).where(F.col("Value").isNotNull())

    def apply(self, changes: dict[str, DataFrame], batch: int) -> None:
        """Take in one batch of change rows (table -> rows with ``Sign``)."""
        changes = {t: materialize(df, "dq-changes") for t, df in changes.items()}
        self.keys.add(self._union([k for t, df in changes.items() for k in self._keys_of(t, df)]), batch)
        self.rows.add(self._union([self._broken_rows(t, df) for t, df in changes.items()]), batch)
        refs = [r for t, df in changes.items() if (r := self._references(t, df)) is not None]
        touched = []
        if refs:
            touched.append(self.children.add(self._union(refs), batch).select("Parent", "Value"))
        referred = {parent: pcol for _, _, parent, pcol in FOREIGN_KEYS}
        own = [df.select(F.lit(t).alias("Parent"), F.col(referred[t]).cast("long").alias("Value"), SIGN) for t, df in changes.items() if t in referred]
        if own:
            moved = self.parents.add(self._union(own), batch)
            touched.append(moved.where((F.col("n") > 0) != (F.col("was") > 0)).select("Parent", "Value"))
        if touched:
            self._judge(self._union(touched).distinct(), batch)

    def _judge(self, touched: DataFrame, batch: int) -> None:
        """Which of the touched values are referred to without being there."""
        touched = materialize(touched, "dq-touched")
        used = self.children.read(touched).select("Parent", "Value").distinct()
        orphan = used.join(self.parents.read(touched).select("Parent", "Value"), ["Parent", "Value"], "left_anti")
        was = self.orphans._newest(self.orphans._only(self.orphans._rows(batch), touched)).select("Parent", "Value")
        self.orphans.add(appearing(orphan).unionByName(going(was)), batch)

    def fold(self, batch: int) -> None:
        for store in (self.keys, self.rows, self.children, self.parents, self.orphans):
            store.fold(batch)

    def report(self) -> DataFrame:
        """(Rule, TableName, RecordKey, Detail) of every violation as of the last batch."""
        twice = self.keys.read().where("n > 1").select("Rule", "TableName", "RecordKey", F.concat(F.lit("count="), F.col("n").cast("string")).alias("Detail"))
        rows = self.rows.read().select("Rule", "TableName", "RecordKey", "Detail", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
        orphans = self.orphans.read().select("Parent", "Value")
        lost = self.children.read(orphans).select(F.lit("foreign_key").alias("Rule"), "TableName", "RecordKey", "Detail", F.explode(
            F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
        return self._union([twice, rows, lost])


class IncrementalViews:
    """Station availability (J1) and dashboard figures (A2, A3) as counts under ``workdir``."""

    def __init__(self, spark: SparkSession, workdir: str):
        self.spark = spark
        self.figures = CountStore(spark, f"{workdir}/figures", "Figure string, Key int")
        self.stations = CountStore(spark, f"{workdir}/stations", "StationID int, Name string, Location string, Capacity int, IsActive boolean")

    def apply(self, changes: dict[str, DataFrame], batch: int) -> None:
        """Change rows of stations, vehicles, trips and users, as far as given."""
        none = F.lit(None).cast("int")
        parts = []

        def add(df: DataFrame, figure: str, key=none) -> None:
            parts.append(df.select(F.lit(figure).alias("Figure"), key.alias("Key"), SIGN))

        if "vehicles" in changes:
            v = changes["vehicles"]
            add(v.where("Status = 'available'"), "at_station", F.col("CurrentStationID"))
            add(v.where("Status = 'available'"), "available")
            add(v.where("Status <> 'decommissioned'"), "fleet")
        if "trips" in changes:
            add(changes["trips"], "rides", F.col("UserID"))
        if "users" in changes:
            add(changes["users"], "user", F.col("UserID"))
        if "stations" in changes:
            add(changes["stations"].where("IsActive"), "active_stations")
            self.stations.add(changes["stations"].select(*self.stations.keys, SIGN), batch)
        if parts:
            self.figures.add(IncrementalQuality._union(parts), batch)

    def fold(self, batch: int) -> None:
        self.figures.fold(batch)
        self.stations.fold(batch)

    def station_availability(self) -> DataFrame:
        here = self.figures.read().where("Figure = 'at_station'").select(F.col("Key").alias("__s"), "n")
        s = self.stations.read().drop("n").where("IsActive")
        return s.join(here, F.col("StationID") == F.col("__s"), "left").select(
            "StationID", "Name", "Location", "Capacity", F.coalesce("n", F.lit(0)).cast("long").alias("AvailableVehicles"))

    def dashboard(self) -> DataFrame:
        f = self.figures.read()
        one = f.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("Figure") == name, F.col("n"))), F.lit(0)).alias(col) for name, col in (
            ("active_stations", "TotalStations"), ("fleet", "TotalVehicles"), ("available", "AvailableVehicles"))))
        users = f.where("Figure = 'user'").select(F.col("Key").alias("UserID"))
        rides = f.where("Figure = 'rides'").select(F.col("Key").alias("__u"), F.col("n").alias("__rides"))
        return users.join(rides, F.col("UserID") == F.col("__u"), "left").crossJoin(F.broadcast(one)).select(  # one row
            "UserID", "TotalStations", "TotalVehicles", "AvailableVehicles", F.coalesce("__rides", F.lit(0)).cast("long").alias("TotalRides"))
