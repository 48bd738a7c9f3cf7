"""Reports kept up from change rows == the reports from scratch, after every batch."""

import datetime
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from ridegrid.operators import incremental as I
from ridegrid.operators import quality as Q
from ridegrid.operators import views as V
from ridegrid.schemas import CONVENTIONAL_DOMAINS, ENUM_DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, not_null_columns

TABLES = ("stations", "vehicles", "users", "trips", "payments")
DAY = datetime.date(2024, 1, 1)
NOW = datetime.datetime(2024, 1, 1)


def random_row(rng, table, key):
    if table == "stations":
        return (key, f"s{key}", rng.choice(["L", "x" * 256]), 5, rng.random() < 0.7)
    if table == "vehicles":
        return (key, rng.choice(["R1", "r1", f"R{key}"]), "Car", "M", "X", Decimal("5.00"), rng.choice(["available", "available", "in-use", "lost"]),
                rng.choice([None, 1, 2, 3, 9]))
    if table == "users":
        return (key, rng.choice(["n", "n" * 101]), rng.choice([f"U{key % 3}@x", f"u{key}@x"]), "p", rng.choice(["user", "root"]), Decimal("1.00"), DAY, None)
    if table == "trips":
        return (key, rng.randint(1, 6), rng.randint(1, 6), rng.randint(1, 4), rng.choice([None, 2, 8]), NOW, None, Decimal("3.00"),
                rng.choice(["Ongoing", "Gone"]))
    return (key, rng.randint(1, 8), rng.randint(1, 6), Decimal("3.00"), NOW, rng.choice(["Success", "Nope"]))


def next_batch(rng, now):
    """Random inserts (also of keys that are there), updates and deletes; ``now`` (table -> rows) becomes the new state."""
    gone, come = {t: [] for t in TABLES}, {t: [] for t in TABLES}
    for t in TABLES:
        for row in rng.sample(now[t], min(len(now[t]), rng.randint(0, 3))):
            now[t].remove(row)
            gone[t].append(row)
            if rng.random() < 0.6:
                come[t].append(random_row(rng, t, row[0]))
        come[t] += [random_row(rng, t, rng.randint(1, 7)) for _ in range(rng.randint(0, 4))]
        now[t] += come[t]
    return gone, come


def frame(spark, table, rows):
    relaxed = SCHEMAS[table]
    return spark.createDataFrame(rows, relaxed, verifySchema=False) if rows else spark.createDataFrame([], relaxed)


def from_scratch(tables):
    parts = []
    for t, df in tables.items():
        key = PRIMARY_KEYS[t]
        dup = df.groupBy(key).count().where("count > 1")
        parts.append(dup.select(F.lit("primary_key").alias("Rule"), F.lit(t).alias("TableName"), F.concat(F.lit(f"{key}="), F.col(key).cast("string")).alias(
            "RecordKey"), F.concat(F.lit("count="), F.col("count").cast("string")).alias("Detail")))
        domains = {**ENUM_DOMAINS, **CONVENTIONAL_DOMAINS}
        parts.append(Q.row_violations(t, df, key, not_null_columns(t), {c: d for (x, c), d in domains.items() if x == t},
                                      {c: n for (x, c), n in MAX_LENGTHS.items() if x == t}))
        parts += [Q.unique_violations(t, df, cols, ci) for x, cols, ci in UNIQUE_KEYS if x == t]
        for child, col, parent, pcol in FOREIGN_KEYS:
            if child == t:
                keys = tables[parent].select(F.col(pcol).alias("__p")).distinct() if parent in tables else None
                some = df.where(F.col(col).isNotNull())
                lost = some if keys is None else some.join(keys, F.col(col) == F.col("__p"), "left_anti")
                parts.append(lost.select(F.lit("foreign_key").alias("Rule"), F.lit(t).alias("TableName"), F.concat(
                    F.lit(f"{key}="), F.col(key).cast("string")).alias("RecordKey"), F.concat(
                        F.lit(f"{col}="), F.col(col).cast("string"), F.lit(f" not in {parent}.{pcol}")).alias("Detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_reports_follow_change_batches(spark, tmp_path):
    rng = random.Random(1)
    quality, views = I.IncrementalQuality(spark, f"{tmp_path}/q"), I.IncrementalViews(spark, f"{tmp_path}/v")
    now = {t: [] for t in TABLES}
    for batch in range(3):
        gone, come = next_batch(rng, now)
        changes = {t: I.updated(frame(spark, t, gone[t]), frame(spark, t, come[t])) for t in TABLES}
        quality.apply(changes, batch)
        views.apply({t: changes[t] for t in ("stations", "vehicles", "trips", "users")}, batch)
        if batch == 1:  # a replayed batch changes nothing
            quality.apply(changes, batch)
            quality.fold(batch)
            views.fold(batch)
        tables = {t: frame(spark, t, now[t]) for t in TABLES}
        assert Counter(map(tuple, quality.report().collect())) == Counter(map(tuple, from_scratch(tables).collect())), batch
        got = Counter(map(tuple, views.station_availability().collect()))
        want = Counter(map(tuple, V.station_availability(tables["stations"].distinct(), tables["vehicles"]).collect()))
        assert got == want, batch


def test_batches_write_only_changed_keys(spark, tmp_path):
    store = I.CountStore(spark, f"{tmp_path}/c", "k int")
    store.add(I.appearing(spark.range(1000).select(F.col("id").cast("int").alias("k"))), 0)
    changed = store.add(I.appearing(spark.range(3).select(F.col("id").cast("int").alias("k"))).unionByName(
        I.going(spark.range(2, 4).select(F.col("id").cast("int").alias("k")))), 1)
    assert {r.k: (r.was, r.n) for r in changed.collect()} == {0: (1, 2), 1: (1, 2), 3: (1, 0)}
    assert spark.read.parquet(f"{tmp_path}/c").where("_version = 1").count() == 3
    assert store.read().count() == 999
    store.fold(1)
    assert store.read().count() == 999 and {r.n for r in store.read().where("k < 2").collect()} == {2}
    assert spark.read.parquet(f"{tmp_path}/c").select("_version").distinct().count() == 1
