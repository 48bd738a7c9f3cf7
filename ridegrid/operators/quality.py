"""Data-quality operators: the declared constraints turned into violation reports.

Each rule returns rows ``(Rule, TableName, RecordKey, Detail)`` (all strings);
``dq_report`` unions them.  Every rule is one scan (plus one shuffle for key
rules): duplicates are found by an aggregate with map-side combine, foreign
keys by a ``left_anti`` join against the parent's key column, so a hot key
costs one partial-aggregate row per task, not a hot task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridegrid.schemas import (
    CONVENTIONAL_DOMAINS,
    ENUM_DOMAINS,
    FOREIGN_KEYS,
    MAX_LENGTHS,
    PRIMARY_KEYS,
    UNIQUE_KEYS,
    not_null_columns,
)

REPORT_COLUMNS = ("Rule", "TableName", "RecordKey", "Detail")


def _out(df: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("Rule"), F.lit(table).alias("TableName"),
        key.cast("string").alias("RecordKey"), detail.cast("string").alias("Detail"),
    )


def _keyed(key_col: str) -> Column:
    return F.concat(F.lit(f"{key_col}="), F.col(key_col).cast("string"))


def unique_violations(table: str, df: DataFrame, cols: tuple[str, ...], case_insensitive: bool) -> DataFrame:
    """Unique keys (text compared case-insensitively where the collation is)."""
    keys = [F.lower(F.col(c)).alias(c) if case_insensitive else F.col(c) for c in cols]
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    dup = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    key = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols])
    return _out(dup, "unique", table, key, F.concat(F.lit("count="), F.col("n").cast("string")))


def row_violations(table: str, df: DataFrame, key_col: str, not_null: list[str] = (), domains: dict | None = None,
                   lengths: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """All rules that look at one row (C3, C5, C7), in one pass over the table.

    ``domains``: column -> allowed values (NULL is the NOT NULL rule's business);
    ``lengths``: column -> VARCHAR limit; ``ranges``: column of integer text -> (lo, hi).
    """
    checks = [("not_null", F.col(c).isNull(), F.lit(c)) for c in not_null]
    for c, values in (domains or {}).items():
        checks.append(("domain", ~F.col(c).isin(*values), F.concat(F.lit(f"{c}="), F.col(c))))
    for c, n in (lengths or {}).items():
        checks.append(("length", F.length(c) > n,
                       F.concat(F.lit(f"{c} length "), F.length(c).cast("string"), F.lit(f" > {n}"))))
    for c, (lo, hi) in (ranges or {}).items():
        v = F.trim(F.col(c)).try_cast("int")
        checks.append(("range", v.isNull() | (v < lo) | (v > hi),
                       F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("NULL")))))
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(rule).alias("Rule"), detail.cast("string").alias("Detail")))
                               for rule, cond, detail in checks]), lambda x: x.isNotNull())
    rows = df.select(_keyed(key_col).alias("RecordKey"), F.explode(found).alias("v"))
    return rows.select("v.Rule", F.lit(table).alias("TableName"), "RecordKey", "v.Detail")


# ------------------------------------------------------------------ request feed rules
# Which request columns are written into which constrained column.
FEED_FOREIGN_KEYS = [
    ("booking_requests", "UserID", "users", "UserID"),
    ("booking_requests", "VehicleID", "vehicles", "VehicleID"),
    ("booking_requests", "StartStationID", "stations", "StationID"),
    ("end_requests", "EndStationID", "stations", "StationID"),
    ("cancel_requests", "TripID", "trips", "TripID"),
    ("review_requests", "TripID", "trips", "TripID"),
    ("report_requests", "VehicleID", "vehicles", "VehicleID"),
    ("topup_requests", "UserID", "users", "UserID"),
    ("purchase_requests", "UserID", "users", "UserID"),
    ("purchase_requests", "PlanID", "membership_plans", "PlanID"),
    ("complete_requests", "LogID", "maintenance_logs", "LogID"),
]
FEED_NOT_NULL = {
    "report_requests": ["UserID", "VehicleID", "IssueReported"],
    "register_requests": ["name", "email", "password"],
    "booking_requests": ["UserID", "VehicleID", "StartStationID", "DurationHours"],
}
FEED_LENGTHS = [("register_requests", "name", 100), ("register_requests", "email", 100)]
FEED_RANGES = [("review_requests", "rating", 1, 5)]
# Dirty copies of clean tables: (name, key column, the table whose rules hold).
IMPORTS = [("imported_users", "UserID", "users")]
FEEDS = ("redelivered_requests",
         "booking_requests", "end_requests", "cancel_requests", "topup_requests", "report_requests",
         "register_requests", "purchase_requests", "review_requests", "complete_requests")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dq_pk(td) -> DataFrame:
    """C1 over every table and feed with one shuffle: (table, key) pairs counted together."""
    sources = [(t, td.table(t), pk) for t, pk in PRIMARY_KEYS.items()] + [(f, td.table(f), "RequestID") for f in FEEDS]
    keys = _union([df.select(F.lit(t).alias("__t"), F.lit(pk).alias("__c"), F.col(pk).cast("long").alias("__v"))
                   for t, df, pk in sources])
    dup = keys.groupBy("__t", "__c", "__v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.select(F.lit("primary_key").alias("Rule"), F.col("__t").alias("TableName"),
                      F.concat(F.col("__c"), F.lit("="), F.col("__v").cast("string")).alias("RecordKey"),
                      F.concat(F.lit("count="), F.col("n").cast("string")).alias("Detail"))


def _email_candidates(td) -> DataFrame:
    """Existing e-mails plus requested ones: a duplicate here is a rejected registration."""
    existing = td.users().select(F.col("Email"))
    requested = td.register_requests().select(F.col("email").alias("Email"))
    return existing.unionByName(requested)


def dq_unique(td) -> DataFrame:
    parts = [unique_violations(t, td.table(t), cols, ci) for t, cols, ci in UNIQUE_KEYS]
    parts.append(unique_violations("users+register_requests", _email_candidates(td), ("Email",), True))
    return _union(parts)


def _row_rules(td, families: tuple[str, ...]) -> DataFrame:
    """The row rules of the named families over every table, feed and import; each is scanned once."""
    parts = []

    def add(name: str, key: str, rules: dict) -> None:
        wanted = {k: v for k, v in rules.items() if v and k in families}
        if wanted:
            parts.append(row_violations(name, td.table(name), key, **wanted))

    domains = {**ENUM_DOMAINS, **CONVENTIONAL_DOMAINS}

    def declared(table: str, columns: set[str] | None = None) -> dict:
        def has(c: str) -> bool:
            return columns is None or c in columns

        return {
            "not_null": [c for c in not_null_columns(table) if has(c)],
            "domains": {c: d for (t, c), d in domains.items() if t == table and has(c)},
            "lengths": {c: n for (t, c), n in MAX_LENGTHS.items() if t == table and has(c)},
        }

    for table, key in PRIMARY_KEYS.items():
        add(table, key, declared(table))
    for name, key, like in IMPORTS:
        add(name, key, declared(like, set(td.table(name).columns)))
    for feed in FEEDS:
        add(feed, "RequestID", {
            "not_null": FEED_NOT_NULL.get(feed, []),
            "lengths": {c: n for f, c, n in FEED_LENGTHS if f == feed},
            "ranges": {c: (lo, hi) for f, c, lo, hi in FEED_RANGES if f == feed},
        })
    return _union(parts)


def dq_not_null(td) -> DataFrame:
    return _row_rules(td, ("not_null",))


def dq_fk(td) -> DataFrame:
    """C4 for all 25 references with one anti join.

    A child table's foreign-key columns become (Parent, Value) reference rows,
    all parents' keys one key set.  The distinct references are
    anti-joined with it; what is left, usually little, is joined back.
    """
    by_child: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
    for child, col, parent, pcol in FOREIGN_KEYS:
        by_child.setdefault((child, PRIMARY_KEYS[child]), []).append((col, parent, pcol))
    for child, col, parent, pcol in FEED_FOREIGN_KEYS:
        by_child.setdefault((child, "RequestID"), []).append((col, parent, pcol))
    # References travel as numbers (rule, parent, key, value); their texts are made for the orphans alone.
    parents = sorted({(parent, pcol) for fks in by_child.values() for _, parent, pcol in fks})
    at = {p: i for i, p in enumerate(parents)}
    refs, texts = [], []
    for (child, key), fks in by_child.items():
        each = []
        for col, parent, pcol in fks:
            each.append(F.struct(F.lit(len(texts)).alias("Fk"), F.lit(at[parent, pcol]).alias("Parent"), F.col(col).cast("long").alias("Value")))
            texts.append((child, f"{key}=", f"{col}=", f" not in {parent}.{pcol}"))
        refs.append(td.table(child).select(F.col(key).cast("long").alias("Key"), F.explode(F.array(*each)).alias("r")))
    keys = _union([td.table(p).select(F.lit(i).alias("Parent"), F.col(pc).cast("long").alias("Value"))
                   for (p, pc), i in at.items()])
    r = _union(refs).select("Key", "r.*").where(F.col("Value").isNotNull())
    # Distinct references first (combined map-side: a common value is one row per task), then the
    # few dangling ones back to their rows.
    dangling = r.select("Parent", "Value").distinct().join(keys, ["Parent", "Value"], "left_anti")
    orphans = r.join(dangling, ["Parent", "Value"], "left_semi")

    def text(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(t[i]) for t in texts]), F.col("Fk") + 1)

    return orphans.select(F.lit("foreign_key").alias("Rule"), text(0).alias("TableName"),
                          F.concat(text(1), F.col("Key").cast("string")).alias("RecordKey"),
                          F.concat(text(2), F.col("Value").cast("string"), text(3)).alias("Detail"))


def dq_enum(td) -> DataFrame:
    return _row_rules(td, ("domains", "ranges"))


def dq_length(td) -> DataFrame:
    return _row_rules(td, ("lengths",))


def dq_report(td) -> DataFrame:
    """All rules in one result: one pass per table for the row rules, one shuffle for keys, one for references."""
    return _union([dq_pk(td), dq_unique(td), _row_rules(td, ("not_null", "domains", "lengths", "ranges")), dq_fk(td)])
